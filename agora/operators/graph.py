"""User-interaction graph: nodes, weighted edges, PageRank, degree,
connected components and the top-n induced subgraph.

The graph is two DataFrames, ``nodes(node, ...)`` and
``edges(src, dst, weight)``; iterative kernels run as a driver loop of
set-based steps whose state is persisted and periodically written to the
session's reliable checkpoint folder.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.functions.lookups import expertise_rank, medal_boost
from agora.session import cut_lineage


# ----------------------------------------------------------------- G3 / G4
def recency_factor(ts: Column, reference_date: str, floor: float = K.RECENCY_FLOOR) -> Column:
    """max(floor, 1 - days/365); days = floor of the elapsed time in days
    (negative for comments after the reference date)."""
    # wall-clock difference (time zone stripped, as the source data is):
    # whole days between the dates plus the time-of-day difference, so no
    # session time zone or daylight-saving shift enters the count
    ts = ts.cast("timestamp_ntz")
    ref = F.to_timestamp_ntz(F.lit(reference_date))

    def tod_us(c):
        return (F.hour(c) * 3600 + F.minute(c) * 60).cast("double") * 1e6 + F.date_part(
            F.lit("SECOND"), c).cast("double") * 1e6

    elapsed_us = (F.unix_date(ref.cast("date")) - F.unix_date(ts.cast("date"))).cast("double") * 86_400_000_000.0 \
        + (tod_us(ref) - tod_us(ts))
    days = F.floor(elapsed_us / F.lit(86_400_000_000.0))
    return F.greatest(F.lit(floor), F.lit(1.0) - days / F.lit(365.0))


def interaction_weight(c_votes, c_app, c_medal, p_medal, c_exp, p_exp, c_ts, reference_date) -> Column:
    appreciation = F.when(F.coalesce(c_app, F.lit(False)), F.lit(K.APPRECIATION_BOOST)).otherwise(
        F.lit(K.NON_APPRECIATION_BOOST)
    )
    medal = (medal_boost(c_medal) + medal_boost(p_medal)) / F.lit(2.0)
    expertise = (expertise_rank(c_exp) + expertise_rank(p_exp)) / F.lit(2.0)
    return (
        (F.lit(1.0) + c_votes)
        * appreciation
        * medal
        * expertise
        * recency_factor(c_ts, reference_date)
    )


def first_discussions(discussions: DataFrame) -> DataFrame:
    """The first row, in load order, of every discussion id."""
    fields = [c for c in discussions.columns if c != "id"]
    if "load_order" not in fields:
        return discussions.dropDuplicates(["id"])
    return discussions.groupBy("id").agg(F.min_by(F.struct(*fields), "load_order").alias("r")).select("id", "r.*")


def interactions(discussions: DataFrame, comments: DataFrame, reference_date: str, missing: str = "error") -> DataFrame:
    """One weighted interaction per non-deleted comment: commenter -> author.

    The comment -> discussion lookup (J1) is an equi-join on the discussion
    key with the first discussion of that id; both sides shuffle on that key
    once.  A comment whose discussion is missing fails the query, without a
    job of its own; ``missing="skip"`` leaves such comments out (see
    ``orphan_comments``)."""
    if missing not in ("error", "skip"):
        raise ValueError(missing)
    needed = [c for c in ("id", "user", "medal", "expertise", "load_order") if c in discussions.columns]
    d = first_discussions(discussions.select(*needed)).select(
        F.col("id").alias("d_id"),
        F.col("user").alias("author"),
        F.col("medal").alias("p_medal"),
        F.col("expertise").alias("p_expertise"),
    )
    c = comments.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    j = c.join(d, c.discussion_id == d.d_id, "left" if missing == "error" else "inner")
    lost = F.raise_error(F.concat(F.lit("no discussion has the id of a comment: "), F.coalesce(F.col("discussion_id").cast("string"), F.lit("null"))))
    return j.select(
        F.col("user").alias("src"),
        (F.when(F.col("d_id").isNull(), lost).otherwise(F.col("author")) if missing == "error" else F.col("author")).alias("dst"),
        interaction_weight(
            F.col("votes"), F.col("is_appreciation"), F.col("medal"), F.col("p_medal"),
            F.col("expertise"), F.col("p_expertise"), F.col("datetime"), reference_date,
        ).alias("weight"),
    )


def orphan_comments(discussions: DataFrame, comments: DataFrame) -> DataFrame:
    """Audit for J1: non-deleted comments whose discussion is missing."""
    c = comments.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    return c.join(discussions.select(F.col("id").alias("discussion_id")), "discussion_id", "left_anti")


# ----------------------------------------------------------------------- G5
def aggregate_edges(interactions_df: DataFrame) -> DataFrame:
    """Parallel edges summed per (src, dst); self-loops and non-positive
    weights kept.  Partial aggregation runs map-side, so a hot pair costs
    one row per map task in the shuffle."""
    return interactions_df.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


# ------------------------------------------------------------------- G1 / G2
def author_nodes(discussions: DataFrame) -> DataFrame:
    """One node per author with the attributes of the author's *last*
    discussion (by load order); ``first_order`` is the insertion position."""
    attrs = F.struct(
        F.col("medal"), F.col("expertise"), F.col("votes"), F.col("n_comments"),
        F.col("n_appreciation_comments"),
    )
    g = discussions.groupBy(F.col("user").alias("node")).agg(
        F.max_by(attrs, F.col("load_order")).alias("a"),
        F.min("load_order").alias("first_order"),
    )
    return g.select(
        "node",
        F.col("a.medal").alias("medal"),
        F.col("a.expertise").alias("expertise"),
        F.lit(1).cast("long").alias("n_posts"),
        F.col("a.votes").cast("long").alias("total_post_votes"),
        F.col("a.n_comments").cast("long").alias("n_comments"),
        F.col("a.n_appreciation_comments").cast("long").alias("n_appreciations"),
        F.lit(0).alias("kind"),
        F.struct(
            F.col("first_order").alias("k1"), F.lit(0).cast("long").alias("k2"),
            F.lit(0).cast("long").alias("k3"), F.lit(0).cast("long").alias("k4"),
            F.lit(0.0).alias("k5"),
        ).alias("node_order"),
    )


def commenter_nodes(discussions: DataFrame, comments: DataFrame) -> DataFrame:
    """Users who only comment: attributes of their *first* non-deleted
    comment, inserted after all authors (authors' attributes win)."""
    c = comments.where(~F.coalesce(F.col("is_deleted"), F.lit(False)))
    attrs = F.struct(F.col("medal"), F.col("expertise"), F.col("votes"), F.col("is_appreciation"))
    g = c.groupBy(F.col("user").alias("node")).agg(
        F.min_by(attrs, F.col("c_order")).alias("a"),
        F.min("c_order").alias("node_order"),
    )
    authors = discussions.select(F.col("user").alias("node")).distinct()
    g = g.join(authors, "node", "left_anti")
    return g.select(
        "node",
        F.col("a.medal").alias("medal"),
        F.col("a.expertise").alias("expertise"),
        F.lit(0).cast("long").alias("n_posts"),
        F.col("a.votes").cast("long").alias("total_comment_votes"),
        F.col("a.is_appreciation").alias("is_appreciation"),
        F.lit(1).alias("kind"),
        "node_order",
    )


def graph_nodes(discussions: DataFrame, comments: DataFrame) -> DataFrame:
    """Union of author and commenter nodes with user-metric defaults."""
    a = author_nodes(discussions)
    c = commenter_nodes(discussions, comments)
    return a.unionByName(c, allowMissingColumns=True).select(
        "node", "medal", "expertise", "n_posts",
        F.coalesce("total_post_votes", F.lit(0)).cast("long").alias("total_post_votes"),
        F.coalesce("n_comments", F.lit(0)).cast("long").alias("comment_count"),
        F.coalesce("n_appreciations", F.lit(0)).cast("long").alias("received_appreciations"),
        "kind", "node_order",
    )


# ----------------------------------------------------------------------- G8
def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct in-neighbours per node (edges are already unique per pair)."""
    deg = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("edge_count"))
    return nodes.select("node").join(deg, "node", "left").select(
        "node", F.coalesce("edge_count", F.lit(0)).cast("long").alias("edge_count")
    )


# ----------------------------------------------------------------------- G6
class PageRankNotConverged(RuntimeError):
    pass


ROWS_PER_PARTITION = 2_000_000


def partitions_for(spark, rows: int) -> int:
    """Partition count for a table of ``rows`` rows that is joined repeatedly
    (kept co-partitioned across rounds): about two million rows per
    partition, and at least the cluster's task slots or the session's shuffle
    partition setting, whichever is less."""
    slots = spark.sparkContext.defaultParallelism
    least = min(slots, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(1, least, -(-rows // ROWS_PER_PARTITION))


def pagerank(
    nodes: DataFrame,
    edges: DataFrame,
    alpha: float = K.PAGERANK_ALPHA,
    max_iter: int = K.PAGERANK_MAX_ITER,
    tol: float = K.PAGERANK_TOL,
    on_no_convergence: str = "error",
    checkpoint_every: int = 10,
    num_partitions: int | None = None,
) -> DataFrame:
    """Weighted PageRank by power iteration.

    Out-weights are row-normalized; nodes whose out-weight sum is zero are
    dangling and spread their mass uniformly.  Stops when the L1 change is
    below ``N * tol``.  Without convergence: ``"error"`` raises, ``"uniform"``
    returns 1/N for every node (G7, the drawing path), ``"last"`` returns the
    last iterate.

    Plan: the normalized transition table is hash-partitioned by ``src`` and
    kept (memory, then disk; a lost part is recomputed from the checkpointed
    edges), so its partitioning is known to the planner and each round joins
    without moving the edges: only the small rank vector and the partial sums
    of the contributions (map-side combined) are shuffled.
    One small aggregate per round returns (L1 change, dangling mass).
    """
    spark = nodes.sparkSession
    node_ids = nodes.select("node").distinct()

    # edges with their source's out-weight, computed once and kept
    edges = cut_lineage(edges)
    out_w = edges.groupBy("src").agg(F.sum("weight").alias("out_w"))
    ew = edges.join(out_w, "src").persist(StorageLevel.MEMORY_AND_DISK)
    src_w = ew.groupBy(F.col("src").alias("node")).agg(F.first("out_w").alias("out_w"))
    state = node_ids.join(src_w, "node", "left").select(
        "node", (F.col("out_w").isNull() | (F.col("out_w") == 0)).alias("dangling")).persist(
        StorageLevel.MEMORY_AND_DISK)
    n, n_dangling = state.agg(F.count(F.lit(1)), F.count_if("dangling")).first()
    if n == 0:
        ew.unpersist()
        return node_ids.withColumn("pagerank", F.lit(None).cast("double"))
    n_part = num_partitions or partitions_for(spark, ew.count() + n)
    state = state.repartition(n_part, "node")
    state = state.withColumn("x", F.lit(1.0 / n))
    dangling_mass = n_dangling / n

    # Row-normalized transitions plus one self row per node.  The self rows
    # carry each node's previous value and dangling flag through the same
    # join + aggregate that sums the contributions, so every round
    # references the state once.  A written table would lose its partitioning
    # and be shuffled in every round, a persisted one keeps it.
    trans2 = (
        ew.where(F.col("out_w") != 0)
        .select("src", "dst", (F.col("weight") / F.col("out_w")).alias("p"), F.lit(False).alias("self"))
        .unionByName(state.select(F.col("node").alias("src"), F.col("node").alias("dst"),
                                  F.lit(0.0).alias("p"), F.lit(True).alias("self")))
        .repartition(n_part, "src")
        .persist(StorageLevel.MEMORY_AND_DISK))
    trans2.count()
    ew.unpersist()
    converged = False
    previous = None
    for it in range(1, max_iter + 1):
        base = alpha * dangling_mass / n + (1.0 - alpha) / n
        nxt = (
            trans2.join(state.select(F.col("node").alias("src"), "x", "dangling").hint("shuffle_hash"), "src")
            .groupBy(F.col("dst").alias("node"))
            .agg(
                F.sum(F.col("x") * F.col("p")).alias("s"),
                F.max(F.when(F.col("self"), F.col("x"))).alias("x_prev"),
                F.max(F.when(F.col("self"), F.col("dangling"))).alias("dangling"),
            )
            .select("node", "dangling", (F.lit(alpha) * F.col("s") + F.lit(base)).alias("x"), "x_prev")
            .persist(StorageLevel.MEMORY_AND_DISK)
        )
        err, dangling_mass = nxt.agg(
            F.sum(F.abs(F.col("x") - F.col("x_prev"))),
            F.sum(F.when(F.col("dangling"), F.col("x")).otherwise(0.0)),
        ).first()
        dangling_mass = dangling_mass or 0.0
        if it % checkpoint_every == 0:
            nxt = cut_lineage(nxt)
        if previous is not None:
            previous.unpersist()
        previous = nxt
        state = nxt.select("node", "dangling", "x")
        if err < n * tol:
            converged = True
            break
    state = cut_lineage(state)
    trans2.unpersist()

    if not converged:
        if on_no_convergence == "error":
            raise PageRankNotConverged(f"PageRank did not converge in {max_iter} iterations")
        if on_no_convergence == "uniform":
            return node_ids.select("node", F.lit(1.0 / n).alias("pagerank"))
    return state.select("node", F.col("x").alias("pagerank"))


# ---------------------------------------------------------------------- G18
def weakly_connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Label each node with the smallest node id of its weakly connected
    component.

    Alternating star contraction: in each round every node first hooks its
    larger neighbours, then its smaller ones, to the smallest of them, until
    the edges no longer change; then every node hangs on its component's
    smallest id.  Joins are on nodes and their own neighbourhoods (never on a
    label that a whole component shares), sums are combined before the
    shuffle, and the edges are written to the checkpoint folder every round."""
    now = cut_lineage(edges.where(F.col("src") != F.col("dst")).select(
        F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.where("m < n").select(F.col("n").alias("u"), F.col("m").alias("v"))
        star = large.unionByName(own).where("u <> v").distinct()
        low2 = star.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = star.join(low2, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        now = cut_lineage(small.unionByName(low2.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct())
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            break
        mark = seen
    return nodes.select("node").distinct().join(now, F.col("node") == F.col("u"), "left").select(
        "node", F.coalesce("v", "node").alias("label"))


# -------------------------------------------------------------- G11 - G17
def top_nodes(scores: DataFrame, tie_order: list[Column], top_n: int) -> DataFrame:
    """Top-n nodes by score, ties by insertion order (a top-k report:
    TakeOrderedAndProject keeps n rows per task, no global sort)."""
    return scores.orderBy(F.col("pagerank").desc(), *tie_order).limit(top_n)


def induced_subgraph(edges: DataFrame, selected: DataFrame, weight_threshold: float | None = None) -> DataFrame:
    """Edges whose both ends are selected; ``selected`` is a top-n set of
    bounded size, so it is broadcast to two semi joins."""
    sel = F.broadcast(selected.select("node"))
    e = edges.join(sel.withColumnRenamed("node", "src"), "src", "left_semi").join(
        sel.withColumnRenamed("node", "dst"), "dst", "left_semi"
    )
    if weight_threshold is not None:
        e = e.where(F.col("weight") >= weight_threshold)
    return e


def minmax_scale(c: str, lo: float, hi: float, constant: float, over_all: bool = True) -> Column:
    """Scale ``c`` into [lo, hi] by min/max over the (small) frame; a
    constant column maps to ``constant``."""
    from pyspark.sql import Window

    w = Window.partitionBy()
    mn, mx = F.min(c).over(w), F.max(c).over(w)
    return F.when(mx > mn, F.lit(lo) + (F.col(c) - mn) / (mx - mn) * F.lit(hi - lo)).otherwise(F.lit(constant))
