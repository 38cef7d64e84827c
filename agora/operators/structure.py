"""Thread-structure features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.lookups import expertise_rank
from agora.session import cut_lineage


def node_levels(adjacency: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """Level of every node of a reply forest: top-level comments (null
    parent) are level 1, a reply is its parent's level + 1.

    Pointer doubling: every node knows an ancestor and how far up it is; a
    round replaces the ancestor by the ancestor's own, so the number of rounds
    is the logarithm of the depth.  Nodes whose chain ends at a missing parent
    have no level; nor have nodes of a cycle, which are those still open when
    the distance passes the number of nodes."""
    top = F.col(parent).isNull()
    now = cut_lineage(adjacency.select(
        F.col(key).alias("_k"), F.col(node).alias("_n"), F.col(parent).alias("_up"),
        F.when(top, 0).otherwise(1).cast("long").alias("_far")).distinct())
    total, far = now.count(), 1
    while far <= total and not now.where(F.col("_up").isNotNull()).isEmpty():
        above = now.select("_k", F.col("_n").alias("_up"), F.col("_up").alias("_next"), F.col("_far").alias("_more"))
        moved = now.where(F.col("_up").isNotNull()).join(above, ["_k", "_up"]).select(
            "_k", "_n", F.col("_next").alias("_up"), (F.col("_far") + F.col("_more")).alias("_far"))
        now = cut_lineage(now.where(F.col("_up").isNull()).unionByName(moved))
        far *= 2
    return now.where(F.col("_up").isNull()).select(F.col("_k").alias(key), F.col("_n").alias(node), (F.col("_far") + 1).cast("int").alias("level"))


def thread_depth(discussion_ids: DataFrame, id_col: str, levels: DataFrame, key: str) -> DataFrame:
    """0 without comments, else the deepest level."""
    mx = levels.groupBy(F.col(key).alias(id_col)).agg(F.max("level").alias("depth"))
    return discussion_ids.select(id_col).join(mx, id_col, "left").select(
        id_col, F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def comment_stats(comments: DataFrame) -> DataFrame:
    """F2 + F5 per discussion over top-level comments (deleted included):
    count and mean expertise rank over the comments that have the attribute.
    An unknown or null rank counts as 0; where ``has_expertise`` tells that the
    key itself is absent, the comment does not count."""
    rank = expertise_rank(F.col("expertise"))
    if "has_expertise" in comments.columns:
        rank = F.when(F.col("has_expertise"), rank)
    return comments.groupBy("discussion_id").agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.avg(rank).alias("expertise_avg"),
    )


def feature_rows(discussions: DataFrame, comments: DataFrame, depth: DataFrame | None = None) -> DataFrame:
    """one feature row per discussion."""
    st = comment_stats(comments)
    d = discussions.select("id", "votes").join(st, discussions.id == st.discussion_id, "left").drop("discussion_id")
    n = F.coalesce(F.col("n_comments"), F.lit(0)).cast("long")
    out = d.select(
        F.col("id").alias("discussion_id"),
        F.coalesce(F.col("expertise_avg"), F.lit(0.0)).alias("expertise_avg"),
        vote_ratio(F.col("votes"), n).alias("vote_ratio"),
        (n > 0).alias("has_comments"),
        n.alias("n_comments"),
    )
    if depth is None:
        # top-level comments without reply structure: depth 1 iff commented
        return out.withColumn("depth", F.when(F.col("has_comments"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return out.join(depth.withColumnRenamed("id", "discussion_id"), "discussion_id", "left")


def vote_ratio(votes, n_comments):
    """votes / (n_comments + 1e-6); a non-numeric count counts as 0."""
    n = F.coalesce(n_comments.try_cast("double") if hasattr(n_comments, "try_cast") else n_comments.cast("double"),
                   F.lit(0.0))
    return F.coalesce(votes, F.lit(0)).cast("double") / (n + F.lit(1e-6))
