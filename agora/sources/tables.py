"""Readers for the given parquet tables and the stand-in views that map them
onto the forum data model (discussions, comments, reply threads, ...).

Every view is a lazy projection of a parquet scan, so Catalyst prunes columns
and pushes filters into the scan.  Order-dependent forum semantics (last post
wins, first comment wins, rank ties) use an explicit ``load_order`` instead of
row order, which Spark does not have.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# --- fixed values: stand-in attribute cycles (index = key modulo length) ------
MEDAL_CYCLE = [None, "bronze", "silver", "gold", "platinum"]
EXPERTISE_CYCLE = [None, "Novice", "Contributor", "Expert", "Master", "Grandmaster"]
TAG_CYCLE = [None, ["Machine Learning", "GPU"], ["zzz"], ["AWS", "python", "AWS"]]
REFERENCE_DATE = "2001-03-27"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has
    task slots, before CPU-heavy per-row work (regexes over whole texts).
    Large inputs already split into many partitions and pass unchanged."""
    slots = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < slots:
        return df.repartition(slots)
    return df


def text_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Scan of a text table, pruned to ``cols`` and spread for CPU work."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*cols) if cols else df)


#: Markup appended to the text of every seventh document, so that each
#: cleaning step has something to do (index = doc_id modulo 7).
MARKUP = [
    " see https://x.org/a?b=1 now",
    " ![](https://i.org/s.png) shot",
    " run `x = 1` or ```a b``` here",
    " @some_user wrote",
    " Machine Learning and deep learning: neural networks",
    " <b>bold</b> www.site.org end",
    " [](http://i.org/t.png) plain",
]


def marked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` (doc_id, text) with the ``MARKUP`` appended."""
    mark = F.get(F.array(*[F.lit(m) for m in MARKUP]), (F.col("doc_id") % len(MARKUP)).cast("int"))
    return text_table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.concat("text", mark).alias("text"))


def _cycle(key: Column, values: list) -> Column:
    """CASE over ``key % len(values)``; literal, so it stays in codegen."""
    k = key % F.lit(len(values))
    out = None
    for i, v in enumerate(values):
        lit = F.lit(v) if not isinstance(v, list) else F.array(*[F.lit(x) for x in v])
        out = F.when(k == i, lit) if out is None else out.when(k == i, lit)
    return out


def discussions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forum posts: one row per order."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("u"), F.col("o_custkey").cast("string")).alias("user"),
        (F.floor(F.col("o_totalprice") / 1000).cast("int") - 50).alias("votes"),
        _cycle(F.col("o_custkey"), MEDAL_CYCLE).cast("string").alias("medal"),
        _cycle(F.col("o_custkey"), EXPERTISE_CYCLE).cast("string").alias("expertise"),
        _cycle(F.col("o_orderkey"), TAG_CYCLE).cast("array<string>").alias("tags"),
        F.col("o_orderdate").alias("datetime"),
        F.col("o_orderstatus").alias("forum"),
        F.col("o_orderkey").alias("load_order"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-level comments: one row per line item.  ``(l_orderkey,
    l_linenumber)`` repeats, so the load order is the wider tuple
    ``c_order``."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(
        F.col("l_orderkey").alias("discussion_id"),
        # every fourth supplier is a user who only comments
        F.concat(F.when(F.col("l_suppkey") % 4 == 0, "v").otherwise("u"), F.col("l_suppkey").cast("string")).alias("user"),
        (F.col("l_quantity").cast("int") - 5).alias("votes"),
        _cycle(F.col("l_suppkey"), MEDAL_CYCLE).cast("string").alias("medal"),
        _cycle(F.col("l_suppkey"), EXPERTISE_CYCLE).cast("string").alias("expertise"),
        (F.col("l_returnflag") == "A").alias("is_appreciation"),
        (F.col("l_returnflag") == "R").alias("is_deleted"),
        F.col("l_shipdate").alias("datetime"),
        F.struct(
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").cast("long").alias("k2"),
            F.col("l_partkey").alias("k3"),
            F.col("l_suppkey").alias("k4"),
            F.col("l_extendedprice").alias("k5"),
        ).alias("c_order"),
    )


def comment_counts(comments_df: DataFrame) -> DataFrame:
    """Per discussion: number of top-level comments and appreciation comments
    (partial aggregation before the shuffle on the discussion key)."""
    return comments_df.groupBy("discussion_id").agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.count_if(F.col("is_appreciation")).alias("n_appreciation_comments"),
    )


def discussions_with_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = discussions(spark, sf_dir)
    c = comment_counts(comments(spark, sf_dir))
    return (
        d.join(c, d.id == c.discussion_id, "left")
        .drop("discussion_id")
        .withColumn("n_comments", F.coalesce("n_comments", F.lit(0)).cast("long"))
        .withColumn("n_appreciation_comments", F.coalesce("n_appreciation_comments", F.lit(0)).cast("long"))
    )


def reply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reply threads as an adjacency table: node (conv_id, turn), parent turn-1."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        "conv_id",
        "turn",
        F.when(F.col("turn") > 0, F.col("turn") - 1).alias("parent_turn"),
        "role",
        "text",
    )


def points(spark: SparkSession, sf_dir: str, dims: int = 3) -> DataFrame:
    """Numeric points: first ``dims`` embedding entries, label as cluster."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("pid"),
        *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(dims)],
        F.col("label").cast("long").alias("cluster"),
    )


def quality_labels(spark: SparkSession, sf_dir: str, tasks: list[str]) -> DataFrame:
    """Stand-in adapter labels: ``<task_k>_ad = (l_partkey*(k+1)+l_linenumber+k) % 4``."""
    l = table(spark, sf_dir, "lineitem")
    cols = [
        ((F.col("l_partkey") * (k + 1) + F.col("l_linenumber") + k) % 4).cast("long").alias(f"{t}_ad")
        for k, t in enumerate(tasks)
    ]
    return l.select(
        F.col("l_orderkey").alias("id"),
        F.col("l_linenumber").cast("long").alias("line"),
        F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"),
        F.col("l_extendedprice").alias("price"),
        *cols,
    )
