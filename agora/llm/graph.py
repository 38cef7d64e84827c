"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import freeze, remove_tree


def components(edges: DataFrame) -> DataFrame:
    """``id, component`` (smallest id reachable) for every node of the edges
    ``a, b``.

    Each round hooks all neighbours of a node to the smallest of them, first
    the larger neighbours, then the smaller ones; rounds go on until nothing
    changes, when every node hangs on its component's smallest id.  Grouping
    sums up per task before the shuffle, and each round's edges are written
    to the shared folder, so plans stay short and a lost executor costs at
    most one round.
    """
    spark = edges.sparkSession
    now = freeze(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    mark = None
    while True:
        both = now.union(now.select("v", "u"))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.col("n")).alias("m"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node that is no larger neighbour keeps its own edge to its smallest one
        own = low.where("m < n").select(F.col("n").alias("u"), F.col("m").alias("v"))
        star = large.union(own).where("u <> v").distinct()
        low2 = star.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = star.join(low2, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        new = freeze(small.union(low2.select("n", "m").toDF("u", "v")).distinct(), "edges")
        # unchanged sums of both hashes: the same set of edges
        seen = tuple(new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        for path in {f.rsplit("/", 1)[0] for f in now.inputFiles()}:
            remove_tree(spark, path)
        now = new
        if seen == mark:
            break
        mark = seen
    return now.select("u", "v").union(now.select("v", "v").distinct()).toDF("id", "component")
