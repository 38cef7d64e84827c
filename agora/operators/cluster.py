"""Clustering and cluster-validation operators.

Points are rows ``(pid, x0, ..., x{d-1})``.  DBSCAN finds ε-neighbours with
a grid equi-join (cell side ε, the 3^d surrounding cells, exact distance
filter), so only pairs of nearby points are ever formed; clusters are the
connected components of the core-core graph.
"""

from __future__ import annotations

import itertools

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.operators.graph import weakly_connected_components
from agora.operators.ranking import global_row_number


def require_columns(df: DataFrame, cols: list[str]) -> None:
    """Raises with the names of the columns that are missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in the table: {', '.join(missing)}")


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1."""
    require_columns(df, cols)
    out = df
    for c in cols:
        mean = df.agg(F.avg(c)).scalar()
        sd = df.agg(F.stddev_pop(c)).scalar()
        out = out.withColumn(c, (F.col(c) - mean) / F.when(sd == 0, F.lit(1.0)).otherwise(sd))
    return out


def _cell(cols: list[str], side: float):
    return F.array(*[F.floor(F.col(c) / F.lit(side)).cast("long") for c in cols])


def eps_pairs(points: DataFrame, cols: list[str], eps: float, group: str | None = None) -> DataFrame:
    """All ordered pairs (a, b) with distance <= eps, self pairs included
    (within the same ``group`` when given)."""
    d = len(cols)
    g = [group] if group else []
    offsets = [list(o) for o in itertools.product([-1, 0, 1], repeat=d)]
    p = points.select(*g, "pid", *cols, _cell(cols, eps).alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)
    probe = p.select(
        *g, F.col("pid").alias("a"), *[F.col(c).alias(f"a_{c}") for c in cols],
        F.explode(F.array(*[F.array(*[F.col("cell")[i] + F.lit(o[i]) for i in range(d)]) for o in offsets])).alias("cell"))
    build = p.select(*g, F.col("pid").alias("b"), *[F.col(c).alias(f"b_{c}") for c in cols], "cell")
    dist2 = None
    for c in cols:
        t = F.pow(F.col(f"a_{c}") - F.col(f"b_{c}"), 2)
        dist2 = t if dist2 is None else dist2 + t
    return probe.join(build, g + ["cell"]).where(dist2 <= F.lit(eps * eps)).select(*g, "a", "b")


def dbscan(points: DataFrame, cols: list[str], eps: float = K.DBSCAN_EPS,
           min_samples: int = K.DBSCAN_MIN_SAMPLES, group: str | None = None, keep: bool = False) -> DataFrame:
    """Labels (group?, pid, cluster), with ``keep`` the points too, noise = -1, computed on the fine
    grid without forming every epsilon-pair (see ``dbscan_grid``)."""
    from agora.operators import dbscan_grid

    return dbscan_grid.dbscan(points, cols, eps, min_samples, group, keep)


def dbscan_pairs(points: DataFrame, cols: list[str], eps: float = K.DBSCAN_EPS,
                 min_samples: int = K.DBSCAN_MIN_SAMPLES, group: str | None = None) -> DataFrame:
    """Reference DBSCAN from all epsilon-pairs (quadratic in dense regions;
    kept to cross-check the grid version).  Labels (group?, pid, cluster).  Clusters are
    numbered by their smallest core pid and a border point joins the
    smallest adjacent cluster: the numbering of a sequential scan in pid
    order.  With ``group`` (e.g. a weight candidate), every group is
    clustered independently in the same jobs."""
    g = [group] if group else []
    pairs = eps_pairs(points, cols, eps, group).persist(StorageLevel.MEMORY_AND_DISK)
    counts = pairs.groupBy(*g, F.col("a").alias("pid")).agg(F.count(F.lit(1)).alias("n_nb"))
    core = counts.where(F.col("n_nb") >= min_samples).select(*g, "pid")
    node = F.struct(*[F.col(x) for x in g], F.col("pid")) if g else F.col("pid")
    core_nodes = core.select(node.alias("node"))
    ca = core.select(*g, F.col("pid").alias("a"))
    cb = core.select(*g, F.col("pid").alias("b"))
    core_edges = pairs.join(ca, g + ["a"], "left_semi").join(cb, g + ["b"], "left_semi")
    src = F.struct(*[F.col(x) for x in g], F.col("a").alias("pid")) if g else F.col("a")
    dst = F.struct(*[F.col(x) for x in g], F.col("b").alias("pid")) if g else F.col("b")
    comp = weakly_connected_components(core_nodes, core_edges.select(src.alias("src"), dst.alias("dst")))
    if g:
        comp = comp.select(*[F.col("node")[x].alias(x) for x in g], F.col("node.pid").alias("pid"),
                           F.col("label.pid").alias("label"))
    else:
        comp = comp.select(F.col("node").alias("pid"), "label")
    labels_tab = comp.select(*g, "label").distinct()
    if g:
        w = Window.partitionBy(*g).orderBy("label")
        order = labels_tab.withColumn("cid", F.row_number().over(w))
    else:
        order = global_row_number(labels_tab, [F.col("label")], "cid")
    core_lab = comp.join(order, g + ["label"]).select(*g, "pid", (F.col("cid") - 1).alias("cluster"))
    border = (pairs.join(core_lab.withColumnRenamed("pid", "b"), g + ["b"])
              .join(core_lab.select(*g, F.col("pid").alias("a")), g + ["a"], "left_anti")
              .groupBy(*g, F.col("a").alias("pid")).agg(F.min("cluster").alias("cluster")))
    labelled = core_lab.unionByName(border)
    return points.select(*g, "pid").join(labelled, g + ["pid"], "left").select(
        *g, "pid", F.coalesce(F.col("cluster"), F.lit(-1)).cast("long").alias("cluster"))


# ---------------------------------------------------------------- metrics
def cluster_sizes(labels: DataFrame) -> DataFrame:
    """Points per cluster, noise excluded."""
    return labels.where(F.col("cluster") != -1).groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))


def noise_stats(labels: DataFrame) -> DataFrame:
    """Noise count and ratio, number of clusters without noise."""
    return labels.agg(
        F.count_if(F.col("cluster") == -1).alias("noise_points"),
        (F.count_if(F.col("cluster") == -1) / F.count(F.lit(1))).alias("noise_ratio"),
        F.count_distinct(F.when(F.col("cluster") != -1, F.col("cluster"))).alias("n_clusters"),
    )


def variance_ratio(df: DataFrame, cols: list[str], label: str = "cluster", group: str | None = None) -> DataFrame:
    """C7 per group (one row without): ``n, k, variance_ratio`` =
    (B / (k - 1)) / (W / (n - k)) over the non-noise rows, null with fewer than
    two clusters or no more rows than clusters, 1 if nothing varies within.

    W is the sum of central second moments, which Spark adds up about running
    means, and B sums squared distances of cluster means from the grand mean,
    so neither cancels on data far from the origin."""
    g = [group] if group else []
    own = df.where(F.col(label) != -1).groupBy(*g, label).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m_{c}") for c in cols], sum(F.var_pop(c) for c in cols).alias("_v"))
    grand = own.groupBy(*g).agg(
        F.sum("_n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("_n") * F.col("_v")).alias("_w"),
        *[(F.sum(F.col("_n") * F.col(f"_m_{c}")) / F.sum("_n")).alias(f"_g_{c}") for c in cols])
    both = own.join(F.broadcast(grand), g) if g else own.join(F.broadcast(grand.where("k > 0")))  # without groups: one row
    apart = sum(F.pow(F.col(f"_m_{c}") - F.col(f"_g_{c}"), 2) for c in cols)
    out = both.groupBy(*g, "n", "k", "_w").agg(F.sum(F.col("_n") * apart).alias("_b"))
    ratio = F.when(F.col("_w") == 0, F.lit(1.0)).otherwise((F.col("_b") / (F.col("k") - 1)) / (F.nullif(F.col("_w"), F.lit(0.0)) / F.nullif(F.col("n") - F.col("k"), F.lit(0))))
    return out.select(*g, "n", "k", F.when((F.col("k") >= 2) & (F.col("n") > F.col("k")), ratio).alias("variance_ratio"))


def calinski_harabasz(df: DataFrame, cols: list[str], label: str = "cluster") -> float | None:
    """C7 of one clustering."""
    row = variance_ratio(df, cols, label).first()
    return row["variance_ratio"] if row else None


def silhouette_squared(df: DataFrame, cols: list[str], label: str = "cluster", group: str | None = None) -> DataFrame:
    """Per-point silhouette with squared Euclidean distance, exact in O(n*k):
    the mean squared distance from x to cluster C is
    |x|^2 - 2 x.mean_C + mean_C(|y|^2), so per-cluster sums replace pairs.
    (Plain Euclidean silhouette has no such decomposition and needs every
    pair; this is the scalable form, the one Spark ML's evaluator uses.)
    The per-cluster table (one row per group and cluster) is attached to each
    point as an array by a join on the group key."""
    g = [group] if group else []
    d = df.where(F.col(label) != -1).select(*g, label, *cols)
    sq = sum(F.col(c) * F.col(c) for c in cols)
    stats = d.groupBy(*g, label).agg(F.count(F.lit(1)).alias("_n"), F.avg(sq).alias("_msq"),
                                     *[F.avg(c).alias(f"_m_{c}") for c in cols])
    cl = stats.groupBy(*g).agg(F.collect_list(F.struct(F.col(label).alias("c"), "_n", "_msq",
                                                       *[f"_m_{c}" for c in cols])).alias("_cl"))
    x2 = sum(F.col(c) * F.col(c) for c in cols)

    def msd(s):
        dot = sum(F.col(c) * s[f"_m_{c}"] for c in cols)
        return x2 - 2 * dot + s["_msq"]

    if g:
        j = d.join(F.broadcast(cl), g, "inner")
    else:
        j = d.withColumn("_cl", cl.select("_cl").scalar())
    per = j.select(
        *g, label,
        F.filter("_cl", lambda s: s["c"] == F.col(label))[0].alias("_own"),
        F.transform(F.filter("_cl", lambda s: s["c"] != F.col(label)), msd).alias("_other"),
        *cols,
    )
    own = F.col("_own")
    a = F.when(own["_n"] > 1, msd(own) * own["_n"] / (own["_n"] - 1)).otherwise(F.lit(0.0))
    b = F.array_min("_other")
    s = F.when(own["_n"] > 1, (b - a) / F.greatest(a, b)).otherwise(F.lit(0.0))
    return per.select(*g, label, s.alias("silhouette"))


def objective(n_clusters: int, noise_ratio: float, silhouette: float | None, algorithm: str = "dbscan",
              bic: float | None = None, n: int | None = None) -> float:
    """Weight-search objective on one clustering's metrics."""
    if algorithm == "dbscan":
        if n_clusters < 2 or noise_ratio > 0.5:
            return 10.0
        return -(silhouette if silhouette is not None else -1.0) + 2.0 * noise_ratio
    if n_clusters < 2:
        return 10.0
    return -(silhouette if silhouette is not None else -1.0) + (bic / n) * 0.001


def improvement_pct(initial, final):
    """C11: 100 * (final - initial) / |initial|; null when initial is null or 0."""
    init = F.col(initial) if isinstance(initial, str) else initial
    fin = F.col(final) if isinstance(final, str) else final
    return F.when(init.isNull() | (init == 0), F.lit(None).cast("double")).otherwise(
        F.lit(100.0) * (fin - init) / F.abs(init))
