"""Summary statistics and dashboard aggregates.

Exact quantiles come from counts per (group, value): the counted rows are
sorted over range partitions and summed up (``ranking.running_total``), and
the interpolation points are the values whose count range holds the wanted
positions.  No group is ever collected into one task, however large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.operators.ranking import running_total


# ------------------------------------------------------------- P8 / P9
def engagement(votes="votes", n_comments="n_comments", depth="depth") -> Column:
    return (F.col(votes) + F.col(n_comments) * F.lit(K.ENGAGEMENT_COMMENT_WEIGHT)
            + F.col(depth) * F.lit(K.ENGAGEMENT_DEPTH_WEIGHT))


def content_band(kl="kl_divergence", typical_below=K.BAND_TYPICAL_BELOW, atypical_from=K.BAND_ATYPICAL_FROM,
                 labels=K.BAND_LABELS) -> Column:
    """Null or NaN falls through to the last band, as a failed comparison does."""
    c = F.col(kl)
    return F.when(c < typical_below, F.lit(labels[0])).when(c < atypical_from, F.lit(labels[1])).otherwise(
        F.lit(labels[2]))


def decimal_comma(c) -> Column:
    """S21: '1,25' -> 1.25 (null when not a number)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(c.cast("string"), ",", ".").try_cast("double")


# ------------------------------------------------------------ P10 / P11
def range_filter(df: DataFrame, kl="kl_divergence", domain: str | None = None, lo: float | None = None,
                 hi: float | None = None, all_label: str = "Todos") -> DataFrame:
    """Domain equality filter with an 'all' bypass, then an inclusive KL
    range whose open bounds default to the column's min / max (which keeps
    every non-null value, so they need no extra pass)."""
    if domain is not None and domain != all_label:
        df = df.where(F.col("domain") == domain)
    cond = F.col(kl).isNotNull()
    if lo is not None:
        cond = cond & (F.col(kl) >= lo)
    if hi is not None:
        cond = cond & (F.col(kl) <= hi)
    return df.where(cond)


# ------------------------------------------------------------ quantiles
def quantiles(df: DataFrame, value: str, probs: list[float], group: str | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas/numpy 'linear').
    Output: (group?, prob, q)."""
    keys = [group] if group else []
    base = df.select(*keys, F.col(value).cast("double").alias("_v")).where(
        F.col("_v").isNotNull() & ~F.isnan("_v"))
    # equal values become one counted row, so a value that a third of all rows
    # share is one row, and only distinct values are sorted
    counts = base.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    order = ([F.col(group).asc_nulls_first()] if group else []) + [F.col("_v")]
    placed = running_total(counts, order, "_c", "_b")
    gs = placed.groupBy(*keys).agg(F.min("_b").alias("_g0"), F.sum("_c").alias("_n"))
    pos = lambda p: (F.col("_n") - 1) * F.lit(float(p))
    wanted = F.array(*[F.struct(F.lit(float(p)).alias("prob"), (F.col("_g0") + F.floor(pos(p))).alias("lo"), (F.col("_g0") + F.ceil(pos(p))).alias("hi"),
                                (pos(p) - F.floor(pos(p))).alias("f")) for p in probs])
    targets = gs.where("_n > 0").select(*[F.col(k).alias("_k") for k in keys], wanted.alias("_t"))
    joined = placed.join(targets, F.col(group).eqNullSafe(F.col("_k"))) if group else placed.join(F.broadcast(targets))
    within = lambda at: (F.col("_b") <= at) & (at < F.col("_b") + F.col("_c"))
    near = joined.select(*keys, "_v", "_b", "_c", F.explode(F.filter("_t", lambda t: within(t["lo"]) | within(t["hi"]))).alias("_t"))
    ends = near.groupBy(*keys, F.col("_t.prob").alias("prob"), F.col("_t.f").alias("_f")).agg(
        F.max(F.when(within(F.col("_t.lo")), F.col("_v"))).alias("_vlo"), F.max(F.when(within(F.col("_t.hi")), F.col("_v"))).alias("_vhi"))
    return ends.select(*keys, "prob", (F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_f")).alias("q"))


# ----------------------------------------------------------------- A4 / A5
def describe(df: DataFrame, value: str, group: str | None = None) -> DataFrame:
    keys = [group] if group else []
    return df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"))


def domain_stats(df: DataFrame, kl="kl_divergence", typical_below=K.BAND_TYPICAL_BELOW,
                 atypical_from=K.BAND_ATYPICAL_FROM) -> DataFrame:
    """A5: one grouped aggregate with conditional counts."""
    return df.groupBy("domain").agg(
        F.count(F.lit(1)).alias("count"),
        F.avg(kl).alias("avg_kl"), F.stddev_samp(kl).alias("std_kl"),
        F.min(kl).alias("min_kl"), F.max(kl).alias("max_kl"),
        F.avg("engagement").alias("avg_engagement"),
        F.count_if(F.col(kl) < typical_below).alias("typical_count"),
        F.count_if(F.col(kl) >= atypical_from).alias("atypical_count"),
    )


def radar_norm(stats: DataFrame, metrics=("avg_kl", "avg_engagement", "count")) -> DataFrame:
    """Divide by the column max over the (one row per domain) table."""
    w = Window.partitionBy()
    return stats.select("domain", *[(F.col(m) / F.max(m).over(w)).alias(f"{m}_norm") for m in metrics])


# -------------------------------------------------------------- A19 / A20
def header_metrics(filtered: DataFrame, full: DataFrame, kl="kl_divergence", lo=K.HEADER_TYPICAL_BELOW,
                   hi=K.HEADER_ATYPICAL_FROM) -> DataFrame:
    full_avg = full.agg(F.avg(kl)).scalar()
    return filtered.agg(
        F.avg(kl).alias("avg_kl"), (F.avg(kl) - full_avg).alias("delta_kl"),
        F.count_if(F.col(kl) < lo).alias("typical_count"), F.count_if(F.col(kl) >= hi).alias("atypical_count"),
        F.count_distinct("domain").alias("n_domains"))


def band_percentages(df: DataFrame, kl="kl_divergence", lo=K.HEADER_TYPICAL_BELOW, hi=K.HEADER_ATYPICAL_FROM) -> DataFrame:
    n = F.nullif(F.count(F.lit(1)), F.lit(0))
    return df.agg(
        (F.lit(100.0) * F.count_if(F.col(kl) < lo) / n).alias("typical_pct"),
        (F.lit(100.0) * F.count_if((F.col(kl) >= lo) & (F.col(kl) < hi)) / n).alias("moderate_pct"),
        (F.lit(100.0) * F.count_if(F.col(kl) >= hi) / n).alias("atypical_pct"),
    )


# ---------------------------------------------------------- A15 - A17
def corr_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairwise Pearson correlations in one aggregate (pairwise
    complete), returned long: (col_a, col_b, corr)."""
    pairs = [(a, b) for a in cols for b in cols]
    row = df.agg(*[F.corr(a, b).alias(f"{a}__{b}") for a, b in pairs])
    return row.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"{a}__{b}").alias("corr"))
        for a, b in pairs])).alias("s")).select("s.*")


def trend_line(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line; fitted values per row (ordered by x on read)."""
    slope = df.agg(F.regr_slope(y, x)).scalar()
    intercept = df.agg(F.regr_intercept(y, x)).scalar()
    return df.withColumn("slope", slope).withColumn("intercept", intercept).withColumn(
        "fitted", F.col("intercept") + F.col("slope") * F.col(x))


# ---------------------------------------------------------- A10 / A11
def histogram(df: DataFrame, value: str, bins: int = 20, group: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed; bounds from one
    global aggregate (a single row joined back)."""
    keys = [group] if group else []
    v = df.where(F.col(value).isNotNull())
    mn, mx = v.agg(F.min(value)).scalar(), v.agg(F.max(value)).scalar()
    h = v.withColumn("_mn", mn).withColumn("_mx", mx)
    width = (F.col("_mx") - F.col("_mn")) / F.lit(bins)
    idx = F.when(F.col("_mx") > F.col("_mn"),
                 F.least(F.floor((F.col(value) - F.col("_mn")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    h = h.withColumn("bin", idx.cast("long")).withColumn("_w", width)
    return h.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("count"),
        F.first(F.col("_mn") + F.col("bin") * F.col("_w")).alias("lo"),
    )


# -------------------------------------------------------------------- A12
def kde_grid(df: DataFrame, value: str, points: int = 200, sums: int = 50) -> DataFrame:
    """Gaussian KDE on an equal grid over [min, max], Scott bandwidth
    (n^-1/5 times the sample std).

    Equal values are counted first (combined before the shuffle), then each
    counted value meets every block of ``sums`` grid points: an aggregate of
    that many sums stays within generated code, one of all points does not."""
    v = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("_x"))
    n = v.agg(F.count(F.lit(1)).cast("double")).scalar()
    sd = v.agg(F.stddev_samp("_x")).scalar()
    lo, hi = v.agg(F.min("_x")).scalar(), v.agg(F.max("_x")).scalar()
    one = df.sparkSession.range(1).select(n.alias("_n"), (sd * F.pow(n, F.lit(-0.2))).alias("_h"), lo.alias("_mn"), ((hi - lo) / F.lit(points - 1)).alias("_step"))
    counted = v.groupBy("_x").agg(F.count(F.lit(1)).alias("_c"))
    scaled = counted.join(F.broadcast(one)).withColumn("_first", F.explode(F.sequence(F.lit(0), F.lit(points - 1), F.lit(sums))))  # one row
    kernel = lambda i: F.exp(F.lit(-0.5) * F.pow((F.col("_mn") + (F.col("_first") + i) * F.col("_step") - F.col("_x")) / F.col("_h"), 2))
    blocks = scaled.groupBy("_n", "_h", "_mn", "_step", "_first").agg(F.array(*[F.sum(F.col("_c") * kernel(i)) for i in range(sums)]).alias("_s"))
    g = blocks.select("_n", "_h", "_mn", "_step", "_first", F.posexplode("_s").alias("_i", "_k")).withColumn("point", F.col("_first") + F.col("_i"))
    return g.where(F.col("point") < points).select("point", (F.col("_mn") + F.col("point") * F.col("_step")).alias("x"),
                    (F.col("_k") / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"))


# ---------------------------------------------------------- A13 / A14
def box_stats(df: DataFrame, value: str, group: str) -> DataFrame:
    """Five-number summary per group: quartiles (exact, linear), whiskers =
    most extreme data within 1.5 IQR of the box."""
    q = quantiles(df, value, [0.25, 0.5, 0.75], group)
    qw = q.groupBy(group).pivot("prob", [0.25, 0.5, 0.75]).agg(F.first("q"))
    qw = qw.toDF(group, "q1", "median", "q3")
    j = df.select(group, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull()).join(qw, group)
    iqr = F.col("q3") - F.col("q1")
    return j.groupBy(group, "q1", "median", "q3").agg(
        F.min(F.when(F.col("_v") >= F.col("q1") - 1.5 * iqr, F.col("_v"))).alias("whisker_lo"),
        F.max(F.when(F.col("_v") <= F.col("q3") + 1.5 * iqr, F.col("_v"))).alias("whisker_hi"),
        F.count(F.lit(1)).alias("n"),
    )


# ------------------------------------------------------------------- A1
def first_min_per_key(df: DataFrame, key: str, value: str, tie_order: list[str]) -> DataFrame:
    """A1 (groupby-idxmin): per key, the row with the smallest value, ties by
    load order; null keys dropped.  min_by over a struct is a two-phase
    aggregate, so a hot key does not gather its rows in one task."""
    cols = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*cols), F.struct(F.col(value), *[F.col(c) for c in tie_order]))
    return df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(best.alias("_b")).select(
        key, "_b.*")


# ------------------------------------------------------------------- A3
def iqr_outliers(df: DataFrame, field: str, k: float = 1.5) -> DataFrame:
    """Flag rows outside [q1 - k*IQR, q3 + k*IQR] (inclusive); null -> outlier."""
    q = quantiles(df, field, [0.25, 0.75])
    q1 = q.where(F.col("prob") == 0.25).select("q").scalar()
    q3 = q.where(F.col("prob") == 0.75).select("q").scalar()
    iqr = F.col("_q3") - F.col("_q1")
    j = df.withColumn("_q1", q1).withColumn("_q3", q3)
    flag = ~F.coalesce(F.col(field).between(F.col("_q1") - k * iqr, F.col("_q3") + k * iqr), F.lit(False))
    return j.withColumn("outlier", flag).drop("_q1", "_q3")


# --------------------------------------------------------------- A9
def pivot_table(df: DataFrame, index: str, columns: str, values: str, agg: str = "mean",
                column_values: list | None = None) -> DataFrame:
    fn = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "median": F.median}[agg]
    d = df.where(F.col(index).isNotNull() & F.col(columns).isNotNull())
    return d.groupBy(index).pivot(columns, column_values).agg(fn(values))


# ---------------------------------------------------------- P12 / A7 / A8
def membership(df: DataFrame, domains_col: str, domains: list[str]) -> DataFrame:
    return df.select("*", *[F.array_contains(F.col(domains_col), d).alias(d) for d in domains])


def subset_sizes(df: DataFrame, flags: list[str]) -> DataFrame:
    return df.groupBy(*flags).agg(F.count(F.lit(1)).alias("size"))


# ------------------------------------------------------------------ A27
def column_mode(df: DataFrame, col: str) -> DataFrame:
    """Most frequent non-null value, smallest among ties (two-phase: count
    per value, then the top one)."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return c.agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias("mode"))
