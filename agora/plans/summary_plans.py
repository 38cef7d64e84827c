"""Registered queries: topic divergence table and the dashboard summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.functions.divergence import kl_divergence, kl_divergence_sql
from agora.operators import summary as Su
from agora.operators import topics as Tp
from agora.plans import sql_views as V
from agora.plans.common import R, r6, with_ctes
from agora.sources import tables as S
from agora.sources.kl_table import CONTENT_TOPICS_SQL, K_TOPICS, content_topics

FILTER_DOMAIN = "en"
KL_COLS = ["kl_divergence", "votes", "n_comments", "engagement"]


def kl_table(spark, sf) -> DataFrame:
    return Tp.kl_content_vs_domain(content_topics(spark, sf), K_TOPICS)


def dash(spark, sf) -> DataFrame:
    """Dashboard frame: KL table + engagement (P8) + content band."""
    return kl_table(spark, sf).withColumn("engagement", Su.engagement()).withColumn("content_type", Su.content_band())


def q_kl_fixed(spark, sf):
    c = content_topics(spark, sf)
    uni = F.array(*[F.lit(1.0 / K_TOPICS)] * K_TOPICS)
    return c.select("id", r6(kl_divergence("topic_dist", uni)).alias("kl_uniform"),
                    r6(kl_divergence(uni, "topic_dist")).alias("kl_reverse"))


def q_domain_mean_topics(spark, sf):
    return Tp.domain_mean_topics(content_topics(spark, sf), K_TOPICS).select(
        "domain", F.col("topic").cast("long").alias("topic"), r6("mean_prob").alias("mean_prob"))


def q_kl_content_domain(spark, sf):
    return kl_table(spark, sf).select("title", "id", "domain", r6("kl_divergence").alias("kl_divergence"),
                                      "user", "votes", "n_comments", "depth")


def q_kl_bands(spark, sf):
    d = dash(spark, sf)
    as_text = F.replace(F.round("kl_divergence", 6).cast("string"), F.lit("."), F.lit(","))
    return d.select("id", "domain", r6("engagement").alias("engagement"), "content_type",
                    r6(Su.decimal_comma(as_text)).alias("kl_parsed"))


def q_domain_stats(spark, sf):
    s = Su.domain_stats(dash(spark, sf))
    return s.select("domain", "count", *[r6(c).alias(c) for c in ["avg_kl", "std_kl", "min_kl", "max_kl", "avg_engagement"]],
                    "typical_count", "atypical_count")


def q_radar_norm(spark, sf):
    r = Su.radar_norm(Su.domain_stats(dash(spark, sf)))
    return r.select("domain", *[r6(c).alias(c) for c in ["avg_kl_norm", "avg_engagement_norm", "count_norm"]])


def _filtered(spark, sf):
    d = dash(spark, sf)
    return d, Su.range_filter(d, domain=FILTER_DOMAIN, lo=0.05)


def q_header_metrics(spark, sf):
    full, f = _filtered(spark, sf)
    h = Su.header_metrics(f, full)
    return h.select(r6("avg_kl").alias("avg_kl"), r6("delta_kl").alias("delta_kl"), "typical_count",
                    "atypical_count", "n_domains")


def q_band_pct(spark, sf):
    _, f = _filtered(spark, sf)
    return Su.band_percentages(f).select(*[r6(c).alias(c) for c in ["typical_pct", "moderate_pct", "atypical_pct"]])


def q_range_filter(spark, sf):
    d = dash(spark, sf)
    f = Su.range_filter(d, domain=FILTER_DOMAIN)
    return f.select("id", "domain", r6("kl_divergence").alias("kl_divergence"))


def q_filter_bounds(spark, sf):
    d = dash(spark, sf)
    return d.agg(r6(F.min("kl_divergence")).alias("kl_min"), r6(F.max("kl_divergence")).alias("kl_max"),
                 F.count_distinct("domain").alias("n_domains"))


def _topk(spark, sf, largest: bool):
    d = dash(spark, sf)
    k = F.round("kl_divergence", 6)
    order = [k.desc_nulls_last() if largest else k.asc_nulls_last(), F.col("id"), F.col("domain")]
    return d.orderBy(*order).limit(10).select("title", "domain", r6("kl_divergence").alias("kl_divergence"),
                                              "votes", "n_comments", "user")


def q_top_atypical(spark, sf):
    return _topk(spark, sf, True)


def q_top_typical(spark, sf):
    return _topk(spark, sf, False)


def q_corr_matrix(spark, sf):
    c = Su.corr_matrix(dash(spark, sf), KL_COLS)
    return c.select("col_a", "col_b", r6("corr").alias("corr"))


def q_trend_line(spark, sf):
    t = Su.trend_line(dash(spark, sf), "kl_divergence", "engagement")
    return t.select("id", "domain", r6("kl_divergence").alias("kl_divergence"), r6("fitted").alias("fitted"),
                    r6("slope").alias("slope"), r6("intercept").alias("intercept"))


def q_box_domain(spark, sf):
    b = Su.box_stats(dash(spark, sf), "kl_divergence", "domain")
    return b.select("domain", *[r6(c).alias(c) for c in ["q1", "median", "q3", "whisker_lo", "whisker_hi"]], "n")


def q_kl_quantiles(spark, sf):
    q = Su.quantiles(dash(spark, sf), "kl_divergence", [0.25, 0.5, 0.75, 0.9])
    return q.select(r6("prob").alias("prob"), r6("q").alias("q"))


def q_kl_describe(spark, sf):
    d = Su.describe(dash(spark, sf), "kl_divergence")
    return d.select("count", *[r6(c).alias(c) for c in ["mean", "std", "min", "max"]])


def q_histogram20(spark, sf):
    """A10 on the quality score column."""
    h = Su.histogram(S.table(spark, sf, "events"), "value", 20)
    return h.select("bin", "count", r6("lo").alias("lo"))


def q_histogram_bands(spark, sf):
    """KL histogram split by content band."""
    h = Su.histogram(dash(spark, sf), "kl_divergence", 20, group="content_type")
    return h.select("content_type", "bin", "count", r6("lo").alias("lo"))


def q_kde_grid(spark, sf):
    k = Su.kde_grid(S.table(spark, sf, "events"), "value", 200)
    return k.select(F.col("point").cast("long").alias("point"), r6("x").alias("x"), r6("density").alias("density"))


def q_value_stats(spark, sf):
    """A2/A4 per group on a numeric column (events.value by event_type)."""
    ev = S.table(spark, sf, "events")
    d = Su.describe(ev, "value", "event_type")
    q = Su.quantiles(ev, "value", [0.25, 0.5, 0.75], "event_type").groupBy("event_type").pivot(
        "prob", [0.25, 0.5, 0.75]).agg(F.first("q")).toDF("event_type", "p25", "p50", "p75")
    return d.join(q, "event_type").select("event_type", "count", *[r6(c).alias(c) for c in
                                                                   ["mean", "std", "min", "max", "p25", "p50", "p75"]])


def q_min_kl_per_user(spark, sf):
    kl = kl_table(spark, sf).withColumn("_k", F.round("kl_divergence", 9))
    m = Su.first_min_per_key(kl, "user", "_k", ["id", "domain"])
    return m.select("user", "id", "domain", r6("kl_divergence").alias("kl_divergence"))


def q_pivot_mean(spark, sf):
    d = S.discussions(spark, sf)
    levels = list(K.EXPERTISE_RANKS)
    p = Su.pivot_table(d, "medal", "expertise", "votes", "mean", levels)
    return p.select("medal", *[r6(c).alias(c) for c in levels])


ALL_DOMAINS = list(K.DOMAIN_TAGS) + [K.GENERAL_DOMAIN]


def _disc_domains(spark, sf):
    from agora.operators import domains as D
    d = S.discussions(spark, sf)
    return d.select("id", "user", D.domains_by_tags("tags").alias("domains"))


def _flag(d):
    return d.replace(" ", "_").lower()


def q_domain_membership(spark, sf):
    m = Su.membership(_disc_domains(spark, sf), "domains", ALL_DOMAINS)
    return m.select("id", *[F.col(d).alias(_flag(d)) for d in ALL_DOMAINS])


def q_domain_subsets(spark, sf):
    m = Su.membership(_disc_domains(spark, sf), "domains", ALL_DOMAINS)
    s = Su.subset_sizes(m, ALL_DOMAINS)
    return s.select(*[F.col(d).alias(_flag(d)) for d in ALL_DOMAINS], F.col("size").cast("long").alias("size"))


def q_param_mode(spark, sf):
    ev = S.table(spark, sf, "events")
    parts = [Su.column_mode(ev, c).select(F.lit(c).alias("column"), F.col("mode").cast("string").alias("mode"))
             for c in ["user_id", "event_type", "value"]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


QUERIES = {
    "kl_fixed": q_kl_fixed,
    "domain_mean_topics": q_domain_mean_topics,
    "kl_content_domain": q_kl_content_domain,
    "kl_bands": q_kl_bands,
    "domain_stats": q_domain_stats,
    "radar_norm": q_radar_norm,
    "header_metrics": q_header_metrics,
    "band_pct": q_band_pct,
    "range_filter": q_range_filter,
    "filter_bounds": q_filter_bounds,
    "top_atypical": q_top_atypical,
    "top_typical": q_top_typical,
    "corr_matrix": q_corr_matrix,
    "trend_line": q_trend_line,
    "box_domain": q_box_domain,
    "kl_quantiles": q_kl_quantiles,
    "kl_describe": q_kl_describe,
    "histogram20": q_histogram20,
    "histogram_bands": q_histogram_bands,
    "kde_grid": q_kde_grid,
    "value_stats": q_value_stats,
    "min_kl_per_user": q_min_kl_per_user,
    "pivot_mean": q_pivot_mean,
    "domain_membership": q_domain_membership,
    "domain_subsets": q_domain_subsets,
    "param_mode": q_param_mode,
}

# ------------------------------------------------------------------ SQL
_KL = f"""x AS (SELECT ct.*, unnest(domains) AS domain FROM content_topics ct),
dm AS (SELECT domain, g.i AS topic, avg(topic_dist[g.i + 1]) AS mean_prob
       FROM x, generate_series(0, {K_TOPICS - 1}) AS g(i) GROUP BY domain, g.i),
dv AS (SELECT domain, list(mean_prob ORDER BY topic) AS domain_avg FROM dm GROUP BY domain),
kl AS (SELECT title, id, x.domain, {kl_divergence_sql('topic_dist', 'domain_avg')} AS kl_divergence, "user",
              greatest(votes, 0) AS votes, n_comments, depth
       FROM x JOIN dv ON dv.domain = x.domain),
dash AS (SELECT *, votes + n_comments * 1.5 + depth * 1.2 AS engagement,
                CASE WHEN kl_divergence < 1.0 THEN 'Típico' WHEN kl_divergence < 1.45 THEN 'Moderado'
                     ELSE 'Atípico' END AS content_type FROM kl),
filt AS (SELECT * FROM dash WHERE domain = '{FILTER_DOMAIN}' AND kl_divergence >= 0.05)"""

_D = [CONTENT_TOPICS_SQL, _KL]


def _q(body: str, *extra: str) -> str:
    return with_ctes(*_D, *extra, body=body)


def _cols(*cs):
    return ", ".join(f"{R(c)} AS {c}" for c in cs)


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS col_a, '{b}' AS col_b, {R(f'corr({a}, {b})')} AS corr FROM dash" for a in KL_COLS for b in KL_COLS)

_BOX = """box AS (
  SELECT b.{g}, b.q1, b.median, b.q3,
         min(CASE WHEN v >= b.q1 - 1.5 * (b.q3 - b.q1) THEN v END) AS whisker_lo,
         max(CASE WHEN v <= b.q3 + 1.5 * (b.q3 - b.q1) THEN v END) AS whisker_hi, CAST(count(*) AS BIGINT) AS n
  FROM (SELECT {g}, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median,
               quantile_cont({v}, 0.75) AS q3 FROM {src} WHERE {v} IS NOT NULL GROUP BY {g}) b
  JOIN (SELECT {g}, CAST({v} AS DOUBLE) AS v FROM {src} WHERE {v} IS NOT NULL) d ON d.{g} = b.{g}
  GROUP BY b.{g}, b.q1, b.median, b.q3)"""


def _hist(src: str, v: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    return f"""
  SELECT {g}CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS count, {R('min(mn + bin * w)')} AS lo FROM (
    SELECT *, CASE WHEN mx > mn THEN least(floor(({v} - mn) / w), 19) ELSE 0 END AS bin FROM (
      SELECT *, (SELECT min({v}) FROM {src} WHERE {v} IS NOT NULL) AS mn,
                (SELECT max({v}) FROM {src} WHERE {v} IS NOT NULL) AS mx,
                ((SELECT max({v}) FROM {src} WHERE {v} IS NOT NULL) - (SELECT min({v}) FROM {src} WHERE {v} IS NOT NULL)) / 20.0 AS w
      FROM {src} WHERE {v} IS NOT NULL))
  GROUP BY {g}bin"""


_DOMAIN_SQL = """dd AS (
  SELECT id, "user", coalesce((SELECT list_sort(list(DISTINCT tx.domain)) FROM unnest(coalesce(tags, []::VARCHAR[])) AS u(t)
                                JOIN tx ON tx.tag = lower(u.t)), ['General']) AS domains FROM discussions)"""


def _mode_sql(c: str) -> str:
    return (f"SELECT '{c}' AS column, CAST(v AS VARCHAR) AS mode FROM (SELECT {c} AS v, count(*) AS n FROM events "
            f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v ASC LIMIT 1)")


def _oracle():
    from agora.operators import domains as D
    flags = ", ".join(f"list_contains(domains, '{d}') AS {_flag(d)}" for d in ALL_DOMAINS)
    flag_names = ", ".join(_flag(d) for d in ALL_DOMAINS)
    levels = list(K.EXPERTISE_RANKS)
    piv = ", ".join(f"{R(f'avg(votes) FILTER (WHERE expertise = {chr(39)}{lv}{chr(39)})')} AS {lv}" for lv in levels)
    return {
        "kl_fixed": with_ctes(CONTENT_TOPICS_SQL, body=f"""SELECT id,
            {R(kl_divergence_sql('topic_dist', '[0.25, 0.25, 0.25, 0.25]'))} AS kl_uniform,
            {R(kl_divergence_sql('[0.25, 0.25, 0.25, 0.25]', 'topic_dist'))} AS kl_reverse FROM content_topics"""),
        "domain_mean_topics": _q(f"SELECT domain, CAST(topic AS BIGINT) AS topic, {R('mean_prob')} AS mean_prob FROM dm"),
        "kl_content_domain": _q(f"""SELECT title, id, domain, {R('kl_divergence')} AS kl_divergence, "user", votes,
                                   n_comments, depth FROM kl"""),
        "kl_bands": _q(f"""SELECT id, domain, {R('engagement')} AS engagement, content_type,
                          {R("CAST(replace(CAST(round(kl_divergence, 6) AS VARCHAR), '.', ',') AS VARCHAR)".replace(
                              "CAST(replace", "TRY_CAST(replace(replace").replace("AS VARCHAR), '.', ',') AS VARCHAR)",
                              "AS VARCHAR), '.', ','), ',', '.') AS DOUBLE)"))} AS kl_parsed FROM dash"""),
        "domain_stats": _q(f"""SELECT domain, CAST(count(*) AS BIGINT) AS count, {R('avg(kl_divergence)')} AS avg_kl,
            {R('stddev_samp(kl_divergence)')} AS std_kl, {R('min(kl_divergence)')} AS min_kl, {R('max(kl_divergence)')} AS max_kl,
            {R('avg(engagement)')} AS avg_engagement,
            CAST(count(*) FILTER (WHERE kl_divergence < 1.0) AS BIGINT) AS typical_count,
            CAST(count(*) FILTER (WHERE kl_divergence >= 1.45) AS BIGINT) AS atypical_count FROM dash GROUP BY domain"""),
        "radar_norm": _q(f"""SELECT domain, {R('a / max(a) OVER ()')} AS avg_kl_norm, {R('e / max(e) OVER ()')} AS avg_engagement_norm,
            {R('c / max(c) OVER ()')} AS count_norm FROM (SELECT domain, avg(kl_divergence) AS a, avg(engagement) AS e,
            CAST(count(*) AS DOUBLE) AS c FROM dash GROUP BY domain)"""),
        "header_metrics": _q(f"""SELECT {R('avg(kl_divergence)')} AS avg_kl,
            {R('avg(kl_divergence) - (SELECT avg(kl_divergence) FROM dash)')} AS delta_kl,
            CAST(count(*) FILTER (WHERE kl_divergence < 0.5) AS BIGINT) AS typical_count,
            CAST(count(*) FILTER (WHERE kl_divergence >= 1.5) AS BIGINT) AS atypical_count,
            CAST(count(DISTINCT domain) AS BIGINT) AS n_domains FROM filt"""),
        "band_pct": _q(f"""SELECT {R('100.0 * count(*) FILTER (WHERE kl_divergence < 0.5) / nullif(count(*), 0)')} AS typical_pct,
            {R('100.0 * count(*) FILTER (WHERE kl_divergence >= 0.5 AND kl_divergence < 1.5) / nullif(count(*), 0)')} AS moderate_pct,
            {R('100.0 * count(*) FILTER (WHERE kl_divergence >= 1.5) / nullif(count(*), 0)')} AS atypical_pct FROM filt"""),
        "range_filter": _q(f"""SELECT id, domain, {R('kl_divergence')} AS kl_divergence FROM dash
            WHERE domain = '{FILTER_DOMAIN}' AND kl_divergence IS NOT NULL"""),
        "filter_bounds": _q(f"""SELECT {R('min(kl_divergence)')} AS kl_min, {R('max(kl_divergence)')} AS kl_max,
            CAST(count(DISTINCT domain) AS BIGINT) AS n_domains FROM dash"""),
        "top_atypical": _q(f"""SELECT title, domain, {R('kl_divergence')} AS kl_divergence, votes, n_comments, "user" FROM dash
            ORDER BY round(kl_divergence, 6) DESC NULLS LAST, id, domain LIMIT 10"""),
        "top_typical": _q(f"""SELECT title, domain, {R('kl_divergence')} AS kl_divergence, votes, n_comments, "user" FROM dash
            ORDER BY round(kl_divergence, 6) ASC NULLS LAST, id, domain LIMIT 10"""),
        "corr_matrix": _q(_CORR),
        "trend_line": _q(f"""SELECT id, domain, {R('kl_divergence')} AS kl_divergence,
            {R('(SELECT regr_intercept(engagement, kl_divergence) FROM dash) + (SELECT regr_slope(engagement, kl_divergence) FROM dash) * kl_divergence')} AS fitted,
            {R('(SELECT regr_slope(engagement, kl_divergence) FROM dash)')} AS slope,
            {R('(SELECT regr_intercept(engagement, kl_divergence) FROM dash)')} AS intercept FROM dash"""),
        "box_domain": _q(f"SELECT domain, {_cols('q1', 'median', 'q3', 'whisker_lo', 'whisker_hi')}, n FROM box",
                         _BOX.format(g="domain", v="kl_divergence", src="dash")),
        "kl_quantiles": _q(" UNION ALL ".join(
            f"SELECT {R(f'CAST({p} AS DOUBLE)')} AS prob, {R(f'quantile_cont(kl_divergence, {p})')} AS q FROM dash"
            for p in [0.25, 0.5, 0.75, 0.9])),
        "kl_describe": _q(f"""SELECT CAST(count(kl_divergence) AS BIGINT) AS count, {R('avg(kl_divergence)')} AS mean,
            {R('stddev_samp(kl_divergence)')} AS std, {R('min(kl_divergence)')} AS min, {R('max(kl_divergence)')} AS max FROM dash"""),
        "histogram20": _hist("events", "value"),
        "histogram_bands": _q(_hist("dash", "kl_divergence", "content_type")),
        "kde_grid": """
          WITH v AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
          st AS (SELECT CAST(count(*) AS DOUBLE) AS n, stddev_samp(x) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h,
                        min(x) AS mn, (max(x) - min(x)) / 199.0 AS step FROM v),
          dv AS (SELECT x, count(*) AS c FROM v GROUP BY x)
          SELECT CAST(g.i AS BIGINT) AS point, """ + R("st.mn + g.i * st.step") + """ AS x,
                 """ + R("sum(dv.c * exp(-0.5 * pow((st.mn + g.i * st.step - dv.x) / st.h, 2))) / (st.n * st.h * sqrt(2 * pi()))") + """ AS density
          FROM dv, st, generate_series(0, 199) AS g(i) GROUP BY g.i, st.mn, st.step, st.n, st.h""",
        "value_stats": f"""SELECT event_type, CAST(count(value) AS BIGINT) AS count, {R('avg(value)')} AS mean,
            {R('stddev_samp(value)')} AS std, {R('min(value)')} AS min, {R('max(value)')} AS max,
            {R('quantile_cont(value, 0.25)')} AS p25, {R('quantile_cont(value, 0.5)')} AS p50,
            {R('quantile_cont(value, 0.75)')} AS p75 FROM events GROUP BY event_type""",
        "min_kl_per_user": _q(f"""SELECT "user", id, domain, {R('kl_divergence')} AS kl_divergence FROM (
            SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY round(kl_divergence, 9), id, domain) AS rn
            FROM kl WHERE "user" IS NOT NULL AND kl_divergence IS NOT NULL) WHERE rn = 1"""),
        "pivot_mean": with_ctes(V.DISCUSSIONS, body=f"""SELECT medal, {piv} FROM discussions
            WHERE medal IS NOT NULL AND expertise IS NOT NULL GROUP BY medal"""),
        "domain_membership": with_ctes(V.DISCUSSIONS, D.taxonomy_cte("tx"), _DOMAIN_SQL,
                                       body=f"SELECT id, {flags} FROM dd"),
        "domain_subsets": with_ctes(V.DISCUSSIONS, D.taxonomy_cte("tx"), _DOMAIN_SQL,
                                    body=f"SELECT {flag_names}, CAST(count(*) AS BIGINT) AS size FROM (SELECT {flags} FROM dd) GROUP BY ALL"),
        "param_mode": " UNION ALL ".join(f"({_mode_sql(c)})" for c in ["user_id", "event_type", "value"]),
    }


ORACLE = _oracle()
