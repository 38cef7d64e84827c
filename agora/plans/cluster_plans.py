"""Registered queries: standardization, DBSCAN, cluster metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.operators import cluster as C
from agora.operators import neighbors as N
from agora.plans.common import R, r6, with_ctes
from agora.plans.graph_plans import _CC
from agora.sources import tables as S

COLS = ["x0", "x1", "x2"]
#: with these the stand-in points fall into several clusters and noise
EPS, MIN_SAMPLES = 0.4, 5


def _std(spark, sf):
    return C.standardize(S.points(spark, sf, 3), COLS)


def q_standardize(spark, sf):
    return _std(spark, sf).select("pid", *[r6(c).alias(c) for c in COLS])


def labels(spark, sf):
    return C.dbscan(_std(spark, sf), COLS, EPS, MIN_SAMPLES)


def q_dbscan(spark, sf):
    return labels(spark, sf)


def q_cluster_sizes(spark, sf):
    return C.cluster_sizes(labels(spark, sf)).select("cluster", F.col("size").cast("long").alias("size"))


def q_noise_stats(spark, sf):
    n = C.noise_stats(labels(spark, sf))
    return n.select(F.col("noise_points").cast("long").alias("noise_points"), r6("noise_ratio").alias("noise_ratio"),
                    F.col("n_clusters").cast("long").alias("n_clusters"))


def q_calinski(spark, sf):
    v = C.calinski_harabasz(_std(spark, sf), COLS)
    return spark.createDataFrame([(None if v is None else round(v, 6),)], "calinski double")


def q_silhouette(spark, sf):
    s = C.silhouette_squared(_std(spark, sf), COLS)
    return s.agg(r6(F.avg("silhouette")).alias("silhouette_sq"))


def q_improvement(spark, sf):
    ev = S.table(spark, sf, "events").groupBy("event_type").agg(F.min("value").alias("initial"),
                                                                F.max("value").alias("final"))
    return ev.select("event_type", r6(C.improvement_pct("initial", "final")).alias("improvement_pct"))


def q_nn_distance(spark, sf):
    """Distance from each of m quasi-uniform points to its nearest data point."""
    p = _std(spark, sf).select("pid", *COLS)
    b = p.agg(*[F.min(c) for c in COLS], *[F.max(c) for c in COLS]).first()
    bounds = [(b[i], b[i + 3]) for i in range(3)]
    n = p.count()
    m = int(K.HOPKINS_SAMPLE_RATIO * n)
    q = N.weyl_points(spark, m, bounds).toDF("qid", *COLS)
    return N.nearest_distance(q, p, COLS, 0.25).select("qid", r6("dist").alias("dist"))


def q_hopkins_fixed(spark, sf):
    h = N.hopkins(_std(spark, sf).select("pid", *COLS), COLS, K.HOPKINS_SAMPLE_RATIO)
    return spark.createDataFrame([(round(h, 6),)], "hopkins double")


QUERIES = {
    "standardize": q_standardize,
    "nn_distance": q_nn_distance,
    "hopkins_fixed": q_hopkins_fixed,
    "dbscan": q_dbscan,
    "cluster_sizes": q_cluster_sizes,
    "noise_stats": q_noise_stats,
    "calinski": q_calinski,
    "silhouette": q_silhouette,
    "improvement": q_improvement,
}

_PTS = """pts0 AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x0, CAST(embedding[2] AS DOUBLE) AS x1,
                      CAST(embedding[3] AS DOUBLE) AS x2, CAST(label AS BIGINT) AS cluster FROM embeddings),
pts AS (SELECT pid, cluster,
   (x0 - (SELECT avg(x0) FROM pts0)) / coalesce(nullif((SELECT stddev_pop(x0) FROM pts0), 0), 1.0) AS x0,
   (x1 - (SELECT avg(x1) FROM pts0)) / coalesce(nullif((SELECT stddev_pop(x1) FROM pts0), 0), 1.0) AS x1,
   (x2 - (SELECT avg(x2) FROM pts0)) / coalesce(nullif((SELECT stddev_pop(x2) FROM pts0), 0), 1.0) AS x2 FROM pts0)"""

_DB = f"""pairs AS (SELECT a.pid AS a, b.pid AS b FROM pts a JOIN pts b
            ON (a.x0 - b.x0) * (a.x0 - b.x0) + (a.x1 - b.x1) * (a.x1 - b.x1) + (a.x2 - b.x2) * (a.x2 - b.x2) <= {EPS ** 2!r}),
core AS (SELECT a AS node FROM pairs GROUP BY a HAVING count(*) >= {MIN_SAMPLES}),
cedges AS (SELECT a AS src, b AS dst FROM pairs WHERE a IN (SELECT node FROM core) AND b IN (SELECT node FROM core)),
{_CC.replace('{E}', 'cedges').replace('{N}', 'core')},
cid AS (SELECT label, dense_rank() OVER (ORDER BY label) - 1 AS cluster FROM (SELECT DISTINCT label FROM labels)),
core_lab AS (SELECT l.node AS pid, c.cluster FROM labels l JOIN cid c USING (label)),
border AS (SELECT p.a AS pid, min(c.cluster) AS cluster FROM pairs p JOIN core_lab c ON c.pid = p.b
           WHERE p.a NOT IN (SELECT pid FROM core_lab) GROUP BY p.a),
db AS (SELECT p.pid, CAST(coalesce(c.cluster, b.cluster, -1) AS BIGINT) AS cluster
       FROM pts p LEFT JOIN core_lab c ON c.pid = p.pid LEFT JOIN border b ON b.pid = p.pid)"""

def _weyl_sql(m_expr: str) -> str:
    w = N.WEYL
    return f"""bnd AS (SELECT min(x0) AS l0, max(x0) AS h0, min(x1) AS l1, max(x1) AS h1, min(x2) AS l2, max(x2) AS h2,
                  count(*) AS n FROM pts),
uq AS (SELECT g.i AS qid,
              l0 + (((g.i + 1) * {w[0]!r}) - floor((g.i + 1) * {w[0]!r})) * (h0 - l0) AS x0,
              l1 + (((g.i + 1) * {w[1]!r}) - floor((g.i + 1) * {w[1]!r})) * (h1 - l1) AS x1,
              l2 + (((g.i + 1) * {w[2]!r}) - floor((g.i + 1) * {w[2]!r})) * (h2 - l2) AS x2
       FROM bnd, generate_series(0, {m_expr} - 1) AS g(i)),
ud AS (SELECT q.qid, sqrt(min((q.x0 - p.x0) ^ 2 + (q.x1 - p.x1) ^ 2 + (q.x2 - p.x2) ^ 2)) AS dist
       FROM uq q, pts p GROUP BY q.qid)"""


_M = f"CAST(floor({K.HOPKINS_SAMPLE_RATIO} * (SELECT count(*) FROM pts)) AS BIGINT)"
_HOP = f"""ws AS (SELECT pid FROM pts ORDER BY ((pid + 1) * {N.WEYL[3]!r}) - floor((pid + 1) * {N.WEYL[3]!r}), pid LIMIT {_M}),
wd AS (SELECT s.pid, sqrt(min((a.x0 - p.x0) ^ 2 + (a.x1 - p.x1) ^ 2 + (a.x2 - p.x2) ^ 2)) AS dist
       FROM ws s JOIN pts a ON a.pid = s.pid JOIN pts p ON p.pid <> s.pid GROUP BY s.pid)"""

ORACLE = {
    "nn_distance": with_ctes(_PTS, _weyl_sql(_M), body=f"SELECT qid, {R('dist')} AS dist FROM ud"),
    "hopkins_fixed": with_ctes(_PTS, _weyl_sql(_M), _HOP,
                               body=f"SELECT {R('(SELECT sum(dist) FROM ud) / ((SELECT sum(dist) FROM ud) + (SELECT sum(dist) FROM wd))')} AS hopkins"),
    "standardize": with_ctes(_PTS, body=f"SELECT pid, {R('x0')} AS x0, {R('x1')} AS x1, {R('x2')} AS x2 FROM pts"),
    "dbscan": with_ctes(_PTS, _DB, recursive=True, body="SELECT pid, cluster FROM db"),
    "cluster_sizes": with_ctes(_PTS, _DB, recursive=True,
                               body="SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM db WHERE cluster <> -1 GROUP BY cluster"),
    "noise_stats": with_ctes(_PTS, _DB, recursive=True, body=f"""SELECT CAST(count(*) FILTER (WHERE cluster = -1) AS BIGINT) AS noise_points,
        {R('count(*) FILTER (WHERE cluster = -1) / count(*)')} AS noise_ratio,
        CAST(count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS BIGINT) AS n_clusters FROM db"""),
    "calinski": with_ctes(_PTS, """cm AS (SELECT cluster, count(*) AS n, avg(x0) AS m0, avg(x1) AS m1, avg(x2) AS m2 FROM pts GROUP BY cluster),
        g AS (SELECT avg(x0) AS g0, avg(x1) AS g1, avg(x2) AS g2, count(*) AS n, (SELECT count(*) FROM cm) AS k FROM pts),
        bw AS (SELECT (SELECT sum(cm.n * ((m0 - g0) ^ 2 + (m1 - g1) ^ 2 + (m2 - g2) ^ 2)) FROM cm, g) AS b,
                      (SELECT sum((p.x0 - c.m0) ^ 2 + (p.x1 - c.m1) ^ 2 + (p.x2 - c.m2) ^ 2) FROM pts p JOIN cm c USING (cluster)) AS w)""",
                          body=f"SELECT {R('(b / (k - 1)) / (w / (n - k))')} AS calinski FROM bw, g"),
    "silhouette": with_ctes(_PTS, """d AS (SELECT a.pid, a.cluster AS ca, b.cluster AS cb,
              avg((a.x0 - b.x0) ^ 2 + (a.x1 - b.x1) ^ 2 + (a.x2 - b.x2) ^ 2) AS md, count(*) AS nb
            FROM pts a JOIN pts b ON true GROUP BY a.pid, a.cluster, b.cluster),
        s AS (SELECT pid, max(CASE WHEN ca = cb THEN md * nb / nullif(nb - 1, 0) END) AS a,
                     min(CASE WHEN ca <> cb THEN md END) AS b, max(CASE WHEN ca = cb THEN nb END) AS n_own FROM d GROUP BY pid)""",
                            body=f"SELECT {R('avg(CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END)')} AS silhouette_sq FROM s"),
    "improvement": f"""SELECT event_type, {R('CASE WHEN i IS NULL OR i = 0 THEN NULL ELSE 100.0 * (f - i) / abs(i) END')} AS improvement_pct
        FROM (SELECT event_type, min(value) AS i, max(value) AS f FROM events GROUP BY event_type)""",
}
