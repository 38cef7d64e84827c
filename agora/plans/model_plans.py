"""Registered queries: randomized / iterative models (no SQL twin; checked by
properties in tests), dump ingest and inference hooks."""

from __future__ import annotations

import inspect
import uuid

from pyspark.sql import functions as F

from agora.functions import constants as K
from agora.functions import text as T
from agora.operators import cluster as C
from agora.operators import discussion_models as DM
from agora.operators import domains as D
from agora.operators import mixture as MX
from agora.operators import models as M
from agora.operators import neighbors as N
from agora.operators import phrases as P
from agora.operators import quality as Q
from agora.operators import weights as W
from agora.plans import quality_plans as QP
from agora.plans import sql_views as V
from agora.plans import text_plans as TP
from agora.plans import cluster_plans as CP
from agora.plans.cluster_plans import COLS, _std
from agora.plans.common import R, r6, with_ctes
from agora.session import cut_lineage, ensure_checkpoint_dir
from agora.sources import forum_json as J
from agora.sources import tables as S
from agora.sources.scored import TASKS


def _docs_tokens(spark, sf):
    return S.text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.analysis_tokens("text").alias("toks"))


def q_lda_topics(spark, sf):
    cv, model, bow = M.fit_lda(_docs_tokens(spark, sf), "toks")
    return M.topic_terms(cv, model, bow, 5)


def q_lda_doc_topics(spark, sf):
    cv, model, bow = M.fit_lda(_docs_tokens(spark, sf), "toks")
    return M.doc_topics(model, bow).select("doc_id", F.array_join(
        F.transform("topic_dist", lambda x: F.format_string("%.4f", x)), " ").alias("topic_dist"))


def q_gmm(spark, sf):
    _, pred, stats = M.fit_gmm(_std(spark, sf).drop("cluster"), COLS)
    return pred.select("pid", F.col("cluster").cast("long").alias("cluster"))


def q_gmm_fit(spark, sf):
    _, _, s = M.fit_gmm(_std(spark, sf).drop("cluster"), COLS)
    return spark.createDataFrame([(s["log_likelihood"], s["bic"], s["aic"])], "log_likelihood double, bic double, aic double")


def q_dbscan_objective(spark, sf):
    pts = _std(spark, sf)
    lab = C.dbscan(pts, COLS, CP.EPS, CP.MIN_SAMPLES)
    ns = C.noise_stats(lab).first()
    sil = C.silhouette_squared(pts.drop("cluster").join(lab, "pid"), COLS).agg(F.avg("silhouette")).first()[0]
    obj = C.objective(ns["n_clusters"], ns["noise_ratio"], sil)
    return spark.createDataFrame([(int(ns["n_clusters"]), float(ns["noise_ratio"]), sil, float(obj))],
                                 "n_clusters long, noise_ratio double, silhouette_sq double, objective double").select(
        "n_clusters", *[r6(c).alias(c) for c in ("noise_ratio", "silhouette_sq", "objective")])


def _dump_tables(spark, sf):
    d = S.discussions(spark, sf).withColumn("content", F.col("title"))
    c = S.comments(spark, sf).select(
        "discussion_id", F.concat_ws("-", F.col("c_order.k2"), F.col("c_order.k3"), F.col("c_order.k4"),
                                                  F.col("c_order.k5").cast("string")).alias("cid"),
        "user", F.lit("see https://x.org now").alias("content"), "votes", "medal", "expertise", "is_appreciation",
        "is_deleted", "datetime")
    return d, c


def _dump(spark, sf):
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forum-dump-{uuid.uuid4().hex}"
    J.write_line_dump(*_dump_tables(spark, sf), path)
    return J.read_dump_objects(spark, path, layout="lines", keep_raw=False)


def q_json_ingest(spark, sf):
    d = J.discussions_from_dump(_dump(spark, sf))
    return d.select("id", "title", "user", "votes", "n_comments", F.array_join("domains", "|").alias("domains"))


def q_json_split(spark, sf):
    """The same tables written as a few JSON objects of whole
    discussions, each file split over tasks."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forum-objects-{uuid.uuid4().hex}"
    J.write_object_dump(*_dump_tables(spark, sf), path)
    objs = J.read_dump_objects(spark, path, layout="split", keep_raw=False)
    d = J.discussions_from_dump(objs)
    return d.select("id", "title", "user", "votes", "n_comments", F.array_join("domains", "|").alias("domains"))


def q_json_comments(spark, sf):
    c = J.comments_from_dump(_dump(spark, sf))
    return c.select("discussion_id", "id", "user", "votes", "is_deleted", "content")


def q_infer_hook(spark, sf):
    docs = S.text_table(spark, sf, "documents", "doc_id", "text")
    lab = Q.infer_labels(docs, "text", Q.deterministic_scorer(TASKS), TASKS)
    return lab.select("doc_id", r6(Q.weighted_score()).alias("score"))


def q_translate_hook(spark, sf):
    """Q8 with a stand-in translator that knows one word."""
    docs = S.text_table(spark, sf, "documents", "doc_id", "text")
    out = Q.translate_column(docs, "text", "text_de", lambda texts: texts.str.replace("the ", "die ", regex=False))
    return out.select("doc_id", F.md5("text_de").alias("digest"), F.length("text_de").cast("long").alias("n_chars"))


N_TRIALS = 20
GATE = 0.5


def _deliq_points(spark, sf):
    """The merged DELIQ rows (J3, J4, P2-P5), written once."""
    m = QP.merged(spark, sf)
    num = lambda c: F.col(c).cast("double").alias(c)
    return cut_lineage(m.select(F.xxhash64(*QP.KEY).alias("pid"), *[num(c) for c in (*W.PARTS, *W.CLUSTER_COLS)]))


def q_weight_search(spark, sf):
    """C9 round 0: the metrics of every start, for both algorithms."""
    pts = _deliq_points(spark, sf)
    rows = [r for a in W.ALGORITHMS for r in W.evaluate(pts, W.dirichlet_candidates(N_TRIALS), a)]
    return spark.createDataFrame([tuple(r) for r in rows], "algorithm string, candidate long, w0 double, w1 double, w2 double, n long, n_clusters long, silhouette_score double, "
                                      "calinski_harabasz_score double, noise_points long, noise_ratio double, bic_score double, aic_score double, objective double")


def q_weight_comparison(spark, sf):
    """C13 gate (Hopkins on the initial DELIQ features), then the search and
    the table before/after, a row per method, algorithm and metric; a closed
    gate leaves one row of nulls."""
    pts = _deliq_points(spark, sf)
    feats = pts.select("pid", Q.deliq_score().alias("deliq_score"), "votes", "n_comments")
    h = float(N.hopkins(feats, ["deliq_score", "votes", "n_comments"], K.HOPKINS_SAMPLE_RATIO))
    return W.gated(spark, h, GATE, lambda: W.search(pts, N_TRIALS))


def q_gmm_diag(spark, sf):
    """C4 + C5: diagonal and full mixtures of the standardized DELIQ features."""
    pts = _deliq_points(spark, sf)
    cols = ["deliq_score", "n_comments", "votes"]
    z = C.standardize(pts.select("pid", Q.deliq_score().alias("deliq_score"), "n_comments", "votes"), cols).persist()
    src = MX.grouped(z, cols)
    starts, blocks = MX.seeds(src, cols, 3, K.RANDOM_STATE), MX.packed(src, cols)
    rows = []
    for kind in ("diag", "full"):
        m = MX.fit_mixtures(z, cols, 3, kind, starts=starts, blocks=blocks)[0]
        rows += [(kind, j, float(m.weights[j]), m.means[j].tolist(), m.bic(), m.aic()) for j in range(3)]
    return spark.createDataFrame(rows, "covariance string, component int, weight double, mean array<double>, bic_score double, aic_score double")


def q_metric_comparison(spark, sf):
    """C10 + C11 arithmetic: seven figures of every event type before and after
    the middle of the table's time span."""
    ev = S.table(spark, sf, "events").withColumn("late", F.col("event_id") % 2 == 1)
    figures = {
        "n_clusters": lambda x: F.count_distinct(x["user_id"]), "silhouette_score": lambda x: F.min(x["value"]), "calinski_harabasz_score": lambda x: F.max(x["value"]),
        "noise_points": lambda x: F.count(x["value"]), "noise_ratio": lambda x: F.sum(F.when(x["value"] > 1e6, 1.0)), "bic_score": lambda x: F.sum(x["value"]), "aic_score": lambda x: F.min(F.when(x["value"] < 0, x["value"]).otherwise(0.0)),
    }
    when = lambda late: {c: F.when(F.col("late") == late, F.col(c)) for c in ("user_id", "value")}
    wide = ev.groupBy("event_type").agg(*[f(when(late)).alias(f"{side}_{m}") for m, f in figures.items() for side, late in (("initial", False), ("final", True))])
    out = W.comparison_rows(wide, ["event_type"], list(figures))
    return out.select("event_type", "metric", *[r6(c).alias(c) for c in ("initial", "final", "difference", "improvement_pct")])


TUNING_CANDIDATES = 2


def q_lda_tuning(spark, sf):
    """Tuning on all documents that have enough content
    (T17: at least 5 tuning tokens)."""
    d = S.text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.tuning_tokens("text").alias("toks"))
    best, results, cv, bow = M.tune_lda(spark, T.once(d, "toks").where(F.size("toks") >= 5), "toks", TUNING_CANDIDATES)
    return M.flatten_tuning(spark, best, cv, bow)


def q_discussion_topics(spark, sf):
    """M1-M3: one four-topic model per document over its phrased tokens."""
    t = DM.discussion_topics(P.phrase_tokens(_docs_tokens(spark, sf), "doc_id", "toks"), "doc_id", "phrased")
    return t.select("doc_id", F.array_join(F.transform("topics", lambda x: DM.format_terms(x["terms"])), " || ").alias("topics"),
                    F.transform(DM.listed(F.col("topic_dist")), lambda p: F.round(p, 6)).alias("topic_dist"))


def q_discussion_tuning(spark, sf):
    """The best of the drawn models of every document, flattened."""
    d = S.text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.tuning_tokens("text").alias("toks"))
    phrased = P.phrase_tokens(T.once(d, "toks").where(F.size("toks") >= 5), "doc_id", "toks")
    return DM.flatten_topics(cut_lineage(DM.tune_discussions(phrased, "doc_id", "phrased", TUNING_CANDIDATES)), "doc_id")


def q_topic_format(spark, sf):
    """M2: the five most frequent tokens of every document with their shares,
    formatted like a topic."""
    d = S.text_table(spark, sf, "documents", "doc_id", "text").select("doc_id", T.simple_tokens("text").alias("toks"))
    # token arrays are shuffled once; counts and lists of a document then lie in one partition
    n = d.repartition("doc_id").select("doc_id", F.explode("toks").alias("term"))
    n = n.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("doc_id").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "term"))).alias("t"))
    terms = F.transform(F.slice("t", 1, 5), lambda x: F.struct(x["term"].alias("term"), (-x["n"] / F.col("total")).alias("w")))
    return total.select("doc_id", DM.format_terms(terms).alias("terms"))


QUERIES = {
    "discussion_topics": q_discussion_topics,
    "discussion_tuning": q_discussion_tuning,
    "topic_format": q_topic_format,
    "lda_tuning": q_lda_tuning,
    "gmm_diag": q_gmm_diag,
    "metric_comparison": q_metric_comparison,
    "weight_search": q_weight_search,
    "weight_comparison": q_weight_comparison,
    "lda_topics": q_lda_topics,
    "lda_doc_topics": q_lda_doc_topics,
    "gmm": q_gmm,
    "gmm_fit": q_gmm_fit,
    "dbscan_objective": q_dbscan_objective,
    "json_ingest": q_json_ingest,
    "json_split": q_json_split,
    "json_comments": q_json_comments,
    "infer_hook": q_infer_hook,
    "translate_hook": q_translate_hook,
}
_CID = """(CAST(k2 AS VARCHAR) || '-' || CAST(k3 AS VARCHAR) || '-' || CAST(k4 AS VARCHAR) || '-' || CAST(k5 AS VARCHAR))"""

_BOUND = inspect.signature(Q.weighted_score).parameters["bound"].default


def _label_sql(k: int) -> str:
    """The stand-in scorer's arg-max of task number ``k``."""
    logits = f"[(n + {k}) % 5, (w + {2 * k}) % 5, (n + w) % 3, {k % 4}]"
    return f"(list_position({logits}, list_max({logits})) - 1)"


_FIGURES = {"n_clusters": "count(DISTINCT user_id)", "silhouette_score": "min(value)", "calinski_harabasz_score": "max(value)", "noise_points": "count(value)",
            "noise_ratio": "sum(CASE WHEN value > 1e6 THEN 1.0 END)", "bic_score": "sum(value)", "aic_score": "min(CASE WHEN value < 0 THEN value ELSE 0 END)"}
_INGEST = with_ctes(V.DISCUSSIONS, V.COMMENTS, D.taxonomy_cte("tx"), D.taxonomy_cte("kw", single_token=True), body="""
        SELECT CAST(id AS VARCHAR) AS id, title, "user", votes, CAST(coalesce(n, 0) AS BIGINT) AS n_comments,
               CASE WHEN tags IS NOT NULL THEN """ + TP._BY_TAGS + " ELSE " + TP._by_content("kw", "title", "title") + """ END AS domains
        FROM discussions LEFT JOIN (SELECT discussion_id, count(*) AS n FROM comments GROUP BY discussion_id) c
          ON discussion_id = id""")

ORACLE: dict[str, str] = {
    "dbscan_objective": with_ctes(CP._PTS, CP._DB, """q AS (SELECT p.pid, db.cluster, x0, x1, x2 FROM pts p JOIN db USING (pid) WHERE db.cluster <> -1),
        d AS (SELECT a.pid, a.cluster AS ca, b.cluster AS cb, avg((a.x0 - b.x0) ^ 2 + (a.x1 - b.x1) ^ 2 + (a.x2 - b.x2) ^ 2) AS md, count(*) AS nb
              FROM q a JOIN q b ON true GROUP BY a.pid, a.cluster, b.cluster),
        s AS (SELECT pid, max(CASE WHEN ca = cb THEN md * nb / nullif(nb - 1, 0) END) AS a, min(CASE WHEN ca <> cb THEN md END) AS b,
                     max(CASE WHEN ca = cb THEN nb END) AS n_own FROM d GROUP BY pid),
        m AS (SELECT (SELECT count(DISTINCT cluster) FROM q) AS n_clusters, (SELECT count(*) FILTER (cluster = -1) / count(*) FROM db) AS noise_ratio,
                     (SELECT avg(CASE WHEN n_own > 1 THEN (b - a) / greatest(a, b) ELSE 0.0 END) FROM s) AS silhouette_sq)""", recursive=True, body=f"""
        SELECT n_clusters, {R("noise_ratio")} AS noise_ratio, {R("silhouette_sq")} AS silhouette_sq,
               {R("CASE WHEN n_clusters < 2 OR noise_ratio > 0.5 THEN 10.0 ELSE -coalesce(silhouette_sq, -1.0) + 2.0 * noise_ratio END")} AS objective FROM m"""),
    "metric_comparison": "WITH h AS (SELECT event_type, event_id % 2 = 1 AS late, " + ", ".join(f"CAST({x} AS DOUBLE) AS {m}" for m, x in _FIGURES.items())
    + " FROM events GROUP BY ALL), l AS (" + " UNION ALL ".join(f"SELECT event_type, late, '{m}' AS metric, {m} AS v FROM h" for m in _FIGURES)
    + f"""), p AS (SELECT event_type, metric, max(v) FILTER (NOT late) AS initial, max(v) FILTER (late) AS final FROM l GROUP BY ALL)
        SELECT event_type, metric, {R("initial")} AS initial, {R("final")} AS final, {R("(final - initial)")} AS difference,
               {R("CASE WHEN initial <> 0 THEN 100.0 * (final - initial) / abs(initial) END")} AS improvement_pct FROM p""",
    "topic_format": f"""
        WITH tk AS (SELECT doc_id, unnest({T.simple_tokens_sql("text")}) AS term FROM documents WHERE text IS NOT NULL),
        n AS (SELECT doc_id, term, count(*) AS n FROM tk GROUP BY doc_id, term),
        s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS total,
                     row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rk FROM n)
        SELECT doc_id, string_agg(printf('%s (%.2f)', term, round_even(n / total, 2)), ' | ' ORDER BY rk) AS terms
        FROM s WHERE rk <= 5 GROUP BY doc_id""",
    "json_comments": with_ctes(V.COMMENTS, body=f"""
        SELECT CAST(discussion_id AS VARCHAR) AS discussion_id, {_CID} AS id, "user", votes, is_deleted,
               'see  URL  now' AS content FROM comments"""),
    "json_ingest": _INGEST,
    "json_split": _INGEST,
    "translate_hook": """SELECT doc_id, md5(replace(text, 'the ', 'die ')) AS digest, length(replace(text, 'the ', 'die ')) AS n_chars FROM documents WHERE text IS NOT NULL""",
    "infer_hook": f"""
        SELECT doc_id, {R("(" + " + ".join(f"{w!r} * {_label_sql(k)}" for k, (_, w) in enumerate(K.QUALITY_TASK_WEIGHTS))
                          + f" - {K.QUALITY_SCORE_MIN!r}) / {K.QUALITY_SCORE_MAX - K.QUALITY_SCORE_MIN!r} * {_BOUND!r}")} AS score
        FROM (SELECT doc_id, length(text) AS n, length(text) - length(replace(text, ' ', '')) AS w
              FROM documents WHERE text IS NOT NULL)""",
}
