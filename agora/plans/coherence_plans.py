"""Registered queries: windowed co-occurrence counts and c_v coherence.

Topics are a deterministic stand-in for model topics: the 20 most frequent
analysis tokens of each language (ties by token), so the result is
reproducible by the SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import coherence as Co

from agora.session import cut_lineage, written
from agora.sources import tables as S

TOPN = 20
W = Co.WINDOW


def _inputs(spark, sf):
    docs = written(S.text_table(spark, sf, "documents", "doc_id", "lang", "text").select(
        "doc_id", "lang", T.analysis_tokens("text").alias("toks")), "coherence-tokens")
    freq = docs.select("lang", F.explode("toks").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("c"))
    rk = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c").desc(), F.col("word")))
    topics = freq.withColumn("rk", rk).where(F.col("rk") <= TOPN).select(F.col("lang").alias("topic"), "word")
    return docs, cut_lineage(topics)  # read by every step; one word count of the corpus


def q_coherence_counts(spark, sf):
    docs, topics = _inputs(spark, sf)
    counts = Co.window_counts(docs, "toks", topics, W)
    return Co.pair_windows(counts).select("a", "b", F.col("co").cast("long").alias("co"),
                                          Co.all_windows(counts).cast("long").alias("n_windows"))


def q_coherence_cv(spark, sf):
    docs, topics = _inputs(spark, sf)
    c = Co.coherence_cv(docs, "doc_id", "toks", topics, W)
    return c.select("topic", F.round(F.col("coherence"), 6).alias("coherence"))


QUERIES = {
    "coherence_counts": q_coherence_counts,
    "coherence_cv": q_coherence_cv,
}

_BASE = f"""toks AS (SELECT doc_id, lang, {T.analysis_tokens_sql('text')} AS t FROM documents),
freq AS (SELECT lang, w, count(*) AS c FROM (SELECT lang, unnest(t) AS w FROM toks) GROUP BY lang, w),
topics AS (SELECT lang AS topic, w AS word FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, w) AS rn FROM freq) WHERE rn <= {TOPN}),
words AS (SELECT DISTINCT word FROM topics),
occ AS (SELECT o.* FROM (SELECT doc_id, len(t) AS n, g.i - 1 AS pos, t[g.i] AS w
                         FROM toks, generate_series(1, len(t)) AS g(i)) o JOIN words ON words.word = o.w),
ev AS (SELECT doc_id, w, greatest(1, n - {W - 1}) AS nw, greatest(0, pos - {W - 1}) AS step, 1 AS type FROM occ
       UNION ALL SELECT doc_id, w, greatest(1, n - {W - 1}), pos + 1, 0 FROM occ),
ev2 AS (SELECT *, lag(type) OVER (PARTITION BY doc_id, w ORDER BY step, type) AS prev_type,
               min(CASE WHEN type = 0 THEN step END) OVER (PARTITION BY doc_id, w ORDER BY step, type
                   ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_removal
        FROM ev WHERE step < nw),
runs AS (SELECT doc_id, w, step AS s, coalesce(next_removal, nw) AS e FROM ev2
         WHERE type = 1 AND (prev_type IS NULL OR prev_type = 0)),
occw AS (SELECT w, sum(e - s) AS occ FROM runs GROUP BY w),
pairs AS (SELECT DISTINCT t1.word AS a, t2.word AS b FROM topics t1 JOIN topics t2 ON t1.topic = t2.topic AND t1.word < t2.word),
co AS (SELECT p.a, p.b, sum(greatest(0, least(r1.e, r2.e) - greatest(r1.s, r2.s))) AS co
       FROM pairs p JOIN runs r1 ON r1.w = p.a JOIN runs r2 ON r2.w = p.b AND r2.doc_id = r1.doc_id
            AND r1.s < r2.e AND r2.s < r1.e GROUP BY p.a, p.b),
nwin AS (SELECT sum(greatest(1, len(t) - {W - 1})) AS n FROM toks)"""

_CV = f"""m AS (
  SELECT t1.topic, t1.word AS wi, t2.word AS wj,
         ln((CAST(CASE WHEN t1.word = t2.word THEN oi.occ ELSE coalesce(co.co, 0) END AS DOUBLE) / nwin.n + {Co.EPSILON!r})
            / ((CAST(oi.occ AS DOUBLE) / nwin.n) * (CAST(oj.occ AS DOUBLE) / nwin.n)))
         / (-ln(CAST(CASE WHEN t1.word = t2.word THEN oi.occ ELSE coalesce(co.co, 0) END AS DOUBLE) / nwin.n + {Co.EPSILON!r})) AS npmi
  FROM topics t1 JOIN topics t2 ON t1.topic = t2.topic
  JOIN occw oi ON oi.w = t1.word JOIN occw oj ON oj.w = t2.word
  LEFT JOIN co ON co.a = least(t1.word, t2.word) AND co.b = greatest(t1.word, t2.word)
  CROSS JOIN nwin),
vw AS (SELECT topic, wj, sum(npmi) AS vW FROM m GROUP BY topic, wj),
x AS (SELECT m.topic, m.wi, sum(m.npmi * vw.vW) AS dot, sum(m.npmi * m.npmi) AS nn
      FROM m JOIN vw ON vw.topic = m.topic AND vw.wj = m.wj GROUP BY m.topic, m.wi),
nrm AS (SELECT topic, sqrt(sum(vW * vW)) AS nW FROM vw GROUP BY topic)"""

ORACLE = {
    "coherence_counts": f"""WITH {_BASE}
        SELECT w AS a, w AS b, CAST(occ AS BIGINT) AS co, CAST((SELECT n FROM nwin) AS BIGINT) AS n_windows FROM occw
        UNION ALL SELECT a, b, CAST(co AS BIGINT), CAST((SELECT n FROM nwin) AS BIGINT) FROM co""",
    "coherence_cv": f"""WITH {_BASE}, {_CV}
        SELECT x.topic, round(avg(dot / (sqrt(nn) * nW)), 6) AS coherence FROM x JOIN nrm ON nrm.topic = x.topic
        GROUP BY x.topic""",
}
