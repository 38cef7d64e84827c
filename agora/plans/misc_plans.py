"""Registered queries: joins of the processed tables, flags, list parsing,
first-N, distinct domains, densify, sink round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from agora.functions.divergence import densify
from agora.operators import domains as D
from agora.operators import quality as Q
from agora.operators import structure as St
from agora.plans import quality_plans as QP
from agora.plans import sql_views as V
from agora.plans.common import R, r6, with_ctes
from agora.plans.structure_plans import _FEAT, features
from agora.plans.summary_plans import _D, dash
from agora.session import ensure_checkpoint_dir
from agora.sources import sinks as Sk
from agora.sources import table_sets as TS
from agora.sources import tables as S
from agora.sources.kl_table import CONTENT_TOPICS_SQL, content_topics
from agora.sources.scored import scored_rows

FIRST_N = 5


def q_discussion_features(spark, sf):
    """Discussions inner-joined with their feature rows; the
    feature side's comment count is renamed."""
    d = S.discussions(spark, sf)
    f = features(spark, sf).withColumnRenamed("n_comments", "n_comments_features")
    j = d.join(f, d.id == f.discussion_id, "inner")
    return j.select("id", "user", "votes", "depth", r6("expertise_avg").alias("expertise_avg"),
                    r6("vote_ratio").alias("vote_ratio"), "has_comments", "n_comments_features")


def q_label_flags(spark, sf):
    l = S.table(spark, sf, "labels")
    return l.select("doc_id", Sk.flag("quality").alias("is_quality"), Sk.flag("toxic").alias("is_toxic"))


def q_tags_roundtrip(spark, sf):
    d = S.discussions(spark, sf).where(F.col("tags").isNotNull())
    as_text = F.concat(F.lit("['"), F.array_join("tags", "', '"), F.lit("']"))
    return d.select("id", F.array_join(Sk.parse_list_string(as_text), "|").alias("tags"))


def q_first_n(spark, sf):
    """The first N discussions in load order."""
    return S.discussions(spark, sf).orderBy("load_order").limit(FIRST_N).select("id", "title", "user", "votes")


def q_distinct_domains(spark, sf):
    """Distinct domains of the content table (filter choices)."""
    return dash(spark, sf).select("domain").distinct()


def q_densify(spark, sf):
    """M4: sparse (topic -> prob) maps, entries of zero dropped, back to dense."""
    c = content_topics(spark, sf)
    sparse = F.map_from_entries(F.filter(F.transform("topic_dist", lambda x, i: F.struct(i.alias("k"), x.alias("v"))),
                                         lambda e: e["v"] > 0))
    dense = densify(sparse, 4)
    return c.select("id", F.array_join(F.transform(dense, lambda x: F.format_number(x, 6)), " ").alias("dense"))


def q_tsv_roundtrip(spark, sf):
    """Write discussions + features as TSV to the shared scratch
    folder, read back dropping columns and null-text rows."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/tsv-{uuid.uuid4().hex}"
    d = S.discussions(spark, sf).select("id", "title", "user", "votes", F.col("datetime").cast("string").alias("datetime"),
                                        F.array_join("tags", ",").alias("tags"))
    Sk.write_tsv(d, path)
    back = Sk.read_tsv(spark, path, "id long, title string, user string, votes int, datetime string, tags string",
                       text_col="title", drop=("tags", "datetime", "content"))
    return back


def q_table_set(spark, sf):
    """Discussions, comments and features written as one set, read back
    and joined (S9)."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/set-{uuid.uuid4().hex}"
    d, c = S.discussions(spark, sf), S.comments(spark, sf)
    feats = St.feature_rows(d, c)
    TS.write_table_set({"discussions": d.select("id", "title", "user", "votes"), "comments": c.select("discussion_id", "user", "votes"), "features": feats}, root)
    t = TS.read_table_set(spark, root)
    votes = t["comments"].groupBy("discussion_id").agg(F.sum("votes").alias("comment_votes"))
    j = t["discussions"].join(t["features"], F.col("id") == F.col("discussion_id")).drop("discussion_id").join(votes, F.col("id") == F.col("discussion_id"), "left")
    return j.select("id", "user", "votes", "n_comments", r6("expertise_avg").alias("expertise_avg"), F.coalesce("comment_votes", F.lit(0)).cast("long").alias("comment_votes"))


def q_scored_tsv(spark, sf):
    """S13 + S14: the scored rows as a set of tab-separated text, read back."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scored-{uuid.uuid4().hex}"
    rows = scored_rows(spark, sf).withColumn("score", Q.weighted_score()).select("id", "line", "partkey", "suppkey", "user", "score")
    TS.write_table_set({"scored": rows}, root, {"scored": "tsv"})
    return TS.read_table_set(spark, root)["scored"].select("id", "line", "partkey", "suppkey", r6("score").alias("score"))


QUERIES = {
    "table_set": q_table_set,
    "scored_tsv": q_scored_tsv,
    "discussion_features": q_discussion_features,
    "label_flags": q_label_flags,
    "tags_roundtrip": q_tags_roundtrip,
    "first_n": q_first_n,
    "distinct_domains": q_distinct_domains,
    "densify": q_densify,
    "tsv_roundtrip": q_tsv_roundtrip,
}

ORACLE = {
    "table_set": with_ctes(V.DISCUSSIONS, V.COMMENTS, _FEAT, body=f"""
        SELECT d.id, d."user", d.votes, f.n_comments, {R('f.expertise_avg')} AS expertise_avg, CAST(coalesce(c.v, 0) AS BIGINT) AS comment_votes
        FROM discussions d JOIN feat f ON d.id = f.discussion_id
        LEFT JOIN (SELECT discussion_id, sum(votes) AS v FROM comments GROUP BY discussion_id) c ON c.discussion_id = d.id"""),
    "scored_tsv": QP.ORACLE["aqua_score"],
    "discussion_features": with_ctes(V.DISCUSSIONS, V.COMMENTS, _FEAT, body=f"""
        SELECT d.id, d."user", d.votes, f.depth, {R('f.expertise_avg')} AS expertise_avg, {R('f.vote_ratio')} AS vote_ratio,
               f.has_comments, f.n_comments AS n_comments_features
        FROM discussions d JOIN feat f ON d.id = f.discussion_id"""),
    "label_flags": """SELECT doc_id, coalesce(CAST(quality AS DOUBLE) = 1.0, false) AS is_quality,
                             coalesce(CAST(toxic AS DOUBLE) = 1.0, false) AS is_toxic FROM labels""",
    "tags_roundtrip": with_ctes(V.DISCUSSIONS, body="SELECT id, array_to_string(tags, '|') AS tags FROM discussions WHERE tags IS NOT NULL"),
    "first_n": with_ctes(V.DISCUSSIONS, body=f'SELECT id, title, "user", votes FROM discussions ORDER BY load_order LIMIT {FIRST_N}'),
    "distinct_domains": with_ctes(*_D, body="SELECT DISTINCT domain FROM dash"),
    "densify": with_ctes(CONTENT_TOPICS_SQL, body="""SELECT id, array_to_string(list_transform(topic_dist,
                         lambda x: printf('%.6f', x)), ' ') AS dense FROM content_topics"""),
    "tsv_roundtrip": with_ctes(V.DISCUSSIONS, body="""SELECT id, title, "user", votes FROM discussions WHERE title IS NOT NULL"""),
}
