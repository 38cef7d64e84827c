"""Registered queries: thread-structure features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.lookups import expertise_rank
from agora.operators import structure as St
from agora.plans import sql_views as V
from agora.plans.common import R, r6, with_ctes
from agora.sources import tables as S


def q_thread_depth(spark, sf) -> DataFrame:
    adj = S.reply_edges(spark, sf)
    lv = St.node_levels(adj, "conv_id", "turn", "parent_turn")
    ids = adj.select(F.col("conv_id").alias("id")).distinct()
    return St.thread_depth(ids, "id", lv, "conv_id")


def q_expertise_avg(spark, sf) -> DataFrame:
    f = St.feature_rows(S.discussions(spark, sf), S.comments(spark, sf))
    return f.select("discussion_id", r6("expertise_avg").alias("expertise_avg"))


def q_vote_ratio(spark, sf) -> DataFrame:
    f = St.feature_rows(S.discussions(spark, sf), S.comments(spark, sf))
    return f.select("discussion_id", r6("vote_ratio").alias("vote_ratio"))


def features(spark, sf) -> DataFrame:
    """Feature rows with depth (F1) over the comments (level 1) and the
    replies: a conversation stands in for the reply thread of the discussion
    with its number."""
    d, c = S.discussions(spark, sf), S.comments(spark, sf)
    levels = c.select("discussion_id", F.lit(1).alias("level")).unionByName(
        St.node_levels(S.reply_edges(spark, sf), "conv_id", "turn", "parent_turn").select(F.col("conv_id").alias("discussion_id"), "level"))
    return St.feature_rows(d, c, St.thread_depth(d, "id", levels, "discussion_id"))


def q_feature_rows(spark, sf) -> DataFrame:
    f = features(spark, sf)
    return f.select("discussion_id", "depth", r6("expertise_avg").alias("expertise_avg"),
                    r6("vote_ratio").alias("vote_ratio"), "has_comments", "n_comments")


QUERIES = {
    "thread_depth": q_thread_depth,
    "expertise_avg": q_expertise_avg,
    "vote_ratio": q_vote_ratio,
    "feature_rows": q_feature_rows,
}

_FEAT = f"""feat AS (
  SELECT d.id AS discussion_id,
         CAST(greatest(CASE WHEN coalesce(c.n, 0) > 0 THEN 1 ELSE 0 END, coalesce(t.depth, 0)) AS BIGINT) AS depth,
         coalesce(c.ea, 0.0) AS expertise_avg,
         CAST(d.votes AS DOUBLE) / (coalesce(c.n, 0) + 1e-6) AS vote_ratio,
         coalesce(c.n, 0) > 0 AS has_comments,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_comments
  FROM discussions d LEFT JOIN (
    SELECT discussion_id, count(*) AS n, avg({V.expertise_sql('expertise')}) AS ea
    FROM comments GROUP BY discussion_id) c ON c.discussion_id = d.id
  LEFT JOIN (SELECT conv_id, max(turn) + 1 AS depth FROM conversations GROUP BY conv_id) t ON t.conv_id = d.id)"""

ORACLE = {
    "thread_depth": """WITH RECURSIVE lv(conv_id, turn, level) AS (
          SELECT conv_id, turn, 1 FROM conversations WHERE turn = 0
          UNION ALL
          SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN conversations c
            ON c.conv_id = lv.conv_id AND c.turn - 1 = lv.turn AND c.turn > 0)
        SELECT i.conv_id AS id, CAST(coalesce(m.depth, 0) AS BIGINT) AS depth
        FROM (SELECT DISTINCT conv_id FROM conversations) i
        LEFT JOIN (SELECT conv_id, max(level) AS depth FROM lv GROUP BY conv_id) m USING (conv_id)""",
    "expertise_avg": with_ctes(V.DISCUSSIONS, V.COMMENTS, _FEAT,
                               body=f"SELECT discussion_id, {R('expertise_avg')} AS expertise_avg FROM feat"),
    "vote_ratio": with_ctes(V.DISCUSSIONS, V.COMMENTS, _FEAT,
                            body=f"SELECT discussion_id, {R('vote_ratio')} AS vote_ratio FROM feat"),
    "feature_rows": with_ctes(V.DISCUSSIONS, V.COMMENTS, _FEAT, body=f"""
        SELECT discussion_id, depth, {R('expertise_avg')} AS expertise_avg, {R('vote_ratio')} AS vote_ratio,
               has_comments, n_comments FROM feat"""),
}
