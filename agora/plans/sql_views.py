"""SQL twins of the stand-in views (DuckDB dialect), used by the oracle."""

from __future__ import annotations

from agora.functions.constants import EXPERTISE_RANKS, MEDAL_BOOST
from agora.functions.lookups import sql_case
from agora.sources.tables import EXPERTISE_CYCLE, MARKUP, MEDAL_CYCLE, REFERENCE_DATE, TAG_CYCLE


def _cycle_sql(key: str, values: list) -> str:
    parts = []
    for i, v in enumerate(values):
        if v is None:
            continue
        if isinstance(v, list):
            lit = "[" + ", ".join("'" + x + "'" for x in v) + "]"
        else:
            lit = "'" + v + "'"
        parts.append(f"WHEN {i} THEN {lit}")
    return f"(CASE {key} % {len(values)} {' '.join(parts)} END)"


MARKED = "marked AS (SELECT doc_id, text || [" + ", ".join(f"'{m}'" for m in MARKUP) + f"][1 + doc_id % {len(MARKUP)}] AS text FROM documents)"

DISCUSSIONS = f"""discussions AS (
  SELECT o_orderkey AS id, o_orderpriority AS title,
         'u' || CAST(o_custkey AS VARCHAR) AS "user",
         CAST(floor(o_totalprice / 1000) AS INTEGER) - 50 AS votes,
         {_cycle_sql('o_custkey', MEDAL_CYCLE)} AS medal,
         {_cycle_sql('o_custkey', EXPERTISE_CYCLE)} AS expertise,
         {_cycle_sql('o_orderkey', TAG_CYCLE)} AS tags,
         o_orderdate AS datetime, o_orderstatus AS forum, o_orderkey AS load_order
  FROM orders)"""

COMMENTS = f"""comments AS (
  SELECT l_orderkey AS discussion_id,
         (CASE WHEN l_suppkey % 4 = 0 THEN 'v' ELSE 'u' END) || CAST(l_suppkey AS VARCHAR) AS "user",
         CAST(trunc(l_quantity) AS INTEGER) - 5 AS votes,
         {_cycle_sql('l_suppkey', MEDAL_CYCLE)} AS medal,
         {_cycle_sql('l_suppkey', EXPERTISE_CYCLE)} AS expertise,
         (l_returnflag = 'A') AS is_appreciation,
         (l_returnflag = 'R') AS is_deleted,
         l_shipdate AS datetime,
         l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4,
         l_extendedprice AS k5
  FROM lineitem)"""

DISCUSSIONS_WC = """dwc AS (
  SELECT d.*, CAST(coalesce(c.n_comments, 0) AS BIGINT) AS n_comments,
         CAST(coalesce(c.n_app, 0) AS BIGINT) AS n_appreciation_comments
  FROM discussions d LEFT JOIN (
     SELECT discussion_id, count(*) AS n_comments, count(*) FILTER (WHERE is_appreciation) AS n_app
     FROM comments GROUP BY discussion_id) c ON d.id = c.discussion_id)"""


def medal_sql(expr: str) -> str:
    return sql_case(MEDAL_BOOST, expr)


def expertise_sql(expr: str) -> str:
    return sql_case(EXPERTISE_RANKS, expr)


def recency_sql(ts: str, reference_date: str = REFERENCE_DATE) -> str:
    return (
        f"greatest(0.1, 1.0 - floor((epoch_us(TIMESTAMP '{reference_date}') - epoch_us({ts}))"
        f" / 86400000000.0) / 365.0)"
    )


INTERACTIONS = f"""interactions AS (
  SELECT c."user" AS src, d."user" AS dst,
         (1.0 + c.votes)
         * (CASE WHEN coalesce(c.is_appreciation, false) THEN 1.0 ELSE 0.01 END)
         * (({medal_sql('c.medal')} + {medal_sql('d.medal')}) / 2.0)
         * (({expertise_sql('c.expertise')} + {expertise_sql('d.expertise')}) / 2.0)
         * {recency_sql('c.datetime')} AS weight
  FROM comments c JOIN discussions d ON c.discussion_id = d.id
  WHERE NOT coalesce(c.is_deleted, false))"""

EDGES = """edges AS (SELECT src, dst, sum(weight) AS weight FROM interactions GROUP BY src, dst)"""

AUTHOR_NODES = """author_nodes AS (
  SELECT "user" AS node,
         arg_max(medal, load_order) AS medal, arg_max(expertise, load_order) AS expertise,
         CAST(1 AS BIGINT) AS n_posts,
         CAST(arg_max(votes, load_order) AS BIGINT) AS total_post_votes,
         CAST(arg_max(n_comments, load_order) AS BIGINT) AS n_comments,
         CAST(arg_max(n_appreciation_comments, load_order) AS BIGINT) AS n_appreciations,
         0 AS kind, min(load_order) AS k1, CAST(0 AS BIGINT) AS k2, CAST(0 AS BIGINT) AS k3,
         CAST(0 AS BIGINT) AS k4, CAST(0 AS DOUBLE) AS k5
  FROM dwc GROUP BY "user")"""

COMMENTER_NODES = """commenter_nodes AS (
  SELECT node, medal, expertise, CAST(0 AS BIGINT) AS n_posts, CAST(votes AS BIGINT) AS total_comment_votes,
         is_appreciation, 1 AS kind, k1, k2, k3, k4, k5
  FROM (SELECT "user" AS node, medal, expertise, votes, is_appreciation, k1, k2, k3, k4, k5,
               row_number() OVER (PARTITION BY "user" ORDER BY k1, k2, k3, k4, k5) AS rn
        FROM comments WHERE NOT coalesce(is_deleted, false)) c
  WHERE rn = 1 AND node NOT IN (SELECT "user" FROM discussions))"""

GRAPH_NODES = """graph_nodes AS (
  SELECT node, medal, expertise, n_posts, total_post_votes, n_comments AS comment_count,
         n_appreciations AS received_appreciations, kind, k1, k2, k3, k4, k5 FROM author_nodes
  UNION ALL
  SELECT node, medal, expertise, n_posts, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT),
         kind, k1, k2, k3, k4, k5 FROM commenter_nodes)"""


def pagerank_sql(nodes_cte: str = "graph_nodes", edges_cte: str = "edges", alpha: float = 0.85,
                 max_iter: int = 100, tol: float = 1e-6) -> str:
    """PageRank as a recursive CTE with the same stop rule (L1 < N*tol) and
    the uniform fallback when it does not converge.  Emits CTE ``pr(node, pagerank)``."""
    return f"""pr_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {nodes_cte}),
pr_out AS (SELECT src, sum(weight) AS out_w FROM {edges_cte} GROUP BY src),
pr_trans AS (
  SELECT e.src, e.dst, e.weight / o.out_w AS p, false AS self FROM {edges_cte} e JOIN pr_out o USING (src)
  WHERE o.out_w <> 0
  UNION ALL
  SELECT node, node, 0.0, true FROM {nodes_cte}),
pr_dang AS (SELECT g.node, (o.out_w IS NULL OR o.out_w = 0) AS dangling
            FROM {nodes_cte} g LEFT JOIN pr_out o ON o.src = g.node),
pr_iter(it, node, x, dangling, err) AS (
  SELECT 0, node, 1.0 / (SELECT n FROM pr_n), dangling, CAST('inf' AS DOUBLE) FROM pr_dang
  UNION ALL
  SELECT it, node, xnew, dangling, sum(abs(xnew - xold)) OVER () AS err FROM (
    SELECT max(s.it) + 1 AS it, t.dst AS node,
           {alpha} * (sum(s.x * t.p) + max(s.dm) / (SELECT n FROM pr_n)) + {1.0 - alpha} / (SELECT n FROM pr_n) AS xnew,
           max(CASE WHEN t.self THEN s.x END) AS xold,
           bool_or(t.self AND s.dangling) AS dangling
    FROM (SELECT it, node, x, dangling, err,
                 sum(CASE WHEN dangling THEN x ELSE 0.0 END) OVER () AS dm
          FROM pr_iter WHERE it < {max_iter} AND err >= (SELECT n FROM pr_n) * {tol}) s
    JOIN pr_trans t ON t.src = s.node
    GROUP BY t.dst) q),
pr_last AS (SELECT max(it) AS it FROM pr_iter),
pr AS (
  SELECT p.node,
         CASE WHEN p.err < (SELECT n FROM pr_n) * {tol} THEN p.x ELSE 1.0 / (SELECT n FROM pr_n) END AS pagerank
  FROM pr_iter p JOIN pr_last l ON p.it = l.it)"""
