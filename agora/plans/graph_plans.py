"""Registered queries: interaction graph, PageRank, ranking, subgraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators import graph as G
from agora.operators.ranking import global_row_number
from agora.session import cut_lineage
from agora.plans import sql_views as V
from agora.plans.common import R, r6, with_ctes
from agora.sources import tables as S

TOP_N = 60
GRAPH_CTES = [V.DISCUSSIONS, V.COMMENTS, V.DISCUSSIONS_WC, V.INTERACTIONS, V.EDGES,
              V.AUTHOR_NODES, V.COMMENTER_NODES, V.GRAPH_NODES]


def _graph(spark: SparkSession, sf: str):
    d = S.discussions_with_counts(spark, sf)
    c = S.comments(spark, sf)
    edges = G.aggregate_edges(G.interactions(d, c, S.REFERENCE_DATE))
    nodes = G.graph_nodes(d, c)
    return d, c, nodes, edges


def q_edge_weights(spark, sf) -> DataFrame:
    d, c = S.discussions(spark, sf), S.comments(spark, sf)
    return G.interactions(d, c, S.REFERENCE_DATE).select("src", "dst", r6("weight").alias("weight"))


def q_orphan_comments(spark, sf) -> DataFrame:
    """J1 audit, against the discussions that are closed."""
    d, c = S.discussions(spark, sf), S.comments(spark, sf)
    lost = G.orphan_comments(d.where("forum = 'F'"), c)
    return lost.groupBy("discussion_id").agg(F.count(F.lit(1)).alias("n"))


def q_edges(spark, sf) -> DataFrame:
    _, _, _, e = _graph(spark, sf)
    return e.select("src", "dst", r6("weight").alias("weight"))


def q_author_nodes(spark, sf) -> DataFrame:
    return G.author_nodes(S.discussions_with_counts(spark, sf)).select(
        "node", "medal", "expertise", "n_posts", "total_post_votes", "n_comments", "n_appreciations")


def q_commenter_nodes(spark, sf) -> DataFrame:
    return G.commenter_nodes(S.discussions(spark, sf), S.comments(spark, sf)).select(
        "node", "medal", "expertise", "n_posts", "total_comment_votes", "is_appreciation")


def q_in_degree(spark, sf) -> DataFrame:
    _, _, nodes, edges = _graph(spark, sf)
    return G.in_degree(nodes, edges)


def _scores(spark, sf, on_no_convergence: str = "error"):
    _, _, nodes, edges = _graph(spark, sf)
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)  # both are read several times
    pr = G.pagerank(nodes, edges, on_no_convergence=on_no_convergence)
    return nodes, edges, pr


def q_pagerank(spark, sf) -> DataFrame:
    _, _, pr = _scores(spark, sf)
    return pr.select("node", r6("pagerank").alias("pagerank"))


def q_ranked_users(spark, sf) -> DataFrame:
    nodes, edges, pr = _scores(spark, sf)
    deg = G.in_degree(nodes, edges)
    full = nodes.join(pr, "node").join(deg, "node")
    ranked = global_row_number(full, [F.col("pagerank").desc(), F.col("kind"), F.col("node_order")], "rank")
    return ranked.select(
        "rank",
        F.col("node").alias("username"),
        r6("pagerank").alias("influence_score"),
        "edge_count", "medal", "expertise",
        F.col("total_post_votes").alias("received_post_votes"),
        "comment_count", "received_appreciations",
    )


def _top(spark, sf):
    nodes, edges, pr = _scores(spark, sf, "uniform")
    scored = nodes.join(pr, "node").select("node", "pagerank", "kind", "node_order")
    top = G.top_nodes(scored, [F.col("kind"), F.col("node_order")], TOP_N)
    return top, G.induced_subgraph(edges, top)


def q_top_nodes(spark, sf) -> DataFrame:
    top, _ = _top(spark, sf)
    return top.select(
        "node", r6("pagerank").alias("pagerank"),
        r6(G.minmax_scale("pagerank", 400.0, 3000.0, 400.0)).alias("node_size"))


def q_top_subgraph(spark, sf) -> DataFrame:
    _, sub = _top(spark, sf)
    from pyspark.sql import Window
    rk = F.row_number().over(Window.orderBy(F.col("weight").desc(), "src", "dst"))
    return sub.select(
        "src", "dst", r6("weight").alias("weight"),
        r6(G.minmax_scale("weight", 0.5, 4.5, 1.0)).alias("width"),
        F.when((rk <= 10) & (F.col("weight") >= 0.1), r6("weight")).alias("label_weight"),
    )


def q_subgraph_stats(spark, sf) -> DataFrame:
    top, sub = _top(spark, sf)
    comps = G.weakly_connected_components(top.select("node"), sub)
    n = top.count()
    m = sub.count()
    k = comps.select("label").distinct().count()
    density = m / (n * (n - 1)) if n > 1 else 0.0
    return spark.createDataFrame(
        [(int(n), int(m), round(float(density), 6), int(k))],
        "n_nodes long, n_edges long, density double, n_components long",
    )


STRONG = 300.0


def q_components(spark, sf) -> DataFrame:
    """Components of the users over their strong ties."""
    _, _, nodes, edges = _graph(spark, sf)
    labels = G.weakly_connected_components(nodes, edges.where(F.col("weight") >= STRONG))
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).select(
        F.col("label").alias("component"), "size")


def q_components_all(spark, sf) -> DataFrame:
    """Components of the users over all ties."""
    _, _, nodes, edges = _graph(spark, sf)
    labels = G.weakly_connected_components(nodes, edges)
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("size")).select(
        F.col("label").alias("component"), "size")


QUERIES = {
    "edge_weights": q_edge_weights,
    "edges": q_edges,
    "orphan_comments": q_orphan_comments,
    "author_nodes": q_author_nodes,
    "commenter_nodes": q_commenter_nodes,
    "in_degree": q_in_degree,
    "pagerank": q_pagerank,
    "ranked_users": q_ranked_users,
    "top_nodes": q_top_nodes,
    "top_subgraph": q_top_subgraph,
    "subgraph_stats": q_subgraph_stats,
    "components": q_components,
    "components_all": q_components_all,
}

_TOP = f"""top AS (SELECT g.node, p.pagerank FROM graph_nodes g JOIN pr p USING (node)
        ORDER BY p.pagerank DESC, g.kind, g.k1, g.k2, g.k3, g.k4, g.k5 LIMIT {TOP_N}),
sub AS (SELECT e.* FROM edges e WHERE e.src IN (SELECT node FROM top) AND e.dst IN (SELECT node FROM top))"""

_CC = """und AS (SELECT DISTINCT a, b FROM (SELECT src AS a, dst AS b FROM {E} UNION ALL SELECT dst, src FROM {E}) WHERE a <> b),
cc(it, node, label, changed) AS (
  SELECT 0, node, node, true FROM {N}
  UNION ALL
  SELECT it, node, label, changed FROM (
    SELECT max(s.it) + 1 AS it, t.b AS node,
           min(s.label) AS label,
           min(s.label) < max(CASE WHEN t.self THEN s.label END) AS changed0,
           bool_or(min(s.label) < max(CASE WHEN t.self THEN s.label END)) OVER () AS changed
    FROM (SELECT * FROM cc WHERE changed) s
    JOIN (SELECT a, b, false AS self FROM und UNION ALL SELECT node, node, true FROM {N}) t ON t.a = s.node
    GROUP BY t.b) q),
cc_last AS (SELECT max(it) AS it FROM cc),
labels AS (SELECT c.node, c.label FROM cc c JOIN cc_last l ON c.it = l.it)"""

ORACLE = {
    "edge_weights": with_ctes(V.DISCUSSIONS, V.COMMENTS, V.INTERACTIONS,
                              body=f"SELECT src, dst, {R('weight')} AS weight FROM interactions"),
    "orphan_comments": with_ctes(V.DISCUSSIONS, V.COMMENTS, body="""
        SELECT discussion_id, count(*) AS n FROM comments WHERE NOT coalesce(is_deleted, false)
          AND discussion_id NOT IN (SELECT id FROM discussions WHERE forum = 'F') GROUP BY discussion_id"""),
    "edges": with_ctes(*GRAPH_CTES[:5], body=f"SELECT src, dst, {R('weight')} AS weight FROM edges"),
    "author_nodes": with_ctes(V.DISCUSSIONS, V.COMMENTS, V.DISCUSSIONS_WC, V.AUTHOR_NODES,
                              body=f"SELECT node, medal, expertise, n_posts, total_post_votes, n_comments, n_appreciations FROM author_nodes"),
    "commenter_nodes": with_ctes(V.DISCUSSIONS, V.COMMENTS, V.COMMENTER_NODES,
                                 body=f"SELECT node, medal, expertise, n_posts, total_comment_votes, is_appreciation FROM commenter_nodes"),
    "in_degree": with_ctes(*GRAPH_CTES, body=f"""SELECT g.node, CAST(coalesce(d.c, 0) AS BIGINT) AS edge_count
        FROM graph_nodes g LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) d ON d.dst = g.node"""),
    "pagerank": with_ctes(*GRAPH_CTES, V.pagerank_sql(), recursive=True,
                          body=f"SELECT node, {R('pagerank')} AS pagerank FROM pr"),
    "ranked_users": with_ctes(*GRAPH_CTES, V.pagerank_sql(), recursive=True, body=f"""
        SELECT CAST(row_number() OVER (ORDER BY p.pagerank DESC, g.kind, g.k1, g.k2, g.k3, g.k4, g.k5) AS BIGINT) AS rank,
               g.node AS username, {R('p.pagerank')} AS influence_score,
               CAST(coalesce(d.c, 0) AS BIGINT) AS edge_count, g.medal, g.expertise,
               g.total_post_votes AS received_post_votes, g.comment_count, g.received_appreciations
        FROM graph_nodes g JOIN pr p USING (node)
        LEFT JOIN (SELECT dst, count(*) AS c FROM edges GROUP BY dst) d ON d.dst = g.node"""),
    "top_nodes": with_ctes(*GRAPH_CTES, V.pagerank_sql(), _TOP, recursive=True, body=f"""
        SELECT node, {R('pagerank')} AS pagerank,
               round(CASE WHEN max(pagerank) OVER () > min(pagerank) OVER ()
                     THEN 400.0 + (pagerank - min(pagerank) OVER ()) / (max(pagerank) OVER () - min(pagerank) OVER ()) * 2600.0
                     ELSE 400.0 END, 6) AS node_size FROM top"""),
    "top_subgraph": with_ctes(*GRAPH_CTES, V.pagerank_sql(), _TOP, recursive=True, body=f"""
        SELECT src, dst, {R('weight')} AS weight,
               round(CASE WHEN max(weight) OVER () > min(weight) OVER ()
                     THEN 0.5 + (weight - min(weight) OVER ()) / (max(weight) OVER () - min(weight) OVER ()) * 4.0
                     ELSE 1.0 END, 6) AS width,
               CASE WHEN row_number() OVER (ORDER BY weight DESC, src, dst) <= 10 AND weight >= 0.1
                    THEN {R('weight')} END AS label_weight
        FROM sub"""),
    "subgraph_stats": with_ctes(*GRAPH_CTES, V.pagerank_sql(), _TOP,
                                _CC.replace("{E}", "sub").replace("{N}", "top"), recursive=True, body=f"""
        SELECT (SELECT CAST(count(*) AS BIGINT) FROM top) AS n_nodes,
               (SELECT CAST(count(*) AS BIGINT) FROM sub) AS n_edges,
               round(CASE WHEN (SELECT count(*) FROM top) > 1
                     THEN (SELECT count(*) FROM sub) / ((SELECT count(*) FROM top) * ((SELECT count(*) FROM top) - 1.0))
                     ELSE 0.0 END, 6) AS density,
               (SELECT CAST(count(DISTINCT label) AS BIGINT) FROM labels) AS n_components"""),
    "components": with_ctes(*GRAPH_CTES, _CC.replace("{E}", f"(SELECT * FROM edges WHERE weight >= {STRONG})").replace("{N}", "graph_nodes"), recursive=True,
                            body=f"SELECT label AS component, CAST(count(*) AS BIGINT) AS size FROM labels GROUP BY label"),
    "components_all": with_ctes(*GRAPH_CTES, _CC.replace("{E}", "edges").replace("{N}", "graph_nodes"), recursive=True,
                                body="SELECT label AS component, CAST(count(*) AS BIGINT) AS size FROM labels GROUP BY label"),
}
