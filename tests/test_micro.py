"""Hand-checked micro-fixtures (values worked out by hand, see FIXTURES.md)."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.functions.divergence import kl_divergence
from agora.operators import domains as D
from agora.operators import graph as G
from agora.operators import quality as Q
from agora.operators import structure as St
from agora.operators import summary as Su


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,expected", [
    ("<b>Hi</b> @bob: see https://kaggle.com/x?y=1 now!", "Hi USER_bob see  URL  now"),
    ("![](https://i.imgur.com/a.png) ok", "URL  ok"),
    ("use `pip install` and ```a b``` (v1.2)", "use  CODE  and  CODE   v1.2"),
    ("café  time", "caf  time"),
    ("a\n\n b\t c-d_e?", "a b c-d_e?"),
])
def test_clean_text(spark, raw, expected):
    assert one(spark, T.clean_text, raw) == expected


def test_tokens(spark):
    s = "Deep_Learning R2D2 café _x naïve a bb"
    assert one(spark, lambda c: T.simple_tokens(c, deacc=False), s) == ["deep_learning", "café", "naïve", "bb"]
    assert one(spark, T.simple_tokens, s) == ["deep_learning", "cafe", "naive", "bb"]
    assert one(spark, T.simple_tokens, None) == []


def test_analysis_tokens_phrases_stopwords_lemmas(spark):
    toks = one(spark, T.analysis_tokens, "What is Machine Learning? The studies of classes and boxes")
    assert toks == ["what", "machine_learning", "study", "class", "box"]


def test_domains(spark):
    df = spark.createDataFrame([(["Machine Learning", "GPU"],), (["zzz"],), ([],), (None,)], "tags array<string>")
    got = [r[0] for r in df.select(D.domains_by_tags("tags")).collect()]
    assert got == [["AI", "Hardware"], ["General"], ["General"], ["General"]]
    df = spark.createDataFrame([(None, "Python", "on AWS")], "tags array<string>, title string, content string")
    assert df.select(D.classify("tags", F.col("title"), F.col("content"))).first()[0] == ["Cloud Computing", "Computer Science"]


def test_thread_depth_and_features(spark):
    adj = spark.createDataFrame(
        [(1, "c1", None), (1, "r1", "c1"), (1, "r2", "r1"), (1, "c2", None)], "d long, n string, p string")
    lv = St.node_levels(adj, "d", "n", "p")
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    got = {r["id"]: r["depth"] for r in St.thread_depth(ids, "id", lv, "d").collect()}
    assert got == {1: 3, 2: 0}
    disc = spark.createDataFrame([(1, 6), (2, 6)], "id long, votes int")
    com = spark.createDataFrame([(1, "Novice"), (1, "Master"), (1, None)], "discussion_id long, expertise string")
    f = {r["discussion_id"]: r for r in St.feature_rows(disc, com).collect()}
    assert f[1]["expertise_avg"] == pytest.approx(5 / 3)
    assert f[2]["expertise_avg"] == 0.0
    assert f[1]["vote_ratio"] == pytest.approx(6 / (3 + 1e-6))
    assert f[2]["vote_ratio"] == pytest.approx(6 / 1e-6)


def test_edge_weight_and_recency(spark):
    w = G.interaction_weight(F.lit(3), F.lit(True), F.lit("gold"), F.lit("bronze"), F.lit("Expert"),
                             F.lit("Novice"), F.lit(dt.datetime(2024, 3, 26, 12)), "2024-03-27")
    assert spark.range(1).select(w).first()[0] == pytest.approx(16.0)
    rows = [(dt.datetime(2024, 3, 28, 12),), (dt.datetime(2023, 3, 28, 0),), (dt.datetime(2024, 1, 14, 0),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    got = [r[0] for r in df.select(G.recency_factor(F.col("ts"), "2024-03-27")).collect()]
    assert got == pytest.approx([1 + 2 / 365, 0.1, 1 - 73 / 365])


def test_pagerank_single_edge(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    pr = {r["node"]: r["pagerank"] for r in G.pagerank(nodes, edges).collect()}
    assert pr["a"] == pytest.approx(0.350877, abs=1e-5)
    assert pr["b"] == pytest.approx(0.649123, abs=1e-5)
    assert sum(pr.values()) == pytest.approx(1.0)


def test_components_and_density(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0)], "src string, dst string, weight double")
    labels = G.weakly_connected_components(nodes, edges)
    assert labels.select("label").distinct().count() == 2


def test_kl(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.25, 0.75]), ([1.0, 0.0], [0.5, 0.5]), ([0.5, 0.5], [1.0, 0.0])],
                               "p array<double>, q array<double>")
    got = [r[0] for r in df.select(kl_divergence("p", "q")).collect()]
    assert got[0] == pytest.approx(0.143841, abs=1e-6)
    assert got[1] == pytest.approx(0.693147, abs=1e-6)
    assert math.isinf(got[2])


def test_first_min_per_key(spark):
    df = spark.createDataFrame([("u", 2, 0.3), ("u", 1, 0.1), ("u", 3, 0.1)], "user string, id long, kl double")
    assert Su.first_min_per_key(df, "user", "kl", ["id"]).first()["id"] == 1


def test_iqr(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 100, None]], "votes int")
    flags = {r["votes"]: r["outlier"] for r in Su.iqr_outliers(df, "votes").collect()}
    assert flags == {1: False, 2: False, 3: False, 4: False, 100: True, None: True}


def test_argmax_and_score_bounds(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.9, 0.0],)], "l array<double>")
    assert df.select(Q.argmax_first("l")).first()[0] == 1
    from agora.sources.scored import TASKS
    for level, expected in [(0, 1.253488), (1, 2.084496)]:
        row = spark.range(1).select(*[F.lit(level).alias(f"{t}_ad") for t in TASKS])
        assert row.select(Q.weighted_score()).first()[0] == pytest.approx(expected, abs=1e-6)
    from agora.functions.constants import QUALITY_TASK_WEIGHTS
    pos = spark.range(1).select(*[F.lit(3 if w > 0 else 0).alias(f"{t}_ad") for t, w in QUALITY_TASK_WEIGHTS])
    neg = spark.range(1).select(*[F.lit(3 if w < 0 else 0).alias(f"{t}_ad") for t, w in QUALITY_TASK_WEIGHTS])
    assert pos.select(Q.weighted_score()).first()[0] == pytest.approx(5.0, abs=1e-6)
    assert neg.select(Q.weighted_score()).first()[0] == pytest.approx(0.0, abs=1e-6)


def test_deliq_and_weight_fit(spark):
    df = spark.createDataFrame([(2.0, 0.5, 0.1)], "score double, kl_divergence double, influence_score double")
    assert df.select(Q.deliq_score()).first()[0] == pytest.approx(1.395)
    samples = spark.createDataFrame([(0.9, 0.7, 0.8, 0.85), (0.8, 0.6, 0.9, 0.82), (0.95, 0.8, 0.85, 0.90)],
                                    "pagerank double, kl double, llm double, target double")
    w, sse = Q.fit_simplex_weights(samples)
    assert w == pytest.approx([0.560526, 0.078947, 0.360526], abs=1e-5)
    assert sse == pytest.approx(7.8947e-06, rel=1e-3)
    fs = spark.range(1).select(Q.final_score(w, F.lit(0.9), F.lit(0.7), F.lit(0.8))).first()[0]
    assert fs == pytest.approx(0.848158, abs=1e-5)


def test_bands_engagement_decimal(spark):
    df = spark.createDataFrame([(10, 4, 2, v) for v in [0.99, 1.0, 1.45, None]],
                               "votes int, n_comments int, depth int, kl_divergence double")
    rows = df.select(Su.engagement().alias("e"), Su.content_band().alias("b")).collect()
    assert rows[0]["e"] == pytest.approx(18.4)
    assert [r["b"] for r in rows] == ["Típico", "Moderado", "Atípico", "Atípico"]
    assert one(spark, Su.decimal_comma, "1,25") == 1.25


def test_mode_smallest_of_ties(spark):
    df = spark.createDataFrame([(v,) for v in [10, 15, 15, 10, None]], "v int")
    assert Su.column_mode(df, "v").first()["mode"] == 10


def test_recency_independent_of_session_time_zone(spark):
    rows = [(dt.datetime(2024, 3, 9, 12),), (dt.datetime(2023, 11, 4, 23, 30),), (dt.datetime(2024, 3, 26, 0, 0, 1),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = {}
        for tz in ("UTC", "America/New_York", "Europe/Madrid"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            got[tz] = [r[0] for r in df.select(G.recency_factor(F.col("ts"), "2024-03-27")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)
    assert got["UTC"] == got["America/New_York"] == got["Europe/Madrid"]
    assert got["UTC"] == pytest.approx([1 - 17 / 365, 1 - 143 / 365, 1.0])


def test_components_long_chain(spark):
    n = 400
    nodes = spark.range(n).selectExpr("id as node")
    edges = spark.range(n - 1).selectExpr("id as src", "id + 1 as dst").where("src % 200 != 199")
    got = {r["label"]: r["count"] for r in G.weakly_connected_components(nodes, edges).groupBy("label").count().collect()}
    assert got == {0: 200, 200: 200}
