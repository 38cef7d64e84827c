"""Paths that no registered query takes: PageRank without convergence, the
weight threshold, the filtered export, corpus-level tuning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import graph as G
from agora.operators import models as M
from agora.sources import sinks as Sk


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 3.0), ("c", "a", 1.0), ("a", "c", 0.05), ("d", "a", 2.0)], "src string, dst string, weight double")
    return nodes, edges


def test_no_convergence(spark, ring):
    nodes, edges = ring
    with pytest.raises(G.PageRankNotConverged):
        G.pagerank(nodes, edges, max_iter=1)
    even = G.pagerank(nodes, edges, max_iter=1, on_no_convergence="uniform").collect()
    assert {r.node: r.pagerank for r in even} == dict.fromkeys("abcd", 0.25)
    last = G.pagerank(nodes, edges, max_iter=1, on_no_convergence="last").collect()
    assert sum(r.pagerank for r in last) == pytest.approx(1.0) and len({r.pagerank for r in last}) > 1


def test_pagerank_against_plain_iteration(ring):
    nodes, edges = ring
    rows = [tuple(r) for r in edges.collect()]
    out = {n: sum(w for s, _, w in rows if s == n) for n in "abcd"}
    x = dict.fromkeys("abcd", 0.25)
    for _ in range(200):
        x = {n: 0.5 * sum(x[s] * w / out[s] for s, d, w in rows if d == n) + 0.5 / 4 for n in "abcd"}
    got = {r.node: r.pagerank for r in G.pagerank(nodes, edges, alpha=0.5, tol=1e-4).collect()}
    assert got == {n: pytest.approx(v, abs=1e-3) for n, v in x.items()}


def test_weight_threshold(ring):
    nodes, edges = ring
    top = nodes.where("node in ('a', 'b', 'c')")
    kept = G.induced_subgraph(edges, top, weight_threshold=1.0).collect()
    assert {(r.src, r.dst) for r in kept} == {("a", "b"), ("b", "c"), ("c", "a")}
    assert G.induced_subgraph(edges, top).count() == 4


def test_filtered_export(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y, z", 2)], "a string, b int")
    path = Sk.export_filtered_csv(df, str(tmp_path), "Machine Learning")
    assert path.endswith("/kl_analysis_machine_learning.csv")
    assert sorted(map(tuple, spark.read.option("header", True).csv(path).collect())) == [("x", "1"), ("y, z", "2")]


def test_corpus_tuning_keeps_the_best(spark, monkeypatch):
    docs = spark.createDataFrame([(i, [f"w{(i + k) % 7}" for k in range(12)]) for i in range(12)], "doc_id long, toks array<string>")
    drawn = [dict(k=2, alpha="symmetric", passes=2, decay=0.7, offset=10.0, chunksize=500, iterations=100), dict(k=4, alpha="symmetric", passes=2, decay=-1.0, offset=10.0, chunksize=500, iterations=100),
             dict(k=3, alpha="asymmetric", passes=2, decay=0.7, offset=10.0, chunksize=500, iterations=100)]
    monkeypatch.setattr(M, "lda_candidates", lambda n, seed=42: drawn[:n])
    best, results, cv, bow = M.tune_lda(spark, docs, "toks", 3, score_fn=lambda model, cv, bow: model.getK())
    assert best[0] == 2 and best[1]["k"] == 3
    assert results[1][2] is None and isinstance(results[1][3], str)  # a negative decay is refused
    flat = M.flatten_tuning(spark, best, cv, bow, n_terms=3)
    # a topic that no word of this small vocabulary went to names empty slots only and has no row
    assert 1 <= flat.where(F.col("topic_id").isNotNull()).count() <= 3
    assert flat.where(F.col("topic_id").isNull()).select("discussion", "param_k").collect() == [("Discussion Mode", 3)]


def test_models_compute_tokens_once(spark):
    n = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def split(text):
        n.add(1)
        return text.split()

    texts = spark.createDataFrame([(i, " ".join(f"w{(i + k) % 7}" for k in range(12))) for i in range(12)], "doc_id long, text string")
    docs = texts.select("doc_id", split("text").alias("toks"))
    cv, model, bow = M.fit_lda(docs, "toks", k=2, max_iter=3)
    assert M.topic_terms(cv, model, bow, 2).count() > 0 and M.doc_topics(model, bow).count() == 12 and n.value == 12
    best = M.tune_lda(spark, docs, "toks", 1, score_fn=lambda model, cv, bow: 1.0)
    assert M.flatten_tuning(spark, best[0], *best[2:], n_terms=3).count() > 1 and n.value == 24
    # distinct terms are hashed: the filter on slots is not pushed below the counts
    plan = M.slot_terms(cv, bow, [1, 2])._jdf.queryExecution().optimizedPlan().toString()
    assert "UDF" in plan and "UDF" not in plan[plan.rindex("Aggregate"):]


def test_corpus_model_reads_every_document_each_pass(spark):
    """Two themes come apart, each pass has all documents, and partitions do not matter."""
    from agora.operators import online_lda as OL

    rows = [(i, [f"{'ab'[i % 2]}{(i + k) % 9}" for k in range(30)]) for i in range(40)] + [(40, [])]
    docs = spark.createDataFrame(rows, "doc_id long, toks array<string>")
    mixes = []
    for n in (1, 5):
        cv, model, bow = M.fit_lda(docs.repartition(n), "toks", k=2, max_iter=30, learning_offset=1.0, width=64)
        sizes = [len(r.sizes) // 4 for r in OL.packed(bow, "_bow").collect()]
        assert isinstance(model, OL.OnlineLda) and sum(sizes) == 41 and (model.alpha > 0).all() and len(set(model.alpha)) == 2
        # no word is lost or counted twice: at rate 1 the weights would hold the prior and all tokens
        one = OL.fit(OL.packed(bow, "_bow"), "_bow", 64, 2, 1, 0.0, 1.0, [0.5, 0.5], 42)
        assert abs(one.weights.sum() - (64 * 2 * 0.5 + 40 * 30)) < 1e-6
        mixes.append({r.doc_id: r.topic_dist for r in M.doc_topics(model, bow).collect()})
    tops = [{max((0, 1), key=lambda j: m[i][j]) for i in range(p, 40, 2)} for m in mixes for p in (0, 1)]
    assert all(len(t) == 1 for t in tops) and tops[0] != tops[1] and mixes[0][40] == [0.0, 0.0]
    assert all(abs(a - b) < 1e-6 for i in range(40) for a, b in zip(mixes[0][i], mixes[1][i]))


def test_leaps_end_where_plain_steps_end():
    from agora.operators import discussion_models as DM
    from agora.operators import online_lda as OL

    draw = np.random.RandomState(3)
    counts, beta, alpha = draw.poisson(2.0, (30, 60)).astype(float), draw.gamma(100.0, 0.01, (30, 4, 60)), np.full(4, 0.25)
    start, rounds = draw.gamma(100.0, 0.01, (30, 4)), []
    plain, _ = DM._document_step(counts, beta, alpha, start.copy(), DM.TopicSetup(iterations=10**6), found=False)
    theta = OL._theta
    try:
        OL._theta = lambda g: rounds.append(len(g)) or theta(g)
        fast = OL._converged(counts, beta, alpha, start, 1e-3)
    finally:
        OL._theta = theta
    # each document's last plain step was that short for both; the leaps come closer to the end of a slow one
    assert np.abs(fast - plain).max() < 0.05 * counts.sum(axis=1).min() and np.allclose(fast.sum(axis=1), counts.sum(axis=1) + 1.0)
    assert sum(rounds) < 30 * 400


def test_passes_leave_no_shuffles(spark, monkeypatch):
    """The sums of a pass are let go before the next one."""
    from agora.operators import online_lda as OL

    dropped = []
    drop = OL.drop_shuffles
    monkeypatch.setattr(OL, "drop_shuffles", lambda s: dropped.append(1) or drop(s))
    M.fit_lda(spark.createDataFrame([(i, ["a", "b", f"c{i}"]) for i in range(9)], "doc_id long, toks array<string>"), "toks", k=2, max_iter=4, width=32)
    assert len(dropped) == 4
