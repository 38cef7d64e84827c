import numpy as np

from agora.llm.quality import fit, keep_good, score_quality
from tests.llm.cases import SCHEMA, awkward, clashing, documents, prose

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=200):
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        text = prose(i, 80 + i)
        if not good:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_held_out_accuracy_and_contract(spark):
    rows, labels = corpus()
    rows += [(1000 + (r[0] or 0), *r[1:]) if r[0] is not None else r for r in awkward()]
    labels += [(None, 1, 0), (3, None, 0), (5, 1, 0)]
    got = score_quality(clashing(documents(spark, rows)), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(rows)
    truth = {d: q for d, q, _ in labels if q is not None}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)


def test_without_labels_or_documents(spark):
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in score_quality(documents(spark), none).collect()} == {0.5}
    assert score_quality(spark.createDataFrame([], SCHEMA), none).count() == 0
    one = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], LABELS)
    assert {r.score for r in score_quality(documents(spark), one).collect()} == {1.0}


def test_keep_good_keeps_rows_whole(spark):
    rows, labels = corpus(120)
    docs = documents(spark, rows)
    kept = keep_good(docs, spark.createDataFrame(labels, LABELS))
    assert kept.schema.names == docs.schema.names
    ids = {r.doc_id for r in kept.collect()}
    assert ids == {i for i, q, _ in labels if q}


def test_discriminant_is_the_gaussian_log_ratio():
    rng = np.random.default_rng(0)
    x0, x1 = rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (900, 3))
    moments = {k: (float(len(x)), x.sum(axis=0), x.T @ x) for k, x in ((0, x0), (1, x1))}
    model = fit(moments, shrinkage=0.0, ridge=0.0)
    x = rng.normal(0, 2, (50, 3))

    def density(v, own):
        m, c = own.mean(axis=0), np.cov(own.T, bias=True)
        d = v - m
        return -0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1]

    odds = density(x, x1) + np.log(900 / 1300) - density(x, x0) - np.log(400 / 1300)
    assert np.allclose(model.scores(x), 1 / (1 + np.exp(-odds)))
