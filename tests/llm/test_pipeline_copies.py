"""Copies planted in documents leave one document after run()."""

import corpus_pipeline
from tests.llm.cases import documents, edited, prose
from tests.llm.test_quality import corpus


def test_copies_leave_one_document(spark, tmp_path):
    good, labels = corpus(100)
    kept_labels = [x for x in labels if x[1]]
    lines = lambda seed, n: "\n".join(prose(seed + j, 25).replace("\n", " ") for j in range(n))
    exact, near, tail = lines(40_000, 12), lines(41_000, 40), lines(42_000, 6)
    groups = [
        [(50_000 + k, exact) for k in range(4)],
        [(51_000, near)] + [(51_000 + k, edited(near, k, 90)) for k in range(1, 5)],
        # two lines are enough, and a one-line copy
        [(52_000 + k, lines(43_000, 2)) for k in range(2)],
        [(53_000 + k, lines(44_000, 1)) for k in range(2)],
    ]
    # a document made of runs of two others goes whole, though it resembles neither
    head = lines(45_000, 40)
    parts = [(54_000, head + "\n" + lines(46_000, 40)), (54_001, lines(47_000, 40) + "\n" + tail)]
    mixed = (54_002, "\n".join(head.split("\n")[:6]) + "\n" + tail)
    planted = [r for g in groups for r in g] + parts + [mixed]
    rows = [(10_000 + r[0], *r[1:]) for r in good] + [(i, t, "en", "s", len(t)) for i, t in planted]
    root = str(tmp_path)
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    # planted documents are labelled good, so that the classifier keeps them
    marks = [(10_000 + i, q, t) for i, q, t in labels] + [(i, *kept_labels[0][1:]) for i, _ in planted]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")

    good_ids = {r.doc_id for r in corpus_pipeline.quality(spark, spark.read.parquet(f"{root}/documents.parquet"), root).collect()}
    left = {r.doc_id for r in corpus_pipeline.run(spark, root).collect()}
    assert good_ids >= {i for i, _ in planted}
    for g in groups:
        assert left & {i for i, _ in g} == {min(i for i, _ in g)}
    assert {54_000, 54_001} <= left and 54_002 not in left
