"""Stages one by one against brute force on their own input."""

import numpy as np
import pytest

import corpus_pipeline
from agora.llm.packing import Encoder
from agora.llm.packing_queries import vocabulary_path
from tests.llm.cases import documents, prose
from tests.llm.test_decontaminate import brute as contained
from tests.llm.test_linededup import brute_whole as without_lines
from tests.llm.test_linededup import table as line_table
from tests.llm.test_neardup import brute as linked
from tests.llm.test_quality import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tables")
    good, labels = corpus(100)
    rows = [(10_000 + r[0], *r[1:]) for r in good] + line_table()
    rows += [(20_000 + k, prose(60 + k, 80) + " " + prose(9_000, 40) + " " + prose(61 + k, 30), "en", "s", 1) for k in range(5)]
    rows += [(30_000, prose(70, 60), "en", "s", 1), (30_000, prose(71, 60), "en", "s", 1), (30_000, prose(71, 60), "en", "s", 1)]  # unlike rows of one id
    documents(spark, rows).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(10_000 + i, q, t) for i, q, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, prose(9_000, 40)), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root), labels


def test_stages(spark, folder, tmp_path):
    sf, labels = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, before, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == before.columns
        seen[name] = (before.collect(), docs.collect())
    pair = lambda rows: [(r.doc_id, r.text) for r in rows]

    before, after = seen["quality classifier"]
    bad = {10_000 + i for i, q, _ in labels if not q}
    assert set(pair(after)) <= set(pair(before)) and not bad & {r.doc_id for r in after}
    assert {10_000 + i for i, q, _ in labels if q} <= {r.doc_id for r in after}

    before, after = seen["line dedup"]
    single = [x for x in pair(before) if x[0] != 30_000]
    want = without_lines(single)
    left = {(i, want[i, t]) for i, t in single if want[i, t] == t or (want[i, t] or "").split()}
    left |= {x for x in pair(before) if x[0] == 30_000}
    assert set(pair(after)) == left and all(r.n_chars == len(r.text) for r in after if r.text and (r.doc_id, r.text) not in set(pair(before)))

    before, after = seen["near-dedup"]
    # a row per (id, text), numbered in the order of the ids
    named = sorted({(i, t or "") for i, t in pair(before) if i is not None})
    assert len({i for i, _ in named}) < len(named)
    component = linked([(k, t) for k, (_, t) in enumerate(named)], 5, 80)
    stay = {named[k] for k, (_, c) in component.items() if k == c}
    twice = {i for i, _ in named if [x for x, _ in named].count(i) > 1}
    assert {(r.doc_id, r.text or "") for r in after if r.doc_id is not None and r.doc_id not in twice} == {x for x in stay if x[0] not in twice}
    assert len([r for r in after if r.doc_id in twice]) == len([x for x in stay if x[0] in twice])
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)

    before, after = seen["benchmark decontamination"]
    dirty = {d for d, _ in contained(pair(before), [(1, prose(9_000, 40))])}
    assert dirty and set(pair(after)) == {p for p in pair(before) if p[0] not in dirty}

    before, after = seen["best-fit packing"]
    tokens = Encoder(vocabulary_path()).tokenizer
    sizes: dict = {}
    for i, t in pair(before):
        sizes[i] = sizes.get(i, 0) + len(tokens.encode(t or "", add_special_tokens=False).ids) + 1
    packed: dict = {}
    for r in after:
        packed[r.doc_id] = packed.get(r.doc_id, 0) + r.length
    assert {i: n for i, n in packed.items() if i is not None} == {i: n for i, n in sizes.items() if i is not None}
    assert np.all([r.offset + r.length <= 2048 for r in after])

    # run() applies the same stages
    got = sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect() if r.doc_id is not None)
    assert got == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in after if r.doc_id is not None)


def test_empty_tables(spark, folder, tmp_path):
    sf, _ = folder
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
