import math
import random
import re
from collections import Counter

import numpy as np

from agora.llm.blockrank import Blocks, Shard, impacts, rank_documents, terms
from tests.llm.cases import awkward, clashing, documents, edited, prose

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = Blocks(top=20, block=4, planes=6, shard=1024, cells=500)


def brute(rows, items, top=20):
    """Straight from the definition: every document against every item."""
    found = [(i, re.findall(TERM, (t or "").translate(LOWER))) for i, t in rows]
    found = [(i, ts) for i, ts in found if ts]
    n_docs, n_terms = len(found), sum(len(ts) for _, ts in found)
    df = Counter(t for _, ts in found for t in set(ts))
    out = []
    for item, text in items:
        scored = []
        for i, ts in found:
            tf, m = Counter(ts), 75 + (25 * len(ts) * n_docs) // n_terms
            score = 0
            for t in re.findall(TERM, (text or "").translate(LOWER)):
                if tf[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def ask(spark, rows, items, setup=SMALL):
    docs = clashing(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    asked = spark.createDataFrame(items, "item_id long, text string")
    got = rank_documents(docs, asked, setup=setup).collect()
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=repr)


def test_equals_brute_force(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    rows += [(1000 + i, prose(i % 150, 20 + i % 90)) for i in range(400)]  # equal texts: ties at every rank
    items = [(i, prose(i, 12)) for i in range(20)] + [(50, edited(prose(1, 300), 3, 9)[:400]), (51, None), (52, ""), (53, "zzz unknown"), (54, "the the THE Ünïcode 文字")]
    assert ask(spark, rows, items) == brute(rows, items)


def test_chunks_of_items_give_the_same(spark):
    rows = [(i, prose(i, 60)) for i in range(120)]
    items = [(i, prose(i, 10)) for i in range(7)]
    assert ask(spark, rows, items, Blocks(block=8, chunk=3)) == brute(rows, items)


def test_empty_tables_and_repeated_items(spark):
    rows = [(1, "alpha beta"), (2, "beta gamma")]
    assert ask(spark, [], [(1, "alpha")]) == [] == ask(spark, rows, [])
    assert ask(spark, rows, [(1, "beta"), (1, "beta")]) == brute(rows, [(1, "beta")])


def test_terms():
    assert terms("A-b_C9 é×文\x7f~x") == [t.encode() for t in re.findall(TERM, "A-b_C9 é×文\x7f~x".translate(LOWER))]


def random_shard(seed, setup, n=600, size=80):
    r = np.random.default_rng(seed)
    rows = [np.sort(r.choice(size, r.integers(1, 30), replace=False, p=(p := 1 / (1 + np.arange(size))) / p.sum())) for _ in range(n)]
    lens = np.array([len(x) for x in rows])
    cols = np.concatenate(rows)
    imps = impacts(np.repeat(r.integers(5, 400, n), lens), r.integers(1, 9, len(cols)), n, n * 100)
    weights = r.integers(1, 8000, size)
    beside = [np.arange(size)] * size
    return Shard(lens, cols, imps, weights, beside, setup), weights


def test_bounds_hold_and_blocks_are_skipped():
    shard, weights = random_shard(3, Blocks(block=16))
    dense = np.zeros(len(weights), np.int64)
    ids = np.array([0, 1, 2, 40, 60])
    dense[ids] = weights[ids]
    for t in ids:
        docs, bounds = shard.list_of(t), shard.summary(t) @ dense
        assert len(bounds) == -(-len(docs) // 16)
        for b, bound in enumerate(bounds):
            assert shard.score(docs[b * 16 : (b + 1) * 16], dense).max() <= bound
    scored = []
    full = shard.score
    shard.score = lambda d, w: (scored.append(len(d)), full(d, w))[1]
    found, scores = shard.search(ids, weights[ids], 1, few=False)
    every = full(np.arange(len(shard.lens)), dense)
    assert sorted(scores)[-20:] == sorted(every)[-20:]
    assert sum(scored) < len(shard.lens)  # bounds spare documents
    random.seed(0)
    for _ in range(30):
        ids = np.array(sorted(random.sample(range(80), 8)))
        dense[:] = 0
        dense[ids] = weights[ids]
        found, scores = shard.search(ids, weights[ids], 1, few=False)
        every = full(np.arange(len(shard.lens)), dense)
        floor = sorted(every)[-20]
        assert set(np.flatnonzero((every >= floor) & (every > 0))) <= set(found)
