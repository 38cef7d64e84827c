import pytest

from agora.llm.common import words
from agora.llm.graph import components
from agora.llm.neardup import MinMax, near_duplicates
from tests.llm.cases import SCHEMA, awkward, clashing, documents, edited, prose


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            sets[i] = set() if not w else {tuple(w)} if len(w) < k else set(zip(*(w[j:] for j in range(k))))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_brute_force(spark, k, percent):
    rows = awkward()
    want = brute([(r[0], r[1]) for r in rows], k, percent)
    got = near_duplicates(clashing(documents(spark)), MinMax(k, percent)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
            assert r.kept == (r.component_id == r.doc_id)


def test_bridges_between_components(spark):
    # a chain of edits: neighbours are linked, ends are not
    text, rows = prose(5, 200), []
    for i in range(25):
        rows.append((1000 - 7 * i, text, "en", "s", len(text)))
        text = edited(text, i, 70)
    want = brute([r[:2] for r in rows], 3, 85)
    got = near_duplicates(documents(spark, rows), MinMax()).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signature_estimates_jaccard():
    import numpy as np

    method = MinMax(3, 85)
    a, b = method.parameters()
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2**63, 1000).astype(np.uint64)
    y = np.concatenate([x[:700], rng.integers(0, 2**63, 300).astype(np.uint64)])
    same = (method.signature(x, a, b) == method.signature(y, a, b)).mean()
    assert abs(same - 700 / 1300) < 0.15


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}
