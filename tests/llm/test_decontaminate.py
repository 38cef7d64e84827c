import random

from agora.llm.common import words
from agora.llm.decontaminate import contained_items
from tests.llm.cases import SCHEMA, awkward, clashing, documents, prose

ITEMS = "item_id long, text string"


def shingles(text, n=5):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def brute(docs, items, percent=80):
    out = {}
    sets = {}
    for i, t in docs:
        if i is not None:
            sets.setdefault(i, set()).update(shingles(t))
    wanted = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(shingles(t))
    for d, own in sets.items():
        for i, w in wanted.items():
            both = len(own & w)
            if w and 100 * both >= percent * len(w):
                out[d, i] = (len(w), both)
    return out


def test_brute_force(spark):
    r = random.Random(1)
    items = [(i, prose(500 + i, r.randint(5, 60))) for i in range(30)] + [(90, None), (91, ""), (92, "too short"), (None, prose(7, 30)), (3, prose(503, 20))]
    rows = awkward()
    for k in range(40):
        w = prose(900 + k, 200).split(" ")
        own = items[k % 30][1].split(" ")
        if k % 3 == 1:  # one edit
            own[len(own) // 2] = "changed"
        if k % 3 == 2:
            own = own[: len(own) // 2]
        w[50:50] = own
        text = " ".join(w).upper() if k % 5 == 0 else " \n ".join(w)
        rows.append((2000 + k, text, "en", "s", len(text)))
    want = brute([r[:2] for r in rows], items)
    got = contained_items(clashing(documents(spark, rows)), clashing(spark.createDataFrame(items, ITEMS).withColumnRenamed("text", "t")).withColumnRenamed("t", "body"), item_text="body")
    assert {(r.doc_id, r.item_id): (r.item_shingles, r.shared_shingles) for r in got.collect()} == want
    assert len(want) >= 15


def test_shuffle_join_beyond_the_bound(spark, monkeypatch):
    from agora.llm import decontaminate

    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    items = [(1, prose(8, 250)[:300])]
    got = contained_items(documents(spark), spark.createDataFrame(items, ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(8, 1)]


def test_empty_tables(spark):
    none, items = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEMS)
    assert contained_items(none, spark.createDataFrame([(1, "a b c d e f")], ITEMS)).count() == 0
    assert contained_items(documents(spark), items).count() == 0


def test_no_python_on_executors(spark):
    plan = contained_items(documents(spark), spark.createDataFrame([(1, "a b c d e f")], ITEMS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
