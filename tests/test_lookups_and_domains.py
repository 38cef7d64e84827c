"""Lemma tables, many-valued keywords, the first discussion of an id."""

import pytest
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import domains as D
from agora.operators import graph as G
from agora.operators.lemmas import lemmatize_by_table


def test_exceptions_and_rules(spark):
    words = {"news": "news", "series": "series", "dies": "die", "women": "woman", "cities": "city", "boxes": "box", "models": "model", "class": "class", "gas": "gas"}
    df = spark.createDataFrame([(list(words),)], "t array<string>")
    assert df.select(T.lemmatize("t")).first()[0] == list(words.values())


def test_table_in_memory_and_joined(spark):
    docs = spark.createDataFrame([(1, ["dogs", "ran", "ran", "x", None]), (2, None), (3, []), (1, ["ran"]), (None, ["feet", "cars"])], "id long, t array<string>")
    table = spark.createDataFrame([("ran", "run"), ("ran", "sprint"), ("feet", "foot"), ("x", None), (None, "y")], "token string, lemma string")
    want = sorted([(1, ["dog", "run", "run", "x"]), (2, None), (3, []), (1, ["run"]), (None, ["foot", "car"])], key=repr)
    for limit in (1 << 20, 0):
        got = lemmatize_by_table(docs, "id", "t", table, most_bytes=limit)
        assert sorted(((r.id, r.lemmas) for r in got.collect()), key=repr) == want


def test_large_table_shuffles_rare_tokens_only(spark, monkeypatch):
    import agora.operators.lemmas as L

    docs = spark.createDataFrame([(i, ["common", "often", f"word{i}", f"none{i}"]) for i in range(40)], "id long, t array<string>")
    table = spark.createDataFrame([("common", "c"), *[(f"word{i}", f"w{i}") for i in range(40)]], "token string, lemma string")
    held, frequent = [], L._frequent
    monkeypatch.setattr(L, "_frequent", lambda *a: held.append(frequent(*a)) or held[-1])
    got = lemmatize_by_table(docs, "id", "t", table, most_bytes=30)
    assert {r.id: r.lemmas for r in got.collect()} == {i: ["c", "often", f"w{i}", f"none{i}"] for i in range(40)}
    # tokens of many documents, known or not, are looked up where they stand
    assert held == [({"common": "c", "often": None}, 5)]


def test_keyword_under_two_domains(spark):
    taxonomy = {"A": ["Tree", "two words"], "B": ["tree", "tree", "leaf"], "C": ["none"]}
    df = spark.createDataFrame([("a tree", "and a leaf"), ("two words", None), ("TREE", "tree")], "title string, content string")
    assert [r[0] for r in df.select(D.domains_by_content(F.col("title"), F.col("content"), taxonomy)).collect()] == [["A", "B"], ["General"], ["A", "B"]]
    assert [sorted(r[0]) for r in df.select(D.domain_hits(F.col("title"), F.col("content"), taxonomy)).collect()] == [["A", "B", "B"], [], ["A", "B"]]
    tags = spark.createDataFrame([(["TREE", "leaf"],)], "t array<string>")
    assert tags.select(D.domains_by_tags("t", taxonomy)).first()[0] == ["B"]  # of a tag the last domain counts


def test_first_discussion_counts_and_a_missing_one_fails(spark):
    d = spark.createDataFrame([(1, "late", "gold", "Master", 9), (1, "early", "gold", "Master", 2), (2, "other", None, None, 3)], "id long, user string, medal string, expertise string, load_order long")
    schema = "discussion_id long, user string, votes int, medal string, expertise string, is_appreciation boolean, is_deleted boolean, datetime timestamp"
    row = lambda i: (i, "c", 3, "gold", "Master", True, False, None)
    com = spark.createDataFrame([row(1), row(2)], schema)
    assert sorted(r.dst for r in G.interactions(d, com, "2024-01-01").collect()) == ["early", "other"]
    lost = com.union(spark.createDataFrame([row(7)], schema))
    with pytest.raises(Exception, match="no discussion has the id of a comment: 7"):
        G.interactions(d, lost, "2024-01-01").collect()
    assert G.interactions(d, lost, "2024-01-01", missing="skip").count() == 2
    assert [r.discussion_id for r in G.orphan_comments(d, lost).collect()] == [7]
