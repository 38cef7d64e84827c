"""Hooks see texts only; levels by pointer doubling."""

import random

import pandas as pd

from agora.operators import quality as Q
from agora.operators import structure as St


def test_labels_and_translation(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", "z")], "id long, text string, other string")
    seen = []

    def scorer(texts):
        seen.append(list(texts))
        return pd.DataFrame({"t1": [[0, len(t), 1] for t in texts], "unused": [None] * len(texts), "t2": [[2, 2, 1] for _ in texts]})

    got = {r.id: (r.other, r.t1_ad, r.t2_ad) for r in Q.infer_labels(df, "text", scorer, ["t1", "t2"]).collect()}
    assert got == {1: ("x", 1, 0), 3: ("z", 2, 0)}  # the first maximum
    out = Q.translate_column(df, "text", "de", lambda s: s.str.upper())
    assert {r.id: r.de for r in out.collect()} == {1: "A B", 2: None, 3: ""} and out.columns == [*df.columns, "de"]


def test_levels_against_walking(spark):
    r = random.Random(6)
    rows, parent = [], {}
    for k in range(6):
        for n in range(60):
            p = None if n < 2 else r.choice([n - 1, n - 1, r.randrange(n)])
            parent[k, n] = p
            rows.append((k, n, p))
    rows += [(0, 100, 999), (0, 101, 100), (1, 200, 201), (1, 201, 200), (1, 202, 202), (2, 59, parent[2, 59])]  # missing parents, cycles, a repeated row
    got = St.node_levels(spark.createDataFrame(rows, "d long, n long, p long"), "d", "n", "p").collect()

    def level(k, n):
        return 1 if parent[k, n] is None else 1 + level(k, parent[k, n])

    assert sorted((x.d, x.n, x.level) for x in got) == sorted((k, n, level(k, n)) for k, n in parent)
    assert max(x.level for x in got) > 16
    assert St.node_levels(spark.createDataFrame([], "d long, n long, p long"), "d", "n", "p").count() == 0
