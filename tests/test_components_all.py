"""Components over all ties, weak ones too, against a union-find over the edges."""

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_weak_ties_join(spark):
    q = E.queries()
    up = {r.node: r.node for r in q["in_degree"](spark, SF).collect()}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for e in q["edges"](spark, SF).collect():
        a, b = sorted((top(e.src), top(e.dst)))
        up[b] = a
    want = {}
    for x in up:
        want[top(x)] = want.get(top(x), 0) + 1
    assert {r.component: r["size"] for r in q["components_all"](spark, SF).collect()} == want
    assert len(want) < q["components"](spark, SF).count()
