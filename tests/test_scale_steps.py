"""Steps that must not grow with what their result does not need."""

import pandas as pd

from agora.operators import quality as Q
from agora.plans import quality_plans as QP
from agora.sources import sinks as Sk
from agora.sources import splits as Sp

SF = "/root/testdata/sf0.001"


def test_a_scorer_gets_few_texts_at_a_time(spark):
    most = Q.SLICE_ROWS if hasattr(Q, "SLICE_ROWS") else 512

    def scorer(texts: pd.Series) -> pd.DataFrame:
        assert len(texts) <= most
        return pd.DataFrame({"x": [[1.0, float(len(t))] for t in texts], "y": [[len(t), 3] for t in texts]})

    docs = spark.createDataFrame([(i, "t" * (i % 5)) for i in range(2000)] + [(5000, None)], "id long, text string").coalesce(1)
    got = {r.id: (r.x_ad, r.y_ad) for r in Q.infer_labels(docs, "text", scorer, ["x", "y"]).collect()}
    assert got == {i: (int(i % 5 > 1), int(i % 5 < 3)) for i in range(2000)}


def test_merged_rows_hold_no_labels(spark):
    assert not [c for c in QP.merged(spark, SF).columns if c.endswith("_ad")]


def test_records_of_one_line_are_not_gathered(spark, tmp_path):
    rows = [(1, "a"), (2, "b\nc"), (3, 'q"'), (4, "d\n\ne"), (5, "z")]
    Sk.write_tsv(spark.createDataFrame(rows, "id long, text string").coalesce(1), str(tmp_path / "t"))
    found = Sp.quoted_records(spark, str(tmp_path / "t"))
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert [r.record for r in found.orderBy("at").collect()] == ["id\ttext", "1\ta", '2\t"b\nc"', '3\t"q"""', '4\t"d\n\ne"', "5\tz"]



def test_topic_format_shuffles_once(spark):
    import __spark_entry__ as E

    plan = E.queries()["topic_format"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
