"""Sets of tables are seen whole or not at all."""

import pytest
from pyspark.sql import functions as F

from agora.sources import table_sets as TS


def frames(spark, k):
    a = spark.range(5).select("id", (F.col("id") * k).alias("v"))
    b = spark.createDataFrame([(k, "line\nbreak\t\"q\"", None), (k + 1, "é", "x")], "k long, text string, other string")
    return {"a": a, "b": b}


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_round_trip_versions_and_clean_up(spark, tmp_path):
    root = str(tmp_path / "set")
    with pytest.raises(FileNotFoundError):
        TS.read_table_set(spark, root)
    assert TS.write_table_set(frames(spark, 1), root, {"b": "tsv"}) == 1
    assert TS.write_table_set(frames(spark, 2), root) == 2
    for number, k in ((None, 2), (2, 2), (1, 1)):
        got = TS.read_table_set(spark, root, number)
        want = frames(spark, k)
        assert set(got) == {"a", "b"} and all(rows(got[n]) == rows(want[n]) for n in got)
        assert got["a"].dtypes == want["a"].dtypes
    with pytest.raises(FileNotFoundError):
        TS.read_table_set(spark, root, 7)
    TS.drop_old_sets(spark, root)
    assert TS.table_sets(spark, root) == [2] and len(list((tmp_path / "set" / "data").iterdir())) == 1
    assert rows(TS.read_table_set(spark, root)["b"]) == rows(frames(spark, 2)["b"])


def test_a_broken_write_leaves_the_old_set(spark, tmp_path):
    root = str(tmp_path / "set")
    TS.write_table_set(frames(spark, 1), root)
    bad = frames(spark, 2) | {"z": spark.range(3).select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        TS.write_table_set(bad, root)
    got = TS.read_table_set(spark, root)
    assert set(got) == {"a", "b"} and rows(got["a"]) == rows(frames(spark, 1)["a"])
    assert TS.write_table_set(frames(spark, 3), root) == 2
    with pytest.raises(ValueError):
        TS.write_table_set({}, root)
    with pytest.raises(ValueError):
        TS.write_table_set(frames(spark, 3), root, {"a": "xls"})


def test_a_taken_number_is_not_overwritten(spark, tmp_path):
    folder = TS.Folder(spark, str(tmp_path))
    assert folder.write_once("manifests/1.json", "one") and not folder.write_once("manifests/1.json", "two")
    assert folder.read("manifests/1.json") == "one"


def test_gate(spark, tmp_path):
    root = str(tmp_path / "final")
    assert TS.write_gated(frames(spark, 1), root, 0.5) is None and TS.table_sets(spark, root) == []
    assert TS.write_gated(frames(spark, 1), root, 0.51) == 1
