"""Grid DBSCAN equals the all-pairs DBSCAN, including a skewed set where a
third of the points nearly coincide, and per group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import cluster as C

COLS = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.RandomState(1)
    x = np.vstack([rng.normal(0, 0.01, (200, 3)), rng.normal(2, 0.3, (200, 3)), rng.uniform(-3, 5, (150, 3)),
                   rng.normal(-1.5, 0.2, (60, 3))])
    return spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "pid long, x0 double, x1 double, x2 double")


@pytest.mark.parametrize("eps,ms", [(0.3, 5), (0.7, 10), (0.15, 4)])
def test_grid_equals_pairs(spark, skewed, eps, ms):
    a = {r.pid: r.cluster for r in C.dbscan(skewed, COLS, eps, ms).collect()}
    b = {r.pid: r.cluster for r in C.dbscan_pairs(skewed, COLS, eps, ms).collect()}
    assert a == b
    assert len(set(a.values())) > 1


def test_grouped(spark, skewed):
    g = skewed.select(F.lit(0).alias("grp"), "*").unionByName(
            skewed.select(F.lit(1).alias("grp"), "pid", (F.col("x0") * 2).alias("x0"), "x1", "x2"))
    a = {(r.grp, r.pid): r.cluster for r in C.dbscan(g, COLS, 0.3, 5, group="grp").collect()}
    b = {(r.grp, r.pid): r.cluster for r in C.dbscan_pairs(g, COLS, 0.3, 5, group="grp").collect()}
    assert a == b
