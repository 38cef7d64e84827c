"""Distribution arithmetic as array expressions (M4, M5)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def kl_divergence(p, q) -> Column:
    """sum p*ln(p/q) with 0 for p == 0 and +inf for p > 0, q == 0."""
    p = F.col(p) if isinstance(p, str) else p
    q = F.col(q) if isinstance(q, str) else q
    terms = F.zip_with(
        p, q,
        lambda x, y: F.when(x == 0, F.lit(0.0))
        .when(y == 0, F.lit(float("inf")))
        .otherwise(x * F.log(x / y)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def kl_divergence_sql(p: str, q: str) -> str:
    return (f"list_sum(list_transform(list_zip({p}, {q}), lambda z: CASE WHEN z[1] = 0 THEN 0.0 "
            f"WHEN z[2] = 0 THEN CAST('inf' AS DOUBLE) ELSE z[1] * ln(z[1] / z[2]) END))")


def densify(sparse, k: int) -> Column:
    """M4: map<int,double> of (topic, prob) -> dense length-k array, 0 elsewhere."""
    m = F.col(sparse) if isinstance(sparse, str) else sparse
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0)))


def normalize(arr) -> Column:
    a = F.col(arr) if isinstance(arr, str) else arr
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(a, lambda x: x / total)
