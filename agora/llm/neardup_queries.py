"""Query of the near-duplicate search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.neardup import MinMax, near_duplicates


def op9_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinMax(shingle=3, percent=85))


QUERIES = {"op9_neardup": op9_neardup}
ORACLE: dict[str, str] = {}
