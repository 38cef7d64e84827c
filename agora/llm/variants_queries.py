"""Query of spelling variant grouping (SQL has no crc32: brute-force test)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.variants import spelling_variants


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


QUERIES = {"op12_variants": op12_variants}
ORACLE: dict[str, str] = {}
