"""Query of language-model scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.ppm import score_texts


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


QUERIES = {"op6_ppm": op6_ppm}
ORACLE: dict[str, str] = {}
