"""Query of main-text extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.htmltext import extract_text


def op5_htmltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


QUERIES = {"op5_htmltext": op5_htmltext}
ORACLE: dict[str, str] = {}
