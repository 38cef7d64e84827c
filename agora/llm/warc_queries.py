"""Query of the WARC writer: every page is archived and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.warc import archive_pages


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"), least_bytes=0)



QUERIES = {"op2_warc": op2_warc}
ORACLE: dict[str, str] = {}
