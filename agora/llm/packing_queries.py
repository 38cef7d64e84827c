"""Query of best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.packing import pack_documents

VOCABULARY = "word_bpe_49k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())


QUERIES = {"op3_packing": op3_packing}
ORACLE: dict[str, str] = {}
