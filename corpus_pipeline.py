"""Corpus preparation in stages: quality, line dedup, near-dedup, benchmark
decontamination, packing.

``STAGES`` lists (name, function); each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and reread as
the next stage's ``docs``.  All but the last keep the columns of ``docs``.

Decisions: documents that the classifier rejects go; runs of repeated lines of
50 words or more go from the texts (``n_chars`` follows), and a document of
which no word is left goes with them (all its lines stand in documents with
smaller ids); a document at least half of which stands elsewhere, but not all,
is a matter for the next stage and stays whole; of linked near-duplicates the
smallest id stays, of equal rows one; documents that contain a benchmark item
go; what is left is packed.  Rows of one id with different texts are documents
of their own throughout; rows without an id pass both near-dedup and the
decontamination stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import freeze, table
from agora.llm.decontaminate import BROADCAST_ROWS, contained_items
from agora.llm.linededup import Chunks, dedup_lines
from agora.llm.neardup import MinMax, near_duplicates
from agora.llm.packing import pack_documents
from agora.llm.packing_queries import vocabulary_path
from agora.llm.quality import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = dedup_lines(docs, setup=Chunks(most=50)).where("__removed_lines = 0 or __left_words > 0")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        left = left.withColumn("n_chars", F.when(F.col("__removed_lines") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def row_key(key: str, text: str):
    """An exact number per (id, text), in the order of the ids."""
    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text), F.lit(""))), 4)
    return (F.col(key).cast("decimal(20,0)") * F.lit(1 << 60).cast("decimal(19,0)") + mark.cast("decimal(20,0)")).cast("decimal(38,0)")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    named = docs.where(F.col("doc_id").isNotNull()).withColumn("__key", row_key("doc_id", "text"))
    found = near_duplicates(named, MinMax(shingle=5, percent=80), key="__key")
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    kept = named.join(gone, F.col("__key") == F.col("__gone"), "left_anti").dropDuplicates(["__key"])
    return kept.drop("__key").union(docs.where(F.col("doc_id").isNull()))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    dirty = freeze(found.select(F.col("doc_id").alias("__dirty")).distinct(), "dirty")
    small = dirty.count() <= BROADCAST_ROWS  # beyond it the same join shuffles
    return docs.join(F.broadcast(dirty) if small else dirty, docs["doc_id"] == dirty["__dirty"], "left_anti")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("best-fit packing", packing),
]

#: SQL cannot express the classifier; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
