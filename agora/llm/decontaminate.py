"""Benchmark decontamination: which documents contain which test items.

An item is contained in a document if at least ``percent`` of its distinct
five-word shingles are among the document's.  Search by size-partitioned
MinHash containment:

1. items are partitioned by their number of shingles (powers of two); every
   partition keeps, of each item, the ``probes`` smallest shingle hashes (its
   bottom-k MinHash sketch; all of them where the item has fewer);
2. every shingle of every whole document probes the sketches.  A document that
   contains an item holds each sketch member with probability ``percent``, so
   it holds none of eight with a probability under 0.2**8 = 3e-6; a document
   with fewer shingles than its partition's smallest item needs is pruned;
3. candidates are verified exactly: the items' shingles, as text, are counted
   in the candidate documents.

The sketch table is broadcast only after its row count was checked against a
bound; beyond it the same join runs as a shuffle join, whose hot shingles AQE
splits.  Everything is DataFrame expressions; no Python runs on executors.

Defined results: null, empty and short texts (under five words) have no
shingles: such items are contained nowhere, such documents contain nothing;
rows repeating an id count as one document or item with the union of their
shingles; rows without an id are not reported; empty tables give no rows.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import freeze
from agora.llm.shingling import shingle_rows, word_array

BROADCAST_ROWS = 500_000  # of a few numbers each: some tens of MB at most


def _small(df: DataFrame, rows: int) -> DataFrame:
    """A broadcast hint for a written table whose size was looked up."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _probes(hashed: DataFrame, probes: int) -> DataFrame:
    """``item_id, probe, least``: bottom-k sketches by size partition."""
    sized = hashed.groupBy("item_id").agg(F.count(F.lit(1)).alias("size"))
    part = F.pow(F.lit(2.0), F.floor(F.log2("size"))).cast("long")
    ranked = hashed.withColumn("at", F.row_number().over(Window.partitionBy("item_id").orderBy("h")))
    return ranked.where(F.col("at") <= probes).join(sized, "item_id").select("item_id", F.col("h").alias("probe"), part.alias("least"))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    n: int = 5,
    percent: int = 80,
    probes: int = 8,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``doc_id, item_id, item_shingles, shared_shingles, containment``."""
    wanted = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item_id"), word_array(F.col(item_text)).alias("words"))
    item_rows = freeze(shingle_rows(wanted, n, True, ["item_id"]).distinct(), "items")
    n_items = item_rows.count()
    # document shingles are hashed word by word, so item shingles are as well
    hashed = shingle_rows(wanted, n, False, ["item_id"]).withColumnRenamed("shingle", "h").distinct()
    probe_rows = freeze(_probes(hashed, probes), "probes")
    n_probes = probe_rows.count()

    source = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    doc_words = source.select("doc_id", word_array(F.col("text")).alias("words")).select("doc_id", "words", (F.size("words") - (n - 1)).alias("room"))
    probing = shingle_rows(doc_words, n, False, ["doc_id", "room"])
    candidates = freeze(
        probing.join(_small(probe_rows, n_probes), (F.col("shingle") == F.col("probe")) & (100 * F.col("room") >= percent * F.col("least")))
        .select("doc_id", "item_id")
        .distinct(),
        "candidates",
    )
    n_candidates = candidates.count()

    found = source.join(_small(candidates.select("doc_id").distinct(), n_candidates), "doc_id", "left_semi")
    held = shingle_rows(found.select("doc_id", word_array(F.col("text")).alias("words")), n, True, ["doc_id"])
    sizes = item_rows.groupBy("item_id").agg(F.count(F.lit(1)).alias("item_shingles"))
    shared = (
        held.join(_small(item_rows, n_items), "shingle")
        .join(_small(candidates, n_candidates), ["doc_id", "item_id"], "left_semi")
        .select("doc_id", "item_id", "shingle")
        .distinct()
        .groupBy("doc_id", "item_id")
        .agg(F.count(F.lit(1)).alias("shared_shingles"))
    )
    return (
        shared.join(sizes, "item_id")
        .where(100 * F.col("shared_shingles") >= percent * F.col("item_shingles"))
        .select("doc_id", "item_id", "item_shingles", "shared_shingles", F.round(F.col("shared_shingles") / F.col("item_shingles"), 6).alias("containment"))
    )
