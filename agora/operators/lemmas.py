"""T12 with a dictionary: tokens looked up in a (token, lemma) table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.text import lemma
from agora.session import cut_lineage, written

#: bytes of token and lemma text up to which every task holds the table
TABLE_BYTES = 32 << 20


def lemmatize_by_table(docs: DataFrame, key: str, tokens: str, table: DataFrame, out: str = "lemmas", most_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` with the array ``out``: each token's lemma from ``table``
    (token, lemma; of repeated tokens the smallest lemma), by the plural rules
    where it has none; a null array stays null, null tokens go.

    A table within ``most_bytes`` is a hash map of every task, and documents
    pass in Arrow batches.  Beyond it the corpus' tokens found in most documents
    (with their lemma, or without one), as many as ``most_bytes`` hold, are that
    map; only a document's other tokens are shuffled, once, to meet the table."""
    known = table.where(F.col("token").isNotNull() & F.col("lemma").isNotNull()).groupBy("token").agg(F.min("lemma").alias("lemma"))
    known = cut_lineage(known)
    size = known.agg(F.coalesce(F.sum(F.octet_length("token") + F.octet_length("lemma")), F.lit(0))).first()[0]
    clean = F.filter(F.col(tokens), lambda t: t.isNotNull())
    kind = docs.select(F.col(key).alias("k")).schema["k"].dataType.simpleString()
    merged = F.zip_with("t", "l", lambda t, x: F.coalesce(x, lemma(t)))
    if size <= most_bytes:
        src = docs.select(F.col(key).alias("k"), clean.alias("t"))
        looked = src.mapInArrow(_lookup({r["token"]: r["lemma"] for r in known.toLocalIterator()}), f"k {kind}, t array<string>, l array<string>")
        return looked.select(F.col("k").alias(key), F.col("t").alias(tokens), merged.alias(out))
    rows = written(docs.select(F.col(key).alias("k"), clean.alias("t"), F.monotonically_increasing_id().alias("r")), "lemma-rows")
    counts = rows.select(F.explode(F.array_distinct("t")).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    words = written(counts.join(known, "token", "left").select("token", "lemma", F.floor(F.log2("n")).alias("step")), "lemma-words")
    frequent, least = _frequent(words, most_bytes)
    rare = words.where((F.col("step") < least) & F.col("lemma").isNotNull()).select("token", "lemma")

    def others(batches):
        for batch in batches:
            left = [() if row is None else {t for t in row if t not in frequent} for row in batch.column(1).to_pylist()]
            at = pa.array([i for i, ts in enumerate(left) for _ in ts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([t for ts in left for t in ts], pa.string())], names=["r", "token"])

    own = rows.select("r", "t").mapInArrow(others, "r long, token string").join(rare, "token")
    own = own.groupBy("r").agg(F.map_from_entries(F.collect_list(F.struct("token", "lemma"))).alias("m"))
    src = rows.join(own, "r", "left").select("k", "t", "m")
    looked = src.mapInArrow(_lookup(frequent), f"k {kind}, t array<string>, l array<string>")
    return looked.select(F.col("k").alias(key), F.col("t").alias(tokens), merged.alias(out))


def _lookup(lemmas: dict):
    """(key, tokens, lemmas) of batches (key, tokens, the row's own lemmas if any)."""

    def run(batches):
        for batch in batches:
            rows = batch.column(1).to_pylist()
            maps = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * len(rows)
            found = [None if row is None else [lemmas.get(t) for t in row] if not own else [own.get(t, lemmas.get(t)) for t in row] for row, own in zip(rows, map(dict, (m or () for m in maps)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.string()))], names=["k", "t", "l"])

    return run


def _frequent(words: DataFrame, most_bytes: int) -> tuple[dict, int]:
    """The tokens of the highest steps (powers of two of documents) that fit,
    with their lemma or None, and the lowest of these steps."""
    size = F.sum(F.octet_length("token") + F.coalesce(F.octet_length("lemma"), F.lit(0)))
    held, least = 0, 64
    for r in words.groupBy("step").agg(size.alias("b")).orderBy(F.desc("step")).collect():  # a row per power of two
        held += r["b"]
        if held > most_bytes:
            break
        least = r["step"]
    return {r["token"]: r["lemma"] for r in words.where(F.col("step") >= least).toLocalIterator()}, least
