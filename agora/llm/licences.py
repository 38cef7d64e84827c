"""License scans by canonical digest.

A text is normalised (lower case; copyright lines go; punctuation becomes
blanks; equivalent spellings become one) and hashed with SHA-256, as a whole
and line by line.  The digests are hash-joined with those of known licences,
normalised the same way: a document *is* a licence if its entire text matches,
and *carries* the licences whose entire one-line notice is one of its lines.

Plan: one scan writes a digest row per document and per line (texts are not
shuffled); known digests are broadcast only if their table is small, and then
lines of other digests are no rows at all; beyond the bound all lines are, and
the join shuffles.  Matching lines, few, are summed up per document.

Defined results: null, empty and blank texts, and texts of copyright lines
only, have a null digest and no licence; repeated rows are scanned row by row;
a row without an id is scanned like any other; a known text given under two
licences reports both; empty tables give no rows.  Only the named columns are
read.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import freeze
from agora.llm.licence_texts import EQUIVALENT, KNOWN_DIGESTS, KNOWN_TEXTS

BROADCAST_ROWS = 200_000  # digests of 32 bytes and a name: some 20 MB

#: The same patterns serve the SQL twin; classes are spelled out so that all
#: regex engines agree.
COPYRIGHT_LINE = r"(^|\n)[ \t#*/;-]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
PUNCTUATION = "[\\x00-/:-`{-\\x7f\u00a0-\u00bf\u2000-\u206f]+"
_COPYRIGHT = re.compile(COPYRIGHT_LINE)
_PUNCTUATION = re.compile(PUNCTUATION)
_SPELLINGS = dict(EQUIVALENT)
_SPELLING = re.compile("(?<= )(?:" + "|".join(sorted((re.escape(a) for a, _ in EQUIVALENT), key=len, reverse=True)) + ")(?= )")


def canonical(text: str | None) -> str:
    """The normalised text: words of letters and digits, one blank between."""
    text = _COPYRIGHT.sub("\n", (text or "").lower())
    text = " " + _PUNCTUATION.sub(" ", text).strip(" ") + " "
    return _SPELLING.sub(lambda m: _SPELLINGS[m[0]], text).strip(" ")


def canonical_digest(text: str | None) -> bytes | None:
    plain = canonical(text)
    return hashlib.sha256(plain.encode("utf-8")).digest() if plain else None


def known_digests(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """``digest, licence`` of known texts (by default the built-in ones and
    the built-in digests of longer texts)."""
    pairs = {(canonical_digest(t), name) for name, t in (texts or KNOWN_TEXTS)}
    if texts is None:
        pairs |= {(bytes.fromhex(d), name) for name, d in KNOWN_DIGESTS.items()}
    rows = sorted(pairs, key=str)
    return spark.createDataFrame([(bytearray(d), n) for d, n in rows if d], "digest binary, licence string")


def unit_digests(docs: DataFrame, key: str = "doc_id", text: str = "text", wanted: frozenset[bytes] | None = None) -> DataFrame:
    """``row, doc_id, line, digest``: line 0 is the whole text.  With
    ``wanted`` only lines of these digests are rows (whole texts always are)."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        keep = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, line, digest = [], [], []
                for i, t in enumerate(part.column(2).to_pylist()):
                    at.append(i)
                    line.append(0)
                    digest.append(canonical_digest(t))
                    for n, own in enumerate((t or "").split("\n"), 1):
                        d = canonical_digest(own)
                        if d and (keep is None or d in keep):
                            at.append(i)
                            line.append(n)
                            digest.append(d)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), part.column(1).take(take), pa.array(line, pa.int32()), pa.array(digest, pa.binary())],
                    names=["row", "doc_id", "line", "digest"],
                )

    return src.mapInArrow(run, f"row long, doc_id {kind}, line int, digest binary")


def scan_licences(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_digest, text_licence, notice_lines, notices`` per row;
    several licences are listed in order, separated by commas."""
    known = known if known is not None else known_digests(docs.sparkSession)
    names = known.groupBy(F.col("digest").alias("known")).agg(F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("licence"))
    small = known.count() <= BROADCAST_ROWS
    table = F.broadcast(names) if small else names
    wanted = frozenset(bytes(r["known"]) for r in names.select("known").collect()) if small else None
    units = freeze(unit_digests(docs, key, text, wanted), "units")
    whole = units.where("line = 0").join(table, F.col("digest") == F.col("known"), "left").select(
        "row", "doc_id", F.lower(F.hex("digest")).alias("text_digest"), F.col("licence").alias("text_licence")
    )
    lines = units.where("line > 0").join(table, F.col("digest") == F.col("known")).groupBy(F.col("row").alias("r")).agg(
        F.count(F.lit(1)).alias("notice_lines"), F.concat_ws(",", F.array_sort(F.collect_set("licence"))).alias("notices")
    )
    return whole.join(lines, F.col("row") == F.col("r"), "left").select(
        "doc_id", "text_digest", "text_licence", F.coalesce("notice_lines", F.lit(0)).alias("notice_lines"), F.coalesce("notices", F.lit("")).alias("notices")
    )
