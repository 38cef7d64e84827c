"""Word shingles as column expressions (no Python on the executors)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = r"[\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    """Lower-cased (A-Z) runs of non-blanks; null text gives no words."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BLANKS), lambda w: w != "")


def shingle_rows(words: DataFrame, n: int, exact: bool, keep: list[str]) -> DataFrame:
    """One row per ``n``-word shingle of the array ``words``: column
    ``shingle`` holds its words joined by blanks if ``exact``, else a 64-bit
    hash of its word hashes.  Arrays shorter than ``n`` give no row."""
    unit = F.col("words") if exact else F.transform("words", lambda w: F.xxhash64(w))
    cols = [f"__w{i}" for i in range(n)]
    longest = 1 << 30
    rows = (
        words.where(F.size("words") >= n)
        .select(*keep, unit.alias("__u"))
        .select(*keep, F.inline(F.arrays_zip(*[F.slice("__u", i + 1, longest).alias(str(i)) for i in range(n)])).alias(*cols))
        .where(F.col(cols[-1]).isNotNull())  # the zipped tails are shorter
    )
    value = F.concat_ws(" ", *cols) if exact else F.xxhash64(*cols)
    return rows.select(*keep, value.alias("shingle"))
