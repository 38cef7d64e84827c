"""Document fingerprints from prefix polynomial hashes.

A text's code points are hashed into prefix arrays of two polynomials modulo
2**31 - 1.  From them the hash of any span takes two reads, so spans are
compared without touching the text, longest common extensions are found by
binary search, and the spans of one length are hashed all at once: their
minima in 64 bins make the fingerprint (62 bits of the whole text's hash, its
length, then 16 bits per bin).  The likeness of two fingerprints is the share
of equal bins among those filled in either, an estimate of the share of spans
two texts have in common; it is 1 for fingerprints that are equal.

Defined results: null and empty texts are one empty text (no bins filled); a
text shorter than a span is one span; ties and repeated rows are ordered by
text; a null id comes after all others; an empty table gives no rows; a
single row is its own successor; ids that are no whole numbers are ordered by
their rank among the distinct ids.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import mix
from agora.operators.ranking import global_row_number

PRIME = (1 << 31) - 1
BASES = (1_000_003_919, 1_766_418_311)
BINS = 64
EMPTY = "ffff"
_P = np.uint64(PRIME)
_S = np.uint64(31)


def reduce(x: np.ndarray) -> np.ndarray:
    """Values under 2**63 modulo the prime (its form makes it shifts)."""
    x = (x & _P) + (x >> _S)
    x = (x & _P) + (x >> _S)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of a base and of its inverse, grown by doubling."""

    def __init__(self, base: int):
        self.up = self._seed(base)
        self.down = self._seed(pow(base, PRIME - 2, PRIME))

    @staticmethod
    def _seed(base: int) -> np.ndarray:
        return np.array([1, base], np.uint64)

    def reach(self, n: int) -> None:
        for name in ("up", "down"):
            have = getattr(self, name)
            while have.size < n:
                step = np.uint64(int(have[-1]) * int(have[1]) % PRIME)
                have = np.concatenate([have, reduce(have * step)])
            setattr(self, name, have)


_POWERS = [_Powers(b) for b in BASES]


class PrefixHash:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = points.size
        self.prefix = []
        for powers in _POWERS:
            powers.reach(self.n + 1)
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(reduce(points * powers.up[: self.n]), out=sums[1:])
            self.prefix.append(reduce(sums))

    def span(self, start: int, length: int) -> tuple[int, int]:
        """Hash of a span, the same wherever the span stands."""
        return tuple(
            (int(h[start + length]) - int(h[start])) * int(p.down[start]) % PRIME for h, p in zip(self.prefix, _POWERS)
        )

    def spans(self, length: int) -> np.ndarray:
        """Hashes (62 bits) of all spans of a length; of the whole text if it
        is shorter."""
        length = min(length, self.n)
        if not length:
            return np.zeros(0, np.uint64)
        out = np.zeros(self.n - length + 1, np.uint64)
        for h, p in zip(self.prefix, _POWERS):
            value = reduce(h[length:] + _P - h[: h.size - length])
            out = (out << _S) | reduce(value * p.down[: out.size])
        return out

    def equal(self, start: int, other: "PrefixHash", at: int, length: int) -> bool:
        return self.span(start, length) == other.span(at, length)

    def common_extension(self, start: int, other: "PrefixHash", at: int) -> int:
        """Length of the longest common span from two places on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def fingerprint(self, length: int) -> str:
        whole = self.span(0, self.n)
        bins = [EMPTY] * BINS
        keys = mix(self.spans(length))
        keys.sort()
        starts = np.searchsorted(keys, np.arange(BINS, dtype=np.uint64) << np.uint64(58))
        ends = np.append(starts[1:], keys.size)
        for b in np.flatnonzero(starts < ends):
            bins[b] = f"{int(keys[starts[b]]) % 0xFFFF:04x}"
        return f"{whole[0]:08x}{whole[1]:08x}{self.n:010x}" + "".join(bins)


def likeness(a: str, b: str) -> float:
    if a == b:
        return 1.0
    x, y = a[26:], b[26:]
    same = filled = 0
    for i in range(0, 4 * BINS, 4):
        p, q = x[i : i + 4], y[i : i + 4]
        if p != EMPTY or q != EMPTY:
            filled += 1
            same += p == q
    return same / filled if filled else 0.0


def with_successor(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``block, tail, doc_id, text`` in descending id order within blocks of
    ids, the blocks dealt over partitions; each block ends with the first
    row of the next one (``tail`` 1), the last block with the very first row.

    Blocks are id quantiles (their bounds and first rows, a few numbers per
    partition, are all that the driver sees), so every text is shuffled once.
    """
    spark = docs.sparkSession
    lowest = -(1 << 63)
    src = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if src.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        src = src.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    else:
        ranks = global_row_number(src.where("doc_id is not null").select(F.col("doc_id").alias("ranked")).distinct(), [F.col("ranked")], "rank")
        src = src.join(ranks, F.col("doc_id") == F.col("ranked"), "left").select("doc_id", "text", F.coalesce(F.col("rank").cast("long"), F.lit(lowest)).alias("at"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / (4 * width) for i in range(1, 4 * width)]
    ids = src.select("at")
    bounds = ids.agg(F.percentile_approx("at", points, 20 * width).alias("q")).first()["q"]
    if not bounds:  # no rows
        return src.select(F.lit(0.0).alias("block"), F.lit(0).alias("tail"), "doc_id", "text")
    splits = [-float("inf"), *sorted({float(b) for b in bounds}), float("inf")]
    block = Bucketizer(splits=splits, inputCol="__at", outputCol="block")
    blocks = lambda df: block.transform(df.withColumn("__at", F.col("at").cast("double"))).drop("__at")
    firsts = sorted((r["block"], r["first"]) for r in blocks(ids).groupBy("block").agg(F.max("at").alias("first")).collect())
    # the first row of a block ends the next higher one; the highest block's ends the lowest
    ends = [(first, firsts[(i + 1) % len(firsts)][0]) for i, (_, first) in enumerate(firsts)]
    ends_df = F.broadcast(spark.createDataFrame(ends, "first long, home double"))  # one row per block
    own = F.struct(F.col("block"), F.lit(0).alias("tail"))
    extra = F.struct(F.col("home").alias("block"), F.lit(1).alias("tail"))
    rows = blocks(src).join(ends_df, F.col("at") == F.col("first"), "left").withColumn(
        "home", F.explode(F.when(F.col("home").isNull(), F.array(own)).otherwise(F.array(own, extra)))
    )
    rows = rows.select("home.block", "home.tail", "doc_id", "text", "at").repartition(width, "block")
    return rows.sortWithinPartitions("block", "tail", F.desc("at"), "text").drop("at")


def fingerprint_edits(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = 8) -> DataFrame:
    """Fingerprints of every text, of its edited text (the last half replaced
    by the beginning of the next text) and their likenesses; see the column
    names.  ``shared_prefix`` is the longest common extension of text and
    edited text from their beginnings."""
    rows = with_successor(docs, key, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_prefix"]

    def run(batches):
        before = None  # block, id, text, its hashes and its fingerprint
        for batch in batches:
            out: list[list] = [[] for _ in names]
            id_type = batch.schema.types[2]
            for block, tail, doc, own in zip(*(c.to_pylist() for c in batch.columns)):
                if tail and (before is None or before[0] != block):
                    continue  # a further row with the same first id
                hashed = PrefixHash(own)
                print_ = hashed.fingerprint(span)
                if before is not None and before[0] == block:
                    _, last, source, source_hash, source_print = before
                    cut = len(source) // 2
                    edited = source[: len(source) - cut] + own[:cut]
                    edit_hash = PrefixHash(edited)
                    edit_print = edit_hash.fingerprint(span)
                    values = (
                        last, len(source), hashlib.sha256(edited.encode("utf-8")).hexdigest(), source_print, edit_print,
                        likeness(source_print, edit_print), likeness(source_print, print_), source_hash.common_extension(0, edit_hash, 0),
                    )
                    for col, v in zip(out, values):
                        col.append(v)
                before = None if tail else (block, doc, own, hashed, print_)
            kinds = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_prefix long"
    )
