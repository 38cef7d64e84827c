"""Helpers shared by the corpus operators: table scans, written intermediate
tables, token words and the numpy hashing kernels."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/llm-{label}-{uuid.uuid4().hex[:12]}"


def freeze(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and reread
    it: cuts the lineage (a lost executor costs no recomputation before this
    point) and keeps later plans short."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_tree(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system that holds it."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def fold(key: Column, folds: int = 5) -> Column:
    """``crc32`` of the key's decimal text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def words(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII white space characters, A-Z in lower
    case; both rules are those of ``bytes.lower`` and ``bytes.split``."""
    return text.encode("utf-8").lower().split() if text else []


# --- numpy kernels -----------------------------------------------------------
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finalizer (spreads close inputs over all bits)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word: a polynomial over its bytes, mixed with its
    length.  The whole document is hashed by a handful of array operations."""
    n = len(tokens)
    if not n:
        return np.empty(0, np.uint64)
    buf = np.frombuffer(b"".join(tokens), np.uint8).astype(np.uint64) + np.uint64(1)
    lens = np.fromiter(map(len, tokens), np.int64, n)
    starts = np.cumsum(lens) - lens
    powers = np.full(int(lens.max()), _ODD, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    at = np.arange(buf.size) - np.repeat(starts, lens)
    return mix(np.add.reduceat(buf * powers[at], starts) + lens.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingle_hashes(tokens: list[bytes], n: int) -> np.ndarray:
    """Distinct hashes of the ``n``-word shingles; a shorter text is one
    shingle made of all its words, no words give none."""
    h = word_hashes(tokens)
    if not h.size:
        return h
    k = min(n, h.size)
    out = h[: h.size - k + 1].copy()
    for i in range(1, k):
        out = mix(out * _ODD + h[i : h.size - k + 1 + i])
    return np.unique(out + np.uint64(k))
