"""Quality classifier: regularised quadratic discriminant analysis over
transformed document statistics.

One scan turns every whole text into a short vector of statistics.  Class
counts, sums and outer products of the labelled training rows are added up by
Spark (two rows of d*d numbers reach the driver, whatever the input size);
each class covariance is shrunk towards the diagonal of the pooled one and
factored once (Cholesky), and documents are scored from the difference of the
two Mahalanobis log densities plus the log prior odds.

Defined results: null and empty texts have the statistics of an empty text and
are scored like any other; label rows with a null label or key are ignored;
repeated label rows count once per row, repeated documents are scored row by
row; if a class has no training rows the score is the share of label 1 (0.5
without any label).  Only the named key, text and label columns are read, so
extra columns never clash.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import fold, freeze, words

STATISTICS = (
    "log_bytes log_words word_length word_length_spread distinct_words repeats top_word upper digits "
    "spaces lines stops symbols symbol_ends bare_symbols non_ascii line_words"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not (_LETTER[b] or 48 <= b <= 57 or b in b".,;:'\"()-?")]] = True


def document_statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text (see ``STATISTICS``): sizes on a
    log scale, shares as ``log(share + 0.01)`` so that rare symbols tell."""
    data = (text or "").encode("utf-8")
    tokens = data.lower().split()
    n, m = max(1, len(data)), max(1, len(tokens))
    by = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    lens = np.fromiter(map(len, tokens), np.int64, len(tokens))
    counts = Counter(tokens)
    ends = Counter(t[-1] for t in tokens)
    symbol_ends = sum(c for b, c in ends.items() if _SYMBOL[b])
    bare = sum(c for t, c in counts.items() if len(t) == 1 and _SYMBOL[t[0]])
    repeats = sum(a == b for a, b in zip(tokens, tokens[1:]))
    lines = int(by[10]) + 1
    share = lambda x, of: float(np.log(x / of + 0.01))
    return [
        float(np.log1p(len(data))),
        float(np.log1p(len(tokens))),
        float(np.log1p(lens.mean())) if tokens else 0.0,
        float(np.log1p(lens.std())) if tokens else 0.0,
        # distinct words fall with length by a power: the exponent does not
        float(np.log1p(len(counts)) / np.log1p(m)),
        share(repeats, m),
        share(max(counts.values(), default=0), m),
        share(int(by[65:91].sum()), n),
        share(int(by[48:58].sum()), n),
        share(int(by[32]), n),
        share(lines, m),
        share(int(by[46] + by[44]), m),
        share(int(by[_SYMBOL].sum()), n),
        share(symbol_ends, m),
        share(bare, m),
        share(int(by[128:].sum()), n),
        float(np.log1p(m / lines)),
    ]


def _statistics_batches(batches):
    for batch in batches:
        keys, texts = batch.column(0), batch.column(1).to_pylist()
        rows = np.array([document_statistics(t) for t in texts], np.float64).reshape(len(texts), len(STATISTICS))
        yield pa.RecordBatch.from_arrays(
            [keys, pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), len(STATISTICS)).cast(pa.list_(pa.float64()))],
            names=["key", "x"],
        )


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the vector ``x`` of every document, in one scan."""
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = src.schema["key"].dataType.simpleString()
    return src.mapInArrow(_statistics_batches, f"key {kind}, x array<double>")


@dataclass(frozen=True)
class Discriminant:
    """Two Gaussians on standardised statistics; ``whiten`` holds the inverse
    Cholesky factors, so a log density is one triangular product."""

    shift: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, np.ndarray]
    whiten: tuple[np.ndarray, np.ndarray]
    offset: tuple[float, float]
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        log = [o - 0.5 * (((z - m) @ w.T) ** 2).sum(axis=1) for m, w, o in zip(self.means, self.whiten, self.offset)]
        return 1.0 / (1.0 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """``moments``: per class the row count, sums and outer product sums.
    Class covariance = (1 - shrinkage) * own + shrinkage * diagonal of the
    pooled one + ridge, on standardised statistics."""
    empty = np.zeros(0)
    n = {k: moments[k][0] if k in moments else 0.0 for k in (0, 1)}
    if not n[0] or not n[1]:
        total = n[0] + n[1]
        return Discriminant(empty, empty, (empty, empty), (empty, empty), (0.0, 0.0), n[1] / total if total else 0.5)
    total = n[0] + n[1]
    shift = (moments[0][1] + moments[1][1]) / total
    spread = np.diag(moments[0][2] + moments[1][2]) / total - shift**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    means, covs = [], []
    for k in (0, 1):
        m = (moments[k][1] / n[k] - shift) / scale
        second = (moments[k][2] - np.outer(moments[k][1], shift) - np.outer(shift, moments[k][1])) / n[k] + np.outer(shift, shift)
        means.append(m)
        covs.append(second / np.outer(scale, scale) - np.outer(m, m))
    pooled = np.diag((n[0] * np.diag(covs[0]) + n[1] * np.diag(covs[1])) / total)
    whiten, offset = [], []
    for k in (0, 1):
        lower = np.linalg.cholesky((1 - shrinkage) * covs[k] + shrinkage * pooled + ridge * np.eye(len(shift)))
        whiten.append(np.linalg.inv(lower))
        offset.append(float(np.log(n[k] / total) - np.log(np.diag(lower)).sum()))
    return Discriminant(shift, scale, tuple(means), tuple(whiten), tuple(offset))


def class_moments(labelled: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Moments per class of rows (``x``, ``label``): partial sums per Arrow
    batch, added up by Spark entry by entry."""
    d = len(STATISTICS)

    def partial(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64).reshape(-1, d)
            y = batch.column(1).to_numpy(zero_copy_only=False)
            for k in (0, 1):
                if (own := x[y == k]).size:
                    sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(sums.size, k, np.int32)), pa.array(np.arange(sums.size, dtype=np.int32)), pa.array(sums)],
                        names=["label", "at", "v"],
                    )

    sums = labelled.select("x", "label").mapInArrow(partial, "label int, at int, v double")
    out: dict[int, np.ndarray] = {}
    for r in sums.groupBy("label", "at").agg(F.sum("v").alias("v")).collect():  # 2 * (1 + d + d*d) numbers
        out.setdefault(r["label"], np.zeros(1 + d + d * d))[r["at"]] = r["v"]
    return {k: (float(v[0]), v[1 : 1 + d], v[1 + d :].reshape(d, d)) for k, v in out.items()}


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", shrinkage: float = 0.1) -> Discriminant:
    """The discriminant of the labelled rows outside the held-out fold."""
    rows = labels.where(F.col(label).isin(0, 1) & (fold(F.col(key)) != 0)).select(F.col(key).alias("k"), F.col(label).cast("int").alias("label"))
    return fit(class_moments(stats.join(rows, stats["key"] == rows["k"]).select("x", "label")), shrinkage)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whole, that the classifier does not reject; rows
    are judged where they stand, without a shuffle."""
    model = train(freeze(statistics(docs, key, text), "statistics"), labels, key)
    at = docs.columns.index(text)

    def judge(batches):
        for batch in batches:
            x = np.array([document_statistics(t) for t in batch.column(at).to_pylist()], np.float64).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.scores(x) >= threshold))

    return docs.mapInArrow(judge, docs.schema)


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    threshold: float = 0.3,
    shrinkage: float = 0.1,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document row; learns
    only from labelled rows outside the held-out fold (crc32(key) mod 5 = 0)."""
    stats = freeze(statistics(docs, key, text), "statistics")
    model = train(stats, labels, key, label, shrinkage)

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), np.float64).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(x))], names=["key", "score"])

    kind = stats.schema["key"].dataType.simpleString()
    scored = stats.mapInArrow(score, f"key {kind}, score double")
    return scored.select(
        F.col("key").alias("doc_id"),
        F.coalesce(fold(F.col("key")) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
