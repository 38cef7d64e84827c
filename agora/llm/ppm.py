"""Language-model scoring by prediction by partial matching.

The model is a byte-context trie of fixed order: how often every byte followed
every context of up to ``order`` bytes in the training texts.  A byte is
coded from the longest context; if it never followed it there, an escape is
coded and the next shorter context is asked, without the symbols already ruled
out (symbol exclusion).  Escapes are estimated by method D: a symbol seen c
times has weight 2c - 1, the escape the number of distinct symbols.  Below the
empty context all bytes not yet ruled out are equally likely.

The coded text is the token sequence: words in lower case (A-Z), one blank
between them, one end symbol, after ``order`` start symbols; so the score is
the probability of the same tokens that the unigram base score rates.

Plan:
1. one scan counts, per task, the distinct (context, byte) grams of the
   longest order and the words; Spark sums both up (training texts add to the
   counts, held-out texts only make their grams known, with count 0);
2. grams are dealt by the last three bytes of their context.  All contexts of
   three or more bytes that end alike meet in one task, which holds at most
   256**(order - 3) contexts per ending; the shorter contexts are a table of
   at most 256**3 counts that every task gets.  Each task codes its grams;
3. texts are scored by looking every gram up in the written table of code
   lengths, which workers read from the shared folder.  The table is split
   into shards of a checked number of rows; with more than one shard, texts
   pass once per shard and the partial sums are added.  Words above a stated
   share of all tokens (so at most ``frequent`` of them) are looked up on the
   spot, the others are joined with the counts.

Defined results: null and empty texts are one end token; repeated rows are
scored row by row; a null id belongs to no fold, is scored and trains
nothing; without training texts every byte is equally likely and the base is
log10(0.5 / 0.5) = 0 per token.  Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import fold, freeze, mix, words

ALPHABET = 256
END = b"\n"  # no word holds it


# --- grams -------------------------------------------------------------------
def grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed (context, byte) of every byte of the texts (each ends with
    ``END``) and where each text's grams begin."""
    lead = END * order
    buf = np.frombuffer(b"".join(lead + t for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    packed = np.zeros(max(0, buf.size - order), np.int64)
    for k in range(order + 1):
        packed <<= 8
        packed |= buf[k : buf.size - order + k]
    # windows that end in the next text's start symbols are not grams
    begin = np.cumsum(sizes + order) - sizes - order
    inside = np.ones(packed.size, bool)
    for k in range(1, order + 1):
        at = begin[1:] - k
        inside[at] = False
    return packed[inside], np.cumsum(sizes) - sizes


def _counted(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if sorted_keys.size else np.zeros(0, np.int64)
    return sorted_keys[first], np.diff(np.append(first, sorted_keys.size))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their count sums."""
    if not keys.size:
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys, counts = keys[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class _Tally:
    """Distinct grams and their counts, held as a few sorted runs."""

    def __init__(self, most: int = 1_500_000):
        self.raw: list[np.ndarray] = []
        self.raw_size = 0
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []
        self.most = most

    def add(self, keys: np.ndarray, weight: int) -> None:
        # the weight rides in the lowest bit: no second array to sort
        self.raw.append((keys << 1) | weight)
        self.raw_size += keys.size
        if self.raw_size >= 1_000_000:
            self._sort()

    def _sort(self) -> None:
        if self.raw:
            flat = np.concatenate(self.raw)
            flat.sort()
            keys, n = _counted(flat)
            self.runs.append(summed(keys >> 1, n * (keys & 1)))
            self.raw, self.raw_size = [], 0
        if len(self.runs) > 1 and sum(k.size for k, _ in self.runs) > self.most:
            self._merge()

    def _merge(self) -> None:
        self.runs = [summed(np.concatenate([k for k, _ in self.runs]), np.concatenate([c for _, c in self.runs]))]

    def full(self) -> bool:
        return sum(k.size for k, _ in self.runs) > 2 * self.most

    def drain(self):
        self._sort()
        if self.runs:
            self._merge()
            yield from self.runs
        self.runs = []


def _token_text(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens) + END


def count_grams_and_words(docs: DataFrame, order: int) -> DataFrame:
    """``gram, word, c`` (one of the two keys is null) of rows ``train,
    text``; summed per task, to be summed up by key."""

    def tally(batches):
        held, vocabulary = _Tally(), Counter()

        def out(keys=None, n=None):
            if keys is not None:
                for i in range(0, keys.size, 100_000):
                    k = keys[i : i + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(k), pa.nulls(k.size, pa.binary()), pa.array(n[i : i + 100_000].astype(np.int64))], names=["gram", "word", "c"])
                return
            items = list(vocabulary.items())
            vocabulary.clear()
            for i in range(0, len(items), 100_000):
                part = items[i : i + 100_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(len(part), pa.int64()), pa.array([w for w, _ in part], pa.binary()), pa.array([c for _, c in part], pa.int64())], names=["gram", "word", "c"]
                )

        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts: list[list[bytes]] = [[], []]
                for train, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    w = words(text)
                    if train:
                        vocabulary.update(w)
                        vocabulary[END] += 1
                    texts[bool(train)].append(_token_text(w))
                for weight in (0, 1):
                    if texts[weight]:
                        held.add(grams(texts[weight], order)[0], weight)
                if held.full():
                    for keys, n in held.drain():
                        yield from out(keys, n)
                if len(vocabulary) > 500_000:
                    yield from out()
        for keys, n in held.drain():
            yield from out(keys, n)
        yield from out()

    return docs.mapInArrow(tally, "gram long, word binary, c long")


# --- the trie ----------------------------------------------------------------
class Level:
    """Contexts of one length: their symbols' counts, totals and the weight
    that exclusion takes away one level below."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.keys, self.counts = keys, counts
        ctx = keys >> 8
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if ctx.size else np.zeros(0, np.int64)
        self.first, self.contexts = first, ctx[first]
        self.total = np.add.reduceat(counts, first) if ctx.size else counts[:0]
        self.distinct = np.diff(np.append(first, ctx.size))
        self.excluded = np.zeros(first.size, np.int64)

    def rule_out(self, lower: "Level", size: int) -> None:
        """Weights that this level's symbols have in the contexts ``lower``
        (of ``size`` bytes)."""
        if self.keys.size:
            at = np.searchsorted(lower.keys, self.keys & ((1 << 8 * (size + 1)) - 1))
            self.excluded = np.add.reduceat(2 * lower.counts[at] - 1, self.first)


def find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not sorted_keys.size:
        return np.zeros(keys.size, np.int64), np.zeros(keys.size, bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), sorted_keys.size - 1)
    return at, sorted_keys[at] == keys


def build_levels(keys: np.ndarray, counts: np.ndarray, top: int, bottom: int = 0) -> dict[int, Level]:
    """Levels ``top`` to ``bottom`` from the grams of context length ``top``
    that were seen in training."""
    seen = counts > 0
    keys, counts = keys[seen], counts[seen]
    levels = {}
    for size in range(top, bottom - 1, -1):
        keys, counts = summed(keys & ((1 << 8 * (size + 1)) - 1), counts)
        levels[size] = Level(keys, counts)
    return levels


def link_levels(levels: dict[int, Level]) -> dict[int, Level]:
    for size, level in levels.items():
        if size - 1 in levels:
            level.rule_out(levels[size - 1], size - 1)
    return levels


def code(packed: np.ndarray, levels: dict[int, Level], order: int) -> np.ndarray:
    """log10 probability of each gram's last byte after its context."""
    out = np.zeros(packed.size)
    open_ = np.ones(packed.size, bool)
    ruled = np.zeros(packed.size, np.int64)  # symbols ruled out by the longer context
    weight = np.zeros(packed.size, np.int64)  # their weight here
    for size in range(order, -1, -1):
        level = levels[size]
        at, exists = find(level.contexts, (packed >> 8) & ((1 << 8 * size) - 1))
        k, found = find(level.keys, packed & ((1 << 8 * (size + 1)) - 1))
        if not level.keys.size:
            continue
        total = 2 * level.total[at] - weight - ruled
        fresh = level.distinct[at] - ruled
        hit = open_ & found
        out[hit] += np.log10((2 * level.counts[k[hit]] - 1) / total[hit])
        open_ &= ~found
        miss = open_ & exists & (fresh > 0)
        out[miss] += np.log10(fresh[miss] / total[miss])
        ruled = np.where(exists, level.distinct[at], ruled)
        weight = np.where(exists, level.excluded[at], weight)
    out[open_] -= np.log10(ALPHABET - ruled[open_])
    return out


def code_table(counts: DataFrame, order: int) -> DataFrame:
    """``gram, score`` for every counted gram (``gram, c``)."""
    spark = counts.sparkSession
    low = min(2, order)
    mask = (1 << 8 * (low + 1)) - 1
    short = counts.where("c > 0").groupBy(F.col("gram").bitwiseAND(F.lit(mask)).alias("gram")).agg(F.sum("c").alias("c"))
    table = short.toArrow()  # at most 256**3 rows, whatever the corpus
    base = build_levels(table.column("gram").to_numpy().astype(np.int64), table.column("c").to_numpy().astype(np.int64), low)
    shared = spark.sparkContext.broadcast({s: (v.keys, v.counts) for s, v in base.items()})

    def score(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not parts:
            return
        keys, n = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        levels = build_levels(keys, n, order, low + 1) if order > low else {}
        levels = link_levels(levels | {s: Level(*v) for s, v in shared.value.items()})
        for i in range(0, keys.size, 200_000):
            k = keys[i : i + 200_000]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(code(k, levels, order))], names=["gram", "score"])

    ending = F.shiftright(F.col("gram"), 8).bitwiseAND(F.lit((1 << 24) - 1))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return counts.select("gram", "c").repartition(width, ending).mapInArrow(score, "gram long, score double")


# --- tables that workers read ------------------------------------------------
class Codes:
    """Scores by gram: buckets of a hash, two arrays and their starts."""

    def __init__(self, keys: np.ndarray, scores: np.ndarray):
        self.bits = max(4, int(keys.size).bit_length())
        at = self._bucket(keys)
        by = np.argsort(at, kind="stable")
        self.start = np.zeros((1 << self.bits) + 1, np.int32)
        np.cumsum(np.bincount(at, minlength=1 << self.bits), out=self.start[1:])
        del at
        self.keys = np.append(keys[by], -1)
        self.scores = np.append(scores[by], 0.0)

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return (h >> np.uint64(64 - self.bits)).view(np.int64)

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Scores of the keys; 0 for keys of another shard."""
        bucket = self._bucket(keys)
        at, end = self.start[bucket], self.start[bucket + 1]
        hit = self.keys[at] == keys
        out = np.where(hit, self.scores[at], 0.0)
        rest = np.flatnonzero(~hit & (at + 1 < end))
        at = at[rest] + 1
        while rest.size:
            hit = self.keys[at] == keys[rest]
            out[rest[hit]] = self.scores[at[hit]]
            more = ~hit & (at + 1 < end[rest])
            rest, at = rest[more], at[more] + 1
        return out


_READ: dict[str, tuple[str, object]] = {}


def read_once(slot: str, path: str, make):
    """What ``make`` builds from the Parquet folder ``path``; a worker keeps
    the latest of each slot."""
    if _READ.get(slot, ("",))[0] != path:
        import pyarrow.dataset as ds
        from pyarrow import fs

        uri = path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path
        system, inner = fs.FileSystem.from_uri(uri)
        _READ.pop(slot, None)
        _READ[slot] = (path, make(ds.dataset(inner, filesystem=system, format="parquet")))
    return _READ[slot][1]


def _codes(source) -> Codes:
    keys, scores = (source.to_table(columns=[c]).column(0).to_numpy() for c in ("gram", "score"))
    return Codes(keys, scores)


def _counts(source) -> dict[bytes, int]:
    t = source.to_table()
    return dict(zip(t.column("word").to_pylist(), t.column("c").to_pylist()))


def _folder(frozen: DataFrame) -> str:
    return frozen.inputFiles()[0].rsplit("/", 1)[0]


# --- scoring -----------------------------------------------------------------
def score_texts(
    docs: DataFrame,
    order: int = 5,
    key: str = "doc_id",
    text: str = "text",
    held_out: int = 1,
    frequent: int = 500_000,
    shard_rows: int = 6_000_000,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score`` per row; learns from rows whose fold is not ``held_out``."""
    if not 3 <= order <= 6:
        raise ValueError("order must be 3 to 6: a gram is packed into one long")
    spark = docs.sparkSession
    away = F.coalesce(fold(F.col(key)) == held_out, F.lit(False))
    train = F.col(key).isNotNull() & ~away
    counted = freeze(
        count_grams_and_words(docs.select(train.alias("train"), F.col(text).alias("text")), order).groupBy("gram", "word").agg(F.sum("c").alias("c")), "counts"
    )
    codes = freeze(code_table(counted.where("gram is not null"), order), "codes")
    vocabulary = freeze(counted.where("word is not null").select("word", "c"), "words")
    n, v = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    n, v = int(n), int(v)
    unit = np.log10(n + 0.5 * (v + 1)) if n else np.log10(0.5)
    # at most ``frequent`` words have this share of all tokens; long words are joined
    common = freeze(vocabulary.where((F.col("c") >= max(1, ceil(n / frequent))) & (F.length("word") <= 64)), "frequent")
    shards = max(1, ceil(codes.count() / shard_rows))
    paths = [_folder(codes)] if shards == 1 else [
        _folder(freeze(codes.where(F.pmod(F.xxhash64("gram"), F.lit(shards)) == s), "codes")) for s in range(shards)
    ]
    common_path = _folder(common)
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), away.alias("held_out"), F.col(text).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def rate(path: str, first: bool):
        def run(batches):
            codes = read_once("codes", path, _codes)
            known = read_once("words", common_path, _counts) if first else {}
            logs = {c: float(np.log10(c + 0.5)) for c in set(known.values())}
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    part = batch.slice(lo, 128)
                    tokens = [words(t) for t in part.column(3).to_pylist()]
                    packed, begin = grams([_token_text(w) for w in tokens], order)
                    scores = np.add.reduceat(codes.look_up(packed), begin)
                    n_tokens, n_known, base, rare_at, rare, rare_n = [], [], [], [], [], []
                    for i, w in enumerate(tokens):
                        mine, sure = 0.0, 0
                        if first:
                            counts = Counter(w)
                            counts[END] += 1
                            for t, k in counts.items():
                                c = known.get(t)
                                if c:
                                    mine += k * logs[c]
                                    sure += k
                                else:
                                    rare_at.append(i)
                                    rare.append(t)
                                    rare_n.append(k)
                        n_tokens.append(len(w) + 1 if first else 0)
                        n_known.append(sure)
                        base.append(mine)
                    m = len(tokens)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), part.column(2), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()),
                         pa.array(scores), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())],
                        names=names,
                    )
                    if rare:
                        r = len(rare)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(rare_at, pa.int64())), pa.nulls(r, part.column(1).type), pa.nulls(r, pa.bool_()), pa.nulls(r, pa.int64()),
                             pa.nulls(r, pa.int64()), pa.nulls(r, pa.float64()), pa.nulls(r, pa.float64()), pa.array(rare, pa.binary()), pa.array(rare_n, pa.int64())],
                            names=names,
                        )

        return run

    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "k"]
    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, k long"
    rated = freeze(source.mapInArrow(rate(paths[0], True), schema), "rated")
    rows = rated.where("word is null").drop("word", "k")
    sums = [rows.select("row", "base", "n_known", "score")]
    for path in paths[1:]:
        sums.append(source.mapInArrow(rate(path, False), schema).select("row", "base", "n_known", "score"))
    joined = rated.where("word is not null").select("row", F.col("word").alias("w"), "k").join(vocabulary, F.col("w") == F.col("word"), "left")
    sums.append(
        joined.select(
            "row",
            (F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("base"),
            F.when(F.col("c") > 0, F.col("k")).otherwise(0).alias("n_known"),
            F.lit(0.0).alias("score"),
        )
    )
    whole = sums[0]
    for s in sums[1:]:
        whole = whole.union(s)
    whole = whole.groupBy(F.col("row").alias("r")).agg(F.sum("base").alias("b"), F.sum("n_known").alias("known"), F.sum("score").alias("s"))
    return rows.join(whole, F.col("row") == F.col("r")).select(
        "doc_id",
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("b") - F.col("n_tokens") * F.lit(float(unit))).alias("base_score"),
        F.col("s").alias("score"),
    )
