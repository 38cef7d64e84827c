"""Best-fit packing of token sequences, reduced by Martello-Toth dominance.

1. Every document is tokenized once (its ids, then the separator id) and cut
   into pieces of at most ``capacity`` tokens; only narrow piece rows go on.
2. Spark counts pieces per length.  This histogram has at most ``capacity``
   entries whatever the corpus size, and the whole packing is decided on it:
   ``plan_packing`` first fixes sets of one or two pieces that dominate every
   alternative for the largest piece (Martello-Toth), which shrinks the
   instance, then packs the rest best fit decreasing, whole length classes at
   a time.  The plan is a table of moves: "pieces number a..b of length L go
   to sequences s.. at offset o"; there are at most capacity**2 / 2 of them.
3. Pieces are numbered within their length by counting per (length, bucket),
   so that a length shared by a third of all pieces is still split over all
   buckets, and look their sequence up in the plan.

Defined results: a null or empty text is one piece holding only the separator;
repeated rows are separate documents packed on their own; an empty table gives
no rows.  Only the key and text columns are read.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import freeze

# --- tokens ------------------------------------------------------------------
#: Characters for which the tokenizer's normalisation is ASCII/Latin lower
#: casing and its pieces are those of ``_PIECE``; any other text is given to
#: the tokenizer whole.
_PLAIN = re.compile("[\t\n\x0b\x0c\r -~\xa1-\xac\xae-įı-ɏ]*")
_PIECE = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d"
    "|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ]+"
    "|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^\\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-ɏ0-9\xb2\xb3\xb9\xbc-\xbe]+"
)


#: The rules of a vocabulary file that the two patterns stand for.
_RULES = (
    ["NFC", "Replace", "Lowercase"],
    r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
    "</w>",
)


def _rules(tokenizer) -> tuple | None:
    """The same of a tokenizer, None if it has no such parts."""
    spec = json.loads(tokenizer.to_str())
    try:
        steps = [n["type"] for n in spec["normalizer"]["normalizers"]]
        return steps, spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spec["model"]["end_of_word_suffix"]
    except (KeyError, TypeError, IndexError):
        return None


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes.

    Text pieces repeat, so the ids of a piece are looked up; unknown pieces of
    a batch are encoded together.  A vocabulary with other rules than
    ``_RULES`` is given every text whole.  The table is emptied when it holds
    ``remember`` pieces, which bounds memory and changes no result.
    """

    def __init__(self, path: str, remember: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.by_pieces = _rules(self.tokenizer) == _RULES
        self.remember = remember
        self.known: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > self.remember:
            self.known.clear()
        rest = []
        for p in pieces:
            if p.isascii():  # byte symbols of ASCII are the characters themselves
                self.known[p] = np.asarray([t.id for t in self.model.tokenize(p)], "<u4").tobytes()
            else:
                rest.append(p)
        # others together, separated by blanks: a piece ends with a word-end token
        for i in range(0, len(rest), 512):
            ids = np.asarray(self.tokenizer.encode(" ".join(rest[i : i + 512]), add_special_tokens=False).ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            for p, own in zip(rest[i : i + 512], np.split(ids, cuts[:-1])):
                self.known[p] = own.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        split: list[list[str] | None] = []
        for t in texts:
            t = t or ""
            plain = self.by_pieces and "<|" not in t and _PLAIN.fullmatch(t) and unicodedata.is_normalized("NFC", t)
            split.append(_PIECE.findall(t.lower()) if plain else None)
        out: list[bytes] = []
        for t, pieces in zip(texts, split):
            if pieces is None:
                out.append(self._whole(t or ""))
                continue
            try:
                out.append(b"".join(map(self.known.__getitem__, pieces)))
            except KeyError:
                self._learn(list({p for p in pieces if p not in self.known}))
                if any(p not in self.known for p in pieces):  # the table was emptied meanwhile
                    self._learn(list(set(pieces)))
                out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` for each piece of each
    document.  ``vocabulary``: path of a tokenizer file on the executors."""
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    tail = np.asarray([end], "<u4").tobytes()

    def cut(batches):
        enc = encoder(vocabulary)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):  # bounds what a batch holds at once
                part = batch.slice(lo, 256)
                rows: list[list] = [[], [], [], [], []]
                for i, ids in enumerate(enc.encode(part.column(1).to_pylist())):
                    ids += tail
                    for p, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        for col, v in zip(rows, (i, p, at // 4, len(piece) // 4, zlib.crc32(piece))):
                            col.append(v)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32())] + [pa.array(c, pa.int64()) for c in rows[2:]],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return src.mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


# --- the plan ----------------------------------------------------------------
def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix sets that dominate every feasible set holding the largest piece.

    For the largest remaining length j:
    * nothing fits beside it: {j};
    * a length k with j + k = capacity: {j, k} (whatever else could stand
      beside j can stand in place of k);
    * no two pieces fit beside it: {j, k} with k the largest that fits;
    * no three pieces fit beside it and no two that fit sum to more than the
      largest single k that fits: {j, k}.
    Each fixing applies to as many pieces as there are.  After the first
    length where no rule holds, exact pairs are still fixed among the smaller
    lengths (that rule needs no largest piece).  Returns the fixed sets with
    their numbers and what remains.
    """
    left = {k: c for k, c in counts.items() if c}
    sizes = sorted(left)
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(size: int, n: int) -> None:
        left[size] -= n
        if not left[size]:
            del left[size]
            sizes.pop(bisect_left(sizes, size))

    def smallest(n: int) -> list[int]:
        got: list[int] = []
        for s in sizes:
            got += [s] * min(n - len(got), left[s])
            if len(got) == n:
                break
        return got

    def pair(j: int, k: int) -> None:
        n = left[j] // 2 if j == k else min(left[j], left[k])
        fixed.append(((j, k), n))
        take(j, 2 * n if j == k else n)
        if j != k:
            take(k, n)

    def largest_beside(j: int, room: int) -> int | None:
        for s in reversed(sizes[: bisect_left(sizes, room + 1)]):
            if s != j or left[j] >= 2:
                return s
        return None

    def best_two(j: int, room: int) -> int:
        """The largest sum of two pieces that fits beside ``j``."""
        have = [s for s in sizes if s <= room]
        best, hi = 0, len(have) - 1
        for lo, a in enumerate(have):
            while hi >= 0 and a + have[hi] > room:
                hi -= 1
            for b in (have[hi : hi + 1] if hi >= lo else []):
                if a != b or left[a] >= 2 + (a == j):
                    best = max(best, a + b)
                elif hi - 1 >= 0:
                    best = max(best, a + have[hi - 1])
        return best

    while sizes:
        j = sizes[-1]
        room = capacity - j
        k = largest_beside(j, room)
        if k is None:
            fixed.append(((j,), left[j]))
            take(j, left[j])
            continue
        if k == room:
            pair(j, k)
            continue
        low = smallest(3)
        if j in low:  # few pieces left: leave them to best fit
            break
        if sum(low[:2]) > room or len(low) == 1 or (sum(low) > room and best_two(j, room) <= k):
            n = left[j] // 2 if j == k else min(left[j], left[k])
            fixed.append(((j, k), n))
            take(j, 2 * n if j == k else n)
            if j != k:
                take(k, n)
            continue
        break
    for j in [s for s in reversed(sizes) if 2 * s >= capacity]:
        k = capacity - j
        if left.get(j, 0) >= (2 if j == k else 1) and left.get(k, 0):
            pair(j, k)
    return fixed, left


def plan_packing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Moves ``(length, from, to, sequence, offset)``: pieces number
    ``from <= n < to`` of that length go to sequences ``sequence``,
    ``sequence + 1``, ... at ``offset``; and the number of sequences."""
    moves: list[tuple[int, int, int, int, int]] = []
    used: dict[int, int] = defaultdict(int)
    opened = 0
    fixed, left = reduce_by_dominance(counts, capacity)

    def place(size: int, n: int, sequence: int, offset: int) -> None:
        moves.append((size, used[size], used[size] + n, sequence, offset))
        used[size] += n

    for group, n in fixed:
        offset = 0
        for size in group:
            place(size, n, opened, offset)
            offset += size
        opened += n
    # best fit decreasing on runs of sequences with equal room
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, n))

    for size in sorted(left, reverse=True):
        n = left[size]
        while n:
            at = bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size  # new sequences take as many of this length as fit
                full, rest = divmod(n, per)
                for group, k in ((full, per), (1, rest)):
                    if group and k:
                        for i in range(k):
                            place(size, group, opened, i * size)
                        add(capacity - k * size, opened, group)
                        opened += group
                n = 0
            else:
                room = rooms[at]
                first, many = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
                got = min(many, n)
                if got < many:
                    add(room, first + got, many - got)
                place(size, got, first, capacity - room)
                add(room - size, first, got)
                n -= got
    return moves, opened


def pack(pieces: DataFrame, capacity: int = 2048, buckets: int | None = None) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to frozen rows with ``doc_id,
    piece, length``; other columns stay."""
    spark = pieces.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    per = own.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity rows
    moves, _ = plan_packing(counts, capacity)
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(F.col("length").alias("__l"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece")
    numbered = own.withColumn("__n", F.row_number().over(within) - 1).join(
        starts, (F.col("length") == F.col("__l")) & (F.col("__bucket") == F.col("__b"))
    )
    numbered = numbered.withColumn("__n", F.col("__n") + F.col("__before")).select(*pieces.columns, "__n")
    plan = np.array(sorted(moves), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(plan)  # at most capacity**2 / 2 rows of 40 bytes
    names = pieces.columns
    at_length, at_number = names.index("length"), len(names)

    def look_up(batches):
        p = shared.value
        keys = p[:, 0] * (1 << 40) + p[:, 1]
        for batch in batches:
            size, n = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (at_length, at_number))
            hit = p[np.searchsorted(keys, size * (1 << 40) + n, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:at_number] + [pa.array(hit[:, 3] + n - hit[:, 1]), pa.array(hit[:, 4])],
                names=[*names, "sequence_id", "offset"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return numbered.mapInArrow(look_up, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenize, cut and pack whole documents."""
    return pack(freeze(token_pieces(docs, vocabulary, capacity, end, key, text), "pieces"), capacity)
