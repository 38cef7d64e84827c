"""Ranked lexical search with per-term geometric blocking.

The documents with the highest scores of every query item, exactly.  A
document's weight for a term is an integer (see ``impacts``); a score is the
sum of term weight times document weight over the item's terms.

Index: documents are dealt in shards, as Spark's tasks read them.  Within a
shard every term's posting list is clustered by document similarity: the list
is ordered by the sides of random hyperplanes on which the documents' weight
vectors lie, and cut into blocks.  A block stores the coordinatewise maximum
of its documents' vectors, on the terms that any item holds beside the list's
own; no other coordinate can ever enter a bound.

Search: an item's lists are taken by falling contribution bound.  A document
outside the lists already taken can only gain from the remaining terms, so a
block's bound is the product of the remaining term weights and its summary,
and a whole list's bound is the sum of the remaining maxima.  A block is
skipped only if its bound is below the item's current threshold, its
documents are scored exactly otherwise; equal bounds are opened, because ties
go by key.

Plan: one scan turns texts into short vectors of the items' terms (written
once); counts and document frequencies are aggregates over it.  A first pass
opens the most promising blocks of every shard; the k-th best score found
anywhere is each item's first threshold, and the second pass starts from it.
Each shard returns at most ``top`` rows an item.  Documents are not shuffled.
Items are collected in chunks of a fixed size, each chunk answered by passes
of its own, so their number is not bounded and no broadcast grows with it.

Defined results: null or empty texts have no term and are never found; an item
without terms finds nothing; equal scores go by ascending key, rows without a
key last; repeated document rows are ranked row by row, repeated item rows
(same id and text) are answered once, different texts of one id each on their
own.  Only key and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from agora.llm.common import freeze

_ALPHANUMERIC = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
#: term bytes to lower case, all others to blanks
_TERM_BYTES = bytes(b if b in _ALPHANUMERIC else 32 for b in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of digits, letters and non-ASCII code points, A-Z lowered."""
    return (text or "").encode("utf-8").translate(_TERM_BYTES).split()


@dataclass(frozen=True)
class Blocks:
    """``block`` documents in a block, ``shard`` documents (or ``postings``) in
    an index, ``chunk`` items (or ``chunk_bytes`` of their texts) in a pass,
    ``cells`` numbers of summaries kept at once by a task."""

    top: int = 20
    block: int = 64
    planes: int = 16
    shard: int = 8192
    postings: int = 1_500_000
    chunk: int = 4096
    chunk_bytes: int = 4_000_000
    cells: int = 8_000_000


def item_chunks(items: DataFrame, setup: Blocks) -> Iterator[list[Row]]:
    """Rows (item, text) of ``items``, a bounded number at a time."""
    chunk, size = [], 0
    for row in items.toLocalIterator():
        chunk.append(row)
        size += len(row["text"] or "")
        if len(chunk) >= setup.chunk or size >= setup.chunk_bytes:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def term_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``key, n`` (terms of the whole text) and the vocabulary's ``terms`` with
    their counts ``tfs``, by ascending term number."""

    def vectors(batches):
        for batch in batches:
            n, ids, tfs = [], [], []
            for text in batch.column(1).to_pylist():
                found = terms(text)
                n.append(len(found))
                counts = sorted((vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary)
                ids.append([i for i, _ in counts])
                tfs.append([c for _, c in counts])
            columns = [pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n", "terms", "tfs"])

    kind = docs.schema["key"].dataType.simpleString()
    return docs.mapInArrow(vectors, f"key {kind}, n long, terms array<int>, tfs array<int>")


def impacts(n: np.ndarray, tf: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """Integer document weights of terms that occur ``tf`` times among ``n``."""
    m = 75 + (25 * n * total_docs) // max(1, total_terms)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def spans(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The indices of several spans, one after the other."""
    ends = np.cumsum(lens)
    return np.repeat(starts - ends + lens, lens) + np.arange(ends[-1] if len(ends) else 0)


class Shard:
    """The blocked index of some documents with at least one term each."""

    def __init__(self, lens, cols, imps, weights, beside, setup: Blocks):
        self.lens, self.cols, self.imps, self.beside, self.setup = lens, cols, imps, beside, setup
        self.starts = np.cumsum(lens) - lens
        size = len(weights)
        doc = np.repeat(np.arange(len(lens)), lens)
        sides = np.random.default_rng(7).choice([-1.0, 1.0], (setup.planes, size))
        pull = weights[cols] * imps.astype(np.float64)
        side = np.zeros(len(lens), np.int64)
        for plane in sides:
            side = side * 2 + (np.add.reduceat(pull * plane[cols], self.starts) > 0)
        order = np.lexsort((doc, side[doc], cols))
        self.posting = doc[order]
        self.at = np.searchsorted(cols[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, cols, imps)
        self.place = np.full(size, -1, np.int64)
        self.summaries: dict[int, np.ndarray] = {}
        self.held = 0

    def list_of(self, term: int) -> np.ndarray:
        return self.posting[self.at[term] : self.at[term + 1]]

    def summary(self, term: int) -> np.ndarray:
        """Coordinatewise maxima: a row per block, a column per term beside."""
        if term in self.summaries:
            return self.summaries[term]
        docs, beside = self.list_of(term), self.beside[term]
        self.place[beside] = np.arange(len(beside))
        lens = self.lens[docs]
        entry = spans(self.starts[docs], lens)
        where = self.place[self.cols[entry]]
        block = np.repeat(np.arange(len(docs)) // self.setup.block, lens)
        out = np.zeros((-(-len(docs) // self.setup.block), len(beside)), np.int64)
        used = where >= 0
        np.maximum.at(out, (block[used], where[used]), self.imps[entry[used]])
        self.place[beside] = -1
        while self.summaries and self.held + out.size > self.setup.cells:
            self.held -= self.summaries.pop(next(iter(self.summaries))).size
        self.summaries[term] = out
        self.held += out.size
        return out

    def score(self, docs: np.ndarray, dense: np.ndarray) -> np.ndarray:
        lens = self.lens[docs]
        entry = spans(self.starts[docs], lens)
        return np.add.reduceat(dense[self.cols[entry]] * self.imps[entry], np.cumsum(lens) - lens)

    def search(self, ids: np.ndarray, gains: np.ndarray, least: int, few: bool) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores among which are the best ``top`` of the shard
        with a score of at least ``least``; ``few``: stops once ``top`` are
        scored, for a first threshold."""
        top = self.setup.top
        bound = gains * self.most[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        ids, gains, bound = ids[order], gains[order], bound[order]
        rest = np.cumsum(bound[::-1])[::-1]
        dense = np.zeros(len(self.most), np.int64)
        dense[ids] = gains
        seen = np.zeros(len(self.lens), bool)
        found, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for i, term in enumerate(ids):
            if rest[i] < least or (few and len(found) >= top):
                break
            beside = self.beside[term]
            bounds = self.summary(term)[:, np.searchsorted(beside, ids[i:])] @ gains[i:]
            by_bound, docs, block = np.argsort(-bounds, kind="stable"), self.list_of(term), self.setup.block
            done, step = 0, 1
            while done < len(by_bound) and bounds[by_bound[done]] >= least and not (few and len(found) >= top):
                batch = by_bound[done : done + step]
                done, step = done + step, step * 2
                batch = batch[bounds[batch] >= least]
                new = np.concatenate([docs[b * block : (b + 1) * block] for b in batch])
                new = new[~seen[new]]
                if not len(new):
                    continue
                seen[new] = True
                got = self.score(new, dense)
                found, scores = np.concatenate([found, new]), np.concatenate([scores, got])
                if len(scores) >= top:
                    least = max(least, int(np.partition(scores, len(scores) - top)[len(scores) - top]))
        good = scores >= max(1, least)
        return found[good], scores[good]


def _shards(batches, setup: Blocks):
    """Arrow batches gathered to tables of ``setup.shard`` documents or less."""
    held, rows, size = [], 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            held.append(part)
            rows += part.num_rows
            size += len(part.column(2).flatten())
            if rows >= setup.shard or size >= setup.postings:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _search(vectors: DataFrame, queries: list[tuple[np.ndarray, np.ndarray]], least: list[int], weights: np.ndarray, totals: tuple[int, int], setup: Blocks, few: bool) -> DataFrame:
    """``item`` (number in ``queries``), ``key`` and ``score`` of what each shard finds."""
    kind = vectors.schema["key"].dataType.simpleString()

    def found(batches):
        beside: list = [[] for _ in range(len(weights))]
        for ids, _ in queries:
            for t in ids:
                beside[t].append(ids)
        beside = [np.unique(np.concatenate(b)) if b else np.zeros(0, np.int64) for b in beside]
        for table in _shards(batches, setup):
            lists = table.column("terms").combine_chunks()
            lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            full = lens > 0
            if not full.any():
                continue
            keys = table.column("key").filter(pa.array(full)).to_pylist()
            n = np.repeat(table.column("n").to_numpy(), lens)
            tfs = table.column("tfs").combine_chunks().flatten().to_numpy().astype(np.int64)
            shard = Shard(lens[full], lists.flatten().to_numpy().astype(np.int64), impacts(n, tfs, *totals), weights, beside, setup)
            out: tuple[list, list, list] = ([], [], [])
            for item, (ids, gains) in enumerate(queries):
                docs, scores = shard.search(ids, gains, least[item], few)
                best = sorted(zip((-scores).tolist(), docs.tolist()), key=lambda x: (x[0], keys[x[1]] is None, keys[x[1]]))[: setup.top]
                out[0].extend([item] * len(best))
                out[1].extend(keys[d] for _, d in best)
                out[2].extend(-s for s, _ in best)
            schema = pa.schema([("item", pa.int32()), ("key", table.schema.field("key").type), ("score", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return vectors.mapInArrow(found, f"item int, key {kind}, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _answer(docs: DataFrame, chunk: list[Row], item_kind: str, setup: Blocks) -> DataFrame:
    spark = docs.sparkSession
    counts = [Counter(terms(row["text"])) for row in chunk]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*counts)))}
    vectors = freeze(term_vectors(docs, vocabulary), "term-vectors")
    n_docs, n_terms = vectors.where("n > 0").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(vocabulary), np.int64)
    for row in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the chunk
        frequency[row["t"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequency], np.int64)
    queries = []
    for own in counts:
        ids = np.array(sorted(vocabulary[t] for t in own), np.int64)
        times = {vocabulary[t]: c for t, c in own.items()}
        queries.append((ids, np.array([weights[i] * times[i] for i in ids], np.int64)))
    totals = (int(n_docs), int(n_terms))
    seeds = _ranked(_search(vectors, queries, [1] * len(chunk), weights, totals, setup, few=True), setup.top)
    least = [1] * len(chunk)
    for row in seeds.where(F.col("rank") == setup.top).select("item", "score").collect():  # a row per item of the chunk
        least[row["item"]] = max(1, row["score"])
    found = _ranked(_search(vectors, queries, least, weights, totals, setup, few=False), setup.top)
    names = spark.createDataFrame([(i, row["item"]) for i, row in enumerate(chunk)], f"number int, item_id {item_kind}")
    return found.join(F.broadcast(names), F.col("item") == F.col("number")).select("item_id", "rank", F.col("key").alias("doc_id"), "score")


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    setup: Blocks = Blocks(),
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``setup.top`` best documents of
    every item, by falling score, then key."""
    asked = items.select(F.col(item_key).alias("item"), F.col(item_text).alias("text")).distinct()
    kind = asked.schema["item"].dataType.simpleString()
    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    answers = [_answer(src, chunk, kind, setup) for chunk in item_chunks(asked, setup)]
    if answers:
        return reduce(DataFrame.unionByName, answers)
    nothing = f"item_id {kind}, rank int, doc_id {src.schema['key'].dataType.simpleString()}, score long"
    return docs.sparkSession.createDataFrame([], nothing)
