"""Near-duplicate documents by min-max hashing.

One hash function per permutation is evaluated once per shingle and gives two
signature values, its minimum and its maximum; each agrees between two sets
with probability equal to their Jaccard similarity, so half the evaluations
of plain MinHash give as many values, of lower variance.  Signature values are
cut into bands; the number of bands follows from the threshold so that a pair
exactly at the threshold is missed with probability ``miss`` at most.

Plan:
1. one scan makes a narrow sketch row per document (set size, digest of the
   words, band keys, 256 signature bits); exact copies are folded onto their
   smallest id by digest;
2. every band bucket is paired as a star with its smallest member, pairs are
   screened by set sizes and signature bits, and confirmed on the full sets of
   word shingles (not hashes);
3. components of the confirmed links; buckets whose members already share a
   component are done; in the others the pairs *between* components are
   screened and confirmed as well, block by block inside tasks (only links
   come out, no pairs); the screen also knows how many shingles of a document
   no other one of these has, which bounds what a pair can share.  So every candidate pair is either tested
   or inside one component: no candidate is capped and no group is expanded
   into all its pairs.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; a text shorter than a shingle is one shingle of all its words;
equal word sequences are always linked; repeated rows of one id are one
document, listed once per row; a row without an id is linked with nothing and
kept, its component is null.  Only the named columns are read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import ceil, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import freeze, mix, shingle_hashes, words
from agora.llm.graph import components

SKETCH_VALUES = 128  # signature values that give two bits each


@dataclass(frozen=True)
class MinMax:
    """``shingle`` words; linked if 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 85
    rows: int = 6
    miss: float = 1e-5
    seed: int = 20240229

    @property
    def bands(self) -> int:
        return ceil(log(self.miss) / log(1 - (self.percent / 100) ** self.rows))

    @property
    def permutations(self) -> int:
        return max(SKETCH_VALUES // 2, ceil(self.bands * self.rows / 2))

    @property
    def most_bits(self) -> int:
        """Differing signature bits that a pair at the threshold exceeds with
        a probability under one in a million (five deviations)."""
        p = 1 - self.percent / 100
        return ceil(SKETCH_VALUES * p + 5 * sqrt(SKETCH_VALUES * (1.5 * p - p * p)))

    def parameters(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 2**64, (2, self.permutations), np.uint64)
        return a | np.uint64(1), b

    def signature(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Minima, then maxima, of every permutation over the shingles ``x``;
        long sets go through in blocks of bounded size."""
        low = np.full(len(a), 2**64 - 1, np.uint64)
        high = np.zeros(len(a), np.uint64)
        for i in range(0, x.size, 8192):
            h = (x[None, i : i + 8192] ^ b[:, None]) * a[:, None]
            np.minimum(low, h.min(axis=1), out=low)
            np.maximum(high, h.max(axis=1), out=high)
        return np.concatenate([low, high])


def sketches(docs: DataFrame, method: MinMax, key: str, text: str) -> DataFrame:
    """``id, n, digest, bands, s0..s3`` in one scan."""
    src = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    bands, rows = method.bands, method.rows

    def sketch(batches):
        a, b = method.parameters()
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            n, digests, keys, bits = [], [], [], []
            for t in batch.column(1).to_pylist():
                w = words(t)
                x = shingle_hashes(w, method.shingle)
                n.append(x.size)
                digests.append(hashlib.blake2b(b" ".join(w), digest_size=16).digest())
                if not x.size:
                    keys.append([])
                    bits.append(np.zeros(4, np.uint64))
                    continue
                values = method.signature(x, a, b)
                band = salt.copy()
                for col in values[: bands * rows].reshape(bands, rows).T:
                    band = mix(band ^ col) + salt
                keys.append(band.view(np.int64))
                two = ((mix(values[:SKETCH_VALUES]) >> np.uint64(40)) & np.uint64(3)).reshape(4, -1)
                bits.append((two << (2 * np.arange(SKETCH_VALUES // 4, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
            s = np.array(bits, np.uint64).reshape(-1, 4).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                + [pa.array(s[:, i]) for i in range(4)],
                names=["id", "n", "digest", "bands", "s0", "s1", "s2", "s3"],
            )

    return src.mapInArrow(sketch, f"id {kind}, n int, digest binary, bands array<long>, s0 long, s1 long, s2 long, s3 long")


def _alike(method: MinMax, x: str, y: str) -> Column:
    """Screen of a pair: sizes that allow the threshold, near signature bits."""
    c = lambda side, name: F.col(f"{side}.{name}")
    differ = sum((F.bit_count(c(x, f"s{i}").bitwiseXOR(c(y, f"s{i}"))) for i in range(4)), F.lit(0))
    sizes = (100 * F.least(c(x, "n"), c(y, "n")) >= method.percent * F.greatest(c(x, "n"), c(y, "n")))
    return sizes & (differ <= method.most_bits)


def _confirm(pairs: DataFrame, texts: DataFrame, method: MinMax, per_task: int = 256) -> DataFrame:
    """Pairs ``a, b`` whose full shingle sets meet the threshold.  Partners of
    one ``a`` are dealt over as many groups as they need; in a group the text
    of ``a`` comes first and the partners stream past it."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    own = dealt.select("a", "part").distinct().select("a", "part", F.lit(0).alias("side"), F.col("a").alias("id"))
    rows = own.union(dealt.select("a", "part", F.lit(1), "b")).join(texts, "id")
    width = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(width, "a", "part").sortWithinPartitions("a", "part", "side", "id").select("a", "part", "side", "id", "text")
    kind = pairs.schema["a"].dataType.simpleString()
    k, percent = method.shingle, method.percent

    def shingles(text):
        w = words(text)
        return {tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k))))

    def test(batches):
        at, first = None, set()
        for batch in batches:
            a, b = [], []
            for hub, part, side, other, text in zip(*(c.to_pylist() for c in batch.columns)):
                if side == 0:
                    at, first = (hub, part), shingles(text)
                elif at == (hub, part):
                    own = shingles(text)
                    both = len(first & own)
                    if 100 * both >= percent * (len(first) + len(own) - both):
                        a.append(hub)
                        b.append(other)
            yield pa.RecordBatch.from_arrays([pa.array(a, batch.schema.types[0]), pa.array(b, batch.schema.types[0])], names=["a", "b"])

    return rows.mapInArrow(test, f"a {kind}, b {kind}")


def _unshared(members: DataFrame, texts: DataFrame, method: MinMax, per_part: int = 2_000_000) -> DataFrame:
    """``id, lone``: how many shingles of each member (``id, n``) no other
    member has.  Shingle hashes are dealt by value over parts of about
    ``per_part`` hashes, and each part counts its own; equal hashes of
    different shingles can only lower a count."""
    total = members.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts, k = int(total) // per_part + 1, method.shingle
    kind = members.schema["id"].dataType.simpleString()

    def deal(batches):
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = shingle_hashes(words(text), k)
                part = (mix(x) % np.uint64(parts)).astype(np.int64)
                own = [x[part == p].view(np.int64) for p in np.unique(part)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.unique(part)), pa.array([doc] * len(own), batch.schema.types[0]), pa.array(own, pa.list_(pa.int64()))], names=["part", "id", "x"]
                )

    def count(batches):
        ids, hashes, sizes, id_type = [], [], [], pa.int64()
        for batch in batches:
            id_type = batch.schema.types[1]
            ids += batch.column(1).to_pylist()
            lists = batch.column(2)
            sizes.append(np.diff(lists.offsets.to_numpy()))
            hashes.append(lists.flatten().to_numpy())
        if ids:
            every, n = np.concatenate(hashes), np.concatenate(sizes)
            _, first, times = np.unique(every, return_index=True, return_counts=True)
            owner = np.repeat(np.arange(len(ids)), n)[first[times == 1]]
            lone = np.bincount(owner, minlength=len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(lone, pa.int64())], names=["id", "lone"])

    dealt = texts.join(members.select("id"), "id", "left_semi").select("id", "text").mapInArrow(deal, f"part long, id {kind}, x array<long>")
    counted = dealt.repartition(parts, "part").mapInArrow(count, f"id {kind}, lone long")
    return counted.groupBy("id").agg(F.sum("lone").alias("lone"))


BLOCK = 1024  # rows of a bucket that one task compares with as many others


def _links_between(rows: DataFrame, method: MinMax) -> DataFrame:
    """Links ``a, b`` between components, of rows ``band, p, q, block, id,
    label, n, lone, s0..s3, bands, text``: blocks ``p`` and ``q`` of a bucket
    meet in one task.  A pair is looked at in the first band it shares; found
    links join components at once, so pairs within one are not tested, and no
    more links come out than components go in."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["band", "p", "q", "block", "id", "label", "n", "lone", "s0", "s1", "s2", "s3", "bands", "text"]
    ordered = rows.select(*names).repartition(width, "band", "p", "q").sortWithinPartitions("band", "p", "q", "id")
    k, percent, most_bits = method.shingle, method.percent, method.most_bits

    def shingles(text):
        w = words(text)
        return {tuple(w)} if len(w) < k else set(zip(*(w[i:] for i in range(k))))

    def links(group):
        band, p, q = group[0][:3]
        _, _, _, block, ids, labels, n, lone, s0, s1, s2, s3, bands, text = zip(*group)
        block, n, lone = np.array(block), np.array(n, np.int64), np.array(lone, np.int64)
        sketch = np.ascontiguousarray(np.array([s0, s1, s2, s3], np.int64).T).view(np.uint64)
        keys = np.array(bands, np.int64)
        place = int(np.flatnonzero(keys[0] == band)[0])
        root = np.unique(np.array(labels), return_inverse=True)[1]
        sets: dict[int, set] = {}
        held = n - lone
        for i in range(len(ids) - 1):
            rest = slice(i + 1, None)
            least = np.minimum(held[i], held[rest])
            ok = (root[rest] != root[i]) & (100 * least >= percent * (n[i] + n[rest] - least))
            if p != q:
                ok &= block[rest] != block[i]
            at = np.flatnonzero(ok) + i + 1
            if at.size:
                at = at[np.bitwise_count(sketch[at] ^ sketch[i]).sum(axis=1) <= most_bits]
            if at.size:
                at = at[(keys[at] == keys[i]).argmax(axis=1) == place]
            for j in at:
                if root[i] == root[j]:
                    continue
                for x in (i, j):
                    if x not in sets:
                        sets[x] = shingles(text[x])
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    yield ids[i], ids[j]
                    root[root == root[j]] = root[i]

    def run(batches):
        group: list[tuple] = []
        id_type = None
        for batch in batches:
            id_type = batch.schema.types[4]
            found = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if group and row[:3] != group[0][:3]:
                    found += links(group)
                    group = []
                group.append(row)
            yield _pair_batch(found, id_type)
        if group:
            yield _pair_batch(list(links(group)), id_type)

    return ordered.mapInArrow(run, f"a {kind}, b {kind}")


def _pair_batch(pairs: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], kind), pa.array([y for _, y in pairs], kind)], names=["a", "b"])


def near_duplicates(docs: DataFrame, method: MinMax = MinMax(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row."""
    sk = freeze(sketches(docs, method, key, text), "sketches")
    copies = freeze(
        sk.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("digest").alias("d"), "rep"),
        "copies",
    )
    folded = sk.join(copies, sk["digest"] == copies["d"], "left").withColumn("rep", F.when(F.col("id").isNotNull(), F.coalesce("rep", "id")))
    reps = folded.where("n > 0 and id = rep").dropDuplicates(["id"])
    signs = freeze(reps.select("id", "n", "bands", "s0", "s1", "s2", "s3"), "signs")
    banded = signs.select("id", F.explode("bands").alias("band"))
    hubs = freeze(
        banded.groupBy("band").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("c")).where("c > 1").select(F.col("band").alias("k"), "hub"),
        "hubs",
    )
    shared = freeze(banded.join(hubs, banded["band"] == hubs["k"]).select("band", "hub", "id"), "buckets")
    texts = freeze(
        docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(shared.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]),
        "texts",
    )
    bits = signs.drop("bands")
    stars = (
        shared.where("id <> hub").select("hub", "id").distinct()
        .join(bits.alias("x"), F.col("hub") == F.col("x.id"))
        .select(F.struct("x.*").alias("x"), F.col("hub"), shared["id"].alias("other"))
        .join(bits.alias("y"), F.col("other") == F.col("y.id"))
        .where(_alike(method, "x", "y"))
        .select(F.col("hub").alias("a"), F.col("other").alias("b"))
    )
    tried = freeze(stars, "pairs")
    links = freeze(_confirm(tried, texts, method), "links")
    labels = components(links)
    # buckets that still hold several components
    at = shared.join(labels.withColumnRenamed("id", "l"), F.col("id") == F.col("l"), "left").select(
        "band", "hub", "id", F.coalesce("component", "id").alias("label")
    )
    open_ = at.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select(F.col("band").alias("k"))
    rest = freeze(
        at.where("id <> hub").join(open_, F.col("band") == F.col("k"), "left_semi").join(bits.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).drop("i", "hub"),
        "open",
    )
    lone = freeze(_unshared(rest.select("id", "n").distinct(), texts, method), "unshared")
    held = rest.join(lone, "id").where((100 * (F.col("n") - F.col("lone")) >= method.percent * F.col("n")))
    per = held.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = held.join(per, "band").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    rows = dealt.join(signs.select("id", "bands"), "id").join(texts, "id")
    more = freeze(_links_between(rows, method), "links")
    final = components(links.union(more)).select(F.col("id").alias("node"), "component")
    return (
        folded.select("id", "n", "rep")
        .join(final, F.col("rep") == F.col("node"), "left")
        .select(
            F.col("id").alias("doc_id"),
            F.col("n").cast("long").alias("n_shingles"),
            F.coalesce("component", "rep").alias("component_id"),
            F.coalesce(F.col("id") == F.coalesce("component", "rep"), F.lit(True)).alias("kept"),
        )
    )
