"""Spelling variants: words that differ by one code point, grouped under their
most frequent form by a trie over letter-group counts.

Words: the runs of ``LETTERS`` of every whole text, A-Z in lower case, of which
a fixed share loses one code point (see ``spelled``), counted over the corpus;
those of ``least_length`` code points that occur ``least_count`` times stay.

The alphabet is cut into groups of letters of about equal frequency.  A word's
vector holds how many of its letters fall in each group; words are arranged in
a trie by the successive entries of the vector.  One inserted letter adds one
to a single entry, a deleted one takes one away, a replaced one does both or
nothing: a depth-first search with a budget of one surplus and one deficit
therefore meets every near word, and the words at the leaves it reaches are
verified letter by letter.

Plan: texts are counted in tasks before the shuffle.  The trie is cut below
its first levels: the word's length and the first ``cut`` entries are the key
of a subtree, each word probes the subtrees its budget allows, and every pair
is looked for in the subtree of the larger key only, both words gaining from
it.  Subtrees of many words or probes are split, words by parts and probes by
shares, so no task holds more than a bounded part of one.  Only sums and best
words come out, never the pairs.

Defined results: null and empty texts hold no word; a null key counts as an
empty one; repeated rows count again; a word without near words is its own
root.  Only key and text columns are read, so extra columns never clash.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass
from operator import ne

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.common import freeze

LETTERS = "[A-Za-zÀ-ÿ]+"
_RUN = re.compile(LETTERS)


@dataclass(frozen=True)
class Spelling:
    """``groups`` of letters, of which ``cut`` name a subtree; a subtree part
    holds at most ``words`` words, a share ``probes`` probes."""

    least_length: int = 6
    least_count: int = 5
    dominance: int = 5
    drop_one_in: int = 199
    groups: int = 12
    cut: int = 4
    words: int = 8192
    probes: int = 32768


def spelled(run: str, seed: int, one_in: int = 199) -> str:
    """A lower-cased run as it is counted: if ``one_in`` divides the crc32 of
    ``<key>:<run>`` (``seed``: that of ``<key>:``), without one code point."""
    h = zlib.crc32(run.encode("utf-8"), seed)
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", setup: Spelling = Spelling()) -> DataFrame:
    """``word, n``: occurrences of every word that stays."""
    one_in, least = setup.drop_one_in, setup.least_length

    def counted(batches):
        total: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if own is None else own}:".encode())
                for run, n in Counter(_RUN.findall(text.encode("utf-8").lower().decode("utf-8"))).items():
                    if len(word := spelled(run, seed, one_in)) >= least:
                        total[word] += n
                if len(total) > 200_000:
                    yield flush()
        if total:
            yield flush()

    src = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    sums = src.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= setup.least_count)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of ``words`` in ``groups`` strings of about equal frequency
    (a row per letter reaches the driver, at most the alphabet's)."""
    counts = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    out, load = [""] * groups, [0] * groups
    for n, c in sorted(((r["count"], r["c"]) for r in counts), reverse=True):
        at = load.index(min(load))
        out[at] += c
        load[at] += n
    return out


def group_count(word: Column, letters: str) -> Column:
    return F.length(word) - F.length(F.translate(word, letters, "")) if letters else F.lit(0)


def probe_steps(cut: int) -> list[tuple[tuple[int, ...], int, int, int]]:
    """What a near word's subtree key may differ by: (change of the first
    entries, change of length, surplus left, deficit left)."""
    flat = (0,) * cut
    plus = [flat[:i] + (1,) + flat[i + 1 :] for i in range(cut)]
    minus = [flat[:i] + (-1,) + flat[i + 1 :] for i in range(cut)]
    both = [tuple(a + b for a, b in zip(p, m)) for p in plus for m in minus if p.index(1) != m.index(-1)]
    longer = [(flat, 1, 1, 0)] + [(p, 1, 0, 0) for p in plus]
    shorter = [(flat, -1, 0, 1)] + [(m, -1, 0, 0) for m in minus]
    equal = [(flat, 0, 1, 1)] + [(p, 0, 0, 1) for p in plus] + [(m, 0, 1, 0) for m in minus] + [(b, 0, 0, 0) for b in both]
    return longer + shorter + equal


def is_near(a: str, b: str) -> bool:
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(map(ne, a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    if len(b) != len(a) + 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at:] == b[at + 1 :]


class Subtree:
    """Trie of words by the rest of their vectors; every word sums up what it
    is near to."""

    def __init__(self):
        self.root: dict = {}
        self.rows: list[list] = []  # word, n, near words, best n, best word

    def add(self, word: str, n: int, rest: list[int]) -> None:
        node = self.root
        for c in rest[:-1]:
            node = node.setdefault(c, {})
        node.setdefault(rest[-1], []).append(len(self.rows))
        self.rows.append([word, n, 0, 0, None])

    def leaves(self, rest: list[int], surplus: int, deficit: int) -> list[int]:
        """Rows at the leaves within the budget, depth first."""
        out: list[int] = []
        last = len(rest)
        stack = [(self.root, 0, surplus, deficit)]
        while stack:
            node, level, s, d = stack.pop()
            if level == last:
                out += node
                continue
            c = rest[level]
            level += 1
            if (child := node.get(c)) is not None:
                stack.append((child, level, s, d))
            if s and (child := node.get(c + 1)) is not None:
                stack.append((child, level, s - 1, d))
            if d and (child := node.get(c - 1)) is not None:
                stack.append((child, level, s, d - 1))
        return out

    def probe(self, word: str, n: int, rest: list[int], surplus: int, deficit: int, own: bool) -> list:
        row = [word, n, 0, 0, None]
        for at in self.leaves(rest, surplus, deficit):
            other = self.rows[at]
            if (not own or word < other[0]) and is_near(word, other[0]):
                gain(row, other)
                gain(other, row)
        return row


def gain(row: list, near: list) -> None:
    row[2] += 1
    if near[1] > row[3] or (near[1] == row[3] and near[0] < row[4]):
        row[3], row[4] = near[1], near[0]


def _searched(batches):
    """Rows sorted by subtree, words before probes -> sums of near words."""
    here, tree, out = None, Subtree(), []

    def flush():
        columns = list(zip(*out)) if out else [[], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["word", "n_near", "best_n", "best"])
        out.clear()
        return done

    for batch in batches:
        for node, probe, word, n, rest, surplus, deficit, own in zip(*[c.to_pylist() for c in batch.columns]):
            if node != here:
                out.extend((w, k, b, f) for w, _, k, b, f in tree.rows if k)
                here, tree = node, Subtree()
            if not probe:
                tree.add(word, n, rest)
            elif (row := tree.probe(word, n, rest, surplus, deficit, own))[2]:
                out.append((row[0], row[2], row[3], row[4]))
            if len(out) > 20_000:
                yield flush()
    out.extend((w, k, b, f) for w, _, k, b, f in tree.rows if k)
    yield flush()


def near_words(words: DataFrame, setup: Spelling = Spelling()) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words: how
    many, and the most frequent one (ties: the smallest)."""
    groups = letter_groups(words, setup.groups)
    counts = [group_count(F.col("word"), letters) for letters in groups]
    first = [f"c{i}" for i in range(setup.cut)]
    vectors = words.select(
        "word", "n", F.length("word").alias("len"), *[c.cast("int").alias(a) for a, c in zip(first, counts)], F.array(*[c.cast("int") for c in counts[setup.cut :]]).alias("rest")
    )
    name = lambda change, longer: F.concat_ws(",", (F.col("len") + longer).cast("string"), *[(F.col(a) + d).cast("string") for a, d in zip(first, change)])
    flat = (0,) * setup.cut
    vectors = freeze(vectors.withColumn("key", name(flat, 0)), "letter-vectors")
    steps = F.array(*[F.struct(name(c, longer).alias("at"), F.lit(s).alias("s"), F.lit(d).alias("d")) for c, longer, s, d in probe_steps(setup.cut)])
    # each pair is looked for once, in the subtree of the larger key
    probes = vectors.select("word", "n", "rest", "key", F.inline(F.filter(steps, lambda x: x["at"] >= F.col("key"))))
    asked = probes.groupBy("at").agg(F.count(F.lit(1)).alias("asked"))
    nodes = (
        vectors.groupBy("key").agg(F.count(F.lit(1)).alias("held"))
        .join(asked, F.col("key") == F.col("at"))
        .select(
            F.col("key").alias("node"),
            F.ceil(F.col("held") / setup.words).cast("int").alias("parts"),
            F.ceil(F.col("asked") / setup.probes).cast("int").alias("shares"),
        )
    )
    nodes = freeze(nodes, "subtrees")
    dealt = lambda by, of: F.pmod(F.xxhash64(by), F.col(of))
    place = lambda part, share: F.concat_ws("/", "node", part.cast("string"), share.cast("string"))
    kept = vectors.join(nodes, F.col("key") == F.col("node")).select(
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), dealt("word", "parts").alias("part"), "node", "word", "n", "rest"
    )
    kept = kept.select(place(F.col("part"), F.col("share")).alias("node"), F.lit(False).alias("probe"), "word", "n", "rest", F.lit(0).alias("s"), F.lit(0).alias("d"), F.lit(False).alias("own"))
    sent = probes.join(nodes, F.col("at") == F.col("node")).select(
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), dealt("word", "shares").alias("share"), "node", "word", "n", "rest", "s", "d", (F.col("at") == F.col("key")).alias("own")
    )
    sent = sent.select(place(F.col("part"), F.col("share")).alias("node"), F.lit(True).alias("probe"), "word", "n", "rest", "s", "d", "own")
    found = kept.unionByName(sent).repartition("node").sortWithinPartitions("node", "probe").mapInArrow(_searched, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: forms followed to the last, by pointer doubling.  A
    form is more frequent than its word by a factor, so chains are short."""
    now = freeze(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("via"), F.col("root").alias("next"))
        further = freeze(now.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = further.select("word", "root")
        if further.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", setup: Spelling = Spelling()) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word: its near word of
    largest count, if that is ``dominance`` times its own, and the last form
    reached from it."""
    words = freeze(word_counts(docs, key, text, setup), "words")
    near = near_words(words, setup).select(F.col("word").alias("of"), "n_near", "best_n", "best")
    strong = F.col("best_n") >= setup.dominance * F.col("n")
    all_words = freeze(
        words.join(near, F.col("word") == F.col("of"), "left").select(
            "word", F.when(strong, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best_n")).alias("form_n")
        ),
        "near-words",
    )
    last = roots(all_words.where(F.col("form").isNotNull())).select(F.col("word").alias("of"), "root")
    return all_words.join(last, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
