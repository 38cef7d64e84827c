"""Line dedup by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last ``window`` line hashes marks a
chunk end wherever it is 0 modulo a divisor that falls with the line's words
(``density`` words a bound on average, a longer line always ends a chunk); a
line of ``least`` words or more begins one, too.  So
the bounds depend on the lines around them only: inserting or removing lines
elsewhere in a document does not shift the chunks of a shared passage.

Chunks of at least ``anchor`` words that occur more than once anywhere are
anchors.  Every later occurrence (by document id, then text, then place) is
compared with the first one byte by byte and extended over equal lines of the
chunks before both (as many as ``window``: so far the line before a passage
can move its bounds) and of the one after both.  Stretches of a document that overlap are one
run; runs of at least ``least`` words go, be they one line or a whole
document.  Every removed line stands at an earlier place, so the first
occurrence of a line always stays.

It finds whole equal lines only: not a passage that begins or ends inside a
line, not a line of which one character differs, not a run below ``least``
words, and not a passage whose chunks each stood first somewhere else.

Plan: chunk hashes are counted (map-side sums; a chunk that occurs in a third
of all documents is one row per task), only repeated hashes are written.  They
are broadcast to the chunks if their row count is within a bound, else joined
by a shuffle; the occurrences are joined to the first ones by hash, and the
runs, a list per document, are joined back under a bound of their own: first
to count words, then to cut the texts.  All of it is DataFrame
expressions; no Python runs on executors.

Defined results: a null text stays null (0 lines); an empty text is one empty
line and stays; rows repeating an id are told apart by their texts, equal rows
of one id are one document (both stay or lose the same lines); rows without an
id are kept as they are.  Only the named columns are read, all others pass
through unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import freeze


BROADCAST_ROWS = 1_000_000  # of a hash and a place: some 50 MB at most
DOCUMENT_ROWS = 200_000  # of a document and its runs, a hundred bytes as a rule
WORD = r"[^ \t\r\f\x0b]+"


@dataclass(frozen=True)
class Chunks:
    """Sizes in words, but for ``window`` (lines) and ``most`` (percent): a
    document that would lose ``most`` or more of its words, but not all, stays
    whole (below 100: for pipelines that judge whole documents afterwards)."""

    window: int = 2
    density: int = 12
    anchor: int = 8
    least: int = 50
    most: int = 100


def line_hash(line: Column) -> Column:
    """31-bit line hash (first 32 bits of MD5, halved), plain in any SQL."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("long") % F.lit(2147483647)


def word_count(line: Column) -> Column:
    return F.regexp_count(line, F.lit(WORD))


def rolled(hashes: str, at: Column, window: int) -> Column:
    """Rolling hash of the ``window`` lines up to line number ``at`` (from 1)."""
    value = F.lit(0).cast("long")
    for back in range(window - 1, -1, -1):
        value = (value * 1000003 + F.coalesce(F.get(F.col(hashes), at - 1 - back), F.lit(0))) % F.lit(2147483647)
    return value


def line_chunks(docs: DataFrame, key: str, text: str, setup: Chunks, beside: bool) -> DataFrame:
    """``id, t, chunk, lo, hi, body`` of every chunk with enough words of every
    document: ``t`` a hash of the text, ``lo, hi`` its line numbers (from 1).
    ``beside`` adds the lines of the chunks ``before`` and ``after``, null at the ends."""
    n = F.size("__lines")
    many = lambda i: F.get(F.col("__words"), i - 1)
    divisor = lambda i: F.greatest(F.lit(1), F.ceil(F.lit(setup.density) / F.greatest(F.lit(1), many(i))))
    is_end = lambda i: (i == n) | (many(i + 1) >= setup.least) | (rolled("__h", i, setup.window) % divisor(i) == 0)
    ends = F.filter(F.sequence(F.lit(1), n), is_end)
    cut = (
        docs.where(F.col(key).isNotNull() & F.col(text).isNotNull())
        .select(F.col(key).alias("id"), F.xxhash64(F.col(text)).alias("t"), F.split(F.col(text), "\n", -1).alias("__lines"))
        .select("id", "t", "__lines", F.transform("__lines", line_hash).alias("__h"), F.transform("__lines", word_count).alias("__words"))
        .select("id", "t", "__lines", "__words", ends.alias("__ends"))
    )
    # the chunks are built as one array: exploded rows then carry a chunk each, not the whole document
    bounds = F.col("__ends")
    start = lambda c: F.coalesce(F.get(bounds, c - 1), F.lit(0)) + 1
    span = lambda c: F.get(bounds, c) - start(c) + 1
    body = lambda c: F.array_join(F.slice("__lines", start(c), span(c)), "\n")
    words = lambda c: F.aggregate(F.slice("__words", start(c), span(c)), F.lit(0), lambda a, w: a + w)
    last = F.size(bounds) - 1
    numbers = F.filter(F.sequence(F.lit(0), last), lambda c: words(c) >= setup.anchor)
    ahead = lambda c: F.slice("__lines", start(F.greatest(F.lit(0), c - setup.window)), start(c) - start(F.greatest(F.lit(0), c - setup.window)))
    sides = lambda c: [F.when(c > 0, F.array_join(ahead(c), "\n")).alias("before"), F.when(c < last, body(c + 1)).alias("after")] if beside else []
    rows = F.transform(numbers, lambda c: F.struct(c.alias("chunk"), start(c).alias("lo"), F.get(bounds, c).alias("hi"), body(c).alias("body"), *sides(c)))
    return cut.select("id", "t", F.inline(rows))


def equal_lines(a: Column, b: Column) -> Column:
    """How many leading entries two arrays share (0 for null)."""
    most = F.least(F.size(a), F.size(b))
    count = F.aggregate(F.sequence(F.lit(1), most), F.lit(0), lambda n, i: F.when((n == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(n))
    return F.when(a.isNotNull() & b.isNotNull(), count).otherwise(0)


def repeated_runs(docs: DataFrame, key: str, text: str, setup: Chunks) -> DataFrame:
    """``id, t, lo, hi`` of the maximal runs of repeated lines, of any size."""
    place = F.struct("id", "t", "chunk")
    counted = line_chunks(docs, key, text, setup, beside=False).groupBy(F.xxhash64("body").alias("k")).agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("c"))
    repeated = freeze(counted.where("c > 1").select("k", "first"), "repeated")
    # occurrences of repeated hashes, with their bytes; chunk texts are shuffled only beyond the bound
    small = repeated.count() <= BROADCAST_ROWS
    chunks = line_chunks(docs, key, text, setup, beside=True).withColumn("hash", F.xxhash64("body"))
    seen = freeze(
        chunks.join(F.broadcast(repeated) if small else repeated, F.col("hash") == F.col("k")).select("hash", (place != F.col("first")).alias("later"), "id", "t", "lo", "hi", "body", "before", "after"),
        "occurrences",
    )
    kept = freeze(
        seen.where("not later").dropDuplicates(["hash"]).select(F.col("hash").alias("k"), *[F.col(c).alias(f"kept_{c}") for c in ("body", "before", "after")]),
        "kept",
    )
    split = lambda c: F.split(F.col(c), "\n", -1)
    back = equal_lines(F.reverse(split("before")), F.reverse(split("kept_before")))
    forth = equal_lines(split("after"), split("kept_after"))
    equal = (
        seen.where("later").join(kept, F.col("hash") == F.col("k")).where(F.col("body") == F.col("kept_body"))
        .select("id", "t", (F.col("lo") - back).alias("lo"), (F.col("hi") + forth).alias("hi"))
        .groupBy("id", "t", "lo").agg(F.max("hi").alias("hi"))
    )
    order = Window.partitionBy("id", "t").orderBy("lo")
    reached = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("lo") <= F.col("reached"), 0).otherwise(1)
    runs = equal.withColumn("reached", reached).withColumn("run", F.sum(begins).over(order))
    return runs.groupBy("id", "t", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("id", "t", "lo", "hi")


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", setup: Chunks = Chunks()) -> DataFrame:
    """All columns of ``docs`` with ``text`` cleaned, plus ``__n_lines``,
    ``__removed_lines``, ``__removed_words`` and ``__left_words`` (0 where
    nothing is removed)."""
    runs = (
        repeated_runs(docs, key, text, setup)
        .groupBy(F.col("id").alias("__id"), F.col("t").alias("__t"))
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("__runs"))
    )
    runs = freeze(runs, "runs")
    gone = freeze(judged_runs(docs.select(F.col(key).alias("__k"), F.col(text).alias("__text")), runs, setup), "removals")
    small = gone.count() <= DOCUMENT_ROWS
    names, lines, long = docs.columns, F.split(F.col(text), "\n", -1), F.col("__long")
    start = lambda k: F.coalesce(F.get(long, k - 1)["hi"], F.lit(0)) + 1
    stop = lambda k: F.coalesce(F.get(long, k)["lo"], F.size(lines) + 1)
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(long)), lambda k: F.slice(lines, start(k), stop(k) - start(k))))
    clean = F.when(long.isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    cut = docs.join(F.broadcast(gone) if small else gone, (docs[key] == gone["__id"]) & (F.xxhash64(docs[text]) == gone["__t"]), "left")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return cut.select(
        *[clean.alias(c) if c == text else F.col(f"`{c}`") for c in names],
        F.coalesce(F.length(text) - F.length(F.translate(text, "\n", "")) + 1, F.lit(0)).cast("long").alias("__n_lines"),
        *[number(c) for c in ("__removed_lines", "__removed_words", "__left_words")],
    )


def judged_runs(texts: DataFrame, runs: DataFrame, setup: Chunks) -> DataFrame:
    """``__id, __t`` of the documents that lose runs, the runs ``__long`` and
    what goes and stays, in numbers; no text leaves the scan while the runs
    are few enough to be broadcast."""
    small = runs.count() <= DOCUMENT_ROWS
    own = texts.join(F.broadcast(runs) if small else runs, (F.col("__k") == F.col("__id")) & (F.xxhash64("__text") == F.col("__t")))
    counted = own.select("__id", "__t", "__runs", F.transform(F.split("__text", "\n", -1), word_count).alias("__words"))
    add = lambda xs: F.aggregate(xs, F.lit(0), lambda a, w: a + w)
    within = lambda r: add(F.slice("__words", r["lo"], r["hi"] - r["lo"] + 1))
    long = counted.withColumn("__long", F.filter("__runs", lambda r: within(r) >= setup.least)).where(F.size("__long") > 0)
    long = long.select(
        "__id",
        "__t",
        "__long",
        F.aggregate("__long", F.lit(0), lambda n, r: n + r["hi"] - r["lo"] + 1).alias("__removed_lines"),
        F.aggregate("__long", F.lit(0), lambda n, r: n + within(r)).alias("__removed_words"),
        add(F.col("__words")).alias("__all_words"),
    )
    stays = F.col("__all_words") - F.col("__removed_words")
    judged = long.dropDuplicates(["__id", "__t"]).withColumn("__left_words", stays).drop("__all_words")
    return judged.where((F.col("__left_words") == 0) | (100 * F.col("__removed_words") < setup.most * (F.col("__removed_words") + F.col("__left_words")))) if setup.most < 100 else judged
