"""Line-first cleaning: rules judge the lines of a text, failing lines go, and
a document that loses too much of its text by that is rejected.

Rules of a line that holds a word (its blanks at both ends do not count):

* punctuation: it ends in no sentence mark and holds no whole sentence either
  (a mark before a blank, in a line of ten words or more), or over a fifth of
  its words end in doubled exclamation or question marks;
* symbols: over a tenth of its word characters are one of ``#*$%&|<>``;
* navigation: at least two words are bare separators, one word in four or more;
* boilerplate: at most 40 words, and one of ``BOILERPLATE`` in lower case;
* repetition: an earlier line of the same text is equal.

Lines without a word never fail.  Base statistics come first: a document of
fewer than 50 words, or with over half of its words in three-word windows that
occur twice or more, is rejected whatever its lines are.

Every text is judged alone and whole, in one scan without a shuffle; a task
holds one Arrow batch of texts and the counts of one text.

Defined results: a null or empty text has no words and is rejected, its
cleaned text is empty; repeated rows are judged row by row; rows without a key
are judged too.  Only the key and text columns are read, so extra columns
never clash.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_END = r"""[.!?:;…。！？]["'”’»)\]]*$"""
SENTENCE_INSIDE = r"[.!?…。！？][\x20\x09-\x0D]"
DOUBLED_MARK = r"[!?]{2,}$"
SEPARATOR = r"^[|>»›•·/→]+$"
BOILERPLATE = [
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use cookies",
    "javascript is disabled", "enable javascript", "click here", "read more", "sign up", "log in", "subscribe to our",
    "share this", "follow us", "skip to content", "back to top", "lorem ipsum", "powered by",
]

_END, _INSIDE, _DOUBLED = re.compile(SENTENCE_END), re.compile(SENTENCE_INSIDE), re.compile(DOUBLED_MARK.encode())
_SEPARATORS = frozenset("|>»›•·/→")
_LOWER = bytes(range(256)).lower()


@dataclass(frozen=True)
class LineRules:
    """Limits of the rules; shares are percentages."""

    least_words: int = 50
    most_repeated: int = 50
    most_symbols: int = 10
    most_doubled: int = 20
    sentence_words: int = 10
    separators: int = 2
    separator_share: int = 25
    boilerplate_words: int = 40
    most_lost: int = 40


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """How many words stand in an ``n``-word window that occurs twice or more."""
    windows = list(zip(*[words[i:] for i in range(n)]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    total = covered = 0  # words before ``covered`` are counted
    for at, window in enumerate(windows):
        if counts[window] > 1:
            total += at + n - max(at, covered)
            covered = at + n
    return total


def line_fails(line: str, words: list[bytes], rules: LineRules) -> str | None:
    """The first rule that the line breaks, or None."""
    n = len(words)
    bare = line.strip(BLANKS)
    if not _END.search(bare) and not (n >= rules.sentence_words and _INSIDE.search(bare)):
        return "punctuation"
    if 100 * sum(map(bool, map(_DOUBLED.search, words))) > rules.most_doubled * n:
        return "punctuation"
    chars = sum(len(w.decode("utf-8", "replace")) for w in words)
    if 100 * sum(map(line.count, SYMBOLS)) > rules.most_symbols * chars:
        return "symbols"
    bars = sum(len(w) <= 12 and _SEPARATORS.issuperset(w.decode("utf-8", "replace")) for w in words)
    if bars >= rules.separators and 100 * bars >= rules.separator_share * n:
        return "navigation"
    if n <= rules.boilerplate_words:
        low = line.encode().translate(_LOWER).decode()
        if any(b in low for b in BOILERPLATE):
            return "boilerplate"
    return None


def judge(text: str | None, rules: LineRules) -> tuple:
    """Statistics and verdict of one text; the last entry is the cleaned text."""
    text = text or ""
    words: list[bytes] = []
    seen: set[str] = set()
    left, n_dup, lost, gone = [], 0, 0, 0
    for line in text.split("\n"):
        own = line.encode("utf-8").split()  # the six ASCII blanks
        words += own
        if not own:
            left.append(line)
            continue
        if again := line in seen:
            n_dup += 1
        seen.add(line)
        if again or line_fails(line, own, rules):
            gone += 1
            lost += len(own)
        else:
            left.append(line)
    n, repeated = len(words), repeated_words(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    base = n < rules.least_words or 100 * repeated > rules.most_repeated * n
    kept = not base and 100 * lost <= rules.most_lost * n
    return n, chars, sum(map(text.count, SYMBOLS)), n_dup, repeated, base, kept, gone, lost, "\n".join(left)


_FIELDS = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"),
    ("base_failed", "boolean"), ("kept", "boolean"), ("removed_lines", "long"), ("removed_words", "long"), ("text", "string"),
]


def clean_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """Per row of ``docs``: ``key``, the statistics, ``base_failed``, ``kept``,
    ``removed_lines``, ``removed_words`` and the cleaned ``text``
    (``with_text=False`` leaves it out)."""
    fields = _FIELDS if with_text else _FIELDS[:-1]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def judged(batches):
        for batch in batches:
            rows = [judge(t, rules) for t in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["__key", *[name for name, _ in fields]])

    src = docs.select(F.col(key).alias("__key"), F.col(text).alias("text"))
    kind = src.schema["__key"].dataType.simpleString()
    out = src.mapInArrow(judged, f"__key {kind}, " + ", ".join(f"{name} {kind}" for name, kind in fields))
    return out.withColumnRenamed("__key", key)
