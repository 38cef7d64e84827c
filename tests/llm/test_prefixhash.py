import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from agora.llm.prefixhash import PrefixHash, fingerprint_edits, likeness
from tests.llm.cases import SCHEMA, awkward, clashing, documents, edited, prose


def brute(rows):
    """rows in order; edited text and successor of each."""
    low = -(1 << 63)
    order = sorted(((low if i is None else i, t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (_, text, i) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        cut = len(text) // 2
        out.append((i, text, text[: len(text) - cut] + after[:cut], after))
    return out


P = 2**31 - 1
MASK = 2**64 - 1


def plain_print(text, span=8):
    """The fingerprint from its definition, number by number."""

    def poly(points, base):
        return sum((c + 1) * pow(base, i, P) for i, c in enumerate(points)) % P

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & MASK
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & MASK
        return x ^ (x >> 31)

    points, bins = list(map(ord, text)), {}
    n = min(span, len(points))
    for i in range(len(points) - n + 1 if n else 0):
        a, b = (poly(points[i : i + n], base) for base in (1_000_003_919, 1_766_418_311))
        key = mixed(a << 31 | b)
        bins[key >> 58] = min(key, bins.get(key >> 58, MASK))
    whole = [0, 0]
    for k, base in enumerate((1_000_003_919, 1_766_418_311)):
        for c in reversed(points):
            whole[k] = (whole[k] * base + c + 1) % P
    marks = [f"{bins[b] % 0xFFFF:04x}" if b in bins else "ffff" for b in range(64)]
    return f"{whole[0]:08x}{whole[1]:08x}{len(points):010x}" + "".join(marks)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([p[i : i + 4] for i in range(26, 282, 4)] for p in (a, b))
    filled = [(p, q) for p, q in zip(x, y) if (p, q) != ("ffff", "ffff")]
    return sum(p == q for p, q in filled) / len(filled) if filled else 0.0


def test_contract(spark):
    rows = [r[:2] for r in awkward()]
    want = {}
    prints = {}
    for i, text, edit, after in brute(rows):
        a, b, c = (prints[x] if x in prints else prints.setdefault(x, plain_print(x)) for x in (text, edit, after))
        want.setdefault(i, []).append((len(text), hashlib.sha256(edit.encode()).hexdigest(), a, b, plain_likeness(a, b), plain_likeness(a, c)))
    got = {}
    for r in fingerprint_edits(clashing(documents(spark))).collect():
        got.setdefault(r.doc_id, []).append((r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_text_ids(spark):
    rows = [("b", "second text"), ("a", "first text"), ("c", "third one"), (None, "no id"), ("b", "second, again")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    order = [("c", "third one"), ("b", "second text"), ("b", "second, again"), ("a", "first text"), (None, "no id")]
    order = sorted(order, key=lambda r: ({"c": 0, "b": 1, "a": 2, None: 3}[r[0]], r[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after, cut = order[(k + 1) % 5][1], len(t) // 2
        want.append((i, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in fingerprint_edits(df).collect()), key=str) == sorted(want, key=str)


def test_one_row_and_empty_table(spark):
    got = fingerprint_edits(documents(spark, [(5, "abcdef", "en", "s", 6)])).collect()
    assert [(r.doc_id, r.edited_sha256) for r in got] == [(5, hashlib.sha256(b"abcabc").hexdigest())]
    assert fingerprint_edits(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab\U0001f600é", max_size=40), st.text(alphabet="ab\U0001f600é", max_size=40), st.data())
def test_spans_and_extensions(a, b, data):
    x, y = PrefixHash(a), PrefixHash(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert x.equal(i, y, j, n) == (a[i : i + n] == b[j : j + n])
    longest = 0
    while i + longest < len(a) and j + longest < len(b) and a[i + longest] == b[j + longest]:
        longest += 1
    assert x.common_extension(i, y, j) == longest


def test_span_array_is_the_span_hashes():
    x = PrefixHash("the quick brown fox")
    spans = x.spans(4)
    assert spans.tolist() == [(h[0] << 31) | h[1] for h in (x.span(i, 4) for i in range(x.n - 3))]


def test_likeness_orders_edits():
    r = random.Random(1)
    text = prose(3, 400)
    own = PrefixHash(text).fingerprint(8)
    light = likeness(own, PrefixHash(edited(text, r.random(), 40)).fingerprint(8))
    heavy = likeness(own, PrefixHash(edited(text, r.random(), 4)).fingerprint(8))
    assert likeness(own, own) == 1 > light > heavy > likeness(own, PrefixHash("0123456789" * 50).fingerprint(8))
