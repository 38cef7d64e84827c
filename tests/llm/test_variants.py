import random
import re
import zlib
from collections import Counter

from agora.llm.variants import Spelling, is_near, probe_steps, spelling_variants
from tests.llm.cases import awkward, clashing, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def distance_one(a, b):
    """By all edits of ``a``, independent of the operator's own test."""
    if a == b:
        return False
    cut = {a[:i] + a[i + 1 :] for i in range(len(a))}
    other = {b[:i] + b[i + 1 :] for i in range(len(b))}
    same = len(a) == len(b) and any(a[:i] == b[:i] and a[i + 1 :] == b[i + 1 :] for i in range(len(a)))
    return b in cut or a in other or same


def brute(rows, least_length=6, least_count=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                counts[run] += 1
    words = {w: n for w, n in counts.items() if n >= least_count}
    form, near = {}, {}
    for w, n in words.items():
        close = [x for x in words if abs(len(x) - len(w)) < 2 and distance_one(w, x)]
        near[w] = len(close)
        best = min(close, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 5 * n else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted([(w, form[w], root(w), n, near[w], words[form[w]] if form[w] else None) for w, n in words.items()])


def corpus(seed, docs=60):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeéÉñ") for _ in range(r.randrange(5, 10))) for _ in range(40)]
    rows = []
    for i in range(docs):
        out = []
        for _ in range(200):
            w = base[min(int(r.expovariate(0.15)), 39)]
            for _ in range(r.choice([0, 0, 0, 0, 1, 2])):
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("abé") + w[at:], w[:at] + r.choice("abé") + w[at + 1 :]]) or "x"
            out.append(w.upper() if r.random() < 0.1 else w)
        rows.append((i, r.choice([" ", "-", "7", "× "]).join(out)))
    return rows


def run(spark, rows, setup):
    docs = clashing(documents(spark, [(i, t, "en", "s", 0) for i, t in rows]))
    return sorted(map(tuple, spelling_variants(docs, setup=setup).select("word", "form", "root", "n", "n_near", "form_n").collect()))


def test_equals_brute_force(spark):
    rows = corpus(1)
    want = brute(rows)
    assert any(w[1] for w in want) and any(w[2] != w[0] and w[2] != w[1] for w in want)
    assert run(spark, rows, Spelling()) == want


def test_split_subtrees_give_the_same(spark):
    rows = corpus(2, 40)
    assert run(spark, rows, Spelling(groups=3, cut=1, words=7, probes=5)) == brute(rows)


def test_awkward_rows_and_empty_table(spark):
    rows = [(r[0], r[1]) for r in awkward()]
    assert run(spark, rows, Spelling()) == brute(rows)
    assert run(spark, [], Spelling()) == []
    assert run(spark, [(1, None), (2, "")], Spelling()) == []


def test_is_near_and_steps():
    r = random.Random(4)
    words = ["".join(r.choice("ab") for _ in range(r.randrange(1, 5))) for _ in range(300)]
    assert all(is_near(a, b) == distance_one(a, b) for a in words for b in words[:60])
    steps = probe_steps(4)
    assert len(steps) == len({s[:2] for s in steps}) == 31
