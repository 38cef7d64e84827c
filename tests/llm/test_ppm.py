import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from agora.llm.common import words
from agora.llm.ppm import Codes, grams, score_texts
from tests.llm.cases import SCHEMA, awkward, clashing, documents, prose


def brute(rows, order):
    trie, vocabulary, coded = defaultdict(Counter), Counter(), []
    for i, t in rows:
        w = words(t)
        s = b"\n" * order + b" ".join(w) + b"\n"
        coded.append((i, w + [b"\n"], s))
        if i is not None and zlib.crc32(str(i).encode()) % 5 != 1:
            vocabulary.update(w + [b"\n"])
            for p in range(order, len(s)):
                for j in range(order + 1):
                    trie[s[p - j : p]][s[p]] += 1

    def log(ctx, symbol):
        out, ruled = 0.0, set()
        for j in range(len(ctx), -1, -1):
            live = {x: c for x, c in trie[ctx[len(ctx) - j :]].items() if x not in ruled} if ctx[len(ctx) - j :] in trie else {}
            total = sum(2 * c - 1 for c in live.values()) + len(live)
            if symbol in live:
                return out + math.log10((2 * live[symbol] - 1) / total)
            if live:
                out += math.log10(len(live) / total)
                ruled |= set(live)
        return out - math.log10(256 - len(ruled))

    n, v = sum(vocabulary.values()), len(vocabulary)
    unit = math.log10(n + 0.5 * (v + 1)) if n else math.log10(0.5)
    out = []
    for i, tokens, s in coded:
        base = sum(math.log10(vocabulary[t] + 0.5) - unit for t in tokens)
        score = sum(log(s[p - order : p], s[p]) for p in range(order, len(s)))
        out.append((i, len(tokens), sum(vocabulary[t] > 0 for t in tokens), n, round(base, 6), round(score, 6)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in df.collect()), key=str)


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x[:4] == y[:4] and np.allclose(x[4:], y[4:], atol=2e-6)


ROWS = [r if r[0] != 15 else (15, prose(15, 3000), *r[2:]) for r in awkward()] + [(500 + k, prose(k, 50) + " новый", "en", "s", 1) for k in range(30)]


@pytest.mark.parametrize("options", [{}, {"shard_rows": 500, "frequent": 50}, {"order": 3}])
def test_brute_force(spark, options):
    got = score_texts(clashing(documents(spark, ROWS)), **options)
    close(found(got), brute([r[:2] for r in ROWS], options.get("order", 5)))


def test_probabilities_sum_to_one(spark):
    # all continuations of one context, each as a document in the held-out fold
    held = [i for i in range(10_000, 12_000) if zlib.crc32(str(i).encode()) % 5 == 1]
    stems = [b for b in range(33, 127) if not 65 <= b <= 90]
    rows = [(i, prose(i, 60), "en", "s", 1) for i in range(40)]
    rows += [(i, "t" + chr(b), "en", "s", 1) for i, b in zip(held, stems)]
    scores = {r.doc_id: r.score for r in score_texts(documents(spark, rows)).collect()}
    assert 0 < sum(10 ** scores[i] for i, _ in zip(held, stems)) <= 1


def test_empty_and_untrained(spark):
    assert score_texts(spark.createDataFrame([], SCHEMA)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    got = score_texts(documents(spark, [(only, "ab", "en", "s", 2)])).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.n_tokens == 2
    assert abs(got.score + 3 * math.log10(256)) < 1e-9 and got.base_score == 0


def test_grams_and_table():
    packed, begin = grams([b"ab\n", b"\n", b"c d\n"], 3)
    assert begin.tolist() == [0, 3, 4] and packed.size == 8
    assert packed[0] == int.from_bytes(b"\n\n\na", "big") and packed[4] == int.from_bytes(b"\n\n\nc", "big")
    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000))
    table = Codes(keys, keys * 0.5)
    assert np.array_equal(table.look_up(keys[::7]), keys[::7] * 0.5)
    assert not table.look_up(keys[:50] + 2**41).any()
