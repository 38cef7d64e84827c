import random
import zlib

import numpy as np
import pytest

from agora.llm.packing import Encoder, pack_documents, plan_packing, reduce_by_dominance
from agora.llm.packing_queries import vocabulary_path
from tests.llm.cases import SCHEMA, awkward, clashing, documents


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_tokenizer(name):
    enc = Encoder(vocabulary_path().replace("word_bpe_49k.json", name), remember=50)
    assert enc.by_pieces == (name == "word_bpe_49k.json")
    texts = [r[1] for r in awkward()] + [
        "it's we'LL ²x!!'s a'sb 'S '' don't", "ΑΣ İ ŉ ǅ ß ﬁ \xa0 a\x85b\x1c", "<|endoftext|> <|x", "\t\x0b\x0c", "é", "x" * 5000,
    ]
    for text, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.tokenizer.encode(text or "", add_special_tokens=False).ids


def check_plan(counts, capacity):
    moves, opened = plan_packing(counts, capacity)
    seen, fill = set(), {}
    for size, lo, hi, sequence, offset in moves:
        for n in range(lo, hi):
            assert (size, n) not in seen
            seen.add((size, n))
            fill.setdefault(sequence + n - lo, []).append((offset, size))
    assert len(seen) == sum(counts.values()) and len(fill) == opened
    for parts in fill.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= capacity
    return opened


@pytest.mark.parametrize("seed", range(40))
def test_plan_is_a_packing(seed):
    r = random.Random(seed)
    capacity = r.choice([7, 10, 20, 50])
    check_plan({r.randint(1, capacity): r.randint(1, 9) for _ in range(r.randint(1, 10))}, capacity)


def best(items, capacity):
    """Fewest bins by search (small instances)."""
    items = sorted(items, reverse=True)
    low = -(-sum(items) // capacity)

    def fits(i, room):
        if i == len(items):
            return True
        tried = set()
        for b in range(len(room)):
            if room[b] >= items[i] and room[b] not in tried:
                tried.add(room[b])
                room[b] -= items[i]
                if fits(i + 1, room):
                    return True
                room[b] += items[i]
        return False

    n = low
    while not fits(0, [capacity] * n):
        n += 1
    return n


@pytest.mark.parametrize("seed", range(60))
def test_dominance_keeps_an_optimum(seed):
    r = random.Random(1000 + seed)
    capacity = r.choice([10, 15, 20])
    items = [r.randint(1, capacity) for _ in range(r.randint(3, 10))]
    counts = {s: items.count(s) for s in items}
    fixed, left = reduce_by_dominance(counts, capacity)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert sum(n for _, n in fixed) + best(rest, capacity) == best(items, capacity)


def test_documents_are_packed_gapless(spark):
    rows = awkward()
    got = pack_documents(clashing(documents(spark)), vocabulary_path(), capacity=64).collect()
    tokenizer = Encoder(vocabulary_path()).tokenizer
    want = []
    for doc, text, *_ in rows:
        ids = np.asarray(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        for p in range(0, len(ids), 64):
            part = ids[p : p + 64]
            want.append((doc, p // 64, p, len(part), zlib.crc32(part.tobytes())))
    key = lambda t: (t[0] is None, t)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 64
    assert len(by) <= 1.05 * sum(r.length for r in got) / 64 + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], SCHEMA), vocabulary_path()).count() == 0
