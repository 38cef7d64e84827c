import hashlib
import random
from collections import defaultdict

from agora.llm.linededup import Chunks, dedup_lines
from tests.llm.cases import SCHEMA, awkward, clashing, documents, edited, prose

P = 2147483647


def n_words(line):
    return len([w for w in line.replace("\t", " ").replace("\r", " ").replace("\f", " ").replace("\v", " ").split(" ") if w])


def chunks(lines, window=2, density=12, least=50):
    """(first, last) line numbers from 0."""
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % P for x in lines]
    out, start = [], 0
    for i, line in enumerate(lines):
        v = 0
        for back in range(window - 1, -1, -1):
            v = (v * 1000003 + (h[i - back] if i >= back else 0)) % P
        if i == len(lines) - 1 or n_words(lines[i + 1]) >= least or v % max(1, -(-density // max(1, n_words(line)))) == 0:
            out.append((start, i))
            start = i + 1
    return out


def brute(rows, anchor=8, least=50):
    """Rows (id, text) with unique ids -> cleaned texts by (id, text)."""
    docs = {i: t.split("\n") for i, t in rows if i is not None and t is not None}
    cuts = {i: chunks(ls) for i, ls in docs.items()}
    places = defaultdict(list)
    for i in sorted(docs):
        for c, (lo, hi) in enumerate(cuts[i]):
            if sum(map(n_words, docs[i][lo : hi + 1])) >= anchor:
                places["\n".join(docs[i][lo : hi + 1])].append((i, c))
    marked = defaultdict(list)
    for (j, d), *later in places.values():
        for i, c in later:
            (lo, hi), (klo, khi) = cuts[i][c], cuts[j][d]
            floor, ceiling = cuts[i][max(0, c - 2)][0], cuts[i][min(c + 1, len(cuts[i]) - 1)][1]
            kfloor, kceiling = cuts[j][max(0, d - 2)][0], cuts[j][min(d + 1, len(cuts[j]) - 1)][1]
            while lo > floor and klo > kfloor and docs[i][lo - 1] == docs[j][klo - 1]:
                lo, klo = lo - 1, klo - 1
            while hi < ceiling and khi < kceiling and docs[i][hi + 1] == docs[j][khi + 1]:
                hi, khi = hi + 1, khi + 1
            marked[i].append((lo, hi))
    out = {}
    for i, t in rows:
        if i not in docs:
            out[i, t] = t
            continue
        runs = []
        for lo, hi in sorted(marked[i]):
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        gone = {k for lo, hi in runs if sum(map(n_words, docs[i][lo : hi + 1])) >= least for k in range(lo, hi + 1)}
        out[i, t] = "\n".join(x for k, x in enumerate(docs[i]) if k not in gone)
    return out


def brute_whole(rows, most=50):
    """``brute`` with documents that lose ``most`` percent, but not all, whole."""
    want = brute(rows)
    size = lambda t: sum(map(n_words, t.split("\n")))
    return {(i, t): t if i is not None and t and 0 < size(c) and 100 * (size(t) - size(c)) >= most * size(t) else c for (i, t), c in want.items()}


def one_line(seed, n):
    return prose(seed, n).replace("\n", " ")


def table():
    shared = "\n".join(one_line(700 + k, 12) for k in range(14))
    rows = [r for r in awkward() if r[0] != 17]
    for k in range(30):
        own = "\n".join(one_line(800 + 20 * k + j, 8) for j in range(k % 7 + 1))
        text = own + "\n" + shared + "\n" + own[::-1]
        rows.append((3000 - k, text, "en", "s", len(text)))
    rows.append((5000, "\n" * 400, "en", "s", 400))
    rows.append((5001, "x\ny\n" * 3000, "en", "s", 12000))  # very long, repeats itself
    rows.append((5002, "some nine words that make up a line here\nthe next line\n" * 60, "en", "s", 3000))
    return rows


def test_brute_force(spark):
    rows = table()
    want = brute([r[:2] for r in rows])
    docs = clashing(documents(spark, rows))
    got = dedup_lines(docs)
    assert got.columns[: len(docs.columns)] == docs.columns
    by_id = {r[0]: r[1] for r in rows if r[0] is not None}
    n = 0
    for r in got.collect():
        original = by_id.get(r.doc_id)
        if r.doc_id is None or original is None:
            assert r["__removed_lines"] == r["__removed_words"] == 0
            continue
        assert r.text == want[r.doc_id, original]
        assert r["__n_lines"] == original.count("\n") + 1
        if r["__removed_lines"]:
            assert r["__left_words"] == sum(map(n_words, r.text.split("\n")))
            assert r["__left_words"] + r["__removed_words"] == sum(map(n_words, original.split("\n")))
        n += r["__removed_lines"]
    assert n > 50


def test_random_texts_against_brute_force(spark):
    r = random.Random(9)
    pool = [one_line(100 + k, r.choice([1, 3, 6, 10, 18, 30, 60])) for k in range(40)]
    rows = []
    for i in range(150):
        at = r.randrange(36)
        body = [r.choice(pool) for _ in range(r.randrange(4))] + pool[at : at + r.randrange(1, 9)] + [one_line(9000 + i, r.randrange(1, 20)) for _ in range(r.randrange(3))]
        rows.append((i, "\n".join(body), "en", "s", 1))
    want = brute([x[:2] for x in rows])
    texts = {x[0]: x[1] for x in rows}
    got = {x.doc_id: x.text for x in dedup_lines(documents(spark, rows)).collect()}
    assert got == {i: want[i, t] for i, t in texts.items()}
    assert sum(got[i] != texts[i] for i in got) > 30


def planted():
    """Passages of 1 to 6 lines, over 50 words each, in two documents each with
    other lines around them; a short one that stays."""
    rows, passages = [], {}
    for k in range(60):
        n = k % 6 + 1
        passages[k] = "\n".join(one_line(5000 + 10 * k + j, 60 // n + 1) for j in range(n))
        for copy in (0, 1):
            own = [one_line(9000 + 8 * k + 4 * copy + j, 12) for j in range(4)]
            rows.append((1 + k + 1000 * copy, "\n".join(own[:2] + [passages[k]] + own[2:]), "en", "s", 1))
    short = one_line(77, 20)
    rows += [(3000 + c, one_line(78 + c, 9) + "\n" + short, "en", "s", 1) for c in (0, 1)]
    return rows, passages


def test_planted_passages(spark):
    rows, passages = planted()
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark, rows)).collect()}
    texts = {r[0]: r[1] for r in rows}
    caught = 0
    for k, p in passages.items():
        assert got[1 + k] == texts[1 + k]
        assert got[1001 + k] in (texts[1001 + k], texts[1001 + k].replace(p + "\n", ""))
        caught += got[1001 + k] != texts[1001 + k]
    assert caught >= 0.95 * len(passages)
    assert all(got[i] == texts[i] for i in (3000, 3001))


def test_no_line_is_lost_and_whole_copies_go(spark):
    rows = [r for r in awkward() if r[0] is not None and r[1]] + [(9000, prose(15, 30_000), "en", "s", 1)]
    got = dedup_lines(documents(spark, rows)).collect()
    lines = {x for r in got for x in r.text.split("\n")}
    assert {x for r in rows for x in r[1].split("\n")} <= lines | {""}
    whole = {r.doc_id for r in got if r["__removed_lines"] == r["__n_lines"]}
    assert {2, 9000} <= whole and not whole & {1, 15}


def test_bounds_resist_shifts():
    body = [one_line(40 + k, 6) for k in range(60)]
    cut = lambda lines: {"\n".join(lines[a : b + 1]) for a, b in chunks(lines)}
    a, b = cut(body), cut(["new line", "another"] + body)
    assert len(a) > 10 and len(a & b) >= len(a) - 2


def test_rows_of_one_id_and_empty_table(spark):
    a, b = one_line(1, 80), one_line(2, 80)
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, b + "\n" + a, "en", "s", 1)]
    got = sorted(r.text for r in dedup_lines(documents(spark, rows)).collect())
    assert got in (sorted([a, a, b]), sorted(["", "", b + "\n" + a]))  # the smaller place stays
    assert dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


def test_edited_lines_stay(spark):
    text = "\n".join(one_line(600 + k, 30) for k in range(6))
    rows = [(1, text, "en", "s", 1), (2, edited(text, 3, 20), "en", "s", 1)]
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark, rows), setup=Chunks(least=500)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1]}


def test_no_python_on_executors(spark):
    plan = dedup_lines(documents(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_mostly_repeated_documents_stay_whole(spark):
    rows = table()
    want = brute_whole([r[:2] for r in rows])
    texts = {r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}
    got = {r.doc_id: r.text for r in dedup_lines(documents(spark, rows), setup=Chunks(most=50)).collect()}
    assert {i: got[i] for i in texts} == {i: want[i, t] for i, t in texts.items()}
    assert any(want[i, t] != brute([r[:2] for r in rows])[i, t] for i, t in texts.items())
