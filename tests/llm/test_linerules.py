import random
import re

import duckdb

from agora.llm.linerules import LineRules, clean_lines, judge, repeated_words
from agora.llm.linerules_queries import ORACLE
from tests.llm.cases import SCHEMA, awkward, clashing, documents, prose

GOOD = "\n".join(" ".join(f"w{i * 7919 + k * k * 31}" for k in range(10)) + "." for i in range(12))


def brute_base(text):
    """Straight from the definition of the base statistics."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_statistics_equal_their_definition(spark):
    r = random.Random(5)
    rows = [x for x in awkward() if not x[1] or len(x[1]) < 20_000]
    for i in range(40):
        text = "".join(r.choice(["a ", "b ", "c ", "a b c ", "\n", "x|", "# ", "é\x1c", "文\t", "\x0b"]) for _ in range(r.randrange(200)))
        rows.append((200 + i, text, "en", "s", len(text)))
    got = clean_lines(clashing(documents(spark, rows))).collect()
    key = lambda x: repr(x)
    mine = sorted([(x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got], key=key)
    assert mine == sorted([(x[0], *brute_base(x[1])) for x in rows], key=key)


def test_rules_one_by_one():
    rules = LineRules()

    def cleaned(line):
        return judge(GOOD + "\n" + line, rules)[-1].split("\n")[12:]

    for bad in ["Home | News | About | Contact.", "no end mark here", "BUY!! NOW!! THE!! BEST!!", "so$$$ ma%%% sym### bols&&&.", "We use cookies on this site.", "Read more.", GOOD.split("\n")[3]]:
        assert cleaned(bad) == [], bad
    for good in ["A whole sentence.", 'He said "so."', "", "  \t", "A sentence stands here. Then one goes on without its end", "Is it? Yes!", "It costs 5 % of $ 20, more or less, all in all, this year."]:
        assert cleaned(good) == [good], good


def test_rejection_by_lost_text(spark):
    junk = "\n".join(f"menu{i} | item{i} | link{i}" for i in range(40))
    rows = [(1, GOOD), (2, GOOD + "\n" + junk), (3, GOOD + "\nHome | News | About"), (4, junk), (5, "short."), (6, None), (7, "")]
    got = {x.doc_id: x for x in clean_lines(documents(spark, [(i, t, "en", "s", 0) for i, t in rows])).collect()}
    assert {i for i, x in got.items() if x.kept} == {1, 3}
    assert got[3].text == GOOD and got[3].removed_lines == 1 and got[3].removed_words == 5
    assert not got[2].base_failed and not got[4].base_failed and got[6].text == "" and got[7].base_failed


def test_prose_is_kept(spark):
    rows = [(i, prose(i, 150) + ".", "en", "s", 0) for i in range(60)]
    assert clean_lines(documents(spark, rows)).where("not kept").count() == 0


def test_repeated_words():
    assert repeated_words(b"a b c x a b c".split()) == 6
    assert repeated_words(b"a a a a".split()) == 4
    assert repeated_words(b"a b".split()) == 0


def test_empty_table_and_sql_twin(spark):
    assert clean_lines(documents(spark, [])).count() == 0
    rows = [x for x in awkward()]
    rows += [(300, GOOD + "\nHome | News | About\nread More\nBUY!! NOW!!\n\n" + GOOD, "en", "s", 0), (301, prose(3, 80).replace(" ", " | ", 30), "en", "s", 0)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    want = con.execute(ORACLE["op11_linerules"]).fetchall()
    got = clean_lines(documents(spark, rows), with_text=False)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert SCHEMA.startswith("doc_id")
