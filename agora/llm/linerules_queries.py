"""Query of line-first cleaning and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.linerules import BOILERPLATE, DOUBLED_MARK, SENTENCE_END, SENTENCE_INSIDE, SEPARATOR, clean_lines


def op11_linerules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents"), with_text=False)


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_WORD = r"'[^\x20\x09-\x0D]+'"
_MARKS = r"'[^#*$%&|<>]'"
_BOILER = "'(" + "|".join(BOILERPLATE) + ")'"
_SQL = rf"""
with l as (select rowid as r, doc_id, coalesce(text, '') as text from (select row_number() over () as rowid, doc_id, text from documents)),
cut as (select r, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from l),
lines as (select *, regexp_extract_all(line, {_WORD}) as ws from cut),
f as (select *, len(ws) as n, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) as bare,
        row_number() over (partition by r, line order by i) > 1 as again from lines),
g as (select r, i, n, again,
        again
        or (not regexp_matches(bare, {_quoted(SENTENCE_END)}) and not (n >= 10 and regexp_matches(bare, {_quoted(SENTENCE_INSIDE)})))
        or 100 * len(list_filter(ws, lambda w: regexp_matches(w, '{DOUBLED_MARK}'))) > 20 * n
        or 100 * length(regexp_replace(line, {_MARKS}, '', 'g')) > 10 * list_sum(list_transform(ws, lambda w: length(w)))
        or (len(list_filter(ws, lambda w: regexp_matches(w, '{SEPARATOR}') and strlen(w) <= 12)) >= 2
            and 100 * len(list_filter(ws, lambda w: regexp_matches(w, '{SEPARATOR}') and strlen(w) <= 12)) >= 25 * n)
        or (n <= 40 and regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_BOILER})) as fails
      from f where n > 0),
by_line as (select r, sum(n) as n_words, count(*) filter (again) as n_dup_lines,
        count(*) filter (fails) as removed_lines, coalesce(sum(n) filter (fails), 0) as removed_words from g group by r),
w as (select r, unnest(ws) as w, generate_subscripts(ws, 1) as i from (select r, regexp_extract_all(text, {_WORD}) as ws from l)),
win as (select r, i, w, lead(w) over o as w2, lead(w, 2) over o as w3 from w window o as (partition by r order by i)),
rep as (select r, i, count(*) over (partition by r, w, w2, w3) > 1 as twice from win where w3 is not null),
covered as (select r, count(distinct i + k) as n_repeat_words from rep, (values (0), (1), (2)) t(k) where twice group by r),
s as (select l.r, doc_id, coalesce(n_words, 0)::bigint as n_words,
        coalesce(list_sum(list_transform(regexp_extract_all(text, {_WORD}), lambda w: length(w))), 0)::bigint as word_chars,
        length(regexp_replace(text, {_MARKS}, '', 'g'))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        coalesce(removed_lines, 0)::bigint as removed_lines, coalesce(removed_words, 0)::bigint as removed_words
      from l left join by_line using (r) left join covered on covered.r = l.r)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and 100 * removed_words <= 40 * n_words as kept,
       removed_lines, removed_words
from s
"""

QUERIES = {"op11_linerules": op11_linerules}
ORACLE = {"op11_linerules": _SQL}
