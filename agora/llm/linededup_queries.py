"""Query of line dedup and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.llm.common import table
from agora.llm.linededup import dedup_lines


def op8_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__removed_lines").alias("removed_lines"), "text")


_SQL = r"""
with l as (select doc_id, string_split(text, chr(10)) as ls from documents where text is not null),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i, len(ls) as n from l),
h as (select *, ('0x' || substr(md5(line), 1, 8))::bigint % 2147483647 as h, len(regexp_extract_all(line, '[^ \t\r\f\v]+')) as words from lines),
r as (select *, (coalesce(lag(h) over (partition by doc_id order by i), 0) * 1000003 + h) % 2147483647 as roll from h),
e as (select *, (i = n or lead(words) over (partition by doc_id order by i) >= 50 or roll % greatest(1, (12 + greatest(1, words) - 1) // greatest(1, words)) = 0)::int as ends from r),
c as (select *, coalesce(sum(ends) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as chunk from e),
g as (select doc_id, chunk, min(i) as lo, max(i) as hi, sum(words) as words, list(line order by i) as body from c group by doc_id, chunk),
b as (select *, case when chunk > 0 then coalesce(lag(body, 2) over w, []) || lag(body) over w end as before, lead(body) over w as after from g window w as (partition by doc_id order by chunk)),
f as (select *, row_number() over w as occurrence, first_value(before) over w as kept_before, first_value(after) over w as kept_after
      from b where words >= 8 window w as (partition by body order by doc_id, chunk)),
x as (select doc_id, lo, hi,
        case when before is null or kept_before is null then 0 else
          coalesce(list_min(list_filter(range(1, least(len(before), len(kept_before)) + 1), lambda k: before[len(before) + 1 - k] <> kept_before[len(kept_before) + 1 - k])) - 1,
                   least(len(before), len(kept_before))) end as back,
        case when after is null or kept_after is null then 0 else
          coalesce(list_min(list_filter(range(1, least(len(after), len(kept_after)) + 1), lambda k: after[k] <> kept_after[k])) - 1,
                   least(len(after), len(kept_after))) end as forth
      from f where occurrence > 1),
s as (select doc_id, lo - back as lo, max(hi + forth) as hi from x group by all),
m as (select *, max(hi) over (partition by doc_id order by lo rows between unbounded preceding and 1 preceding) as reached from s),
k as (select *, sum((reached is null or lo > reached)::int) over (partition by doc_id order by lo) as run from m),
runs as (select doc_id, run, min(lo) as lo, max(hi) as hi from k group by doc_id, run),
long as (select doc_id, lo, hi from runs join h using (doc_id) where i between lo and hi group by doc_id, lo, hi having sum(words) >= 50),
kept as (select doc_id, count(*) as n, string_agg(line, chr(10) order by i) as text
         from lines where not exists (select 1 from long where long.doc_id = lines.doc_id and i between lo and hi) group by doc_id)
select d.doc_id, coalesce(len(l.ls), 0)::bigint as n_lines, (coalesce(len(l.ls), 0) - coalesce(kept.n, 0))::bigint as removed_lines,
       case when d.text is null then null else coalesce(kept.text, '') end as text
from documents d left join l using (doc_id) left join kept using (doc_id)
"""

QUERIES = {"op8_linededup": op8_linededup}
ORACLE = {"op8_linededup": _SQL}
