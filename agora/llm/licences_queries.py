"""Query of license scans and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.licence_texts import EQUIVALENT, KNOWN_DIGESTS, KNOWN_TEXTS
from agora.llm.licences import COPYRIGHT_LINE, PUNCTUATION, scan_licences


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _canonical(expr: str) -> str:
    """The normalisation as nested SQL calls."""
    out = f"regexp_replace(lower({expr}), '{COPYRIGHT_LINE}', chr(10), 'g')"
    out = f"' ' || trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')) || ' '"
    for a, b in sorted(EQUIVALENT, key=lambda x: -len(x[0])):
        out = f"replace({out}, ' {a} ', ' {b} ')"
    return f"trim({out})"


_KNOWN = " union all ".join(f"select '{n}' as licence, '{t.replace(chr(39), chr(39) * 2)}' as t" for n, t in KNOWN_TEXTS)
_DIGESTS = ", ".join(f"('{d}', '{n}')" for n, d in KNOWN_DIGESTS.items())

_SQL = f"""
with known0 as ({_KNOWN}),
known as (select k, string_agg(licence, ',' order by licence) as licence
          from (select distinct {_canonical('t')} as k, licence from known0) where k <> '' group by k),
d as (select doc_id, {_canonical("coalesce(text, '')")} as plain from documents),
l0 as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
l as (select doc_id, {_canonical('line')} as plain from l0),
n as (select doc_id, count(*) as notice_lines, list_sort(list_distinct(flatten(list(string_split(licence, ','))))) as names
      from l join known on l.plain = known.k group by doc_id)
select d.doc_id, case when d.plain = '' then null else sha256(d.plain) end as text_digest, coalesce(known.licence, long.name) as text_licence,
       coalesce(n.notice_lines, 0)::bigint as notice_lines, coalesce(array_to_string(n.names, ','), '') as notices
from d left join known on d.plain = known.k left join (values {_DIGESTS}) long(digest, name) on sha256(d.plain) = long.digest left join n using (doc_id)
"""

QUERIES = {"op4_licences": op4_licences}
ORACLE = {"op4_licences": _SQL}
