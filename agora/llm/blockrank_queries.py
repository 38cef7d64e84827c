"""Query of ranked lexical search and its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from agora.llm.blockrank import rank_documents
from agora.llm.common import table


def op13_blockrank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _terms(text: str) -> str:
    low = f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


_SQL = f"""
with d as (select doc_id, {_terms('text')} as ts from documents where text is not null),
lens as (select doc_id, len(ts)::bigint as n from d where len(ts) > 0),
totals as (select count(*)::bigint as docs, sum(n)::bigint as terms from lens),
tf as (select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(ts) as term from d) group by doc_id, term),
q as (select item_id, term, count(*)::bigint as times
      from (select item_id, unnest({_terms('text')}) as term from benchmark where text is not null) group by item_id, term),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)::double))::bigint as w
      from (select term, count(*)::bigint as df from tf where term in (select term from q) group by term), totals),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::bigint as score
      from q join w using (term) join tf using (term) join lens using (doc_id), totals group by item_id, doc_id),
r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from s where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
"""

QUERIES = {"op13_blockrank": op13_blockrank}
ORACLE = {"op13_blockrank": _SQL}
