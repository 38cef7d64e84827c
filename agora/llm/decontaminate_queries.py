"""Query of benchmark decontamination and its SQL twin."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from agora.llm.common import table
from agora.llm.decontaminate import contained_items


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = (
    f"list_filter(regexp_split_to_array(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    "'[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
)

_SQL = f"""
with dw as (select doc_id, {_WORDS} as w from documents where text is not null and doc_id is not null),
iw as (select item_id, {_WORDS} as w from benchmark where text is not null and item_id is not null),
ish as (select distinct item_id, array_to_string(w[i:i+4], ' ') as s
        from (select item_id, w, unnest(range(1, len(w) - 3)) as i from iw where len(w) >= 5)),
dsh as (select distinct doc_id, array_to_string(w[i:i+4], ' ') as s
        from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from dw where len(w) >= 5)),
m as (select item_id, count(*) as item_shingles from ish group by item_id),
hit as (select doc_id, item_id, count(*) as shared_shingles from dsh join ish using (s) group by doc_id, item_id)
select doc_id, item_id, item_shingles, shared_shingles,
       round(shared_shingles / item_shingles, 6) as containment
from hit join m using (item_id) where 100 * shared_shingles >= 80 * item_shingles
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLE = {"op1_decontaminate": _SQL}
