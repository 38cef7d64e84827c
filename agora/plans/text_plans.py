"""Registered queries: text cleaning, tokens, domain classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import domains as D
from agora.operators.lemmas import lemmatize_by_table
from agora.plans import sql_views as V
from agora.plans.common import with_ctes
from agora.sources import tables as S

# stand-in taxonomy for content classification of the multilingual documents
# --- fixed values: frequent function words per language ----------------------
LANG_TAXONOMY = {
    "German": ["der", "die", "und"],
    "English": ["the", "of", "and"],
    "Spanish": ["de", "la", "que"],
    "French": ["le", "et", "les", "de", "la", "que"],  # some words are of both
}


def _docs(spark, sf):
    return S.text_table(spark, sf, "documents", "doc_id", "text", "lang")


def q_clean_text(spark, sf) -> DataFrame:
    return S.marked_documents(spark, sf).select("doc_id", T.clean_text("text").alias("clean"))


def q_clean_html(spark, sf) -> DataFrame:
    return S.text_table(spark, sf, "pages", "page_id", "html").select("page_id", T.clean_text("html").alias("clean"))


def q_clean_tuning(spark, sf) -> DataFrame:
    return S.marked_documents(spark, sf).select("doc_id", T.clean_text_tuning("text").alias("clean"))


def q_tech_phrases(spark, sf) -> DataFrame:
    return S.marked_documents(spark, sf).select("doc_id", T.tech_phrases("text").alias("phrased"))


def _tok_out(c):
    return [F.array_join(c, " ").alias("tokens"), F.size(c).cast("long").alias("n_tokens")]


def q_tokens(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *_tok_out(T.simple_tokens("text")))


def q_tokens_accents(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *_tok_out(T.simple_tokens("text", deacc=False)))


def q_stopword_filter(spark, sf) -> DataFrame:
    toks = T.remove_stopwords(T.simple_tokens(T.tech_phrases("text")), T.stopword_list("analysis"))
    return _docs(spark, sf).select("doc_id", *_tok_out(toks))


def q_lemmas(spark, sf) -> DataFrame:
    return _docs(spark, sf).select("doc_id", *_tok_out(T.analysis_tokens("text")))


def q_lemma_table(spark, sf) -> DataFrame:
    """T12 with a (token, lemma) table: here every long token of the
    documents and its first letters."""
    d = _docs(spark, sf).select("doc_id", T.simple_tokens("text").alias("toks"))
    known = d.select(F.explode("toks").alias("token")).where("length(token) >= 9").distinct().withColumn("lemma", F.substring("token", 1, 7))
    return lemmatize_by_table(d, "doc_id", "toks", known).select("doc_id", *_tok_out(F.col("lemmas")))


def q_min_tokens(spark, sf) -> DataFrame:
    """Tuning tokens of documents with at least 5 tokens."""
    d = _docs(spark, sf).select("doc_id", T.tuning_tokens("text").alias("t"))
    return T.once(d, "t").where(F.size("t") >= 5).select("doc_id", *_tok_out(F.col("t")))


def _discussion_texts(spark, sf):
    d = S.discussions(spark, sf)
    docs = S.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    return d.join(docs, "id", "left")


def q_tag_domains(spark, sf) -> DataFrame:
    d = S.discussions(spark, sf).where(F.col("tags").isNotNull())
    return d.select("id", F.array_join(D.domains_by_tags("tags"), "|").alias("domains"))


def q_discussion_domains(spark, sf) -> DataFrame:
    d = _discussion_texts(spark, sf)
    return d.select("id", F.array_join(D.classify("tags", F.col("title"), F.col("content")), "|").alias("domains"))


def q_content_domains(spark, sf) -> DataFrame:
    d = _docs(spark, sf)
    return d.select("doc_id", F.array_join(
        D.domains_by_content(F.lit(""), F.col("text"), LANG_TAXONOMY), "|").alias("domains"))


def q_domain_hits(spark, sf) -> DataFrame:
    d = _docs(spark, sf).select("doc_id", F.explode(D.domain_hits(F.lit(""), F.col("text"), LANG_TAXONOMY)).alias("domain"))
    return d.groupBy("doc_id", "domain").agg(F.count(F.lit(1)).alias("hits"))


QUERIES = {
    "clean_text": q_clean_text,
    "clean_html": q_clean_html,
    "clean_tuning": q_clean_tuning,
    "tech_phrases": q_tech_phrases,
    "tokens": q_tokens,
    "tokens_accents": q_tokens_accents,
    "stopword_filter": q_stopword_filter,
    "lemmas": q_lemmas,
    "lemma_table": q_lemma_table,
    "min_tokens": q_min_tokens,
    "tag_domains": q_tag_domains,
    "discussion_domains": q_discussion_domains,
    "content_domains": q_content_domains,
    "domain_hits": q_domain_hits,
}


def _tok_sql(expr: str) -> str:
    return f"array_to_string({expr}, ' ') AS tokens, CAST(len({expr}) AS BIGINT) AS n_tokens"


_DT = """dt AS (SELECT d.id, d.title, d.tags, doc.text AS content
          FROM discussions d LEFT JOIN documents doc ON doc.doc_id = d.id)"""
_BY_TAGS = """coalesce((SELECT array_to_string(list_sort(list(DISTINCT tx.domain)), '|')
                        FROM unnest(tags) AS u(t) JOIN tx ON tx.tag = lower(u.t)), 'General')"""


def _by_content(kw: str, title: str, content: str) -> str:
    return f"""coalesce((SELECT array_to_string(list_sort(list(DISTINCT {kw}.domain)), '|')
                         FROM unnest({D.content_tokens_sql(title, content)}) AS u(t) JOIN {kw} ON {kw}.tag = u.t), 'General')"""


ORACLE = {
    "clean_text": with_ctes(V.MARKED, body=f"SELECT doc_id, {T.clean_text_sql('text')} AS clean FROM marked"),
    "clean_html": f"SELECT page_id, {T.clean_text_sql('html')} AS clean FROM pages",
    "clean_tuning": with_ctes(V.MARKED, body=f"SELECT doc_id, {T.clean_text_tuning_sql('text')} AS clean FROM marked"),
    "tech_phrases": with_ctes(V.MARKED, body=f"SELECT doc_id, {T.tech_phrases_sql('text')} AS phrased FROM marked"),
    "tokens": f"SELECT doc_id, {_tok_sql(T.simple_tokens_sql('text'))} FROM documents",
    "tokens_accents": f"SELECT doc_id, {_tok_sql(T.simple_tokens_sql('text', deacc=False))} FROM documents",
    "stopword_filter": f"""SELECT doc_id, {_tok_sql(T.remove_stopwords_sql(T.simple_tokens_sql(T.tech_phrases_sql('text')), T.stopword_list('analysis')))} FROM documents""",
    "lemma_table": f"""SELECT doc_id, {_tok_sql('t')} FROM (SELECT doc_id,
        list_transform({T.simple_tokens_sql('text')}, lambda t: CASE WHEN length(t) >= 9 THEN left(t, 7) ELSE {T._LEMMA_CASE} END) AS t FROM documents)""",
    "lemmas": f"SELECT doc_id, {_tok_sql(T.analysis_tokens_sql('text'))} FROM documents",
    "min_tokens": f"""SELECT doc_id, {_tok_sql('t')} FROM (SELECT doc_id, {T.tuning_tokens_sql('text')} AS t FROM documents)
                      WHERE len(t) >= 5""",
    "tag_domains": with_ctes(V.DISCUSSIONS, D.taxonomy_cte("tx"),
                             body=f"SELECT id, {_BY_TAGS} AS domains FROM discussions WHERE tags IS NOT NULL"),
    "discussion_domains": with_ctes(V.DISCUSSIONS, _DT, D.taxonomy_cte("tx"), D.taxonomy_cte("kw", single_token=True),
                                    body=f"""SELECT id, CASE WHEN tags IS NOT NULL THEN {_BY_TAGS}
                                             ELSE {_by_content('kw', 'title', 'content')} END AS domains FROM dt"""),
    "content_domains": with_ctes(D.taxonomy_cte("kw", LANG_TAXONOMY, single_token=True),
                                 body=f"SELECT doc_id, {_by_content('kw', chr(39) * 2, 'text')} AS domains FROM documents"),
    "domain_hits": with_ctes(D.taxonomy_cte("kw", LANG_TAXONOMY, single_token=True), body=f"""
        SELECT doc_id, kw.domain, CAST(count(*) AS BIGINT) AS hits
        FROM (SELECT doc_id, unnest({D.content_tokens_sql(chr(39) * 2, 'text')}) AS t FROM documents) u
        JOIN kw ON kw.tag = u.t GROUP BY doc_id, kw.domain"""),
}
