"""Text cleaning and tokenizing as column expressions.

Every function returns a Spark ``Column`` built from built-in functions, so
the whole chain runs inside whole-stage codegen on whole texts.  Each has a
SQL twin (``*_sql``) in the DuckDB dialect used by the oracle; the regular
expressions are written so that Java regex and RE2 read them the same way
(explicit Unicode classes instead of ``\\s`` / ``\\w``, whose meaning differs
between engines).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions.constants import (
    ANALYSIS_KEEP, ENGLISH_STOPWORDS, LEMMA_EXCEPTIONS, TECH_PHRASES, TUNING_EXTRA, TUNING_KEEP,
)
from agora.functions.lookups import literal_map

# Python's str.isspace() set: ASCII controls, 0x1C-0x1F, NEL and Unicode Z*
WS = r"\t\n\x{0B}\f\r\x{1C}-\x{1F}\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"          # Python's Unicode \w (letters, numbers, underscore)
ALPHA_WORD = r"\p{L}\p{Nl}\p{No}_"   # \w without decimal digits

PAT_HTML = r"<[^>]+>"
PAT_WS = f"[{WS}]+"
PAT_SCREENSHOT = rf"!?\[\]?\(https?:[^{WS}]+\)"
PAT_URL = rf"http[^{WS}]+|www[^{WS}]+"
PAT_CODE = r"(?s)```.*?```|`.*?`"
PAT_MENTION = rf"@([{WORD}]+)"
PAT_DISALLOWED = rf"[^a-zA-Z{WS}\-0-9_.?]"
PAT_TOKEN = rf"[{ALPHA_WORD}]+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with costly columns that filters and projections on them do not
    compute again: what a generator yields is computed before them."""
    held = F.struct(*[F.col(n) for n in names])
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(held))).select(*df.columns)


# ------------------------------------------------------------------ T1 - T8
def clean_text(c) -> Column:
    """T1-T8 in their fixed order: drop ':', strip tags, collapse
    whitespace, screenshot links, URLs, code, mentions, disallowed
    characters -> space, trim."""
    t = F.replace(_c(c), F.lit(":"), F.lit(""))
    t = F.regexp_replace(t, PAT_HTML, "")
    t = F.regexp_replace(t, PAT_WS, " ")
    t = _links_code_mentions(t)
    return F.trim(F.regexp_replace(t, PAT_DISALLOWED, " "))


def _links_code_mentions(t: Column) -> Column:
    t = F.regexp_replace(t, PAT_SCREENSHOT, " SCREENSHOT ")
    t = F.regexp_replace(t, PAT_URL, " URL ")
    t = F.regexp_replace(t, PAT_CODE, " CODE ")
    return F.regexp_replace(t, PAT_MENTION, "USER_$1")


def clean_text_tuning(c) -> Column:
    """The link/code/mention/character steps only, no trim."""
    return F.regexp_replace(_links_code_mentions(_c(c)), PAT_DISALLOWED, " ")


def clean_text_sql(x: str) -> str:
    t = f"replace({x}, ':', '')"
    t = f"regexp_replace({t}, '{PAT_HTML}', '', 'g')"
    t = f"regexp_replace({t}, '{PAT_WS}', ' ', 'g')"
    t = _links_code_mentions_sql(t)
    return f"trim(regexp_replace({t}, '{PAT_DISALLOWED}', ' ', 'g'))"


def _links_code_mentions_sql(t: str) -> str:
    t = f"regexp_replace({t}, '{PAT_SCREENSHOT}', ' SCREENSHOT ', 'g')"
    t = f"regexp_replace({t}, '{PAT_URL}', ' URL ', 'g')"
    t = f"regexp_replace({t}, '{PAT_CODE}', ' CODE ', 'g')"
    return f"regexp_replace({t}, '{PAT_MENTION}', 'USER_\\1', 'g')"


def clean_text_tuning_sql(x: str) -> str:
    return f"regexp_replace({_links_code_mentions_sql(x)}, '{PAT_DISALLOWED}', ' ', 'g')"


# ---------------------------------------------------------------------- T9
def tech_phrases(c, phrases=TECH_PHRASES) -> Column:
    """Lower-case, then join each technical phrase with underscores."""
    t = F.lower(_c(c))
    for p in phrases:
        t = F.replace(t, F.lit(p), F.lit(p.replace(" ", "_")))
    return t


def tech_phrases_sql(x: str, phrases=TECH_PHRASES) -> str:
    t = f"lower({x})"
    for p in phrases:
        t = f"replace({t}, '{p}', '{p.replace(' ', '_')}')"
    return t


# --------------------------------------------------------------------- T10
def _accent_table() -> tuple[str, str]:
    """Rule-built accent folding table: every precomposed Latin / Greek /
    Cyrillic letter whose canonical decomposition is one base letter plus
    combining marks maps to that base letter."""
    src, dst = [], []
    for lo, hi in ((0xC0, 0x24F), (0x370, 0x3FF), (0x400, 0x4FF), (0x1E00, 0x1EFF)):
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            base = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
            base = unicodedata.normalize("NFC", base)
            if base != ch and len(base) == 1:
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


ACCENTS_FROM, ACCENTS_TO = _accent_table()


def deaccent(c) -> Column:
    fold = lambda t: F.translate(F.regexp_replace(t, r"\p{Mn}+", ""), ACCENTS_FROM, ACCENTS_TO)
    # ASCII has nothing to fold; a variable of a one-entry array, so the text is computed once for both questions
    return F.get(F.transform(F.array(_c(c)), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(fold(t))), F.lit(0))


def deaccent_sql(x: str) -> str:
    return f"translate(regexp_replace({x}, '\\p{{Mn}}+', '', 'g'), '{ACCENTS_FROM}', '{ACCENTS_TO}')"


def simple_tokens(c, deacc: bool = True, min_len: int = 2, max_len: int = 30) -> Column:
    """Lower-case (and de-accent) then runs of letters / underscore; keep
    tokens of length ``min_len..max_len`` not starting with ``_``.  Null or
    empty text gives an empty array (T13)."""
    t = F.lower(_c(c))
    if deacc:
        t = deaccent(t)
    toks = F.regexp_extract_all(t, F.lit(PAT_TOKEN), 0)
    toks = F.filter(
        toks,
        lambda w: (F.length(w) >= min_len) & (F.length(w) <= max_len) & ~w.startswith("_"),
    )
    return F.coalesce(toks, F.array().cast("array<string>"))


def simple_tokens_sql(x: str, deacc: bool = True, min_len: int = 2, max_len: int = 30) -> str:
    t = f"lower({x})"
    if deacc:
        t = deaccent_sql(t)
    return (
        f"coalesce(list_filter(regexp_extract_all({t}, '{PAT_TOKEN}'), "
        f"lambda w: length(w) BETWEEN {min_len} AND {max_len} AND NOT starts_with(w, '_')), []::VARCHAR[])"
    )


# -------------------------------------------------------------- T11 / T15
def stopword_list(kind: str = "analysis") -> list[str]:
    if kind == "analysis":
        return [w for w in ENGLISH_STOPWORDS if w not in ANALYSIS_KEEP]
    if kind == "tuning":
        return [w for w in ENGLISH_STOPWORDS if w not in TUNING_KEEP] + TUNING_EXTRA
    raise ValueError(kind)


def remove_stopwords(tokens, stop: list[str]) -> Column:
    """Order- and duplicate-preserving difference (not a set difference)."""
    return F.filter(_c(tokens), lambda t: ~t.isin(*stop))  # a hash set, not a scan of the list


def remove_stopwords_sql(x: str, stop: list[str]) -> str:
    lst = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in stop) + "]"
    return f"list_filter({x}, lambda t: NOT list_contains({lst}, t))"


# --------------------------------------------------------------------- T12
# Noun lemmas: a list of exceptions, then regular English plural rules.  A full
# (token, lemma) table is taken by ``operators.lemmas.lemmatize_by_table``.
_LEMMA_CASE = (
    "CASE WHEN length(t) > 3 AND t LIKE '%ies' THEN concat(substr(t, 1, length(t) - 3), 'y') "
    "WHEN length(t) > 3 AND (t LIKE '%sses' OR t LIKE '%ches' OR t LIKE '%shes' OR t LIKE '%xes' "
    "OR t LIKE '%zes') THEN substr(t, 1, length(t) - 2) "
    "WHEN length(t) > 3 AND t LIKE '%s' AND NOT (t LIKE '%ss' OR t LIKE '%us' OR t LIKE '%is') "
    "THEN substr(t, 1, length(t) - 1) ELSE t END"
)


def lemmatize(tokens, exceptions: dict[str, str] = LEMMA_EXCEPTIONS) -> Column:
    known = literal_map(exceptions)
    # the map is searched entry by entry, so a hash set tells first whether it is worth it
    return F.transform(_c(tokens), lambda t: F.when(t.isin(*exceptions), F.element_at(known, t)).otherwise(lemma(t)))


def lemma(t: Column) -> Column:
    """The plural rules alone."""
    n = F.length(t)
    return (
        F.when((n > 3) & t.endswith("ies"), F.concat(t.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 3) & (t.endswith("sses") | t.endswith("ches") | t.endswith("shes") | t.endswith("xes")
                         | t.endswith("zes")), t.substr(F.lit(1), n - 2))
        .when((n > 3) & t.endswith("s") & ~(t.endswith("ss") | t.endswith("us") | t.endswith("is")),
              t.substr(F.lit(1), n - 1))
        .otherwise(t)
    )


def lemmatize_sql(x: str) -> str:
    known = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in LEMMA_EXCEPTIONS.items()) + "}"
    return f"list_transform({x}, lambda t: coalesce(({known})[t], {_LEMMA_CASE}))"


# ------------------------------------------------------- composed token chains
def analysis_tokens(c) -> Column:
    """Tokens for topic analysis: phrases, tokens, stop words, lemmas."""
    return lemmatize(remove_stopwords(simple_tokens(tech_phrases(c)), stopword_list("analysis")))


def analysis_tokens_sql(x: str) -> str:
    return lemmatize_sql(remove_stopwords_sql(simple_tokens_sql(tech_phrases_sql(x)), stopword_list("analysis")))


def tuning_tokens(c) -> Column:
    """T14 + T15: tuning cleaning, tokens, tuning stop list, lemmas."""
    return lemmatize(remove_stopwords(simple_tokens(clean_text_tuning(c)), stopword_list("tuning")))


def tuning_tokens_sql(x: str) -> str:
    return lemmatize_sql(remove_stopwords_sql(simple_tokens_sql(clean_text_tuning_sql(x)), stopword_list("tuning")))
