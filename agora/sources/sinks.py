"""Sinks and delimited-text readers (S10-S14, S20, S22, S7); tables that
belong together are written by ``table_sets``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources.splits import quoted_records


def write_tsv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Tab-separated text with a header, quoted as needed."""
    (df.write.mode(mode).option("sep", "\t").option("header", True).option("quoteAll", False)
     .option("escape", '"').csv(path))


def read_tsv(spark: SparkSession, path: str, schema: str | None = None, text_col: str | None = None,
             drop: tuple[str, ...] = ()) -> DataFrame:
    """Tab-separated scan (multi-line quoted fields); rows with a
    null text column dropped; named columns dropped when present.  With a
    schema (by position) files are split over tasks (see ``splits``); without
    one it is inferred, a task per file."""
    if schema:
        found = quoted_records(spark, path)
        header = found.groupBy("file").agg(F.min("at").alias("top"))
        record = F.regexp_replace("record", "\r$", "")
        rows = found.join(F.broadcast(header), "file").where((F.col("at") > F.col("top")) & (F.trim("record") != "")).select(F.from_csv(record, schema, {"sep": "\t", "escape": '"'}).alias("r"))
        df = rows.select("r.*")
    else:
        df = spark.read.option("sep", "\t").option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", True).csv(path)
    if text_col:
        df = df.where(F.col(text_col).isNotNull())
    return df.drop(*drop)


def export_filtered_csv(df: DataFrame, root: str, domain: str, mode: str = "overwrite") -> str:
    """Filtered export named ``kl_analysis_<domain lower, spaces -> _>``."""
    name = "kl_analysis_" + domain.lower().replace(" ", "_")
    path = f"{root.rstrip('/')}/{name}.csv"
    df.write.mode(mode).option("header", True).csv(path)
    return path


def flag(c) -> Column:
    """``x == 1`` as boolean, null -> false (accepts numbers, booleans and
    their string forms)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string").try_cast("double") == 1.0,
                      F.lower(c.cast("string")) == "true", F.lit(False))


def parse_list_string(c) -> Column:
    """A stringified list such as ``['a', 'b']`` -> array<string>; null
    when it does not parse (the row is then skipped downstream)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.from_json(F.translate(c, "'", '"'), "array<string>")
