"""The stateless part of the pipeline (cleaning T1-T8, tokens T10-T13,
minimum-content filter T17, domain classification D2-D5) applied to a file
stream: the same column expressions as the batch plans, so a stream and a
batch read of the same files give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import text as T
from agora.operators import domains as D

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def cleaned_documents(spark: SparkSession, path: str, schema: str = DOC_SCHEMA,
                      max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    s = reader.parquet(path)
    toks = T.analysis_tokens("text")
    return s.select(
        "doc_id",
        T.clean_text("text").alias("clean"),
        toks.alias("tokens"),
        D.domains_by_content(F.lit(""), F.col("text")).alias("domains"),
    ).where(F.size("tokens") >= 5)


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Process everything available (``availableNow``) into a parquet sink.
    ``checkpoint`` is the query's own folder on shared storage: a restart with
    the same folder resumes where the query ended, exactly once."""
    q = (stream.writeStream.format("parquet").option("path", sink_path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
