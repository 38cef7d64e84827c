"""Topic-mixture divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.functions.divergence import kl_divergence


def domain_mean_topics(content: DataFrame, k: int) -> DataFrame:
    """Element-wise mean distribution per domain.  Exploding to
    (domain, topic) keeps the aggregate partial (map-side) for hot domains."""
    x = content.select(F.explode("domains").alias("domain"), F.posexplode("topic_dist").alias("topic", "prob"))
    return x.groupBy("domain", "topic").agg(F.avg("prob").alias("mean_prob"))


def domain_mean_vectors(content: DataFrame, k: int) -> DataFrame:
    m = domain_mean_topics(content, k)
    return m.groupBy("domain").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("topic", "mean_prob"))), lambda s: s["mean_prob"]).alias("domain_avg"))


def kl_content_vs_domain(content: DataFrame, k: int) -> DataFrame:
    """M6: one row per (content, domain): KL(content mixture || domain mean),
    votes clamped at 0 (P6).  The domain-mean table has one row per domain;
    it joins on the domain key after the explode (J6)."""
    avg = domain_mean_vectors(content, k)
    x = content.select("*", F.explode("domains").alias("domain"))
    j = x.join(avg, "domain", "inner")
    return j.select(
        "title", "id", "domain",
        kl_divergence("topic_dist", "domain_avg").alias("kl_divergence"),
        "user",
        F.greatest(F.col("votes"), F.lit(0)).alias("votes"),
        "n_comments", "depth",
    )
