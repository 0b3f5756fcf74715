"""Agreement, conflict and confidence over claims of one entity and field."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the parts of a confidence; fixed values, of 90 in all.
WEIGHTS = {"authority": 20, "freshness": 12, "agreement": 20, "relevance": 12, "analysis": 16, "synthesis": 10}


def agreement(claims: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Share of the most frequent value among the values that are not empty: two small aggregations, no window."""
    counts = claims.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    return counts.groupBy(*keys).agg((F.max("_n") / F.sum("_n")).alias("agreement"), F.sum("_n").alias("n_values"), F.count("*").alias("n_distinct"))


def conflicts(claims: DataFrame, keys: list[str], value: str, url: str, order: str) -> DataFrame:
    """Keys with more than one value: the values in the order first seen, and the number of addresses.

    Values are reduced to one row each before they are gathered, so an array holds different
    values only, however many claims there are.
    """
    seen = claims.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.min(order).alias("_first"))
    urls = claims.groupBy(*keys).agg(F.count_distinct(url).alias("n_urls"))
    many = seen.groupBy(*keys).agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(F.struct("_first", value))).alias("_v")).where("n_values > 1")
    listed = many.select(*keys, "n_values", F.array_join(F.transform("_v", lambda s: s[value]), "; ").alias("candidate_values"))
    return listed.join(urls, keys)


def confidence(claims: DataFrame, synthesis: DataFrame, keys: list[str]) -> DataFrame:
    """Overall confidence per key: weighted means of the claims' scores, their agreement and the synthesis; without claims at most 0.2.

    Null and non-finite scores are left out of the means, a mean of nothing is 0.
    """
    from gleanery.functions.text import finite

    means = claims.groupBy(*keys).agg(
        F.count("*").alias("n_claims"),
        *[F.coalesce(F.avg(finite(F.col(c))), F.lit(0.0)).alias(name) for name, c in (("authority", "source_authority_score"), ("freshness", "freshness_score"), ("relevance", "entity_match_score"), ("analysis", "analysis_confidence"))],
    )
    agreed = agreement(claims, keys, "candidate_value").select(*keys, "agreement")
    rows = synthesis.join(means.join(agreed, keys, "left"), keys, "left")
    own = F.coalesce(finite(F.col("synthesis_confidence")), F.lit(0.0))
    parts = {**{c: F.coalesce(c, F.lit(0.0)) for c in ("authority", "freshness", "agreement", "relevance", "analysis")}, "synthesis": own}
    total = sum(parts[c] * w for c, w in WEIGHTS.items()) / sum(WEIGHTS.values())
    return rows.select(*keys, F.coalesce("n_claims", F.lit(0)).alias("n_claims"), F.round(F.when(F.col("n_claims") > 0, total).otherwise(F.least(own, F.lit(0.2))), 4).alias("confidence"))
