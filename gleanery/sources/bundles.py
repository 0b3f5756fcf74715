"""Recorded runs: one JSON object per file with search results, documents, reports and a synthesis."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLAIM = "field_name string, candidate_value string, supporting_excerpt string, source_url string, source_title string, analysis_confidence double, source_authority_score double, freshness_score double, entity_match_score double"
SCHEMA = (
    "search_results array<struct<url string, title string, snippet string, provider string, rank int, domain string, source_tier string>>, "
    "parsed_documents array<struct<url string, title string, content_type string, text string, excerpt string, document_type string, entity_match_score double, source_authority_score double, freshness_score double, accepted_for_analysis boolean, rejection_reason string>>, "
    f"analysis_reports array<struct<source_url string, reasoning string, claims array<struct<{_CLAIM}>>>>, "
    "synthesis struct<value string, normalized_value string, reasoning string, synthesis_confidence double, supporting_urls array<string>, conflicts array<struct<field_name string, candidate_values array<string>, source_urls array<string>, reason string>>>"
)


def read_bundles(spark: SparkSession, path: str) -> DataFrame:
    """The bundles below a path, each with its name; a fixed schema, so no pass to infer one. Unreadable files give null columns."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("bundle", F.regexp_extract(F.input_file_name(), r"([^/]+?)\.json$", 1))


def bundle_names(spark: SparkSession, path: str) -> DataFrame:
    """Names of the bundles in order, from the listing alone."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+?)\.json$", 1).alias("bundle")).orderBy("bundle")


def bundle_path(folder: str, entity_id: str, field: str, explicit: str | None = None) -> str:
    """An explicit path, else the bundle of the entity and field."""
    return explicit or f"{folder.rstrip('/')}/{entity_id}_{field}.json"


def search_rows(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.posexplode("search_results").alias("ordinal", "r")).select("bundle", "ordinal", "r.*")


def document_rows(bundles: DataFrame) -> DataFrame:
    return bundles.select("bundle", F.posexplode("parsed_documents").alias("ordinal", "r")).select("bundle", "ordinal", "r.*")


def claim_rows(bundles: DataFrame) -> DataFrame:
    """Claims of accepted documents: of each document the first report of its address; documents without one have none."""
    reports = bundles.select("bundle", F.posexplode("analysis_reports").alias("report", "r"))
    first = reports.groupBy("bundle", F.col("r.source_url").alias("url")).agg(F.min_by("r.claims", "report").alias("claims"))
    accepted = document_rows(bundles).where("accepted_for_analysis").select("bundle", "ordinal", "url")
    return accepted.join(first, ["bundle", "url"]).select("bundle", "ordinal", F.posexplode("claims").alias("claim", "c")).select("bundle", "ordinal", "claim", "c.*")


def synthesis_rows(bundles: DataFrame) -> DataFrame:
    return bundles.where("synthesis is not null").select("bundle", "synthesis.*")


def read_context(spark: SparkSession, manifest: DataFrame, folder: str, budget: int) -> DataFrame:
    """Files named by a manifest (stage, priority, file), each with what its stage's budget of characters leaves for it.

    Files are read whole; of a file beyond the budget only the beginning is taken, without
    blanks at its end. Files that are missing have no row.
    """
    from gleanery.operators.rows import within_budget

    files = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("file"), F.trim("value").alias("text"))
    rows = manifest.join(files, "file").withColumn("n_chars", F.char_length("text").cast("bigint"))
    spent = within_budget(rows, ["stage"], ["priority", "file"], "n_chars", budget)
    return spent.where("taken > 0").select("stage", "priority", "file", F.rtrim(F.left("text", F.col("taken").cast("int"))).alias("text"), "used_before", "budget_left")
