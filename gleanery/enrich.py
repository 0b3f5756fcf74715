"""The steps from entities to ranked evidence as one class: give it a field and where results and documents come from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as fx
from gleanery.operators.chunking import flat_chunks
from gleanery.operators.rows import first_seen, top_k


class Enricher:
    """Evidence for one field of many entities. Subclasses set ``field`` and the templates, where {} stands for the entity's name.

    ``search``: from (entity_id, ordinal, query) to rows with entity_id, ordinal, url, title, snippet, rank.
    ``documents``: rows with url and text. ``chunker``: from (documents, url column, text column) to
    rows with document, index, content and chunk_id. Each step is a plan over all entities.
    """

    field = ""
    queries: tuple[str, ...] = ("{}",)
    asked = "{}"
    accepted = 0.55

    def __init__(self, search: Callable[[DataFrame], DataFrame], documents: DataFrame, chunker: Callable[[DataFrame, str, str], DataFrame] = flat_chunks):
        if not self.field:
            raise ValueError("an enricher needs a field")
        self.search, self.documents, self.chunker = search, documents, chunker

    def plans(self, entities: DataFrame) -> DataFrame:
        """Queries of every entity (entity_id, name) in order."""
        filled = F.array(*[F.replace(F.lit(q), F.lit("{}"), F.col("name")) for q in self.queries])
        return entities.select("entity_id", F.posexplode(filled).alias("ordinal", "query"))

    def results(self, entities: DataFrame, k: int = 5) -> DataFrame:
        """The k best results of every entity, each address the first time it comes."""
        found = first_seen(self.search(self.plans(entities)), ["entity_id", "url"], F.col("ordinal"), F.col("rank"))
        score = fx.search_score(F.col("name"), F.col("url"), F.col("title"), F.col("snippet"))
        return top_k(found.join(entities, "entity_id").withColumn("score", score), ["entity_id"], k, F.col("score").desc(), F.col("ordinal"), F.col("rank"), F.col("url"), name="place")

    def accepted_documents(self, entities: DataFrame) -> DataFrame:
        """Documents of the best results that match their entity well enough."""
        pages = self.results(entities).select("entity_id", "name", "url").join(self.documents.select("url", "text").where("text is not null").dropDuplicates(["url"]), "url")
        return pages.withColumn("entity_match", fx.entity_match(F.col("name"), F.col("text"))).where(F.col("entity_match") >= self.accepted)

    def evidence(self, entities: DataFrame, k: int = 5) -> DataFrame:
        """The k chunks of every entity's accepted documents that hold most words of the question: (entity_id, field, rank, url, chunk_id, content, score)."""
        pages = self.accepted_documents(entities)
        chunks = self.chunker(pages.select("url", "text").dropDuplicates(["url"]), "url", "text").withColumnRenamed("document", "url")
        question = F.replace(F.lit(self.asked), F.lit("{}"), F.col("name"))
        scored = pages.select("entity_id", "name", "url").join(chunks, "url").withColumn("score", fx.keyword_score(question, F.col("content")))
        best = top_k(scored, ["entity_id"], k, F.col("score").desc(), F.col("chunk_id"))
        return best.select("entity_id", F.lit(self.field).alias("field"), "rank", "url", "chunk_id", "content", "score")


class TableCache:
    """Values by key in a table of the shared folder: entries are added, the latest one that hasn't expired counts."""

    _SCHEMA = "key string, value string, set_us bigint, ttl_us bigint"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self._SCHEMA).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self._SCHEMA)

    def set(self, rows: DataFrame, now_us: int, ttl_us: int) -> None:
        """Add (key, value) rows that live ``ttl_us`` from now."""
        rows.select("key", "value", F.lit(now_us).cast("bigint").alias("set_us"), F.lit(ttl_us).cast("bigint").alias("ttl_us")).write.mode("append").parquet(self.path)

    def get(self, keys: DataFrame, now_us: int) -> DataFrame:
        """(key, value, age_us) of every key; value null where there is none or it has expired."""
        latest = self._rows().groupBy("key").agg(F.max_by(F.struct("value", "set_us", "ttl_us"), "set_us").alias("e"))
        live = latest.where(F.col("e.set_us") + F.col("e.ttl_us") >= now_us).select("key", "e.value", (F.lit(now_us) - F.col("e.set_us")).alias("age_us"))
        return keys.select("key").distinct().join(live, "key", "left")
