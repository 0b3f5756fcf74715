"""Search providers as a Python data source, and configuration by priority."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class OfflineSearch(DataSource):
    """Search results without a network, each derived from a hash of the query: the interface that a live provider fills.

    Options: ``queries`` (one a line; each is a partition), ``results`` (per query, 8 unless given), ``provider``.
    """

    @classmethod
    def name(cls) -> str:
        return "offline_search"

    def schema(self) -> str:
        return "query string, url string, title string, snippet string, provider string, rank int"

    def reader(self, schema) -> DataSourceReader:
        return _OfflineReader(self.options)


class _OfflineReader(DataSourceReader):
    def __init__(self, options: dict):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.results, self.provider = int(options.get("results", "8")), options.get("provider", "offline")

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries] or [_Query("")]

    def read(self, partition: _Query) -> Iterator[tuple]:
        for k in range(self.results if partition.query else 0):
            h = hashlib.sha256(f"{partition.query}|{k}".encode()).hexdigest()
            yield partition.query, f"https://www.{h[:8]}.example/{h[8:14]}", f"{partition.query} {h[14:20]}", f"About {partition.query}: {h[20:30]}", self.provider, k + 1


def by_priority(settings: DataFrame, key: str, value: str, priority: str) -> DataFrame:
    """Every setting's value from the source of highest priority (smallest number) that has one; empty values don't count."""
    own = F.nullif(F.col(value), F.lit(""))
    return settings.where(own.isNotNull()).groupBy(key).agg(F.min_by(value, priority).alias(value))
