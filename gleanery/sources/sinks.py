"""Sinks: rows as JSON lines, traces as a timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, *partition: str) -> None:
    """Rows as JSON lines, nulls kept, below a path, optionally by partition."""
    writer = df.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*partition) if partition else writer).json(path)


def timeline(spans: DataFrame, trace: str, order: str, name: str, millis: str) -> DataFrame:
    """One numbered markdown line per span, joined in order: (trace, n_spans, total_ms, timeline). Spans of a trace are few."""
    line = F.struct(F.col(order).alias("o"), F.concat(F.lit("- "), F.col(name), F.lit(": "), F.col(millis).cast("string"), F.lit(" ms")).alias("t"))
    g = spans.groupBy(trace).agg(F.count("*").alias("n_spans"), F.round(F.sum(millis), 3).alias("total_ms"), F.array_sort(F.collect_list(line)).alias("l"))
    return g.select(trace, "n_spans", "total_ms", F.array_join(F.transform("l", lambda s: s["t"]), "\n").alias("timeline"))
