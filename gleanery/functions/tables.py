"""Table and scalar functions for SQL: the extension surface of the engine."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="position int, content string")
class ChunkWindows:
    """chunk_windows(text, size, overlap, least): windows of a text, for LATERAL joins in SQL."""

    def eval(self, text: str, size: int, overlap: int, least: int) -> Iterator[tuple]:
        from gleanery.operators.chunking import windows

        if text is not None:
            yield from enumerate(windows(text, size, overlap, least))


@udtf(returnType="position int, kind string, content string")
class PageBlocks:
    """page_blocks(html, least): blocks of a page, for LATERAL joins in SQL."""

    def eval(self, html: str, least: int) -> Iterator[tuple]:
        from gleanery.operators.parsing import blocks_of

        if html is not None:
            for k, (kind, text) in enumerate(blocks_of(html, least)):
                yield k, kind, text


# Scalar functions as SQL text over built-ins, so they are inlined and optimised.
_SQL = {
    "host_of(url string) returns string": r"coalesce(regexp_replace(lower(try_parse_url(url, 'HOST')), '^www[.]', ''), '')",
    "tokens_of(text string) returns bigint": "cast(ceil(char_length(text) / 4) as bigint)",
    "hybrid_score(v double, k double, t double) returns double": "0.7 * coalesce(v, 0) + 0.2 * coalesce(k, 0) + 0.1 * coalesce(t, 0)",
}


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to a session; gives their names."""
    spark.udtf.register("chunk_windows", ChunkWindows)
    spark.udtf.register("page_blocks", PageBlocks)
    for head, body in _SQL.items():
        spark.sql(f"create or replace temporary function {head} return {body}")
    return ["chunk_windows", "page_blocks", *[h.split("(")[0] for h in _SQL]]


def hash_vector(text: Column, size: int = 8) -> Column:
    """A vector of unit length from the first hex digits of a text's SHA-256: a stand-in for an embedding that needs no model."""
    digits = F.sha2(text, 256)
    raw = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda k: F.conv(F.substr(digits, k, F.lit(1)), 16, 10).cast("double") / 15)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def collection_name(prefix: str, version: int, name: str) -> str:
    """Name of a chunk collection by schema version (1 or 2), of letters, digits, _ and -, at most 512 long."""
    import re

    if version not in (1, 2):
        raise ValueError(f"unknown schema version {version}")
    return re.sub(r"[^A-Za-z0-9_\-]+", "_", f"{prefix}_v{version}_{name}").strip("_")[:512]
