"""Answers of search providers in their own shapes, mapped to one kind of row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import authority

# Where each shape of answer keeps its list, and the address, title and text of an entry.
SHAPES = {"organic": ("organic", "link", "title", "snippet"), "results": ("results", "url", "title", "content")}


def _entries(answer: Column, shape: str) -> Column:
    listed, url, title, text = SHAPES[shape]
    parsed = F.from_json(answer, f"`{listed}` array<struct<`{url}` string, `{title}` string, `{text}` string>>")[listed]
    return F.transform(parsed, lambda e: F.struct(F.coalesce(e[url], F.lit("")).alias("url"), F.coalesce(e[title], F.lit("")).alias("title"), F.coalesce(e[text], F.lit("")).alias("snippet")))


def response_rows(responses: DataFrame, answer: str, shape: str, *keep: str) -> DataFrame:
    """One row per entry of every answer: (kept columns, url, title, snippet, rank from 1, domain).

    ``answer``: JSON text; ``shape``: column that names its shape (``SHAPES``). Answers of another
    shape, broken ones and empty lists give no rows; what an entry lacks is ''.
    """
    found = F.lit(None).cast("array<struct<url string, title string, snippet string>>")
    for name in SHAPES:
        found = F.when(F.col(shape) == name, _entries(F.col(answer), name)).otherwise(found)
    rows = responses.select(*keep, F.posexplode(found).alias("_k", "_e"))
    return rows.select(*keep, "_e.url", "_e.title", "_e.snippet", (F.col("_k") + 1).alias("rank"), authority(F.col("_e.url")).alias("domain"))
