"""Pages to blocks and blocks to sections."""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SCRIPT = re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.S | re.I)
_BREAK = re.compile(r"</?(?:p|div|br|li|ul|ol|section|article|header|footer|blockquote|pre|hr)\b[^>]*>", re.I)
_TAG = re.compile(r"<[^>]+>")
_STRUCTURE = re.compile(r"(?P<table><table\b.*?</table>)|(?P<heading><h[1-6]\b[^>]*>.*?</h[1-6]>)", re.S | re.I)
_ROW, _CELL = re.compile(r"<tr\b[^>]*>(.*?)</tr>", re.S | re.I), re.compile(r"<t[dh]\b[^>]*>(.*?)</t[dh]>", re.S | re.I)
_BARRED, _TABBED, _RULE = re.compile(r"^\|[^\n]+\|", re.M), re.compile(r"^[^\n]+\t[^\n]", re.M), re.compile(r"^[ \t]*[|:\-][|: \-]*$", re.M)


def _flat(fragment: str) -> str:
    return " ".join(_TAG.sub(" ", fragment).split())


def _paragraphs(fragment: str) -> list[str]:
    """Paragraphs of a stretch without tables and headings: block tags and line ends part them."""
    text = html.unescape(_TAG.sub(" ", _BREAK.sub("\n\n", fragment)))
    lines = (re.sub(r" {2,}", " ", x).strip() for x in text.splitlines())
    return [x for x in lines if x]


def table_text(fragment: str) -> str:
    """Rows of a table on lines of their own, cells parted by bars; its plain text where it has no rows."""
    rows = [" | ".join(_flat(c) for c in _CELL.findall(r)) for r in _ROW.findall(fragment)]
    return "\n".join(r for r in rows if r) or _flat(fragment)


def text_kind(text: str) -> str:
    """table for text with two barred lines, two tabbed lines, or a barred line and a rule; the same as ``text_table_kind`` says of a column."""
    barred = len(_BARRED.findall(text))
    return "table" if barred >= 2 or len(_TABBED.findall(text)) >= 2 or (barred and _RULE.search(text)) else "text"


def blocks_of(body: str, least: int = 80) -> Iterator[tuple[str, str]]:
    """(kind, text) of the blocks of a page in order: tables and headings as they stand, paragraphs joined until they have ``least`` characters.

    Tables hold their headings; a heading inside a table is part of it.
    """
    pending: list[str] = []

    def flush():
        if pending:
            text = "\n\n".join(pending)
            pending.clear()
            yield text_kind(text), text

    def stretch(fragment):
        for p in _paragraphs(fragment):
            pending.append(p)
            if sum(map(len, pending)) + 2 * (len(pending) - 1) >= least:
                yield from flush()
        yield from flush()

    body, at = _SCRIPT.sub(" ", body), 0
    for m in _STRUCTURE.finditer(body):
        yield from stretch(body[at : m.start()])
        kind = m.lastgroup
        text = table_text(m.group()) if kind == "table" else _flat(m.group())
        if text:
            yield kind, text
        at = m.end()
    yield from stretch(body[at:])


def extract_blocks(pages: DataFrame, url: str, body: str, least: int = 80) -> DataFrame:
    """Blocks of every page: (url, position, block_type, content). The fold over paragraphs is sequential, so it runs per page in Arrow batches; null bodies give none."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(u, k, kind, text) for u, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for k, (kind, text) in enumerate(blocks_of(t, least))]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["url", "position", "block_type", "content"])

    rows = pages.where(F.col(body).isNotNull()).select(F.col(url).cast("string").alias("url"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "url string, position int, block_type string, content string")


def section_ordinals(blocks: DataFrame, url: str = "url", position: str = "position", kind: str = "block_type") -> DataFrame:
    """Section of every block: 0 before the first heading, then one more at each heading; a running count in one sort per page."""
    run = Window.partitionBy(url).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    return blocks.withColumn("section", F.sum(F.when(F.col(kind) == "heading", 1).otherwise(0)).over(run))


def section_tree(blocks: DataFrame) -> DataFrame:
    """Sections of every page with their id, heading, level and number of blocks; the root holds what stands before the first heading."""
    from gleanery.functions.text import short_id

    own = section_ordinals(blocks)
    heading = F.max(F.when(F.col("block_type") == "heading", F.col("content")))
    out = own.groupBy("url", "section").agg(heading.alias("heading"), F.count(F.when(F.col("block_type") != "heading", 1)).alias("n_blocks"), F.min("position").alias("first_position"))
    return out.select("url", "section", "heading", F.when(F.col("section") == 0, 0).otherwise(1).alias("level"), "n_blocks", short_id(F.col("url"), F.col("section").cast("string"), F.coalesce("heading", F.lit(""))).alias("section_id"))


def html_blocks(body: str) -> Iterator[tuple[str, str]]:
    return blocks_of(body)


def plain_blocks(body: str, least: int = 80) -> Iterator[tuple[str, str]]:
    """Blocks of a text without markup: paragraphs parted by empty lines, joined until they have ``least`` characters."""
    pending: list[str] = []
    for p in (x.strip() for x in re.split(r"\n\s*\n", body)):
        if p:
            pending.append(p)
            if sum(map(len, pending)) + 2 * (len(pending) - 1) >= least:
                text = "\n\n".join(pending)
                yield text_kind(text), text
                pending = []
    if pending:
        text = "\n\n".join(pending)
        yield text_kind(text), text


#: Parser by type of content; the longest name that a type begins with counts, "" any type.
PARSERS: dict[str, Callable[[str], Iterator[tuple[str, str]]]] = {"text/html": html_blocks, "application/xhtml": html_blocks, "": plain_blocks}


def register_parser(content_type: str, parser: Callable[[str], Iterator[tuple[str, str]]]) -> None:
    """Let a function from text to (kind, text) blocks read a type of content, from now on in this process."""
    PARSERS[content_type.lower()] = parser


def parse_documents(pages: DataFrame, key: str, content_type: str, body: str) -> DataFrame:
    """Blocks of documents by the parser their type selects: (key, parser, position, block_type, content).

    The parsers known when this is called go to the tasks. Null bodies give no blocks; a
    parser that fails gives one block of the kind "error" with its message, and the
    other documents go on.
    """
    parsers = dict(PARSERS)
    names = sorted(parsers, key=len, reverse=True)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, m, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                name = next((n for n in names if m.startswith(n)), None)
                try:
                    found = list(parsers[name](t)) if name is not None else []
                except Exception as e:  # noqa: BLE001
                    found = [("error", f"{type(e).__name__}: {e}")]
                rows += [(i, name, k, kind, text) for k, (kind, text) in enumerate(found)]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()))], names=["id", "parser", "position", "block_type", "content"])

    from gleanery.functions.text import mime

    rows = pages.where(F.col(body).isNotNull()).select(F.col(key).cast("string").alias("id"), mime(F.col(content_type)).alias("mime"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "id string, parser string, position int, block_type string, content string").withColumnRenamed("id", key)
