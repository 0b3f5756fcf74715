"""Texts and sections to chunks. Windows and packing depend on what came before, so they run per document in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.text import short_id
from gleanery.operators.rows import closure


def _stretch(text: str, at: int, size: int) -> int:
    """End of a stretch of at most ``size`` characters: the last space within it, else its full length."""
    full = at + size
    if full >= len(text):
        return len(text)
    space = text.rfind(" ", at + 1, full)
    return full if space < 0 else space


def windows(text: str, size: int = 1500, overlap: int = 200, least: int = 80) -> Iterator[str]:
    """Windows of a text that end at a space where they can, each beginning ``overlap`` before the end of the last.

    Stripped windows below ``least`` are left out. A window always begins after the one
    before, also where its only space stands near its start.
    """
    begin = end = 0
    while end < len(text):
        end = _stretch(text, begin, size)
        if len(piece := text[begin:end].strip()) >= least:
            yield piece
        begin = end - overlap if end - overlap > begin else end


def parts(text: str, size: int) -> Iterator[str]:
    """Parts of at most ``size`` characters that end at a space where they can, without overlap."""
    yield from windows(text, size, overlap=0, least=1)


def _chunker(size, overlap, least, table_size):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for u, kind, text in zip(*(b.column(k).to_pylist() for k in range(3))):
                if kind == "table":
                    whole = [text.strip()] if len(text) <= table_size else list(parts(text, table_size))
                    found = [p for p in whole if len(p) >= least]
                else:
                    found = windows(text, size, overlap, least)
                rows += [(u, k, p, "table" if kind == "table" else "text") for k, p in enumerate(found)]
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string())], names=["document", "index", "content", "chunk_type"])

    return run


def flat_chunks(docs: DataFrame, document: str, text: str, kind=None, size: int = 1500, overlap: int = 200, least: int = 80, table_size: int = 4000) -> DataFrame:
    """Chunks of every document or block: (document, index, content, chunk_type, chunk_id). Tables stay whole up to ``table_size`` and are cut without overlap beyond it."""
    k = F.lit("text") if kind is None else (F.col(kind) if isinstance(kind, str) else kind)
    rows = docs.where(F.col(text).isNotNull()).select(F.col(document).cast("string"), k.cast("string"), F.col(text))
    out = rows.mapInArrow(_chunker(size, overlap, least, table_size), "document string, index int, content string, chunk_type string")
    return out.withColumn("chunk_id", short_id(F.col("document"), F.col("index").cast("string"), F.sha2("content", 256)))


def pack(sizes: list[int], target: int, most: int) -> list[int]:
    """Pack number of every size in order: a pack is closed before it would exceed ``most`` and once it has ``target``."""
    out, number, used, empty = [], 0, 0, True
    for s in sizes:
        if not empty and used + s > most:
            number, used, empty = number + 1, 0, True
        out.append(number)
        used, empty = used + s, False
        if used >= target:
            number, used, empty = number + 1, 0, True
    return out


def section_chunks(blocks: DataFrame, keys: list[str], order: str, content: str, kind: str, path: str, target: int = 400, most: int = 800, summary: int = 200) -> DataFrame:
    """Chunks of every section: a summary of its first ``summary`` tokens, tables whole, texts packed in order.

    A section's blocks are gathered per section (keys), which is bounded by a page's own
    size; blocks without a document (a null first key) belong to none and are sections of
    their own. Token counts are a quarter of the characters, rounded down. Chunks begin with
    the heading path.
    """

    def run(key, table):
        import pyarrow as pa

        d = table.sort_by(order).to_pydict()
        head = d[path][0].replace("|", " > ") + "\n\n" if d[path] and d[path][0] else ""
        texts = [t or "" for t in d[content]]
        out = [("section_summary", head + "\n\n".join(texts)[: 4 * summary + 3])] if any(texts) else []
        waiting: list[str] = []

        def flush():
            if waiting:
                for n in dict.fromkeys(packs := pack([len(t) // 4 for t in waiting], target, most)):
                    out.append(("content", head + "\n\n".join(t for t, p in zip(waiting, packs) if p == n)))
                waiting.clear()

        for t, k in zip(texts, d[kind]):
            if k == "table":
                flush()
                if t.strip():
                    out.append(("table", t))
            elif t:
                waiting.append(t)
        flush()
        n = len(out)
        names = [*keys, "ordinal", "chunk_role", "content", "token_count"]
        arrays = [pa.array([k.as_py()] * n, pa.string()) for k in key[: len(keys)]] + [pa.array(range(n), pa.int32()), pa.array([r for r, _ in out], pa.string()), pa.array([c for _, c in out], pa.string()), pa.array([len(c) // 4 for _, c in out], pa.int32())]
        return pa.Table.from_arrays(arrays, names=names)

    own = F.when(F.col(keys[0]).isNull(), F.xxhash64(order, content)).otherwise(F.lit(0)).alias("_own")
    rows = blocks.select(*[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys], own, order, content, kind, path)
    shape = ", ".join(f"`{k}` string" for k in keys) + ", ordinal int, chunk_role string, content string, token_count int"
    return rows.groupBy(*keys, "_own").applyInArrow(run, shape)


def section_walk(nodes: DataFrame) -> DataFrame:
    """Sections of every document in pre-order: (document_url, section_id, walk, depth, n_own, n_children, navigation_hash).

    ``nodes``: document_url, section_id, parent, first (place of its first block), path, n_own. A
    section comes before those below it, these in the order of their places: the list of the
    places of a section's ancestors, itself last, sorts that way. It is made from the closure of
    the tree, so no step goes from node to node. A parent that is no section of the document
    makes its child a root; the sections of a cycle are in no walk. The navigation text is the
    heading path and the headings of the children, here as a hash.
    """
    own = nodes.select("document_url", "section_id", "first", "path", "n_own", "parent")
    known = own.select("document_url", F.col("section_id").alias("parent"), F.lit(True).alias("_known"))
    tree = own.join(known, ["document_url", "parent"], "left").withColumn("parent", F.when(F.col("_known") & (F.col("parent") != F.col("section_id")), F.col("parent"))).drop("_known")
    pairs = closure(tree, ["document_url"], "section_id", "parent")
    depth = pairs.groupBy("document_url", F.col("descendant").alias("section_id")).agg((F.count("*") - 1).cast("int").alias("depth"))
    above = pairs.join(depth.withColumnRenamed("section_id", "ancestor").withColumnRenamed("depth", "_d"), ["document_url", "ancestor"]).join(own.select("document_url", F.col("section_id").alias("ancestor"), F.col("first").alias("_f")), ["document_url", "ancestor"])
    place = above.groupBy("document_url", F.col("descendant").alias("section_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_f"))), lambda x: x["_f"]).alias("_place"))  # as long as the tree is deep
    heading = F.coalesce(F.nullif(F.element_at(F.split("path", r"\|"), -1), F.lit("")), F.col("section_id"))
    heads = tree.where("parent is not null").groupBy("document_url", F.col("parent").alias("section_id")).agg(F.count("*").alias("n_children"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", heading.alias("h")))), lambda x: F.concat(F.lit("• "), x["h"])), "\n").alias("_heads"))
    prefix = F.when(F.coalesce("path", F.lit("")) != "", F.concat(F.replace("path", F.lit("|"), F.lit(" > ")), F.lit("\n\n"))).otherwise("")
    out = own.join(place, ["document_url", "section_id"]).join(depth, ["document_url", "section_id"]).join(heads, ["document_url", "section_id"], "left")
    walk = F.row_number().over(Window.partitionBy("document_url").orderBy("_place"))
    return out.select("document_url", "section_id", walk.alias("walk"), "depth", "n_own", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.md5(F.concat(prefix, F.col("_heads")).cast("binary")).alias("navigation_hash"))


def reassemble(chunks: DataFrame, document: str, order: str, content: str) -> DataFrame:
    """The chunks of every document in order, joined by a blank line, with their number."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, content))), lambda s: s[content])
    return chunks.groupBy(document).agg(F.count("*").alias("n_chunks"), F.array_join(listed, "\n\n").alias("text"))
