"""Cutting oversized texts and tables at topic boundaries found by lexical cohesion."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
#: Natural boundaries, strongest first: paragraph, line, sentence end, clause end, white space. A cut is made after the match.
_BREAKS = (
    (re.compile(r"\n[ \t\r]*\n\s*|\f"), 3.0),
    (re.compile(r"\n\s*|(?:</(?:p|li|tr|h\d|div)>|<br ?/?>)\s*"), 2.0),
    (re.compile(r"[.!?…。！？][\"')\]»”]*\s+|[。！？]"), 1.5),
    (re.compile(r"[;:,|]\s+"), 0.4),
)
_SPACE = re.compile(r"\s+")


def _joins(text: str, at: int) -> bool:
    """Whether a cut at this place would part a letter from its mark, or a joined or flag emoji."""
    if not 0 < at < len(text):
        return False
    c, before = text[at], text[at - 1]
    return unicodedata.combining(c) != 0 or c in "‍️‌" or before == "‍" or "\U0001f3fb" <= c <= "\U0001f3ff" or (before == "\r" and c == "\n")


def _cosine(a: Counter, b: Counter) -> float:
    if not a or not b:
        return 0.0
    dot = sum(n * b[w] for w, n in a.items() if w in b)
    return dot / math.sqrt(sum(n * n for n in a.values()) * sum(n * n for n in b.values()))


def valleys(blocks: list[Counter], k: int = 3) -> list[float]:
    """Depth of the similarity valley at each gap between neighbouring blocks.

    The similarity at a gap compares the k blocks before with the k after it; the two
    windows slide, so each step adds and takes away one block. The depth is how far the
    similarity climbs to the nearest peak on either side.
    """
    n = len(blocks)
    if n < 2:
        return []
    left, right = Counter(), Counter()
    for b in blocks[1 : 1 + k]:
        right.update(b)
    left.update(blocks[0])
    sims = []
    for gap in range(1, n):
        sims.append(_cosine(left, right))
        left.update(blocks[gap])
        if gap - k >= 0:
            left.subtract(blocks[gap - k])
            left = +left
        right.subtract(blocks[gap])
        right = +right
        if gap + k < n:
            right.update(blocks[gap + k])
    peak_left, peak_right = sims[:], sims[:]
    for i in range(1, len(sims)):
        peak_left[i] = max(sims[i], peak_left[i - 1]) if sims[i] <= sims[i - 1] else sims[i]
    for i in range(len(sims) - 2, -1, -1):
        peak_right[i] = max(sims[i], peak_right[i + 1]) if sims[i] <= sims[i + 1] else sims[i]
    return [a + b - 2 * s for a, b, s in zip(peak_left, peak_right, sims)]


def _boundaries(text: str) -> dict[int, float]:
    """Every natural place to cut, with the strength of its kind."""
    at: dict[int, float] = {}
    for pattern, strength in _BREAKS:
        for m in pattern.finditer(text):
            if m.end() < len(text) and not _joins(text, m.end()):
                at[m.end()] = max(at.get(m.end(), 0.0), strength)
    return at


def split_text(text: str, limit: int, overlap: int = 0, least: float = 0.4) -> list[tuple[int, int]]:
    """Pieces of a text as (start, end), each of at most ``limit`` code points.

    Consecutive pieces share exactly ``overlap`` code points, so the text is the first
    piece followed by every other piece without its first ``overlap`` characters. Each cut
    lies in the window from ``least`` of the limit to the limit: at the deepest valley among
    the ends of paragraphs, lines and sentences, the kind of boundary deciding between equal
    depths; where there are none, at a clause end, else at white space, else at the last
    place that parts no letter from its marks. An overlap that leaves no room for a new
    character (``overlap >= limit``) or is negative raises ValueError.
    """
    if limit < 1 or not 0 <= overlap < limit:
        raise ValueError(f"no pieces of {limit} characters share {overlap}")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    bounds = _boundaries(text)
    strong = sorted(p for p, s in bounds.items() if s >= 1.5)
    edges = [0, *strong, n]
    depth = dict(zip(strong, valleys([Counter(_WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])])))
    places = sorted(bounds)
    pieces, start, p = [], 0, 0
    while n - start > limit:
        high = start + limit
        low = start + max(overlap + 1, int(limit * least))
        while p < len(places) and places[p] < low:
            p += 1
        best, cut, q = None, 0, p
        while q < len(places) and places[q] <= high:
            x = places[q]
            score = (round(depth[x], 9) if x in depth else -1.0, bounds[x], x)
            if best is None or score > best:
                best, cut = score, x
            q += 1
        if best is None:
            spaces = [m.end() for m in _SPACE.finditer(text, low - 1, high) if m.end() >= low and not _joins(text, m.end())]
            cut = spaces[-1] if spaces else next((x for x in range(high, low, -1) if not _joins(text, x)), high)
        pieces.append((start, cut))
        start = cut - overlap
        while p and places[p - 1] >= start:
            p -= 1
    pieces.append((start, n))
    return pieces


def table_size(rows) -> int:
    """Characters of all cells plus one per cell; a null cell has no characters, a null row no cells."""
    return sum(len(c or "") + 1 for r in rows if r is not None for c in r)


def split_table(rows: list, limit: int, overlap: int = 0) -> list[list]:
    """Tables of whole rows, each within the limit, cut at the deepest valley of row similarity in each window.

    A row beyond the limit is cut between cells, a cell beyond it like a text. Cells keep
    their order, and no row, cell or null is lost. Consecutive tables share the last rows
    of the first, as many as come to at most ``overlap`` and leave room for another row.
    An overlap that is negative or not below the limit raises ValueError.
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError(f"no tables of {limit} characters share {overlap}")
    units: list = []
    for r in rows:
        if r is None or table_size([r]) <= limit:
            units.append(r)
            continue
        part: list = []
        for c in r:
            bits = [c] if len(c or "") < limit else [c[a:b] for a, b in split_text(c, limit - 1)]
            for bit in bits:
                if part and table_size([part]) + len(bit or "") + 1 > limit:
                    units.append(part)
                    part = []
                part.append(bit)
        units.append(part)
    shapes = [Counter(w for c in (r or []) for w in (re.sub(r"\d", "0", t) for t in _WORD.findall((c or "").lower()))) for r in units]
    depth = [0.0, *valleys(shapes)]
    sizes = [table_size([r]) for r in units]
    out, start, fresh = [], 0, 0  # fresh: the first row not yet in a table
    while fresh < len(units):
        end, size = start, 0
        while end < len(units) and size + sizes[end] <= limit:
            size += sizes[end]
            end += 1
        if end < len(units):
            low = max(fresh + 1, start + max(1, int((end - start) * 0.4)))
            end = max(range(low, end + 1), key=lambda i: (round(depth[i], 9), i)) if low < end else end
        out.append(units[start:end])
        start = fresh = end
        if fresh < len(units):
            shared = 0
            while overlap and start > 0 and shared + sizes[start - 1] <= min(overlap, limit - sizes[fresh]) and len(out[-1]) > fresh - start + 1:
                start -= 1
                shared += sizes[start]
    return out


def _pieces(limits: dict[str, tuple[int, int]]):
    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for kind, item, text, data in zip(pdf["item_kind"], pdf["item_id"], pdf["content"], pdf["table_data"]):
                limit, overlap = limits[kind]
                if text is not None:
                    rows += [(kind, item, k, text[a:b], None, a, b - a) for k, (a, b) in enumerate(split_text(text, limit, overlap))]
                else:
                    cells = [None if r is None else [None if c is None else str(c) for c in r] for r in data]
                    rows += [(kind, item, k, None, t, None, table_size(t)) for k, t in enumerate(split_table(cells, limit, overlap))]
            yield pd.DataFrame(rows, columns=["item_kind", "item_id", "piece_no", "content", "table_data", "start_char", "n_chars"]).astype({"start_char": "Int64"})

    return run


PIECES = "item_kind string, item_id string, piece_no int, content string, table_data array<array<string>>, start_char bigint, n_chars bigint"


def split_oversized(sources: list[tuple[DataFrame, str, str, str]], limits: dict[str, tuple[int, int]]) -> DataFrame:
    """Pieces of every item beyond the limit of its kind.

    ``sources``: (table, kind of item, id column, content or table column); the column may
    be a string or an array of arrays of strings. ``limits``: kind to (largest size,
    overlap). Items within their limit, null and empty ones give no rows. Copies under one
    id count once; of different contents under one id any one counts. Rows with a null id
    are kept as one item per kind. Texts share exactly the overlap, tables whole rows within it.
    The JVM measures sizes and passes only oversized items on to Python.
    """
    parts = []
    for df, kind, key, column in sources:
        c = F.col(column)
        if df.schema[column].dataType.typeName() == "array":
            cell = lambda a, x: a + F.char_length(F.coalesce(x, F.lit(""))) + F.lit(1)
            size = F.aggregate(c, F.lit(0), lambda a, r: a + F.coalesce(F.aggregate(r, F.lit(0), cell), F.lit(0)))
            text, data = F.lit(None).cast("string"), c.cast("array<array<string>>")
        else:
            size, text, data = F.char_length(c), c.cast("string"), F.lit(None).cast("array<array<string>>")
        big = df.where(size > limits[kind][0])
        parts.append(big.select(F.lit(kind).alias("item_kind"), F.col(key).cast("string").alias("item_id"), text.alias("content"), data.alias("table_data")))
    items = reduce(DataFrame.unionByName, parts).dropDuplicates(["item_kind", "item_id"])
    return items.mapInPandas(_pieces(limits), PIECES)
