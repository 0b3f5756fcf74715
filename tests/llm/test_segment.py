import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import segment


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé .\ń😀|,", max_size=900), st.integers(20, 200), st.integers(0, 30))
def test_pieces_make_up_the_text(text, limit, overlap):
    overlap = min(overlap, limit - 1)
    got = segment.split_text(text, limit, overlap)
    assert all(b - a <= limit for a, b in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    assert all(c == b - overlap and d > b for (_, b), (c, d) in zip(got, got[1:]))


cells = st.one_of(st.none(), st.text(alphabet="ab ", max_size=60))
tables = st.lists(st.one_of(st.none(), st.lists(cells, max_size=5)), max_size=30)


@settings(max_examples=150, deadline=None)
@given(tables, st.integers(20, 120))
def test_table_pieces_keep_every_cell(rows, limit):
    got = segment.split_table(rows, limit)
    assert all(segment.table_size(t) <= limit for t in got)
    flat = lambda t: "".join(c for r in t if r is not None for c in r if c)
    assert "".join(flat(t) for t in got) == flat(rows)
    if all(segment.table_size([r]) <= limit for r in rows):
        assert [r for t in got for r in t] == rows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet="ab", max_size=9), max_size=4), max_size=30), st.integers(20, 80), st.integers(0, 79))
def test_tables_share_rows_within_the_overlap(rows, limit, overlap):
    overlap = min(overlap, limit - 1)
    rows = [[f"{k}", *r][:3] for k, r in enumerate(rows)]  # each row is told by its first cell and within the limit or cut
    if any(segment.table_size([r]) > limit for r in rows):
        return
    got = segment.split_table(rows, limit, overlap)
    at = 0
    for k, t in enumerate(got):
        start = int(t[0][0]) if t else 0
        assert segment.table_size(t) <= limit and t == rows[start : start + len(t)] and start <= at < start + len(t)
        assert segment.table_size(rows[start:at]) <= overlap
        at = start + len(t)
    assert at == len(rows)


@pytest.mark.parametrize("limit,overlap", [(10, 10), (10, 11), (10, -1), (0, 0)])
def test_impossible_overlaps_raise(limit, overlap):
    with pytest.raises(ValueError):
        segment.split_text("x" * 50, limit, overlap)
    with pytest.raises(ValueError):
        segment.split_table([["x"] * 50], limit, overlap)


def test_cuts_are_at_the_deepest_valley(spark, sf):
    """Over the pieces of all tables: limit, overlap, text restored, and the share of cuts at the deepest valley of their window."""
    from gleanery.llm.queries import QUERIES
    from gleanery.sources.tables import table

    limits = {r.item_kind: (r.max_chars, r.overlap_chars) for r in table(spark, sf, "size_limits").collect()}
    texts = {("chunk_content", r.chunk_id): r.content for r in table(spark, sf, "chunks").select("chunk_id", "content").collect()} | {("block_content", r.block_id): r.content for r in table(spark, sf, "content_blocks").select("block_id", "content").collect()}
    pieces: dict = {}
    for r in QUERIES["p2_pieces"](spark, sf).where("content is not null").collect():
        pieces.setdefault((r.item_kind, r.item_id), []).append(r)
    cuts = deepest = 0
    for key, rows in pieces.items():
        rows.sort(key=lambda r: r.piece_no)
        text, (limit, overlap) = texts[key], limits[key[0]]
        assert rows[0].content + "".join(r.content[overlap:] for r in rows[1:]) == text and all(len(r.content) <= limit for r in rows)
        strong = sorted(p for p, s in segment._boundaries(text).items() if s >= 1.5)
        edges = [0, *strong, len(text)]
        depth = dict(zip(strong, segment.valleys([segment.Counter(segment._WORD.findall(text[a:b].lower())) for a, b in zip(edges, edges[1:])])))
        for r in rows[:-1]:
            own = [round(d, 9) for p, d in depth.items() if r.start_char + max(overlap + 1, int(limit * 0.4)) <= p <= r.start_char + limit]
            if own:
                cuts += 1
                deepest += round(depth.get(r.start_char + r.n_chars, -1), 9) == max(own)
    assert cuts and deepest >= 0.95 * cuts


def test_cut_at_the_topic_boundary():
    cats = "The cat sat near the other cat. A cat likes the cat food. Every cat sleeps. "
    ships = "Ships sail the sea. The sea carries ships far. Old ships rest by the sea. "
    text = cats * 2 + ships * 2
    (a, b), *_ = segment.split_text(text, len(cats) * 3)
    assert b == len(cats) * 2


def test_marks_stay_with_their_letters():
    text = "é" * 100
    assert all(text[b : b + 1] != "́" for _, b in segment.split_text(text, 51))


def test_operator(spark):
    a = spark.createDataFrame([("a", "x " * 100, None, 1), ("a", "x " * 100, None, 1), ("b", None, None, 2), ("c", "", None, 3), ("d", "y" * 50_000, None, 4), (None, "z" * 150, None, 5)], "id string, content string, table_data array<array<string>>, piece_no int")
    t = spark.createDataFrame([("t", [["a" * 30, None], None, ["b" * 90]]), ("s", [["x"]]), ("e", []), ("n", None)], "id string, table_data array<array<string>>")
    got = segment.split_oversized([(a, "text", "id", "content"), (t, "table", "id", "table_data")], {"text": (100, 10), "table": (60, 0)})
    rows = got.collect()
    assert {(r.item_kind, r.item_id) for r in rows} == {("text", "a"), ("text", "d"), ("text", None), ("table", "t")}
    assert all(r.n_chars <= (100 if r.item_kind == "text" else 60) for r in rows)
    own = sorted((r for r in rows if r.item_id == "d"), key=lambda r: r.piece_no)
    assert own[0].content + "".join(r.content[10:] for r in own[1:]) == "y" * 50_000
    assert segment.split_oversized([(a.limit(0), "text", "id", "content")], {"text": (100, 10)}).count() == 0


@pytest.mark.parametrize("rows,size", [([], 0), ([["ab", None]], 4), ([None, ["x"]], 2), ([[]], 0)])
def test_table_size(rows, size):
    assert segment.table_size(rows) == size
