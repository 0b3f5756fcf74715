import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.operators import chunking, claims, parsing, retrieval, rows


def out(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_once_and_first_seen(spark):
    d = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (2, "a", 1), (3, None, 2)], "id int, k string, o int")
    assert rows.once(d, "id", "k").count() == 3
    assert out(rows.first_seen(d, ["k"], F.col("o"), F.col("id")).select("k", "id")) == [(None, 3), ("a", 2)]
    assert rows.first_seen(d.limit(0), ["k"], F.col("o")).count() == 0


def test_as_of_equals_brute_force(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("ab"), rng.randint(0, 20)) for i in range(60)]
    right = [(rng.choice("ab"), rng.randint(0, 20), f"v{k:02}") for k in range(25)]
    sides = spark.createDataFrame(left, "id int, k string, at int"), spark.createDataFrame(right, "k string, since int, v string")
    want = [(i, max(((s, v) for kk, s, v in right if kk == k and s <= at), default=(0, None))[1]) for i, k, at in left]
    for coarse in (None, lambda p: F.floor(p / 4), lambda p: p):
        assert out(rows.as_of(*sides, ["k"], "at", "since", "v", "found", coarse).select("id", "found"), "id") == want


def test_nearest_above(spark):
    d = spark.createDataFrame([("u", 0, 0), ("u", 1, 1), ("u", 2, 2), ("u", 3, 1), ("u", 4, 3), ("w", 5, 2)], "u string, i int, level int")
    rng = random.Random(5)
    flat = [(rng.choice("uv"), k, rng.choice([0, 1, 2, 3, 9, None])) for k in range(80)]
    df = spark.createDataFrame(flat, "u string, i int, level int")
    want = {i: max((j for v, j, m in flat if v == u and j < i and m is not None and level is not None and m < level), default=None) for u, i, level in flat}
    for coarse in (None, F.floor(F.col("i") / 7), F.col("i")):
        assert {r.i: r.p for r in rows.nearest_above(df, ["u"], "i", "level", "p", coarse=coarse).collect()} == want
    assert out(rows.nearest_above(d, ["u"], "i", "level", "p").select("i", "p")) == [(0, None), (1, 0), (2, 1), (3, 0), (4, 3), (5, None)]


def test_closures(spark):
    e = spark.createDataFrame([("u", "r", ""), ("u", "a", "r"), ("u", "b", "a"), ("u", "c", "b"), ("w", "b", None), ("u", "x", "y"), ("u", "y", "x")], "u string, c string, p string")
    got = {(r.ancestor, r.descendant) for r in rows.closure(e, ["u"], "c", "p").where("u = 'u'").collect()}
    assert {(a, b) for a, b in got if a in "rabc"} == {("r", "r"), ("r", "a"), ("r", "b"), ("r", "c"), ("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c")}
    assert {("x", "y"), ("y", "x")} <= got
    p = spark.createDataFrame([("u", "A", 1), ("u", "A|B", 2), ("u", "A|BC", 3), ("u", "A|B|C", 4), ("u", None, 5)], "u string, path string, n int")
    assert {(r.ancestor, r.descendant) for r in rows.prefix_closure(p, ["u"], "path", "n").collect()} == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 2), (2, 4), (3, 3), (4, 4)}


def test_budget_and_upsert(spark):
    d = spark.createDataFrame([("k", 1, 40), ("k", 2, 70), ("k", 3, 5)], "k string, o int, n int")
    assert out(rows.within_budget(d, ["k"], ["o"], "n", 100).select("o", "used_before", "taken", "budget_left")) == [(1, 0, 40, 60), (2, 40, 60, 0), (3, 110, 0, 0)]
    assert out(rows.within_budget(d, ["k"], ["o"], "n", 100, F.col("o")).select("o", "used_before", "taken", "budget_left")) == [(1, 0, 40, 60), (2, 40, 60, 0), (3, 110, 0, 0)]
    old = spark.createDataFrame([("d1", 1), ("d1", 2), ("d2", 3)], "doc string, id int")
    new = spark.createDataFrame([("d1", 2), ("d1", 9)], "doc string, id int")
    assert out(rows.upsert_documents(old, new, "doc", "id"), "id") == [("d1", 2), ("d2", 3), ("d1", 9)]
    assert [r.id for r in rows.stale_ids(old, new, "doc", "id").collect()] == [1]


def test_claims(spark):
    c = spark.createDataFrame(
        [(1, "e", "USA", "u1", 0.9, 0.8, 0.7, 1.0), (2, "e", "USA", "u2", 0.9, 0.8, 0.7, 1.0), (3, "e", "UK", "u2", 0.9, 0.8, 0.7, 1.0), (4, "e", "", "u3", 0.9, 0.8, 0.7, float("nan")), (5, "f", "X", "u4", 0.5, None, 0.5, 0.5)],
        "claim_id int, e string, candidate_value string, source_url string, analysis_confidence double, source_authority_score double, freshness_score double, entity_match_score double",
    )
    assert out(claims.agreement(c, ["e"], "candidate_value"))[0] == ("e", pytest.approx(2 / 3), 3, 2)
    assert out(claims.conflicts(c, ["e"], "candidate_value", "source_url", "claim_id")) == [("e", 2, "USA; UK", 3)]
    s = spark.createDataFrame([("e", 0.6), ("g", 0.9)], "e string, synthesis_confidence double")
    got = {r.e: r.confidence for r in claims.confidence(c, s, ["e"]).collect()}
    assert got["e"] == round((0.8 * 20 + 0.7 * 12 + 2 / 3 * 20 + 12 + 0.9 * 16 + 0.6 * 10) / 90, 4)
    assert got["g"] == 0.2


def test_blocks():
    page = "<p>Short</p><p>" + "long text " * 10 + "</p><h2>Head</h2><table><tr><th>a</th><td>b</td></tr><tr><td>1</td><td>2</td></tr></table><p>tail</p><script>var x='<h1>no</h1>';</script>"
    got = list(parsing.blocks_of(page))
    assert [k for k, _ in got][:4] == ["text", "heading", "table", "text"]
    assert got[0][1].startswith("Short\n\nlong text") and got[2][1] == "a | b\n1 | 2" and got[3][1] == "tail"
    assert list(parsing.blocks_of("")) == []


def test_sections(spark):
    pages = spark.createDataFrame([("u", "intro text<h1>One</h1><p>a</p><h2>One</h2><p>b</p>"), ("v", None)], "url string, body string")
    tree = parsing.section_tree(parsing.extract_blocks(pages, "url", "body"))
    got = out(tree.select("section", "heading", "level", "n_blocks"), "section")
    assert got == [(0, None, 0, 1), (1, "One", 1, 1), (2, "One", 1, 1)]
    assert tree.select("section_id").distinct().count() == 3


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=600), st.integers(5, 60), st.integers(0, 40))
def test_windows_end_and_hold_the_text(text, size, overlap):
    got = list(chunking.windows(text, size, overlap, least=1))
    assert all(len(p) <= size for p in got)
    assert set("".join(text.split())) == set("".join("".join(got).split()))


def test_windows_advance_over_a_long_word():
    assert len(list(chunking.windows("ab " + "x" * 5000, 1500, 200))) < 10


def test_pack_and_section_chunks(spark):
    assert chunking.pack([300, 200, 500, 100, 900], 400, 800) == [0, 0, 1, 2, 3]
    d = spark.createDataFrame([("u", "s", 1, "x" * 4000, "text", "A|B"), ("u", "s", 2, "t", "table", "A|B"), ("u", "s", 3, "y", "text", "A|B"), ("u", "z", 1, None, "text", None)], "u string, s string, i int, c string, k string, p string")
    got = out(chunking.section_chunks(d, ["u", "s"], "i", "c", "k", "p").select("ordinal", "chunk_role"))
    assert got == [(0, "section_summary"), (1, "content"), (2, "table"), (3, "content")]


def test_flat_chunks_and_reassembly(spark):
    d = spark.createDataFrame([("a", "word " * 1000, "text"), ("b", "cell | " * 1000, "table"), ("c", "short", "text"), ("d", None, "text")], "id string, t string, k string")
    got = chunking.flat_chunks(d, "id", "t", "k")
    assert got.where("document = 'b'").agg(F.max(F.length("content"))).first()[0] <= 4000
    assert got.where("document in ('c', 'd')").count() == 0
    assert got.select("chunk_id").distinct().count() == got.count()
    back = chunking.reassemble(spark.createDataFrame([("x", 1, "b"), ("x", 0, "a")], "d string, i int, c string"), "d", "i", "c")
    assert back.first().text == "a\n\nb"


def test_hybrid_weights():
    with pytest.raises(ValueError):
        retrieval.checked((0.5, 0.6, 0.1))
    with pytest.raises(ValueError):
        retrieval.checked((1.5, -0.5, 0.0))


def test_refine_keeps_the_best_round(spark):
    q = spark.createDataFrame([(1, "good"), (2, "poor")], "id int, q string")
    found = retrieval.refine(q, "id", "q", lambda o: o.select("query_id", F.when(F.col("query") == "good", 0.9).when(F.contains("query", F.lit("alpha")), 0.3).otherwise(0.1).alias("quality")), 0.4, 3, ("alpha beta", "gamma"))
    got = {r.query_id: (r.best_round, r.rounds, r.quality) for r in found.collect()}
    assert got == {1: (0, 1, 0.9), 2: (1, 3, 0.3)}


def test_vector_topk_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [(i, int(i % 3 == 0), rng.normal(size=5).round(1).tolist()) for i in range(80)] + [(90, 0, None), (91, 0, [0.0] * 5)]
    items = spark.createDataFrame(vectors, "id bigint, s int, v array<double>")
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in vectors if v}
    for block, of in ((1000, 1000), (9, 1000), (9, 2), (1000, 3)):
        got = retrieval.vector_topk(items.where("id % 10 = 0"), items, "s", "id", "id", "v", 4, block, of)
        want = []
        for i, s, v in vectors:
            if i % 10 == 0 and v:
                near = sorted((-round(float(unit[i] @ unit[j]), 9), j) for j, t, w in vectors if w and t == s and j != i)[:4]
                want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "item_id").collect()) == sorted(want)


def test_validation(spark):
    from gleanery.operators import validation as va

    d = spark.createDataFrame(
        [(1, "money", '```json\n{"total": 100, "rows": [{"v": 60, "p": 60}, {"v": 39, "p": 40}], "year": "x"}\n```'), (2, "money", '{"total": 100, "rows": [{"v": 60, "p": 60}, {"v": 20, "p": null}], "year": 2020}'), (3, "name", '{"first": "A"}'), (4, "money", "none"), (5, None, None)],
        "id int, tag string, j string",
    )
    t = va.tagged(d, "tag", "j", {"money": "total double, year int, rows array<struct<v double, p double>>", "name": "first string"})
    bad = va.violations(year=(F.col("money.year").between(1900, 2100), "must be a year"), rows__v=(va.sums_agree(F.col("money.rows"), "v", F.col("money.total")), "row sum diverges"), rows__p=(va.percentages_agree(F.col("money.rows"), "p"), "shares don't add up"))
    got = {r.id: r for r in t.select("*", bad.alias("bad")).select("*", va.message_kinds(F.col("bad"), [("sum", "sum diverges"), ("range", "must be")]).alias("kinds")).collect()}
    assert got[1].bad == ["year: must be a year"] and got[1].money.total == 100 and got[1].kinds == ["range"]
    assert got[2].bad == ["rows.v: row sum diverges"] and got[2].kinds == ["sum"]
    assert got[3].name.first == "A" and got[3].money is None
    assert len(got[4].bad) == len(got[5].bad) == 3 and got[4].kinds == ["range", "sum", "unknown"]


def test_running_before_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(i, rng.choice("ab"), rng.randint(0, 30), rng.choice([1, 2, 5, None])) for i in range(80)]
    got = rows.running_before(spark.createDataFrame(data, "id int, k string, t int, v int"), ["k"], ["t", "id"], "v", "before", F.floor(F.col("t") / 7))
    for r in got.collect():
        earlier = [v for i, k, t, v in data if k == r.k and (t, i) < (r.t, r.id) and v is not None]
        assert r.before == (sum(earlier) if earlier else None)


def test_previous_values_over_stretches(spark):
    rng = random.Random(8)
    data = [(i, rng.choice(["a", "b", None]), rng.randint(0, 30), rng.choice([None, i])) for i in range(90)]
    df = spark.createDataFrame(data, "id int, k string, t int, v int")
    for width in (1, 7, 1000):
        got = {r.id: r.p for r in rows.previous(df, ["k"], ["t", "id"], "v", "p", F.floor(F.col("t") / width)).collect()}
        want = {}
        for k in ("a", "b", None):
            mine = sorted(((t, i, v) for i, kk, t, v in data if kk == k), key=lambda x: x[:2])
            want |= {i: (mine[n - 1][2] if n else None) for n, (_, i, _) in enumerate(mine)}
        assert got == want
