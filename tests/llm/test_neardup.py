import random
from itertools import combinations

import pytest

from gleanery.llm import neardup


def texts(seed, n, vocabulary=60):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            w = rng.choice(out)[1].split()
            for _ in range(rng.randint(0, 4)):
                if rng.random() < 0.5 and len(w) > 3:
                    w.pop(rng.randrange(len(w)))
                else:
                    w.insert(rng.randrange(len(w) + 1), rng.choice(words))
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        out.append((i, " ".join(w)))
    return out


def brute(rows, t, size, least):
    sets = {i: neardup.shingles(x, size) for i, x in rows if x is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(i, j) for i, j in combinations(sorted(sets), 2) if len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}


def found(spark, rows, **kw):
    df = spark.createDataFrame([(x, "x", i, "y") for i, x in rows], "text string, cls string, id bigint, n string")
    m, p = neardup.similar(df, "id", "text", **kw)
    return {tuple(r) for r in neardup.record_pairs(m, p).collect()}


@pytest.mark.parametrize("kw", [{}, {"cap": 2}, {"cap": 4, "overflow": 6, "bits": 64}, {"broadcast_ids": 0, "frequent": 0.2}, {"cap": 10**9, "overflow": 20}, {"ranked": 3, "cap": 4}, {"ranked": 0}])
@pytest.mark.parametrize("t,size,least", [(0.7, 1, 5), (0.8, 5, 1)])
def test_equals_all_pairs(spark, kw, t, size, least):
    rows = texts(7, 160)
    assert found(spark, rows, threshold=t, shingle=size, least=least, **kw) == brute(rows, t, size, least)


def test_large_group_of_alike_records_is_joined_in_blocks(spark):
    rng = random.Random(2)
    base = [f"b{k}" for k in range(60)]
    rows = [(i, " ".join(w for w in base if rng.random() < 0.93)) for i in range(300)] + [(1000 + k, x) for k, x in texts(3, 40)]
    assert found(spark, rows, threshold=0.8, shingle=1, overflow=40, cap=10**9) == brute(rows, 0.8, 1, 1)


@pytest.mark.parametrize("block", [1, 3, 2000])
def test_pairs_of_large_classes_are_made_in_blocks(spark, block):
    members = spark.createDataFrame([(c, 100 * c + k) for c, n in ((1, 12), (2, 7), (3, 1), (4, 1)) for k in range(n)], "cls bigint, id bigint")
    pairs = spark.createDataFrame([(1, 2, 0.9), (3, 4, 0.8)], "a bigint, b bigint, similarity double")
    got = sorted(tuple(r) for r in neardup.record_pairs(members, pairs, block).collect())
    own = {c: [100 * c + k for k in range(n)] for c, n in ((1, 12), (2, 7), (3, 1), (4, 1))}
    want = [p for c in own for p in combinations(own[c], 2)] + [(x, y) for a, b in ((1, 2), (3, 4)) for x in own[a] for y in own[b]]
    assert got == sorted(want)


def test_pivot_windows_measure_what_pivots_would_cost(spark):
    rng = random.Random(6)
    unlike = [(i, " ".join(f"x{rng.randrange(4000)}" for _ in range(30))) for i in range(200)]
    got = neardup.pivot_windows(spark.createDataFrame(unlike, "id bigint, text string"), "id", "text", 0.7, 1, 5, 20)
    assert got["pivots"] == 20 and got["share_beyond_0.9"] > 0.9 and got["share_of_pivots"] > 0.9
    assert neardup.pivot_windows(spark.createDataFrame([], "id bigint, text string"), "id", "text", 0.7, 1, 5)["regions_per_record"] == 0.0


def test_nulls_blanks_copies_and_empty_tables(spark):
    long = " ".join(f"x{k}" for k in range(50_000))
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "A b, c d e f!"), (5, long), (6, long + " y"), (None, "a b c d e f")]
    df = spark.createDataFrame(rows, "id bigint, text string")
    m, p = neardup.similar(df, "id", "text", 0.8, 1)
    assert {tuple(r) for r in neardup.record_pairs(m, p).collect()} == {(3, 4), (5, 6)}
    m, p = neardup.similar(df.limit(0), "id", "text")
    assert m.count() == 0 and p.count() == 0 and neardup.groups(m, p).count() == 0


def test_components(spark):
    rng = random.Random(9)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 380)]
    nodes = sorted({x for e in links for x in e} | {999})
    root = {n: n for n in nodes}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    got = neardup.components(spark.createDataFrame([(n,) for n in nodes], "node bigint"), spark.createDataFrame(links, "a bigint, b bigint"))
    assert {r.node: r.group for r in got.collect()} == {n: top(n) for n in nodes}


def test_groups_count_links(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k"), (3, "a b c d e f g h i j k l"), (4, "z y x"), (5, "z y x")], "id bigint, text string")
    got = {r.id: (r.group, r.links) for r in neardup.groups(*neardup.similar(df, "id", "text", 0.85, 1)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] != got[4][0] == got[5][0]
    assert [got[i][1] for i in (1, 2, 3, 4, 5)] == [1, 2, 1, 0, 0]


def test_hot_short_texts_keep_their_links(spark):
    b = "b1 b2 b3 b4 b5 b6 b7 b8 b9"  # five runs of five words
    a = b.rsplit(" ", 1)[0]  # the first four of them
    rows = [(i, b) for i in range(40)] + [(100, a)] + [(200 + i, f"c{i} b5 b6 b7 b8 b9") for i in range(3)] + [(300 + i, f"d{i} e{i} f{i} g{i} h{i}") for i in range(60)]
    for cap in (1, 2, 16384):
        assert found(spark, rows, threshold=0.8, shingle=5, least=1, cap=cap) == brute(rows, 0.8, 5, 1)


@pytest.mark.parametrize("t", [0.5, 0.7, 0.8])
def test_short_sets_of_hot_words_equal_all_pairs(spark, t):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.sample("abcdefghi", rng.randint(1, 8)))) for i in range(150)]
    assert found(spark, rows, threshold=t, shingle=1, least=1, cap=0) == brute(rows, t, 1, 1)


def test_texts_shorter_than_a_run_are_one_run(spark):
    rows = [(1, "Company profile"), (2, "company PROFILE."), (3, "Home"), (4, "home"), (5, "Company profile home"), (6, "profile company"), (7, "..."), (8, "a b c d e"), (9, "A b c d e"), (10, "a b c d"), (11, "a b c d")]
    assert neardup.shingles("Company profile", 5) == {"company profile"} and neardup.shingles("...", 5) == set()
    assert found(spark, rows, threshold=0.8, shingle=5) == brute(rows, 0.8, 5, 1) == {(1, 2), (3, 4), (8, 9), (10, 11)}
    df = spark.createDataFrame(rows, "id bigint, text string")
    got = {r.id: r.group for r in neardup.groups(*neardup.similar(df, "id", "text", 0.8, 5)).collect()}
    assert set(got) == {i for i, _ in rows} - {7} and got[1] == got[2] != got[5]
