import random

from gleanery.llm import topn


def test_loser_tree_merges():
    rng = random.Random(1)
    for _ in range(200):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(1, 9))]
        runs = [[(x,) for x in r] for r in runs]
        want = sorted({x for r in runs for x in r})
        assert topn.merge_first(runs, 5) == want[:5]
        assert topn.merge_first(runs, 10**6) == want


def check(spark, rows, n, **kw):
    df = spark.createDataFrame([(g, s, i, "x", 1) for g, s, i in rows], "grp string, sc double, id bigint, g string, run int").repartition(9)
    got = topn.top_n_per_group(df, "grp", "sc", "id", n, **kw)
    groups: dict = {}
    for g, s, i in rows:
        if g is not None and s is not None and s == s and i is not None:
            groups.setdefault(g, set()).add((-s, i))
    want = sorted((g, i, -s) for g, v in groups.items() for s, i in sorted(v)[:n])
    assert sorted(tuple(r) for r in got.collect()) == want


def test_equals_sorting(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", "c", None, ""]), rng.choice([1.0, 2.0, 0.5, None, float("nan"), float("inf")]), rng.randint(1, 60)) for _ in range(500)]
    rows += rows[:50]
    check(spark, rows, 3)
    check(spark, rows, 3, fan=2)
    check(spark, rows, 1, fan=3)
    check(spark, rows, 1000)


def test_hot_group_ties_and_empty(spark):
    check(spark, [("hot", 1.0, i) for i in range(3000)] + [("x\u0001y", 1.0, 1), ("x", 2.0, 1)], 3, fan=2)
    check(spark, [("a", 1.0, 7), ("a", 1.0, 7), ("a", 2.0, 7)], 3)
    check(spark, [], 3)
