import random

import pytest
from pyspark.sql import functions as F

import gleanery
from gleanery.operators import chunking, folds, parsing, rows
from gleanery.sources import responses
from gleanery.sources.tables import shared_dir
from gleanery.streaming import events as ev


def test_cache_entries_live_from_when_they_were_set(spark):
    acc = spark.createDataFrame([("a", t, i) for i, t in enumerate((0, 5, 11, 12, 23, 40))] + [("b", 7, 99), (None, 1, 100)], "k string, t bigint, i bigint")
    got = lambda refetch: {r.i: (r.status, r.action) for r in folds.cache_aside(acc, ["k"], "t", "i", 10, 20, refetch).collect()}
    assert got(True) == {0: ("miss", "fetch"), 1: ("hit", "serve"), 2: ("stale", "fetch"), 3: ("hit", "serve"), 4: ("stale", "fetch"), 5: ("stale", "fetch"), 99: ("miss", "fetch"), 100: ("miss", "fetch")}
    assert got(False) == {0: ("miss", "fetch"), 1: ("hit", "serve"), 2: ("stale", "serve"), 3: ("stale", "serve"), 4: ("expired", "fetch"), 5: ("stale", "serve"), 99: ("miss", "fetch"), 100: ("miss", "fetch")}
    assert folds.cache_aside(acc.limit(0), ["k"], "t", "i", 10, 20, True).count() == 0


def test_embedding_batches_keep_order_and_partial_results(spark):
    def embed(texts):
        assert len(texts) <= 3
        if "bad" in texts:
            raise ValueError("no")
        return [(k, [float(len(t))]) for k, t in enumerate(texts)][::-1]

    df = spark.createDataFrame([(k, t) for k, t in enumerate(["a", "bb", "ccc", None, "bad", "x", "yy", "zzzz"])], "id bigint, text string").coalesce(1)
    got = {r.id: (r.vector, r.batch_error) for r in folds.embed_batches(df, "id", "text", embed, 3).collect()}
    assert [got[k][0] for k in (0, 1, 2, 7)] == [[1.0], [2.0], [3.0], [4.0]] and got[3] == (None, None)
    assert all(got[k][0] is None and "after 3 texts" in got[k][1] for k in (4, 5, 6))


def test_line_groups(spark):
    df = spark.createDataFrame([("t", "\n".join("x" * 40 for _ in range(5))), ("u", ""), ("v", None)], "id string, text string")
    got = sorted((r.id, r.part, r.content.count("x")) for r in folds.line_groups(df, "id", "text", 25).collect())
    assert got == [("t", 0, 80), ("t", 1, 80), ("t", 2, 40), ("u", 0, 0)]


def test_answers_of_both_shapes_become_one_kind_of_row(spark):
    df = spark.createDataFrame(
        [("a", "organic", '{"organic": [{"link": "https://X.test/1", "title": "T", "snippet": "s"}, {"title": "only"}]}'), ("b", "results", '{"results": [{"url": "https://y.test", "content": "c"}]}'), ("c", "other", "{}"), ("d", "organic", "{broken"), ("e", "results", '{"results": []}'), ("f", "organic", None)],
        "id string, shape string, answer string",
    )
    got = [tuple(r) for r in responses.response_rows(df, "answer", "shape", "id").orderBy("id", "rank").collect()]
    assert got == [("a", "https://X.test/1", "T", "s", 1, "x.test"), ("a", "", "only", "", 2, ""), ("b", "https://y.test", "", "c", 1, "y.test")]


def test_section_walk_is_pre_order(spark):
    rng = random.Random(2)
    nodes = [("d", "s0", None, 0, "", 1)]
    for k in range(1, 30):
        nodes.append(("d", f"s{k}", rng.choice([f"s{rng.randrange(k)}", "gone", ""]), k, f"A|H{k}", 1))
    df = spark.createDataFrame(nodes, "document_url string, section_id string, parent string, first int, path string, n_own bigint")
    children: dict = {}
    known = {n[1] for n in nodes}
    for n in nodes:
        children.setdefault(n[2] if n[2] in known else None, []).append(n[1])
    want = []

    def visit(s, depth):
        want.append((s, depth, len(children.get(s, []))))
        for c in children.get(s, []):
            visit(c, depth + 1)

    for s in children[None]:
        visit(s, 0)
    got = [(r.section_id, r.depth, r.n_children) for r in chunking.section_walk(df).orderBy("walk").collect()]
    assert got == want


def test_deep_outlines_and_trees(spark):
    d = spark.createDataFrame([("u", k, k) for k in range(40)] + [("u", 40, 12), ("u", 41, -3)], "u string, i int, level int")
    got = {r.i: r.p for r in rows.nearest_above(d, ["u"], "i", "level", "p").collect()}
    assert all(got[k] == k - 1 for k in range(1, 40)) and got[40] == 11 and got[41] is None and got[0] is None
    with pytest.raises(ValueError):
        rows.nearest_above(d, ["u"], "i", "level", "p", most=10)
    chain = spark.createDataFrame([(str(k), str(k - 1) if k else "") for k in range(37)], "c string, p string")
    assert rows.closure(chain, [], "c", "p").count() == 37 * 38 // 2


def test_parsers_by_type(spark):
    parsing.register_parser("application/x-shout", lambda t: [("text", t.upper())] if t != "boom" else 1 / 0)
    df = spark.createDataFrame([("1", "Text/HTML; charset=utf-8", "<h1>A</h1><p>b</p>"), ("2", "text/plain", "one\n\ntwo"), ("3", "application/x-shout", "hey"), ("4", "application/x-shout", "boom"), ("5", None, "x"), ("6", "text/html", None)], "id string, t string, b string")
    got = sorted((r.id, r.parser, r.position, r.block_type, r.content) for r in parsing.parse_documents(df, "id", "t", "b").collect())
    assert got[:4] == [("1", "text/html", 0, "heading", "A"), ("1", "text/html", 1, "text", "b"), ("2", "", 0, "text", "one\n\ntwo"), ("3", "application/x-shout", 0, "text", "HEY")]
    assert got[4][:4] == ("4", "application/x-shout", 0, "error") and got[5] == ("5", "", 0, "text", "x") and len(got) == 6


class Towns(gleanery.Enricher):
    field = "town"
    queries = ("{} seat", "{} plant")
    asked = "Where is {} run from"


def test_enricher_end_to_end(spark):
    entities = spark.createDataFrame([(1, "Kelmar Foods"), (2, "Osten Water")], "entity_id bigint, name string")

    def search(plans):
        return plans.select("entity_id", "ordinal", F.concat(F.lit("https://kelmar.test/"), F.col("entity_id").cast("string")).alias("url"), F.col("query").alias("title"), F.lit("").alias("snippet"), F.lit(1).alias("rank"))

    text = "Kelmar Foods is run from Northton, where it has been for years and where its people have their offices and its plant stands."
    pages = spark.createDataFrame([("https://kelmar.test/1", text), ("https://kelmar.test/2", text)], "url string, text string")
    e = Towns(search, pages)
    assert e.plans(entities).count() == 4 and e.results(entities).count() == 2
    got = e.evidence(entities).collect()
    assert [(r.entity_id, r.field, r.rank, r.url) for r in got] == [(1, "town", 1, "https://kelmar.test/1")] and "Northton" in got[0].content
    with pytest.raises(ValueError):
        gleanery.Enricher(search, pages)


def test_table_cache(spark, tmp_path):
    cache = gleanery.TableCache(spark, f"file://{tmp_path}/cache")
    keys = spark.createDataFrame([("a",), ("b",)], "key string")
    assert {tuple(r) for r in cache.get(keys, 0).collect()} == {("a", None, None), ("b", None, None)}
    put = lambda v, now: cache.set(spark.createDataFrame([("a", v)], "key string, value string"), now, 10)
    put("x", 0)
    put("y", 5)
    assert {tuple(r) for r in cache.get(keys, 12).collect()} == {("a", "y", 7), ("b", None, None)}
    assert {tuple(r) for r in cache.get(keys, 16).collect()} == {("a", None, None), ("b", None, None)}


def test_streams_of_several_micro_batches_equal_the_batch(spark, sf, tmp_path):
    e = spark.read.schema(ev.SCHEMA).parquet(f"{sf}/events.parquet")
    bounds = [r.ts for r in e.orderBy("ts").select("ts").collect()]
    for k, (lo, hi) in enumerate(zip([bounds[0], bounds[len(bounds) // 3], bounds[2 * len(bounds) // 3]], [bounds[len(bounds) // 3], bounds[2 * len(bounds) // 3], None])):
        part = e.where(F.col("ts") >= F.lit(lo)) if hi is None else e.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
    raw = spark.readStream.schema(ev.SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/events").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "3650 days")
    got = {tuple(r) for r in ev.run_available(ev.windowed(raw), "update", ("start_us", "event_type")).collect()}
    batch = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    assert got == {tuple(r) for r in batch.select(F.unix_micros("window.start"), "event_type", "n", "total").collect()}


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
