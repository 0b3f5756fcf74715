import json

from gleanery.sources import bundles, providers, sinks


def bundle(**over):
    claim = {"field_name": "hq", "candidate_value": "USA", "supporting_excerpt": "x", "source_url": "u1", "source_title": "t", "analysis_confidence": 0.9, "source_authority_score": 0.9, "freshness_score": 0.9, "entity_match_score": 1.0}
    doc = {"url": "u1", "title": "t", "content_type": "text/html", "text": "x", "excerpt": "x", "document_type": "other", "accepted_for_analysis": True}
    return {"search_results": [{"url": "u1", "title": "t", "snippet": "s", "provider": "p", "rank": 1}], "parsed_documents": [doc, doc | {"url": "u2", "accepted_for_analysis": False}], "analysis_reports": [{"source_url": "u1", "claims": [claim]}, {"source_url": "u1", "claims": []}], "synthesis": {"value": "USA", "synthesis_confidence": 0.9}} | over


def test_bundles(spark, tmp_path):
    (tmp_path / "a_hq.json").write_text(json.dumps(bundle(), indent=1))
    (tmp_path / "b_hq.json").write_text(json.dumps(bundle(analysis_reports=[], synthesis=None)))
    b = bundles.read_bundles(spark, str(tmp_path))
    assert [r.bundle for r in bundles.bundle_names(spark, str(tmp_path)).collect()] == ["a_hq", "b_hq"]
    assert bundles.search_rows(b).count() == 2
    assert bundles.document_rows(b).count() == 4
    assert [(r.bundle, r.candidate_value) for r in bundles.claim_rows(b).collect()] == [("a_hq", "USA")]
    assert [r.value for r in bundles.synthesis_rows(b).collect()] == ["USA"]
    assert bundles.bundle_path("/x/", "e", "hq") == "/x/e_hq.json" and bundles.bundle_path("/x", "e", "hq", "/y.json") == "/y.json"


def test_offline_search(spark):
    spark.dataSource.register(providers.OfflineSearch)
    got = spark.read.format("offline_search").option("queries", "one\ntwo").option("results", "3").load()
    assert got.count() == 6 and got.select("url").distinct().count() == 6


def test_priority(spark):
    s = spark.createDataFrame([("a", "file", 3), ("a", "env", 1), ("b", "", 1), ("b", "default", 9), ("c", None, 1)], "k string, v string, p int")
    assert {r.k: r.v for r in providers.by_priority(s, "k", "v", "p").collect()} == {"a": "env", "b": "default"}


def test_sinks(spark, tmp_path):
    s = spark.createDataFrame([("t", 2, "fetch", 2.5), ("t", 1, "plan", 1.0), ("u", 1, "plan", None)], "trace string, o int, name string, ms double")
    sinks.write_jsonl(s, str(tmp_path / "spans"), "trace")
    assert spark.read.json(str(tmp_path / "spans")).count() == 3
    line = sinks.timeline(s, "trace", "o", "name", "ms").where("trace = 't'").first()
    assert line.timeline == "- plan: 1.0 ms\n- fetch: 2.5 ms" and line.total_ms == 3.5


def test_context(spark, tmp_path):
    for name, text in (("a.md", "x" * 60), ("b.md", "y" * 30 + "  " + "z" * 30), ("c.md", "late")):
        (tmp_path / name).write_text(text)
    m = spark.createDataFrame([("plan", 2, "b.md"), ("plan", 1, "a.md"), ("plan", 3, "c.md"), ("plan", 4, "gone.md"), ("run", 1, "c.md")], "stage string, priority int, file string")
    got = {(r.stage, r.file): (r.text, r.used_before, r.budget_left) for r in bundles.read_context(spark, m, str(tmp_path), 92).collect()}
    assert got == {("plan", "a.md"): ("x" * 60, 0, 32), ("plan", "b.md"): ("y" * 30, 60, 0), ("run", "c.md"): ("late", 0, 88)}
