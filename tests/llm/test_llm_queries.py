import pytest
from conftest import compare
from pyspark.sql import functions as F

from gleanery.llm.queries import QUERIES, SQL
from gleanery.sources.tables import table


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, sf, duck, name):
    compare(duck, QUERIES[name](spark, sf), SQL[name])


def test_found_queries_have_the_columns_given():
    assert {n for n in QUERIES if n.endswith("_found")} == {f"p{k}_found" for k in (1, 2, 3, 4, 5, 6, 7, 8, 10)}


def rows(spark, sf, name):
    got = QUERIES[name](spark, sf)
    out = [tuple(r) for r in got.collect()]
    assert out and len(got.columns) == len(set(got.columns))
    return got.columns, out


def test_details_stand_in_their_texts_and_placeholders_stand_for_them(spark, sf):
    columns, found = rows(spark, sf, "p3_found")
    assert columns == ["field_name", "record_id", "pii_type", "pii_text"] and len(set(found)) == len(found)
    texts = {("text", r[0]): r[1] for r in table(spark, sf, "cached_assessments").select("assessment_id", "text").collect()} | {("supporting_excerpt", r[0]): r[1] for r in table(spark, sf, "fact_claims").select("claim_id", "supporting_excerpt").collect()}
    assert all(s in texts[f, i] for f, i, _, s in found) and {k for _, _, k, _ in found} == {"email", "phone", "id_number", "street_address", "person_name"}
    _, clean = rows(spark, sf, "p3_redacted")
    clean = {(f, i): t for f, i, t in clean}
    assert clean.keys() == texts.keys()
    for f, i, kind, _ in found:
        assert f"[{kind.upper()}]" in clean[f, i]
    assert all(clean[k] == t for k, t in texts.items() if t and k not in {(f, i) for f, i, *_ in found})


def test_every_value_has_one_answer_from_its_own_list(spark, sf):
    columns, found = rows(spark, sf, "p4_found")
    assert columns == ["field_name", "record_id", "value_id"]
    ref = {r.value_id: (r.field_name, r.canonical_value) for r in table(spark, sf, "canonical_values").collect()}
    values = {("candidate_value", r[0]): (r[1], r[2]) for r in table(spark, sf, "fact_claims").select("claim_id", "field_name", "candidate_value").collect()} | {("normalized_value", r[0]): (r[1], r[2]) for r in table(spark, sf, "synthesis_results").select("synthesis_id", "field_name", "normalized_value").collect()}
    spelt = set(ref.values())
    assert {(f, i) for f, i, _ in found} == {k for k, (field, v) in values.items() if v is not None and v.strip() and (field, v) not in spelt} and len(found) == len({x[:2] for x in found})
    assert all(v == 0 or ref[v][0] == values[f, i][0] for f, i, v in found)


def test_boilerplate_lines_show_text_and_bodies_are_the_rest(spark, sf):
    columns, found = rows(spark, sf, "p5_found")
    assert columns == ["field_name", "record_id", "line_no"] and len(set(found)) == len(found)
    bodies = {r[0]: r[1] for r in table(spark, sf, "cached_fetches").select("fetch_id", "body").collect()}
    gone = {r[0] for r in rows(spark, sf, "p7_found")[1]}
    assert not {i for f, i, _ in found if f == "body"} & gone
    assert all(bodies[i].split("\n")[k - 1].strip() for f, i, k in found if f == "body")
    kept = dict(rows(spark, sf, "p5_bodies")[1])
    assert kept.keys() == bodies.keys() - gone and all(t for t in kept.values())


def test_exclusions_and_their_reasons_agree(spark, sf):
    found, reasons = rows(spark, sf, "p7_found")[1], dict(rows(spark, sf, "p7_reasons")[1])
    assert {i for (i,) in found} == set(reasons) and set(reasons.values()) <= {"blank", "template", "no_article"}
    blank = {r[0] for r in table(spark, sf, "cached_fetches").where(F.col("body").isNull() | (F.trim("body") == "")).select("fetch_id").collect()}
    assert {i for i, r in reasons.items() if r == "blank"} == blank


def test_documents_that_are_no_prose_are_those_with_little_of_it(spark, sf):
    columns, stats = rows(spark, sf, "p10_statistics")
    at = {c: k for k, c in enumerate(columns)}
    assert len({s[at["doc_id"]] for s in stats}) == len(stats) == table(spark, sf, "documents").select("doc_id").distinct().count()
    shares = [s for s in stats if s[at["n_lines"]]]
    assert all(abs(sum(s[at[c]] for c in ("prose_share", "list_share", "table_share", "junk_share")) - 1) < 1e-9 for s in shares)
    assert {s[at["doc_id"]] for s in shares if s[at["prose_share"]] < 0.5} == {i for (i,) in rows(spark, sf, "p10_found")[1]}


def test_mixture_and_shares_agree(spark, sf):
    columns, chosen = rows(spark, sf, "p9_mixture")
    at = {c: k for k, c in enumerate(columns)}
    taken: dict = {}
    for r in chosen:
        taken[r[at["source"]]] = taken.get(r[at["source"]], 0) + r[at["tokens"]] * r[at["repeats"]]
    report = QUERIES["p9_shares"](spark, sf).collect()
    assert {r.source: r.tokens_taken for r in report if r.tokens_taken} == taken
    most = {r.source: r.max_repeats for r in report}
    assert all(1 <= r[at["repeats"]] <= most[r[at["source"]]] for r in chosen)
