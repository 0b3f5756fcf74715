import math

import pytest
from pyspark.sql import functions as F

from gleanery.functions import text as fx


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'array<double>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


@pytest.mark.parametrize("url,host", [("https://www.Example.com:8080/a", "example.com"), ("http://user@sub.www.org/x", "sub.www.org"), ("not a url", ""), ("", ""), (None, "")])
def test_host(spark, url, host):
    assert spark.createDataFrame([(url,)], "u string").select(fx.host(F.col("u"))).first()[0] == host


@pytest.mark.parametrize("query,text,score", [("été naïve", "Un ÉTÉ", 0.5), ("", "x", 0.0), ("a a b", "a", 0.5), ("x", "", 0.0)])
def test_keyword_score(spark, query, text, score):
    assert one(spark, fx.keyword_score(F.col("q"), F.col("t")), q=query, t=text) == score


@pytest.mark.parametrize("name,text,score", [("Acme Widget Corp.", "The ACME  widget works", 1.0), ("Acme Widget Corp", "widget of acme", 1.0), ("Acme Widget", "only acme", 0.5), ("Ltd", "ltd", 0.0)])
def test_entity_match(spark, name, text, score):
    assert one(spark, fx.entity_match(F.col("n"), F.col("t")), n=name, t=text) == score


def test_search_score(spark):
    s = fx.search_score(F.col("n"), F.col("u"), F.col("t"), F.col("s"))
    assert one(spark, s, n="Acme Inc", u="https://acme.test/about", t="Acme", s="") == pytest.approx(2.0 + 0.5 + 0.5 + 0.4)
    assert one(spark, s, n="Acme Inc", u="https://sec.gov/x", t="Acme", s="") == pytest.approx(0.5 + 0.6)
    assert one(spark, fx.search_tier(F.col("u")), u="https://en.wikipedia.org/x") == "reference"


@pytest.mark.parametrize("html,text", [("<p>a</p><script>x('</p>')</script><b>b</b>", "a b"), ("&amp;lt; &quot;x&quot;", '&lt; "x"'), ("", ""), ("  \n a   b ", "a b")])
def test_html_text(spark, html, text):
    assert one(spark, fx.html_text(F.col("h")), h=html) == text


@pytest.mark.parametrize("text,kind", [("| a | b |\n| c | d |", "table"), ("a | b\nc | d", "text"), ("a\tb\nc\td", "table"), ("| a | b |\n|---|:-:|", "table"), ("---\n| a | b", "table"), ("--- x\n| a | b |", "text"), ("| a |", "text"), ("plain", "text")])
def test_text_table_kind(spark, text, kind):
    from gleanery.operators.parsing import text_kind

    assert one(spark, fx.text_table_kind(F.col("t")), t=text) == kind
    assert text_kind(text) == kind


@pytest.mark.parametrize("url,safe", [("https://a.test/x", True), ("ftp://a.test", False), ("http://127.0.0.1/", False), ("http://172.20.1.1/", False), ("http://172.40.1.1/", True), ("http://localhost:8/", False), ("x", False), ("http://2130706433/", False), ("http://0x7f.1/", False), ("http://0177.0.0.1/", False), ("http://8.8.8.8/", True), ("http://134744072/", True), ("http://100.64.0.1/", False), ("http://192.0.2.9/", False), ("http://198.19.255.1/", False), ("http://1.2.3.4.5/", False), ("http://256.1.1.1/", False),
        ("http://[::1]/", False), ("http://[2606:4700::1111]/", True), ("http://[2001:db8::1]/", False), ("http://[fe80::1]/", False), ("http://[::ffff:10.0.0.1]/", False), ("http://[2002:7f00:1::]/", False), ("http://a.localhost/", False), ("http://239.1.1.1/", False)])
def test_url_safe(spark, url, safe):
    assert one(spark, fx.url_safe(F.col("u")), u=url) is safe


@pytest.mark.parametrize("hops,safe", [(["https://a.test/", None, "https://b.test/"], True), (["https://a.test/", "http://10.0.0.1/"], False), ([], False), (None, False), (["https://a.test/"] * 11, True), (["https://a.test/"] * 12, False)])
def test_hops_safe(spark, hops, safe):
    assert spark.createDataFrame([(hops,)], "h array<string>").select(fx.hops_safe(F.col("h"))).first()[0] is safe


@pytest.mark.parametrize("kind,name", [("text/html; charset=Latin-1", "ISO-8859-1"), ("text/html;charset='utf-16'", "UTF-16"), ("text/html", "UTF-8"), (None, "UTF-8"), ("text/html; charset=nonsense", "UTF-8")])
def test_charset(spark, kind, name):
    assert spark.createDataFrame([(kind,)], "k string").select(fx.charset(F.col("k"))).first()[0] == name


def test_cut_and_gate(spark):
    from gleanery.operators import validation

    assert one(spark, fx.cut(F.col("v"), 3, "..."), v="abcd") == "abc..." and one(spark, fx.cut(F.col("v"), 4, "..."), v="abcd") == "abcd" and one(spark, fx.cut(F.col("v"), 2), v="abcd") == "ab"
    kinds = lambda *k: F.array(*map(F.lit, k)) if k else F.array().cast("array<string>")
    got = lambda *k: tuple(spark.range(1).select(*[c.alias(n) for n, c in zip("ab", validation.gate(kinds(*k), ("hard",), 0.15))]).first())
    assert got() == (False, 1.0) and got("hard", "x") == (True, 0.0) and got("x", "unknown") == (False, pytest.approx(0.7)) and got(*["x"] * 9) == (False, 0.0)


def test_unit_raises_for_what_is_not_finite(spark):
    assert one(spark, fx.unit(F.col("x")), x=1.5) == 1.0
    assert one(spark, fx.unit(F.col("x")), x=-0.5) == 0.0
    for bad in (math.nan, math.inf):
        with pytest.raises(Exception, match="finite"):
            one(spark, fx.unit(F.col("x")), x=bad)


def test_small_ones(spark):
    assert one(spark, fx.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))
    assert one(spark, fx.cosine(F.col("a"), F.col("b")), a=[0.0], b=[1.0]) == 0.0
    assert one(spark, fx.iso3(F.col("v")), v=" usa ") == "USA"
    assert one(spark, fx.iso3(F.col("v")), v="us") is None
    assert one(spark, fx.json_object(F.col("v")), v='x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, fx.json_object(F.col("v")), v="none") is None
    assert one(spark, fx.without_fence(F.col("v")), v="```json\n{}\n```") == "{}"
    assert one(spark, fx.truthy(F.col("v")), v=" YES ") is True
    assert one(spark, fx.token_estimate(F.col("v")), v="12345") == 2
    assert one(spark, fx.token_floor(F.col("v")), v="12345") == 1
    assert one(spark, fx.content_type_allowed(F.col("v")), v="Text/HTML; charset=x") is True
    assert one(spark, fx.content_type_allowed(F.col("v")), v="image/png") is False
    assert one(spark, fx.detail_counts(F.col("v"))[0], v="a@b.test, c@d.test") == 2
    assert one(spark, fx.detail_counts(F.col("v"))[2], v="AB123456C") == 1
    assert one(spark, fx.detail_counts(F.col("v"))[2], v="AB 12 34 56 C, GB123456A, QQ123456C") == 1
    assert one(spark, fx.detail_counts(F.col("v"))[1], v="GB82 WEST 1234 5698 7654 32 and DE89370400440532013000, not GB82 WEST 1234 5698 7654 33") == 2
    assert one(spark, fx.similarity(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[-1.0, 0.0]) == 0.0
    assert one(spark, fx.content_type_allowed(F.col("v")), v="application/json-seq") is True and one(spark, fx.content_type_allowed(F.col("v")), v="application/pdf") is False and one(spark, fx.content_type_allowed(F.col("v"), "application/pdf"), v="application/pdf") is True
    assert len(one(spark, fx.short_id(F.col("v")), v="x")) == 16


def test_functions_for_sql(spark):
    from gleanery.functions import tables

    assert set(tables.register(spark)) == {"chunk_windows", "page_blocks", "host_of", "tokens_of", "hybrid_score"}
    got = spark.sql("select w.position, w.content from values ('aaaa bbbb cccc') as t(x), lateral chunk_windows(x, 6, 0, 1) w order by 1").collect()
    assert [r.content for r in got] == ["aaaa", "bbbb", "cccc"]
    assert spark.sql("select b.kind from lateral page_blocks('<h1>A</h1><p>b</p>', 80) b order by b.position").collect()[0].kind == "heading"
    r = spark.sql("select host_of('https://www.a.test/x') h, tokens_of('12345') t, hybrid_score(1, 0.5, null) s").first()
    assert (r.h, r.t) == ("a.test", 2) and abs(r.s - 0.8) < 1e-9
    v = one(spark, tables.hash_vector(F.col("v")), v="x")
    assert len(v) == 8 and abs(sum(x * x for x in v) - 1) < 1e-9
    assert tables.collection_name("ev", 2, "a b/c") == "ev_v2_a_b_c"
    with pytest.raises(ValueError):
        tables.collection_name("ev", 3, "a")
