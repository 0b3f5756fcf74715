"""Queries over search results, claims, syntheses, hits and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as fx
from gleanery.operators import claims as cl
from gleanery.operators import retrieval as rt
from gleanery.operators import rows
from gleanery.plans.registry import query
from gleanery.sources.tables import table

_CLAIMS = "(select distinct claim_id, entity_id, field_name, candidate_value, source_url, analysis_confidence, source_authority_score, freshness_score, entity_match_score from fact_claims)"


def _claims(spark: SparkSession, d: str) -> DataFrame:
    return rows.once(table(spark, d, "fact_claims"), "claim_id", "entity_id", "field_name", "candidate_value", "source_url", "analysis_confidence", "source_authority_score", "freshness_score", "entity_match_score")


@query(
    """
with t as (select distinct result_id, entity_id, title, snippet from search_results where entity_id is not null),
w as (select result_id, entity_id, list_distinct(regexp_extract_all(lower(title), '[\\p{L}\\p{N}_]+')) as q, regexp_extract_all(lower(coalesce(snippet, '')), '[\\p{L}\\p{N}_]+') as s from t),
k as (select result_id, entity_id, case when len(q) > 0 then len(list_intersect(q, s)) / len(q) else 0 end as score from w where q is not null),
r as (select *, row_number() over (partition by entity_id order by score desc, result_id) as rank from k)
select entity_id, cast(rank as int) as rank, result_id, round(score, 6) as score from r where rank <= 5
"""
)
def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five snippets of every entity that have most of the words of their title."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "title", "snippet")
    s = t.where("title is not null").select("entity_id", "result_id", fx.keyword_score(F.col("title"), F.coalesce("snippet", F.lit(""))).alias("score"))
    return rows.top_k(s, ["entity_id"], 5, F.col("score").desc(), F.col("result_id")).select("entity_id", "rank", "result_id", F.round("score", 6).alias("score"))


@query(
    """
with t as (select distinct result_id, title, url, snippet from search_results where title is not null),
n as (select *, regexp_extract(title, '(\\S+ \\S+)$', 1) as name from t),
k as (select *, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ('inc', 'inc.', 'corp', 'corp.', 'corporation', 'ltd', 'ltd.', 'limited', 'llc', 'ag', 'se', 'plc')) as tokens, lower(coalesce(snippet, '')) as low from n)
select result_id, round(case when len(tokens) = 0 then 0 when regexp_matches(low, '(?:^|[^\\p{L}\\p{N}_])' || array_to_string(tokens[1:3], '\\s+') || '(?:[^\\p{L}\\p{N}_]|$)') then 1
  else len(list_filter(tokens, lambda x: contains(low, x))) / len(tokens) end, 6) as score,
  round(case when len(list_filter(tokens, lambda x: contains(lower(url), x))) > 0 then 2.0 else 0.0 end + 0.5 * len(list_filter(tokens, lambda x: contains(lower(concat_ws(' ', url, title, snippet)), x)))
  + case when regexp_matches(lower(concat_ws(' ', url, title, snippet)), 'headquarters|about|company|corporate') then 0.5 else 0.0 end
  + case when regexp_matches(url, 'sec\\.gov|companieshouse') then 0.6 when regexp_matches(lower(url), '/about|/company|/corporate') then 0.4 else 0.0 end, 6) as search_score
from k
"""
)
def entity_match(spark: SparkSession, d: str) -> DataFrame:
    """How well each snippet names the firm of its title, and the result's search score."""
    t = rows.once(table(spark, d, "search_results").where("title is not null"), "result_id", "title", "url", "snippet")
    name = F.regexp_extract("title", r"(\S+ \S+)$", 1)
    return t.select("result_id", F.round(fx.entity_match(name, F.coalesce("snippet", F.lit(""))), 6).alias("score"), F.round(fx.search_score(name, F.col("url"), F.col("title"), F.col("snippet")), 6).alias("search_score"))


@query(
    """
with t as (select distinct result_id, entity_id, url, provider, rank, retrieved_at from search_results),
r as (select *, row_number() over (partition by entity_id, url order by retrieved_at, rank nulls first, result_id) as k from t)
select entity_id, url, result_id, provider from r where k = 1
"""
)
def dedupe_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """The first result of every address of an entity."""
    t = rows.once(table(spark, d, "search_results"), "result_id", "entity_id", "url", "provider", "rank", "retrieved_at")
    return rows.first_seen(t, ["entity_id", "url"], F.col("retrieved_at"), F.col("rank").asc_nulls_first(), F.col("result_id")).select("entity_id", "url", "result_id", "provider")


@query(
    """
with t as (select distinct result_id, entity_id, provider from search_results where entity_id is not null),
p as (select entity_id, min(case provider when 'serper' then 1 when 'tavily' then 2 else 3 end) as best from t group by entity_id)
select t.entity_id, min(t.provider) as provider, count(*) as n from t join p on p.entity_id = t.entity_id and p.best = case t.provider when 'serper' then 1 when 'tavily' then 2 else 3 end group by t.entity_id
"""
)
def provider_failover(spark: SparkSession, d: str) -> DataFrame:
    """Every entity's results from the first provider in order that has any."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "provider")
    order = F.when(F.col("provider") == "serper", 1).when(F.col("provider") == "tavily", 2).otherwise(3)
    per = t.groupBy("entity_id", order.alias("o")).agg(F.min("provider").alias("provider"), F.count("*").alias("n"))
    return per.groupBy("entity_id").agg(F.min_by(F.struct("provider", "n"), "o").alias("b")).select("entity_id", "b.provider", "b.n")


@query(
    f"""
with c as (select entity_id, field_name, candidate_value, count(*) as n from {_CLAIMS} where candidate_value is not null and candidate_value <> '' group by all)
select entity_id, field_name, round(max(n) / sum(n), 6) as agreement, cast(sum(n) as bigint) as n_values, count(*) as n_distinct from c group by all
"""
)
def claim_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Share of the most frequent value among the claims of an entity and field."""
    return cl.agreement(_claims(spark, d), ["entity_id", "field_name"], "candidate_value").withColumn("agreement", F.round("agreement", 6))


@query(
    f"""
with c as (select * from {_CLAIMS}),
v as (select entity_id, field_name, candidate_value, min(claim_id) as first from c where candidate_value is not null and candidate_value <> '' group by all),
m as (select entity_id, field_name, count(*) as n_values, string_agg(candidate_value, '; ' order by first) as candidate_values from v group by all having count(*) > 1),
u as (select entity_id, field_name, count(distinct source_url) as n_urls from c group by all)
select m.*, u.n_urls from m join u on u.entity_id = m.entity_id and u.field_name = m.field_name
"""
)
def conflict_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Conflicting values of an entity and field in the order first seen."""
    return cl.conflicts(_claims(spark, d), ["entity_id", "field_name"], "candidate_value", "source_url", "claim_id")


@query(
    f"""
with c as (select * from {_CLAIMS}), s as (select entity_id, field_name, avg(coalesce(case when isfinite(synthesis_confidence) then synthesis_confidence end, 0)) as synthesis_confidence from (select distinct synthesis_id, entity_id, field_name, synthesis_confidence from synthesis_results where entity_id is not null and field_name is not null) group by all),
m as (select entity_id, field_name, count(*) as n, coalesce(avg(case when isfinite(source_authority_score) then source_authority_score end), 0) as a, coalesce(avg(case when isfinite(freshness_score) then freshness_score end), 0) as f,
  coalesce(avg(case when isfinite(entity_match_score) then entity_match_score end), 0) as r, coalesce(avg(case when isfinite(analysis_confidence) then analysis_confidence end), 0) as x from c group by all),
g as (select entity_id, field_name, max(n) / sum(n) as agreement from (select entity_id, field_name, candidate_value, count(*) as n from c where candidate_value is not null and candidate_value <> '' group by all) group by all)
select s.entity_id, s.field_name, coalesce(m.n, 0) as n_claims,
  round(case when m.n > 0 then (20 * m.a + 12 * m.f + 20 * coalesce(g.agreement, 0) + 12 * m.r + 16 * m.x + 10 * s.synthesis_confidence) / 90 else least(s.synthesis_confidence, 0.2) end, 4) as confidence
from s left join m on m.entity_id = s.entity_id and m.field_name = s.field_name left join g on g.entity_id = s.entity_id and g.field_name = s.field_name
"""
)
def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Confidence of every entity and field from its claims and syntheses."""
    s = rows.once(table(spark, d, "synthesis_results").where("entity_id is not null and field_name is not null"), "synthesis_id", "entity_id", "field_name", "synthesis_confidence")
    s = s.groupBy("entity_id", "field_name").agg(F.avg(F.coalesce(fx.finite(F.col("synthesis_confidence")), F.lit(0.0))).alias("synthesis_confidence"))
    return cl.confidence(_claims(spark, d), s, ["entity_id", "field_name"])


@query(
    """
select provider, count(*) as n, count(distinct url) as n_urls from (select distinct result_id, provider, url from search_results) r
where not exists (select 1 from cached_fetches f where f.url = r.url) group by provider
"""
)
def unfetched_results(spark: SparkSession, d: str) -> DataFrame:
    """Results whose address was never fetched, by provider: an anti-join."""
    t = rows.once(table(spark, d, "search_results"), "result_id", "provider", "url")
    left = t.join(table(spark, d, "cached_fetches").select("url").where("url is not null").distinct(), "url", "left_anti")
    return left.groupBy("provider").agg(F.count("*").alias("n"), F.count_distinct("url").alias("n_urls"))


@query(
    """
select count(*) as n_chunks, count(distinct document_url) as n_documents from (select distinct chunk_id, document_url from chunks) c where chunk_id in (select chunk_id from retrieval_results)
"""
)
def retrieved_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that were retrieved at least once: a semi-join."""
    t = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url")
    found = t.join(table(spark, d, "retrieval_results").select("chunk_id"), "chunk_id", "left_semi")
    return found.agg(F.count("*").alias("n_chunks"), F.count_distinct("document_url").alias("n_documents"))


@query(
    """
with a as (select distinct assessment_id, url from cached_assessments), f as (select url, min(fetch_id) as fetch_id from cached_fetches group by url)
select a.assessment_id, f.fetch_id, f.fetch_id is not null as fetched from a left join f on f.url = a.url
"""
)
def first_match(spark: SparkSession, d: str) -> DataFrame:
    """For every assessment the first fetch of its address, if any."""
    f = table(spark, d, "cached_fetches").groupBy("url").agg(F.min("fetch_id").alias("fetch_id"))
    a = rows.once(table(spark, d, "cached_assessments"), "assessment_id", "url")
    return a.join(f, "url", "left").select("assessment_id", "fetch_id", F.col("fetch_id").isNotNull().alias("fetched"))


# Authority of known domains and of all others; then those of the test tables' own domains.
AUTHORITY = {"microsoft.com": 0.95, "sec.gov": 0.98, "reuters.com": 0.85, "wikipedia.org": 0.45}
OTHERS = 0.3
TEST_AUTHORITY = {"example": 0.6, "test": 0.5}


def authority_of(rows_: DataFrame, key: str, url: str, known: dict[str, float], others: float = OTHERS) -> DataFrame:
    """(key, authority): that of the longest known domain that is the address's host or a parent of it, by equality joins on the host's own suffixes."""
    listed = rows_.sparkSession.createDataFrame(list(known.items()), "domain string, authority double")  # a fixed table
    c = rows_.select(key, F.split(fx.host(F.col(url)), r"\.").alias("p"))
    n = F.size("p")
    suffix = c.select(key, F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice("p", k, n), "."))).alias("domain"))
    hit = suffix.join(F.broadcast(listed), "domain").groupBy(key).agg(F.max_by("authority", F.length("domain")).alias("authority"))
    return rows_.select(key).join(hit, key, "left").select(key, F.coalesce("authority", F.lit(others)).alias("authority"))


@query(
    """
with c as (select distinct claim_id, source_url from fact_claims),
h as (select claim_id, regexp_replace(regexp_extract(lower(source_url), '^[a-z]+://([^/:?#]*)', 1), '^www[.]', '') as host from c),
k as (select * from (values ('microsoft.com', 0.95), ('sec.gov', 0.98), ('reuters.com', 0.85), ('wikipedia.org', 0.45), ('example', 0.6), ('test', 0.5)) t(domain, authority))
select h.claim_id, cast(coalesce(arg_max(k.authority, length(k.domain)), 0.3) as double) as authority from h left join k on h.host = k.domain or ends_with(h.host, '.' || k.domain) group by h.claim_id
"""
)
def source_authority(spark: SparkSession, d: str) -> DataFrame:
    """Authority of every claim's source."""
    return authority_of(rows.once(table(spark, d, "fact_claims"), "claim_id", "source_url"), "claim_id", "source_url", {**AUTHORITY, **TEST_AUTHORITY})


@query(
    """
with h as (select distinct hit_id, query_id, score from retrieval_results)
select query_id, count(*) as n, round(coalesce(avg(case when score is not null and isfinite(score) then score end), 0), 6) as quality from h group by query_id
"""
)
def hit_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of every query's hits, 0 without any."""
    t = rows.once(table(spark, d, "retrieval_results"), "hit_id", "query_id", "score")
    return t.groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg(fx.finite(F.col("score"))), F.lit(0.0)), 6).alias("quality"))


_HYBRID = "0.7 * coalesce(case when isfinite(vector_score) then vector_score end, 0) + 0.2 * coalesce(case when isfinite(keyword_score) then keyword_score end, 0) + 0.1 * coalesce(case when isfinite(table_boost_score) then table_boost_score end, 0)"


@query(
    f"""
with h as (select distinct hit_id, query_id, chunk_id, vector_score, keyword_score, table_boost_score from retrieval_results),
s as (select query_id, hit_id, chunk_id, round({_HYBRID}, 6) as score from h),
r as (select *, row_number() over (partition by query_id order by score desc, hit_id) as rank from s)
select query_id, cast(rank as int) as rank, hit_id, score from r where rank <= 10
"""
)
def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    """Ten hits of every query by the weighted sum of their scores."""
    t = rows.once(table(spark, d, "retrieval_results"), "hit_id", "query_id", "vector_score", "keyword_score", "table_boost_score")
    s = t.select("query_id", "hit_id", F.round(rt.hybrid(F.col("vector_score"), F.col("keyword_score"), F.col("table_boost_score")), 6).alias("score"))
    return rows.top_k(s, ["query_id"], 10, F.col("score").desc(), F.col("hit_id"))


@query(
    f"""
with h as (select distinct hit_id, query_id, vector_score, keyword_score, table_boost_score from retrieval_results),
c as (select *, row_number() over (partition by query_id order by coalesce(case when isfinite(vector_score) then vector_score end, -1) desc, hit_id) as k from h),
s as (select query_id, hit_id, round({_HYBRID}, 6) as score from c where k <= 20),
r as (select *, row_number() over (partition by query_id order by score desc, hit_id) as rank from s)
select query_id, cast(rank as int) as rank, hit_id, score from r where rank <= 5
"""
)
def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Four times as many candidates by vector score as are wanted, ranked again by the hybrid score."""
    t = rows.once(table(spark, d, "retrieval_results"), "hit_id", "query_id", "vector_score", "keyword_score", "table_boost_score")
    v = F.coalesce(fx.finite(F.col("vector_score")), F.lit(-1.0))
    wide = rows.top_k(t, ["query_id"], 20, v.desc(), F.col("hit_id"), name="k")
    s = wide.select("query_id", "hit_id", F.round(rt.hybrid(F.col("vector_score"), F.col("keyword_score"), F.col("table_boost_score")), 6).alias("score"))
    return rows.top_k(s, ["query_id"], 5, F.col("score").desc(), F.col("hit_id"))


_ROUTED = """
with recursive h as (select distinct hit_id, query_id, chunk_id, coalesce(case when isfinite(score) then score end, 0) as score from retrieval_results where chunk_id is not null),
c as (select distinct chunk_id, document_url, section_id, chunk_role, parent_section_id from chunks),
x as (select h.hit_id, h.query_id, h.score, c.* from h join c on c.chunk_id = h.chunk_id),
e as (select distinct document_url, section_id, parent_section_id from c where section_id is not null),
t as (select distinct document_url, section_id as ancestor, section_id as descendant from e union select t.document_url, t.ancestor, e.section_id from t join e on e.document_url = t.document_url and e.parent_section_id = t.descendant where e.section_id <> t.descendant),
b as (select *, row_number() over (partition by query_id, document_url order by score desc, hit_id) as k from x where chunk_role = 'section_summary'),
s as (select distinct query_id, document_url, section_id from b where (k = 1 or (k <= 3 and score >= 0.25)) and section_id is not null and section_id <> '')
"""


@query(_ROUTED + "select query_id, document_url, section_id from s")
def section_select(spark: SparkSession, d: str) -> DataFrame:
    """Sections chosen by the summaries each query hit."""
    x = _hits(spark, d).join(_chunk_roles(spark, d), "chunk_id").where("chunk_role = 'section_summary'")
    return rt.select_sections(x, ["query_id", "document_url"], "section_id", "score", F.col("hit_id"), 3, 0.25)


@query(
    _ROUTED
    + """, w as (select distinct s.query_id, s.document_url, t.descendant as section_id from s join t on t.document_url = s.document_url and t.ancestor = s.section_id),
f as (select x.* from x where exists (select 1 from w where w.query_id = x.query_id and w.document_url = x.document_url and w.section_id = x.section_id)),
m as (select x.* from x where not exists (select 1 from f where f.query_id = x.query_id and f.document_url = x.document_url)),
u as (select *, 'section' as stage from f union all select *, 'document' from m),
r as (select *, row_number() over (partition by query_id order by score desc, hit_id) as rank from u)
select query_id, cast(rank as int) as rank, hit_id, stage from r where rank <= 5
"""
)
def section_route(spark: SparkSession, d: str) -> DataFrame:
    """Two-stage retrieval: sections first, then hits within them, documents where no section was found."""
    e = table(spark, d, "chunks").where("section_id is not null").select("document_url", "section_id", "parent_section_id").distinct()
    below = rows.closure(e, ["document_url"], "section_id", "parent_section_id")
    return rt.two_stage(_hits(spark, d), _chunk_roles(spark, d), below, "query_id", "score", "hit_id")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    t = rows.once(table(spark, d, "retrieval_results").where("chunk_id is not null"), "hit_id", "query_id", "chunk_id", "score")
    return t.withColumn("score", F.coalesce(fx.finite(F.col("score")), F.lit(0.0)))


def _chunk_roles(spark: SparkSession, d: str) -> DataFrame:
    return rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "section_id", "chunk_role")


@query(
    """
with q as (select vec_id, label, embedding from embeddings where vec_id % 20 = 0),
p as (select q.vec_id as query_id, e.vec_id as item_id, q.label, round(list_cosine_similarity(cast(q.embedding as double[]), cast(e.embedding as double[])), 9) as score from q join embeddings e on e.label = q.label and e.vec_id <> q.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from p)
select query_id, cast(rank as int) as rank, item_id, round(score, 6) as score from r where rank <= 5
"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors within the label of every twentieth vector, which are the queries, against all vectors."""
    e = table(spark, d, "embeddings")
    found = rt.vector_topk(e.where("vec_id % 20 = 0"), e, "label", "vec_id", "vec_id", "embedding", 5)
    return found.select("query_id", "rank", "item_id", F.round("score", 6).alias("score"))


@query(
    """
with c as (select distinct chunk_id, chunk_type, content from chunks)
select chunk_type, count(*) as n, count(*) filter (where chunk_type = 'table' and (len(list_intersect(regexp_extract_all(lower(content), '[\\p{L}\\p{N}_]+'), ['revenue','profit','loss','earnings','ebitda','eps','shares','employees','headcount','staff','salary','wage','cost','price','total','sum','count','number','million','billion','thousand','percent','quarterly','annual','fiscal','q1','q2','q3','q4','fy','ytd'])) > 0 or regexp_matches(content, '[$€£¥%]'))) as n_boosted from c group by chunk_type
"""
)
def table_boosts(spark: SparkSession, d: str) -> DataFrame:
    """Table chunks that read as figures."""
    t = rows.once(table(spark, d, "chunks"), "chunk_id", "chunk_type", "content")
    return t.groupBy("chunk_type").agg(F.count("*").alias("n"), F.count_if(fx.table_boost(F.coalesce("content", F.lit("")), F.col("chunk_type")) > 0).alias("n_boosted"))


@query(
    """
with s as (select distinct synthesis_id, field_name, normalized_value, synthesis_confidence from synthesis_results), v as (select field_name, canonical_value from canonical_values)
select s.field_name, count(*) as n, count(v.canonical_value) as n_match, round(count(v.canonical_value) / count(*), 6) as match_rate, count(*) filter (where s.normalized_value is null or trim(s.normalized_value) = '') as n_blank,
  round(coalesce(avg(case when v.canonical_value is not null and isfinite(s.synthesis_confidence) then s.synthesis_confidence end), 0), 6) as mean_confidence
from s left join v on v.field_name = s.field_name and v.canonical_value = s.normalized_value group by s.field_name
"""
)
def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    """Syntheses against the expected spellings: match rate and mean confidence by field."""
    s = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "field_name", "normalized_value", "synthesis_confidence")
    v = table(spark, d, "canonical_values").select("field_name", F.col("canonical_value").alias("normalized_value"), F.lit(1).alias("hit"))
    x = s.join(v, ["field_name", "normalized_value"], "left")
    return x.groupBy("field_name").agg(
        F.count("*").alias("n"), F.count("hit").alias("n_match"), F.round(F.count("hit") / F.count("*"), 6).alias("match_rate"),
        F.count_if(F.col("normalized_value").isNull() | (F.trim("normalized_value") == "")).alias("n_blank"),
        F.round(F.coalesce(F.avg(F.when(F.col("hit").isNotNull(), fx.finite(F.col("synthesis_confidence")))), F.lit(0.0)), 6).alias("mean_confidence"),
    )


@query(
    """
with p as (select provider, domain, count(*) as n from (select distinct result_id, provider, lower(trim(domain)) as domain from search_results where domain is not null) group by all)
select a.provider as provider_a, b.provider as provider_b, count(*) as n_common, cast(sum(a.n) as bigint) as n_a, cast(sum(b.n) as bigint) as n_b from p a join p b on a.domain = b.domain and a.provider < b.provider group by all
"""
)
def scenario_compare(spark: SparkSession, d: str) -> DataFrame:
    """Providers compared in pairs by the domains both found."""
    t = table(spark, d, "search_results").where("domain is not null").select("result_id", "provider", F.lower(F.trim("domain")).alias("domain")).distinct()
    p = t.groupBy("provider", "domain").agg(F.count("*").alias("n"))
    # per domain there are as many rows as providers, so the pairs are of providers only
    a, b = p.select("domain", F.col("provider").alias("provider_a"), F.col("n").alias("x")), p.select("domain", F.col("provider").alias("provider_b"), F.col("n").alias("y"))
    return a.join(b, "domain").where("provider_a < provider_b").groupBy("provider_a", "provider_b").agg(F.count("*").alias("n_common"), F.sum("x").alias("n_a"), F.sum("y").alias("n_b"))


@query(
    """
with r as (select distinct result_id, entity_id, url from search_results), c as (select distinct claim_id, entity_id, source_url from fact_claims), s as (select distinct synthesis_id, entity_id, unnest(supporting_urls) as url from synthesis_results),
u as (select 'search' as kind, entity_id, url from r union all select 'analysis', entity_id, source_url from c union all select 'synthesis', entity_id, url from s)
select kind, count(*) as n, count(distinct entity_id) as n_entities, count(distinct url) as n_urls from u group by kind
"""
)
def lineage_union(spark: SparkSession, d: str) -> DataFrame:
    """Sources of the values: searched, claimed and synthesised, as one set."""
    r = rows.once(table(spark, d, "search_results"), "result_id", "entity_id", "url").select(F.lit("search").alias("kind"), "entity_id", "url")
    c = rows.once(table(spark, d, "fact_claims"), "claim_id", "entity_id", "source_url").select(F.lit("analysis").alias("kind"), "entity_id", F.col("source_url").alias("url"))
    s = table(spark, d, "synthesis_results").select("synthesis_id", "entity_id", F.explode("supporting_urls").alias("url")).distinct().select(F.lit("synthesis").alias("kind"), "entity_id", "url")
    return r.unionByName(c).unionByName(s).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("n_entities"), F.count_distinct("url").alias("n_urls"))


_STORE = """with c as (select distinct chunk_id, document_url, index, chunk_type from chunks), t as (select distinct document_url from c where chunk_type = 'table'),
n as (select c.* from c join t on t.document_url = c.document_url where c.index % 2 = 0)"""


@query(_STORE + " select document_url, count(*) as n_chunks from (select * from c where document_url not in (select document_url from n) union all select * from n) group by document_url")
def document_upsert(spark: SparkSession, d: str) -> DataFrame:
    """A store after documents with tables were indexed anew with every other chunk."""
    c, n = _store(spark, d)
    return rows.upsert_documents(c, n, "document_url", "chunk_id").groupBy("document_url").agg(F.count("*").alias("n_chunks"))


@query(_STORE + " select document_url, count(*) as n_stale from c where document_url in (select document_url from n) and chunk_id not in (select chunk_id from n) group by document_url")
def stale_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks which that upsert removes."""
    c, n = _store(spark, d)
    return rows.stale_ids(c, n, "document_url", "chunk_id").groupBy("document_url").agg(F.count("*").alias("n_stale"))


def _store(spark: SparkSession, d: str):
    c = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "index", "chunk_type")
    tables = c.where("chunk_type = 'table'").select("document_url").distinct()
    return c, c.join(tables, "document_url", "left_semi").where("index % 2 = 0")


@query(
    """
with c as (select distinct claim_id, analysis_confidence, source_authority_score, freshness_score, entity_match_score, candidate_value, source_url from fact_claims)
select claim_id, concat_ws('; ', case when analysis_confidence is null or not isfinite(analysis_confidence) or analysis_confidence < 0 or analysis_confidence > 1 then 'analysis_confidence: must lie in 0..1' end,
  case when source_authority_score is null or not isfinite(source_authority_score) or source_authority_score < 0 or source_authority_score > 1 then 'source_authority_score: must lie in 0..1' end,
  case when freshness_score is null or not isfinite(freshness_score) or freshness_score < 0 or freshness_score > 1 then 'freshness_score: must lie in 0..1' end,
  case when entity_match_score is null or not isfinite(entity_match_score) or entity_match_score < 0 or entity_match_score > 1 then 'entity_match_score: must lie in 0..1' end,
  case when candidate_value is null or trim(candidate_value) = '' then 'candidate_value: must not be blank' end) as violations from c
"""
)
def schema_violations(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with each claim, as a list of constraints that fail."""
    names = ("analysis_confidence", "source_authority_score", "freshness_score", "entity_match_score")
    t = rows.once(table(spark, d, "fact_claims"), "claim_id", "candidate_value", *names)
    ok = lambda c: F.coalesce(fx.finite(F.col(c)).between(0, 1), F.lit(False))
    bad = [F.when(~ok(c), F.lit(f"{c}: must lie in 0..1")) for c in names] + [F.when(F.col("candidate_value").isNull() | (F.trim("candidate_value") == ""), F.lit("candidate_value: must not be blank"))]
    return t.select("claim_id", F.concat_ws("; ", *bad).alias("violations"))


@query(
    """
with n as (select r_name, c_nationkey, sum(l_extendedprice * (1 - l_discount)) as amount from lineitem join orders on o_orderkey = l_orderkey left join customer on c_custkey = o_custkey left join nation on n_nationkey = c_nationkey left join region on r_regionkey = n_regionkey group by all),
t as (select r_name, count(*) as n_rows, sum(amount) as total from n group by r_name), g as (select sum(total) as whole, sum(total) filter (where r_name is not null) as listed from t)
select r_name, n_rows, round(total, 2) as total, round(100 * total / whole, 4) as percentage, abs(listed - whole) <= 0.02 * whole as sums_agree from t cross join g where r_name is not null
"""
)
def revenue_rowsum(spark: SparkSession, d: str) -> DataFrame:
    """Breakdown of revenue by region: each share, and whether the listed rows come to within two per cent of all revenue."""
    li = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("a"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == c.c_custkey, "left").groupBy("c_nationkey").agg(F.sum("a").alias("amount"))
    n = n.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    t = n.groupBy("r_name").agg(F.count("*").alias("n_rows"), F.sum("amount").alias("total"))
    every = Window.partitionBy()  # one row per region
    whole, listed = F.sum("total").over(every), F.sum(F.when(F.col("r_name").isNotNull(), F.col("total"))).over(every)
    out = t.select("r_name", "n_rows", F.round("total", 2).alias("total"), F.round(100 * F.col("total") / whole, 4).alias("percentage"), (F.abs(listed - whole) <= 0.02 * whole).alias("sums_agree"))
    return out.where("r_name is not null")


@query(
    """
with r as (select r_name, count(*) as n from customer join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey group by r_name), g as (select count(*) as whole from customer)
select r_name, n as headcount, whole, (select sum(n) from r) <= 1.05 * whole as plausible from r cross join g
"""
)
def headcount_check(spark: SparkSession, d: str) -> DataFrame:
    """Counts by region against the global count, five per cent allowed."""
    c = table(spark, d, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    r = c.join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_name").agg(F.sum("n").alias("headcount"))
    whole = F.sum("headcount").over(Window.partitionBy())
    return r.select("r_name", "headcount", whole.alias("whole"), (F.sum(F.when(F.col("r_name").isNotNull(), F.col("headcount"))).over(Window.partitionBy()) <= 1.05 * whole).alias("plausible")).where("r_name is not null")


@query(
    """
with f as (select distinct fetch_id, url, fetch_success, error from cached_fetches)
select url, count(*) as n, count(*) filter (where fetch_success) as n_hit, count(*) filter (where not fetch_success) as n_failed, count(*) filter (where fetch_success is null) as n_unknown, bool_and(not coalesce(fetch_success, true)) as all_failed, arg_max(error, fetch_id) as last_error from f group by url
"""
)
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of the fetches of every address, and whether all failed."""
    t = rows.once(table(spark, d, "cached_fetches"), "fetch_id", "url", "fetch_success", "error")
    ok = F.col("fetch_success")
    return t.groupBy("url").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_hit"), F.count_if(~ok).alias("n_failed"), F.count_if(ok.isNull()).alias("n_unknown"), F.bool_and(~F.coalesce(ok, F.lit(True))).alias("all_failed"), F.max_by("error", F.when(F.col("error").isNotNull(), F.col("fetch_id"))).alias("last_error"))


@query(
    """
select source_url, round(coalesce(max(case when isfinite(analysis_confidence) then analysis_confidence end), 0), 6) as confidence, count(*) as n_claims from (select distinct claim_id, source_url, analysis_confidence from fact_claims) group by source_url
"""
)
def source_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Greatest confidence of a source's claims, 0 without any."""
    t = rows.once(table(spark, d, "fact_claims"), "claim_id", "source_url", "analysis_confidence")
    return t.groupBy("source_url").agg(F.round(F.coalesce(F.max(fx.finite(F.col("analysis_confidence"))), F.lit(0.0)), 6).alias("confidence"), F.count("*").alias("n_claims"))


@query(
    """
select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 4) as before from events
"""
)
def running_sum(spark: SparkSession, d: str) -> DataFrame:
    """What every user had spent before each event."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "value")
    return rows.running_before(e, ["user_id"], ["ts", "event_id"], "value", "before", F.date_trunc("week", F.col("ts"))).select("event_id", F.round("before", 4).alias("before"))


@query(
    """
with c as (select distinct chunk_id, document_url, index, length(content) as n from chunks where content is not null),
b as (select *, coalesce(sum(n) over (partition by document_url order by index, chunk_id rows between unbounded preceding and 1 preceding), 0) as before from c)
select chunk_id, cast(before as bigint) as used_before, cast(greatest(0, least(n, 6000 - before)) as bigint) as taken, cast(greatest(0, 6000 - before - greatest(0, least(n, 6000 - before))) as bigint) as budget_left from b
"""
)
def char_budget(spark: SparkSession, d: str) -> DataFrame:
    """Characters each chunk gets of its document's budget, in order."""
    t = table(spark, d, "chunks").where("content is not null").select("chunk_id", "document_url", "index", F.char_length("content").cast("bigint").alias("n")).distinct()
    return rows.within_budget(t, ["document_url"], ["index", "chunk_id"], "n", 6000, F.floor(F.col("index") / 64)).select("chunk_id", "used_before", F.col("taken").cast("bigint").alias("taken"), "budget_left")


@query(
    """
with f as (select distinct fetch_id, url, cached_at from cached_fetches)
select url, arg_max(fetch_id, (cached_at, fetch_id)) as newest, cast(epoch(max(cached_at)) - epoch(min(cached_at)) as bigint) as span_s from f group by url
"""
)
def newest_fetch(spark: SparkSession, d: str) -> DataFrame:
    """Newest fetch of every address and the seconds since its first."""
    t = rows.once(table(spark, d, "cached_fetches"), "fetch_id", "url", "cached_at")
    at = lambda f: f(F.unix_micros("cached_at")) / 1e6
    return t.groupBy("url").agg(F.max_by("fetch_id", F.struct("cached_at", "fetch_id")).alias("newest"), F.round(at(F.max) - at(F.min)).cast("bigint").alias("span_s"))


@query(
    """
with g as (select event_id, cast(epoch_us(ts) as bigint) as t, lag(cast(epoch_us(ts) as bigint)) over (partition by user_id, event_type order by ts, event_id) as p from events)
select event_id, case when p is null then 'miss' when t - p > 604800000000 then 'expired' when t - p > 259200000000 then 'stale' else 'hit' end as status from g
"""
)
def cache_status(spark: SparkSession, d: str) -> DataFrame:
    """Each access as a hit, stale after three days, expired after seven, or a first miss."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    g = rows.previous(e, ["user_id", "event_type"], ["t", "event_id"], "t", "p", F.floor(F.col("t") / 604_800_000_000)).select("event_id", (F.col("t") - F.col("p")).alias("gap"))
    return g.select("event_id", F.when(F.col("gap").isNull(), "miss").when(F.col("gap") > 604800000000, "expired").when(F.col("gap") > 259200000000, "stale").otherwise("hit").alias("status"))


@query(
    """
select event_id, coalesce(max(case when event_type = 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) = 1 as broken from events
"""
)
def circuit_breaker(spark: SparkSession, d: str) -> DataFrame:
    """Whether a user's circuit was open at each event: after the first error it stays open. The first error is one row per user, found by a partial aggregate; no sort."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.struct("ts", "event_id").alias("at"))
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("at").alias("first"))
    return e.join(first, "user_id", "left").select("event_id", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("broken"))


@query(
    """
select event_type, cast(json_extract(props, '$.k') as bigint) % 10 as k, count(*) as n, round(avg(value), 6) as mean_value from events group by all
"""
)
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """Events by a field of their JSON object, read with a schema."""
    j = F.from_json(fx.json_object(fx.without_fence(F.col("props"))), "k bigint")
    return table(spark, d, "events").groupBy("event_type", (j["k"] % 10).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query(
    """
select synthesis_id, case when regexp_matches(upper(trim(normalized_value)), '^[A-Z]{3}$') then upper(trim(normalized_value)) end as code,
  round(case when regexp_matches(upper(trim(normalized_value)), '^[A-Z]{3}$') then s else least(s, 0.49) end, 6) as confidence
from (select distinct synthesis_id, normalized_value, coalesce(case when isfinite(synthesis_confidence) then synthesis_confidence end, 0.5) as s from synthesis_results where normalized_value is not null)
"""
)
def iso_codes(spark: SparkSession, d: str) -> DataFrame:
    """Values that are three-letter codes; others are nulled and their confidence capped."""
    t = rows.once(table(spark, d, "synthesis_results").where("normalized_value is not null"), "synthesis_id", "normalized_value", "synthesis_confidence")
    code, own = fx.iso3(F.col("normalized_value")), F.coalesce(fx.finite(F.col("synthesis_confidence")), F.lit(0.5))
    return t.select("synthesis_id", code.alias("code"), F.round(F.when(code.isNotNull(), own).otherwise(F.least(own, F.lit(0.49))), 6).alias("confidence"))


@query(
    """
with s as (select distinct synthesis_id, supporting_urls, field_name, entity_id from synthesis_results)
select synthesis_id, array_to_string(list_transform(supporting_urls, lambda x: '[redacted]'), ',') as supporting_urls, '[redacted]' as entity_id, field_name from s
"""
)
def redaction(spark: SparkSession, d: str) -> DataFrame:
    """Syntheses with their entities and every nested address replaced."""
    t = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "supporting_urls", "field_name", "entity_id")
    return t.select("synthesis_id", F.array_join(F.transform("supporting_urls", lambda x: F.lit("[redacted]")), ",").alias("supporting_urls"), F.lit("[redacted]").alias("entity_id"), "field_name")


@query(
    """
with h as (select distinct hit_id, query_id, chunk_id, coalesce(case when isfinite(score) then score end, 0) as score from retrieval_results), c as (select distinct chunk_id, content from chunks where content is not null),
r as (select h.*, c.content, row_number() over (partition by query_id order by score desc, hit_id) as k from h join c on c.chunk_id = h.chunk_id)
select query_id, md5(string_agg('[' || k || '] ' || substr(content, 1, 1500), chr(10) || '---' || chr(10) order by k)) as context_hash, count(*) as n from r where k <= 3 group by query_id
"""
)
def context_labels(spark: SparkSession, d: str) -> DataFrame:
    """The three best chunks of every query as one numbered text."""
    c = rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "content")
    h = _hits(spark, d).join(c.select("chunk_id"), "chunk_id", "left_semi")
    best = rows.top_k(h, ["query_id"], 3, F.col("score").desc(), F.col("hit_id"), name="k").select("query_id", "chunk_id", "k").join(c, "chunk_id")
    g = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "content"))).alias("a"))
    text = F.array_join(F.transform("a", lambda s: F.concat(F.lit("["), s["k"].cast("string"), F.lit("] "), F.substring(s["content"], 1, 1500))), "\n---\n")
    return g.select("query_id", F.md5(text.cast("binary")).alias("context_hash"), F.size("a").cast("bigint").alias("n"))


@query(
    """
select o_orderpriority, cast(sum(cast(o_totalprice as decimal(18, 2)) * case when o_orderstatus = 'O' then 1000 when o_orderstatus = 'P' then 1000000 else 1 end) as decimal(38, 2)) as scaled, cast(sum(cast(o_totalprice as decimal(18, 2))) as decimal(38, 2)) as unscaled from orders group by 1
"""
)
def money_scale(spark: SparkSession, d: str) -> DataFrame:
    """Decimal sums with and without each amount's unit multiplier."""
    a = F.col("o_totalprice").cast("decimal(18,2)")
    m = F.when(F.col("o_orderstatus") == "O", 1000).when(F.col("o_orderstatus") == "P", 1000000).otherwise(1)
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(a * m).cast("decimal(38,2)").alias("scaled"), F.sum(a).cast("decimal(38,2)").alias("unscaled"))


@query(
    """
with v as (select distinct claim_id, field_name, candidate_value, analysis_confidence from fact_claims)
select claim_id, nullif(trim(candidate_value, ' '), '') as value, round(coalesce(nullif(case when isfinite(analysis_confidence) then analysis_confidence end, 0), 0.5), 6) as confidence, try_cast(trim(candidate_value, ' ') as bigint) as number, lower(trim(candidate_value, ' ')) in ('1', 'true', 'yes', 'on') as flag from v where candidate_value is not null and trim(candidate_value, ' ') <> ''
"""
)
def claim_rows(spark: SparkSession, d: str) -> DataFrame:
    """Claims as they are built from an answer: blank values go, a missing or zero confidence counts 0.5."""
    t = rows.once(table(spark, d, "fact_claims").where("candidate_value is not null and trim(candidate_value) <> ''"), "claim_id", "candidate_value", "analysis_confidence")
    v = F.trim("candidate_value")
    conf = F.coalesce(F.nullif(fx.finite(F.col("analysis_confidence")), F.lit(0.0)), F.lit(0.5))
    return t.select("claim_id", v.alias("value"), F.round(conf, 6).alias("confidence"), F.expr("try_cast(trim(candidate_value) as bigint)").alias("number"), fx.truthy(F.col("candidate_value")).alias("flag"))


#: What a refined query adds, round by round.
SUFFIXES = ("group results year", "plant town region supplier", "court notice board members")


def _refined_sql(rounds: int) -> str:
    """The rounds of refinement one after the other: qN has the open queries of a round, sN their quality."""
    words = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
    parts = [
        "t as (select distinct result_id, entity_id, title, snippet from search_results where entity_id is not null and title is not null)",
        r"x as (select entity_id, regexp_extract_all(lower(snippet), '[\p{L}\p{N}_]+') as w from t where snippet is not null)",
        "q0 as (select entity_id, arg_min(title, result_id) as query from t group by entity_id)",
    ]
    for k in range(rounds):
        q = words.format("q.query")
        parts.append(f"s{k} as (select q.entity_id, q.query, {k} as round, coalesce(round(avg(case when x.w is not null then len(list_intersect({q}, x.w)) / len({q}) end), 6), 0) as quality from q{k} q left join x on x.entity_id = q.entity_id group by q.entity_id, q.query)")
        more = "[" + ", ".join(f"'{w}'" for w in SUFFIXES[k % len(SUFFIXES)].split(" ")) + "]"
        parts.append(f"q{k + 1} as (select entity_id, query || ' ' || array_to_string(list_filter({more}, lambda z: not list_contains(string_split(lower(query), ' '), z)), ' ') as query from s{k} where quality < 0.4)")
    union = " union all ".join(f"select * from s{k}" for k in range(rounds))
    return f"with {', '.join(parts)}, a as ({union}), r as (select *, row_number() over (partition by entity_id order by quality desc, round) as best, count(*) over (partition by entity_id) as rounds from a) select entity_id as query_id, query, quality, round as best_round, rounds from r where best = 1"


@query(_refined_sql(3))
def refine_loop(spark: SparkSession, d: str) -> DataFrame:
    """Queries of titles refined up to three times against their entity's snippets, each with its best round."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null and title is not null"), "result_id", "entity_id", "title", "snippet")
    queries = t.groupBy("entity_id").agg(F.min_by("title", "result_id").alias("title"))
    texts = t.where("snippet is not null").select("entity_id", fx.words(F.col("snippet")).alias("w"))

    def search(open_rows):
        q = open_rows.select("query_id", F.array_distinct(fx.words(F.col("query"))).alias("q"))
        pairs = q.join(texts.withColumnRenamed("entity_id", "query_id"), "query_id")
        return pairs.groupBy("query_id").agg(F.round(F.avg(F.size(F.array_intersect("q", "w")) / F.size("q")), 6).alias("quality"))

    return rt.refine(queries, "entity_id", "title", search, 0.4, 3, SUFFIXES)


@query(
    """
select user_id, cast(epoch_us(date_trunc('day', ts)) as bigint) as day_us, count(*) as n_spans, round(sum(value), 4) as total, round(max(value), 4) as longest, arg_max(event_type, (ts, event_id)) as last_type, count(*) filter (where event_type = 'error') as n_errors from events group by 1, 2
"""
)
def span_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Spans of every user and day: number, total, longest, the last one's kind and the errors."""
    t = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    g = t.groupBy("user_id", F.date_trunc("day", F.col("ts").cast("timestamp")).alias("day"))
    out = g.agg(F.count("*").alias("n_spans"), F.round(F.sum("value"), 4).alias("total"), F.round(F.max("value"), 4).alias("longest"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"), F.count_if(F.col("event_type") == "error").alias("n_errors"))
    return out.select("user_id", F.unix_micros("day").alias("day_us"), "n_spans", "total", "longest", "last_type", "n_errors")


@query(
    """
with c as (select distinct chunk_id, document_url, token_count, content from chunks)
select document_url, cast(sum(coalesce(token_count, length(content) // 4)) as bigint) as tokens, count(*) filter (where coalesce(token_count, 0) > 0) as n_counted, bool_and(token_count is not null) as all_counted from c group by document_url
"""
)
def token_sums(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of every document, counted where they were recorded and estimated elsewhere."""
    t = table(spark, d, "chunks").select("chunk_id", "document_url", "token_count", fx.token_floor(F.col("content")).alias("guess")).distinct()
    return t.groupBy("document_url").agg(F.sum(F.coalesce(F.col("token_count").cast("bigint"), F.col("guess"))).alias("tokens"), F.count_if(F.coalesce("token_count", F.lit(0)) > 0).alias("n_counted"), F.bool_and(F.col("token_count").isNotNull()).alias("all_counted"))


@query(
    """
with h as (select distinct hit_id, query_id, chunk_id, coalesce(case when isfinite(score) then score end, 0) as score from retrieval_results where chunk_id is not null), c as (select distinct chunk_id, document_url from chunks),
b as (select c.document_url, h.chunk_id, max(h.score) as score from h join c on c.chunk_id = h.chunk_id group by all),
r as (select *, row_number() over (partition by document_url order by score desc, chunk_id) as k from b),
d as (select distinct document_url from c)
select d.document_url, string_agg(r.chunk_id, ',' order by r.k) as chunk_ids, count(r.chunk_id) as n from d left join r on r.document_url = d.document_url and r.k <= 3 group by d.document_url
"""
)
def retrieved_by_document(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its three best retrieved chunks, in order; documents without a hit stay."""
    c = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url")
    best = _hits(spark, d).groupBy("chunk_id").agg(F.max("score").alias("score")).join(c, "chunk_id")
    top = rows.top_k(best, ["document_url"], 3, F.col("score").desc(), F.col("chunk_id"), name="k")
    listed = top.groupBy("document_url").agg(F.array_sort(F.collect_list(F.struct("k", "chunk_id"))).alias("a"))
    out = c.select("document_url").distinct().join(listed, "document_url", "left")
    return out.select("document_url", F.nullif(F.array_join(F.col("a.chunk_id"), ","), F.lit("")).alias("chunk_ids"), F.coalesce(F.size("a"), F.lit(0)).cast("bigint").alias("n"))


@query(
    """
with s as (select source, sum(n) as n from (select lower(replace(trim(source), '-', '_')) as source, count(*) as n from documents where source is not null group by all) group by source)
select t.source, t.target_share, coalesce(s.n, 0) as n_documents, round(coalesce(s.n, 0) / (select count(*) from documents), 6) as share from source_targets t left join s on s.source = t.source
"""
)
def lookup_default(spark: SparkSession, d: str) -> DataFrame:
    """A reference list with what was counted for each entry, 0 where nothing was."""
    t = table(spark, d, "documents").groupBy(F.lower(F.replace(F.trim("source"), F.lit("-"), F.lit("_"))).alias("source")).agg(F.count("*").alias("n"))
    share = t.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row per source
    return table(spark, d, "source_targets").join(share, "source", "left").select("source", "target_share", F.coalesce("n", F.lit(0)).alias("n_documents"), F.round(F.coalesce("share", F.lit(0.0)), 6).alias("share"))
