"""Queries of the steps between search and answer: plans, providers, acceptance, caching, sectioned retrieval, contexts, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as fx
from gleanery.operators import chunking, folds, parsing, rows
from gleanery.operators import retrieval as rt
from gleanery.plans.documents import _BLOCKS_SQL
from gleanery.plans.evidence import _hits
from gleanery.plans.registry import query
from gleanery.sources.responses import response_rows
from gleanery.sources.tables import spread, table

#: Questions asked of a firm: always, and only of one whose name carries a legal form.
ASKED, ASKED_WITH_FORM = ('"{}" annual report', '"{}" plants and offices', '"{}" news'), '"{}" "{}" register entry'


@query(
    """
with s as (select s_suppkey, s_name, case when s_suppkey % 3 = 0 then 'Ltd' else '' end as form from supplier),
q as (select s_suppkey, s_name, form, unnest([1, 2, 3, 4]) as ordinal from s)
select s_suppkey, cast(ordinal as int) as ordinal, case ordinal when 1 then '"' || s_name || '" annual report' when 2 then '"' || s_name || '" plants and offices' when 3 then '"' || s_name || '" news' else '"' || s_name || '" "' || form || '" register entry' end as query, 'Where is ' || s_name || ' run from?' as question
from q where ordinal < 4 or form <> ''
"""
)
def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """Search queries of every supplier in order, one more where it has a legal form, and the question asked of its documents."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_suppkey") % 3 == 0, "Ltd").otherwise("").alias("form"))
    filled = lambda t, *c: F.concat(*[x for k, part in enumerate(t.split("{}")) for x in ((F.lit(part), c[k]) if k < len(c) else (F.lit(part),))])
    asked = F.array_compact(F.array(*[filled(t, F.col("s_name")) for t in ASKED], F.when(F.col("form") != "", filled(ASKED_WITH_FORM, F.col("s_name"), F.col("form")))))
    out = s.select("s_suppkey", "s_name", F.posexplode(asked).alias("k", "query"))
    return out.select("s_suppkey", (F.col("k") + 1).alias("ordinal"), "query", F.concat(F.lit("Where is "), F.col("s_name"), F.lit(" run from?")).alias("question"))


@query(
    """
with r as (select distinct result_id, entity_id, provider, url, title, snippet from search_results where entity_id is not null),
p as (select entity_id, provider, url, title, snippet, result_id, cast(floor(result_id / 8) as bigint) as answer from r)
select entity_id, provider, answer, coalesce(url, '') as url, coalesce(title, '') as title, coalesce(snippet, '') as snippet, cast(row_number() over (partition by entity_id, provider, answer order by result_id) as int) as rank,
  coalesce(regexp_extract(lower(url), '^[a-z]+://([^/?#]*)', 1), '') as domain from p
"""
)
def provider_responses(spark: SparkSession, d: str) -> DataFrame:
    """Results packed into answers of up to eight in the shape of their provider, and read from these again."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "provider", "url", "title", "snippet").withColumn("answer", F.floor(F.col("result_id") / 8))
    shape = F.when(F.col("provider") == "serper", "organic").otherwise("results").alias("shape")
    keys = ["entity_id", "provider", "answer"]
    packed = t.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("result_id", "url", "title", "snippet"))).alias("a"))  # at most eight ids have one answer number
    entries = lambda url, text: F.transform("a", lambda e: F.struct(e["url"].alias(url), e["title"].alias("title"), e["snippet"].alias(text)))
    body = F.when(F.col("provider") == "serper", F.to_json(F.struct(entries("link", "snippet").alias("organic")))).otherwise(F.to_json(F.struct(entries("url", "content").alias("results"))))
    return response_rows(packed.select(*keys, shape, body.alias("body")), "body", "shape", *keys)


_PROVIDERS = "case provider when 'serper' then 1 when 'tavily' then 2 else 3 end"


@query(
    f"""
with r as (select distinct result_id, entity_id, provider, snippet from search_results where entity_id is not null),
o as (select *, {_PROVIDERS} as o from r), f as (select entity_id, o, min(case when snippet is null then result_id end) as broke from o group by all),
k as (select o.entity_id, o.o, any_value(f.broke) as broke, count(*) filter (where f.broke is null or o.result_id < f.broke) as kept from o join f on f.entity_id = o.entity_id and f.o = o.o group by all),
c as (select *, sum(kept) over (partition by entity_id order by o) as so_far from k),
s as (select entity_id, min(o) as stop from c where broke is null and so_far > 0 group by entity_id)
select c.entity_id, cast(sum(c.kept) as bigint) as n, cast(count(*) as bigint) as n_asked, cast(count(c.broke) as bigint) as n_failed from c left join s on s.entity_id = c.entity_id where c.o <= coalesce(s.stop, 9) group by c.entity_id
"""
)
def failover_partial(spark: SparkSession, d: str) -> DataFrame:
    """Providers asked in order until one has answered without failing and something was found: one that fails midway (here at a null snippet) keeps what it gave before."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "provider", "snippet")
    t = t.select("entity_id", "result_id", F.when(F.col("provider") == "serper", 1).when(F.col("provider") == "tavily", 2).otherwise(3).alias("o"), F.col("snippet").isNull().alias("bad"))
    broke = t.groupBy("entity_id", "o").agg(F.min(F.when(F.col("bad"), F.col("result_id"))).alias("broke"))
    kept = t.join(broke, ["entity_id", "o"]).groupBy("entity_id", "o").agg(F.first("broke").alias("broke"), F.count_if(F.col("broke").isNull() | (F.col("result_id") < F.col("broke"))).alias("kept"))
    per = kept.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("o", "kept", "broke"))).alias("p"))  # one entry per provider
    so_far = lambda k: F.aggregate(F.slice("p", 1, k + 1), F.lit(0).cast("bigint"), lambda s, x: s + x["kept"])
    stops = F.filter(F.transform("p", lambda x, k: F.when(x["broke"].isNull() & (so_far(k) > 0), x["o"])), lambda x: x.isNotNull())
    asked = F.filter("p", lambda x: x["o"] <= F.coalesce(F.array_min(stops), F.lit(9)))
    return per.select("entity_id", asked.alias("p")).select("entity_id", F.aggregate("p", F.lit(0).cast("bigint"), lambda s, x: s + x["kept"]).alias("n"), F.size("p").cast("bigint").alias("n_asked"), F.size(F.filter("p", lambda x: x["broke"].isNotNull())).cast("bigint").alias("n_failed"))


@query(
    """
with u as (select result_id as id, entity_id, url, 1 as source, coalesce(rank, 99) as k from (select distinct result_id, entity_id, url, rank from search_results where entity_id is not null)
  union all select claim_id, entity_id, source_url, 2, 0 from (select distinct claim_id, entity_id, source_url from fact_claims where entity_id is not null)),
o as (select *, row_number() over (partition by entity_id order by source, k, id) as ordinal from u),
f as (select *, row_number() over (partition by entity_id, url order by ordinal) as again from o)
select entity_id, cast(ordinal as int) as ordinal, source, id from f where again = 1
"""
)
def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of every entity from results, then from claims, numbered in that order, each the first time it comes."""
    s = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "url", "rank").select(F.col("result_id").alias("id"), "entity_id", "url", F.lit(1).alias("source"), F.coalesce("rank", F.lit(99)).alias("k"))
    c = rows.once(table(spark, d, "fact_claims").where("entity_id is not null"), "claim_id", "entity_id", "source_url").select(F.col("claim_id").alias("id"), "entity_id", F.col("source_url").alias("url"), F.lit(2).alias("source"), F.lit(0).alias("k"))
    o = s.unionByName(c).withColumn("ordinal", F.row_number().over(Window.partitionBy("entity_id").orderBy("source", "k", "id")))
    return rows.first_seen(o, ["entity_id", "url"], F.col("ordinal")).select("entity_id", "ordinal", "source", "id")


@query(
    """
with t as (select distinct result_id, entity_id, title, url, snippet from search_results where entity_id is not null and title is not null),
n as (select entity_id, regexp_extract(arg_min(title, result_id), '(\\S+ \\S+)$', 1) as name from t group by entity_id),
k as (select t.*, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ('inc', 'corp', 'corporation', 'ltd', 'limited', 'llc', 'ag', 'se', 'plc')) as tokens from t join n on n.entity_id = t.entity_id),
s as (select entity_id, result_id, round(case when len(list_filter(tokens, lambda x: contains(lower(url), x))) > 0 then 2.0 else 0.0 end + 0.5 * len(list_filter(tokens, lambda x: contains(lower(concat_ws(' ', url, title, snippet)), x)))
  + case when regexp_matches(lower(concat_ws(' ', url, title, snippet)), 'headquarters|about|company|corporate') then 0.5 else 0.0 end
  + case when regexp_matches(url, 'sec\\.gov|companieshouse') then 0.6 when regexp_matches(lower(url), '/about|/company|/corporate') then 0.4 else 0.0 end, 6) as score from k),
r as (select *, row_number() over (partition by entity_id order by score desc, result_id) as rank from s)
select entity_id, cast(rank as int) as rank, result_id, score from r where rank <= 5
"""
)
def search_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Five results of every entity by their search score against its name, equal ones in the order they came."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null and title is not null"), "result_id", "entity_id", "title", "url", "snippet")
    name = t.groupBy("entity_id").agg(F.regexp_extract(F.min_by("title", "result_id"), r"(\S+ \S+)$", 1).alias("name"))
    s = t.join(name, "entity_id").select("entity_id", "result_id", F.round(fx.search_score(F.col("name"), F.col("url"), F.col("title"), F.col("snippet")), 6).alias("score"))
    return rows.top_k(s, ["entity_id"], 5, F.col("score").desc(), F.col("result_id")).select("entity_id", "rank", "result_id", "score")


# Least match that is accepted, freshness with and without a date, least characters worth an index.
ACCEPTED, FRESH, UNDATED, INDEXED = 0.55, 0.9, 0.7, 2000


@query(
    """
select assessment_id, coalesce(entity_match_score >= 0.55, false) as accepted, case when not coalesce(entity_match_score >= 0.55, false) then 'low_entity_match' end as reason, cast(case when cached_at is not null then 0.9 else 0.7 end as double) as freshness,
  coalesce(entity_match_score >= 0.55, false) and coalesce(length(coalesce(nullif(full_text, ''), text)), 0) >= 2000 as indexed
from (select distinct assessment_id, entity_match_score, cached_at, full_text, text from cached_assessments)
"""
)
def acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Whether each assessed document is accepted, and why not; its freshness; and whether it is long enough to be indexed, by its full text where it has one."""
    t = table(spark, d, "cached_assessments")
    ok = F.coalesce(F.col("entity_match_score") >= ACCEPTED, F.lit(False))
    n = F.coalesce(F.char_length(F.coalesce(F.nullif(F.col("full_text"), F.lit("")), F.col("text"))), F.lit(0))
    return t.select("assessment_id", ok.alias("accepted"), F.when(~ok, "low_entity_match").alias("reason"), F.when(F.col("cached_at").isNotNull(), FRESH).otherwise(UNDATED).alias("freshness"), (ok & (n >= INDEXED)).alias("indexed")).distinct()


@query(
    """
with r as (select distinct result_id, entity_id, url, provider, rank from search_results where entity_id is not null),
u as (select entity_id, url, min(result_id) as first from r where url is not null group by all), t as (select *, row_number() over (partition by entity_id order by first) as k from u),
l as (select entity_id, string_agg(url, ' ' order by k) as top_urls from t where k <= 5 group by entity_id)
select r.entity_id, count(*) as n_results, count(distinct r.url) as n_urls, string_agg(distinct r.provider, ',' order by r.provider) as providers, any_value(l.top_urls) as top_urls from r left join l on l.entity_id = r.entity_id group by r.entity_id
"""
)
def stage_summary(spark: SparkSession, d: str) -> DataFrame:
    """What the search stage gave every entity: numbers, providers, and the first five addresses."""
    r = rows.once(table(spark, d, "search_results").where("entity_id is not null"), "result_id", "entity_id", "url", "provider")
    u = r.where("url is not null").groupBy("entity_id", "url").agg(F.min("result_id").alias("first"))
    top = rows.top_k(u, ["entity_id"], 5, F.col("first"), name="k").groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "url"))), lambda x: x["url"]), " ").alias("top_urls"))
    per = r.groupBy("entity_id", "provider").agg(F.count("*").alias("n"))  # a few providers
    names = per.groupBy("entity_id").agg(F.sum("n").alias("n_results"), F.array_join(F.array_sort(F.collect_set("provider")), ",").alias("providers"))
    return names.join(u.groupBy("entity_id").agg(F.count("*").alias("n_urls")), "entity_id", "left").join(top, "entity_id", "left").select("entity_id", "n_results", F.coalesce("n_urls", F.lit(0)).alias("n_urls"), F.nullif(F.col("providers"), F.lit("")).alias("providers"), "top_urls")


@query(
    """
with h as (select distinct hit_id, query_id, chunk_id, coalesce(case when isfinite(score) then score end, 0) as score from retrieval_results where chunk_id is not null), c as (select distinct chunk_id, content from chunks where content is not null),
r as (select h.query_id, h.chunk_id, c.content, row_number() over (partition by query_id order by score desc, hit_id) as k from h join c on c.chunk_id = h.chunk_id)
select query_id, md5(string_agg('[chunk_id=' || chunk_id || ']' || chr(10) || substr(content, 1, 1500) || case when length(content) > 1500 then ' [...]' else '' end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by k)) as prompt_hash, count(*) as n from r where k <= 12 group by query_id
"""
)
def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """The twelve best chunks of every query as one text, each under its id, long ones marked where they are cut."""
    c = rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "content")
    h = _hits(spark, d).join(c.select("chunk_id"), "chunk_id", "left_semi")
    best = rows.top_k(h, ["query_id"], 12, F.col("score").desc(), F.col("hit_id"), name="k").select("query_id", "chunk_id", "k").join(c, "chunk_id")
    part = F.concat(F.lit("[chunk_id="), F.col("chunk_id"), F.lit("]\n"), F.left("content", F.lit(1500)), F.when(F.char_length("content") > 1500, " [...]").otherwise(""))
    g = best.select("query_id", "k", part.alias("part")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("k", "part"))).alias("a"))  # twelve at most
    return g.select("query_id", F.md5(F.array_join(F.transform("a", lambda x: x["part"]), "\n\n---\n\n").cast("binary")).alias("prompt_hash"), F.size("a").cast("bigint").alias("n"))


_FOLDED = """
with recursive g as (select event_id, user_id, event_type, cast(epoch_us(ts) as bigint) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events),
f as (select user_id, event_type, r, event_id, t as last, 'miss' as status, 'fetch' as action from g where r = 1
  union all select g.user_id, g.event_type, g.r, g.event_id, case when g.t - f.last > {refetch} then g.t else f.last end, case when g.t - f.last > 604800000000 then 'expired' when g.t - f.last > 259200000000 then 'stale' else 'hit' end, case when g.t - f.last > {refetch} then 'fetch' else 'serve' end
  from f join g on g.user_id = f.user_id and g.event_type = f.event_type and g.r = f.r + 1)
select event_id, status, action from f
"""


@query(_FOLDED.format(refetch=259200000000))
def cache_fetches(spark: SparkSession, d: str) -> DataFrame:
    """Accesses through a cache whose stale entries are fetched anew; entries live from when they were set."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return folds.cache_aside(e, ["user_id", "event_type"], "t", "event_id", 259_200_000_000, 604_800_000_000, True)


@query(_FOLDED.format(refetch=604800000000))
def cache_assessments(spark: SparkSession, d: str) -> DataFrame:
    """Accesses through a cache whose stale entries are served as they are."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return folds.cache_aside(e, ["user_id", "event_type"], "t", "event_id", 259_200_000_000, 604_800_000_000, False)


def _stand_in(texts: list[str]) -> list[tuple[int, list[float]]]:
    """Vectors from the digits of each text's hash, given back in the opposite order: a source that needs no model."""
    import hashlib

    out = []
    for k, t in enumerate(texts):
        raw = [int(c, 16) / 15 for c in hashlib.sha256(t.encode()).hexdigest()[:8]]
        norm = sum(x * x for x in raw) ** 0.5
        out.append((k, [x / norm for x in raw] if norm else raw))
    return out[::-1]


@query(
    """
with c as (select distinct chunk_id, content from chunks where content is not null),
h as (select chunk_id, list_transform(range(1, 9), lambda k: (instr('0123456789abcdef', substr(sha256(content), k, 1)) - 1) / 15.0) as v from c)
select chunk_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as last, null::varchar as batch_error from h
"""
)
def embedding_batches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of all chunks from a source that takes a hundred texts at once and answers in any order."""
    t = spread(rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "content"))
    return folds.embed_batches(t, "chunk_id", "content", _stand_in).select("chunk_id", F.round(F.element_at("vector", 1), 6).alias("first"), F.round(F.element_at("vector", -1), 6).alias("last"), "batch_error")


@query(
    """
select count(*) as n_chunks, count(distinct document_url) as n_documents from (select distinct chunk_id, document_url from chunks) c where document_url not in (select url from cached_fetches where fetch_success = false and url is not null)
"""
)
def document_evict(spark: SparkSession, d: str) -> DataFrame:
    """The chunk store without documents whose fetch failed."""
    store = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url")
    gone = table(spark, d, "cached_fetches").where("fetch_success = false and url is not null").select(F.col("url").alias("document_url"))
    return rows.evict(store, gone, "document_url").agg(F.count("*").alias("n_chunks"), F.count_distinct("document_url").alias("n_documents"))


_SECTIONED = """
with recursive h as (select distinct hit_id, query_id, chunk_id, coalesce(case when isfinite(vector_score) then vector_score end, 0) as v, coalesce(case when isfinite(keyword_score) then keyword_score end, 0) as k, coalesce(case when isfinite(table_boost_score) then table_boost_score end, 0) as b from retrieval_results where chunk_id is not null),
c as (select distinct chunk_id, document_url, section_id, chunk_role, parent_section_id from chunks),
x as (select h.hit_id, h.query_id, h.v, h.k, h.b, c.* from h join c on c.chunk_id = h.chunk_id),
e as (select distinct document_url, section_id, parent_section_id from c where section_id is not null),
t as (select distinct document_url, section_id as ancestor, section_id as descendant from e union select t.document_url, t.ancestor, e.section_id from t join e on e.document_url = t.document_url and e.parent_section_id = t.descendant where e.section_id <> t.descendant),
m as (select *, row_number() over (partition by query_id, document_url order by v desc, hit_id) as p from x where chunk_role = 'section_summary'),
s as (select distinct query_id, document_url, section_id from m where (p = 1 or (p <= 3 and v >= 0.25)) and section_id is not null and section_id <> ''),
w as (select distinct s.query_id, s.document_url, t.descendant as section_id from s join t on t.document_url = s.document_url and t.ancestor = s.section_id),
a as (select x.*, row_number() over (partition by x.query_id, x.document_url, x.section_id order by v desc, hit_id) as p from x where exists (select 1 from w where w.query_id = x.query_id and w.document_url = x.document_url and w.section_id = x.section_id)),
f as (select * exclude p, 'section' as stage from a where p <= 10),
o as (select x.*, row_number() over (partition by x.query_id, x.document_url order by v desc, hit_id) as p from x where not exists (select 1 from f where f.query_id = x.query_id and f.document_url = x.document_url)),
u as (select * from f union all select * exclude p, 'document' as stage from o where p <= 10),
z as (select *, round(0.5 * v + 0.15 * k + 0.1 * b + 0.15 * case when chunk_role = 'section_summary' then 0.1 else 0 end + 0.1 * case when chunk_role = 'table' then 0.05 else 0 end, 6) as score from u),
r as (select *, row_number() over (partition by query_id, document_url order by score desc, hit_id) as rank from z)
select query_id, document_url, cast(rank as int) as rank, hit_id, score, stage from r where rank <= 5
"""


@query(_SECTIONED)
def sectioned_topk(spark: SparkSession, d: str) -> DataFrame:
    """Five hits of every query and document: candidates from each section its summaries choose and those below, else from the whole document, ranked by the score of five parts."""
    scores = {n: F.coalesce(fx.finite(F.col(c)), F.lit(0.0)).alias(n) for n, c in (("v", "vector_score"), ("k", "keyword_score"), ("b", "table_boost_score"))}
    h = rows.once(table(spark, d, "retrieval_results").where("chunk_id is not null"), "hit_id", "query_id", "chunk_id", "vector_score", "keyword_score", "table_boost_score").select("hit_id", "query_id", "chunk_id", *scores.values())
    c = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "section_id", "chunk_role")
    e = table(spark, d, "chunks").where("section_id is not null").select("document_url", "section_id", "parent_section_id").distinct()
    below = rows.closure(e, ["document_url"], "section_id", "parent_section_id")
    return rt.sectioned(h.join(c, "chunk_id"), below, "query_id", "hit_id")


_NODES = """
c as (select distinct chunk_id, document_url, section_id, parent_section_id, section_path_str, section_level, index from chunks where section_id is not null and section_id <> ''),
n as (select document_url, section_id, min(index) as first, arg_min(parent_section_id, index) as parent, arg_min(section_path_str, index) as path, count(*) as n_own, list(chunk_id order by index) as block_ids from c group by all),
k as (select n.*, p.section_id is not null as has_parent from n left join n p on p.document_url = n.document_url and p.section_id = n.parent and p.section_id <> n.section_id),
w as (select document_url, section_id, path, n_own, [first] as place from k where not has_parent union all select k.document_url, k.section_id, k.path, k.n_own, list_append(w.place, k.first) from w join k on k.document_url = w.document_url and k.parent = w.section_id and k.has_parent)
"""


@query(
    "with recursive "
    + _NODES
    + """, h as (select k.document_url, k.parent as section_id, string_agg('• ' || coalesce(nullif(regexp_extract(k.path, '([^|]*)$', 1), ''), k.section_id), chr(10) order by k.first) as heads, count(*) as n_children from k where has_parent group by all)
select w.document_url, w.section_id, cast(row_number() over (partition by w.document_url order by w.place) as int) as walk, cast(len(w.place) - 1 as int) as depth, w.n_own, coalesce(h.n_children, 0) as n_children,
  md5(case when h.heads is not null then case when coalesce(w.path, '') <> '' then replace(w.path, '|', ' > ') || chr(10) || chr(10) else '' end || h.heads end) as navigation_hash
from w left join h on h.document_url = w.document_url and h.section_id = w.section_id
"""
)
def section_walk(spark: SparkSession, d: str) -> DataFrame:
    """Sections of every document in the order a reader walks them (a section, then those below it), with the navigation text of those that have others below."""
    return chunking.section_walk(_section_nodes(spark, d))


@query(
    "with recursive "
    + _NODES
    + """, b as (select document_url, section_id, unnest(block_ids) as chunk_id, unnest(range(1, len(block_ids) + 1)) as ordinal from n), t as (select distinct chunk_id, chunk_type, coalesce(length(content), 0) as n_chars from chunks)
select b.document_url, b.section_id, count(*) as n_blocks, count(*) filter (where t.chunk_type = 'table') as n_tables, cast(sum(t.n_chars) as bigint) as n_chars, arg_max(b.chunk_id, b.ordinal) as last_block from b join t on t.chunk_id = b.chunk_id group by all
"""
)
def section_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every section by the list of their ids: the list is exploded and joined with the blocks."""
    listed = _section_nodes(spark, d).select("document_url", "section_id", F.posexplode("block_ids").alias("ordinal", "chunk_id"))
    t = table(spark, d, "chunks").select("chunk_id", "chunk_type", F.coalesce(F.char_length("content"), F.lit(0)).alias("n_chars")).distinct()
    g = listed.join(t, "chunk_id").groupBy("document_url", "section_id")
    return g.agg(F.count("*").alias("n_blocks"), F.count_if(F.col("chunk_type") == "table").alias("n_tables"), F.sum("n_chars").cast("bigint").alias("n_chars"), F.max_by("chunk_id", "ordinal").alias("last_block"))


def _section_nodes(spark: SparkSession, d: str) -> DataFrame:
    c = rows.once(table(spark, d, "chunks").where("section_id is not null and section_id <> ''"), "chunk_id", "document_url", "section_id", "parent_section_id", "section_path_str", "index")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("index", "chunk_id"))), lambda x: x["chunk_id"])  # a section's own blocks
    return c.groupBy("document_url", "section_id").agg(F.min("index").alias("first"), F.min_by("parent_section_id", "index").alias("parent"), F.min_by("section_path_str", "index").alias("path"), F.count("*").alias("n_own"), listed.alias("block_ids"))


@query(
    """
with recursive c as (select distinct chunk_id, string_split(content, chr(10)) as ls from chunks where chunk_type = 'table' and content is not null),
f as (select chunk_id, ls, 1 as i, 0 as part, cast(length(ls[1]) // 4 as bigint) as used from c
  union all select chunk_id, ls, i + 1, case when used + length(ls[i + 1]) // 4 > 60 then part + 1 else part end, case when used + length(ls[i + 1]) // 4 > 60 then length(ls[i + 1]) // 4 else used + length(ls[i + 1]) // 4 end from f where i < len(ls))
select chunk_id, cast(part as int) as part, md5(string_agg(ls[i], chr(10) order by i)) as part_hash from f group by chunk_id, part
"""
)
def table_parts(spark: SparkSession, d: str) -> DataFrame:
    """Tables as text cut between lines into parts of at most sixty tokens."""
    t = rows.once(table(spark, d, "chunks").where("chunk_type = 'table' and content is not null"), "chunk_id", "content")
    return folds.line_groups(t, "chunk_id", "content", 60).select("chunk_id", "part", F.md5(F.col("content").cast("binary")).alias("part_hash"))


@query(
    """
select o_orderpriority as decision, count(*) as n, cast(sum(cast(o_totalprice as decimal(18, 2))) as decimal(38, 2)) as total_cost, count(*) filter (where o_orderstatus = 'F') as n_passed, round(coalesce(avg(case when o_orderstatus = 'F' then o_totalprice end), 0), 4) as mean_cost_passed, round(avg(date_diff('day', date '1990-01-01', cast(o_orderdate as date))), 4) as mean_days
from orders group by 1
"""
)
def eval_costs(spark: SparkSession, d: str) -> DataFrame:
    """Cost report by decision: totals, the mean cost of what passed only, and a mean duration."""
    t, passed = table(spark, d, "orders"), F.col("o_orderstatus") == "F"
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1990-01-01").cast("date"))
    return t.groupBy(F.col("o_orderpriority").alias("decision")).agg(
        F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(38,2)").alias("total_cost"), F.count_if(passed).alias("n_passed"),
        F.round(F.coalesce(F.avg(F.when(passed, F.col("o_totalprice"))), F.lit(0.0)), 4).alias("mean_cost_passed"), F.round(F.avg(days), 4).alias("mean_days"),
    )


@query(
    """
with s as (select distinct synthesis_id, field_name, normalized_value, synthesis_confidence from synthesis_results), v as (select distinct field_name, canonical_value from canonical_values),
x as (select s.*, v.canonical_value is not null as valid from s left join v on v.field_name = s.field_name and v.canonical_value = s.normalized_value)
select field_name, count(*) as n, count(*) filter (where valid) as n_valid, round(count(*) filter (where valid and synthesis_confidence >= 0.5) / nullif(count(*) filter (where valid), 0), 6) as passed_of_valid,
  round(avg(case when valid and isfinite(synthesis_confidence) then synthesis_confidence end), 6) as mean_confidence_valid, coalesce(bool_and(case when not valid then coalesce(synthesis_confidence, 0) < 0.99 end), true) as all_others_below from x group by field_name
"""
)
def acceptance_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of the syntheses that are expected to be valid, how many pass and how sure they are; and whether all others stay below a bound."""
    s = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "field_name", "normalized_value", "synthesis_confidence")
    v = table(spark, d, "canonical_values").select("field_name", F.col("canonical_value").alias("normalized_value")).distinct().withColumn("hit", F.lit(True))
    x, c = s.join(v, ["field_name", "normalized_value"], "left").withColumn("valid", F.col("hit").isNotNull()), F.col("synthesis_confidence")
    return x.groupBy("field_name").agg(
        F.count("*").alias("n"), F.count_if("valid").alias("n_valid"), F.round(F.try_divide(F.count_if(F.col("valid") & (c >= 0.5)), F.nullif(F.count_if("valid"), F.lit(0))), 6).alias("passed_of_valid"),
        F.round(F.avg(F.when(F.col("valid"), fx.finite(c))), 6).alias("mean_confidence_valid"), F.coalesce(F.every(F.when(~F.col("valid"), F.coalesce(c, F.lit(0.0)) < 0.99)), F.lit(True)).alias("all_others_below"),
    )


#: What each kind of backend is: whether it searches the web and whether it reads records; others do neither.
BACKENDS = {"serper": (True, False), "tavily": (True, False), "replay": (False, True), "both": (True, True)}


@query(
    """
select provider, coalesce(provider in ('serper', 'tavily', 'both'), false) as searches, coalesce(provider in ('replay', 'both'), false) as reads_records, count(*) as n from (select distinct result_id, provider from search_results) group by all
"""
)
def backend_routes(spark: SparkSession, d: str) -> DataFrame:
    """Results by what their backend does, from a table of four names; an unknown name does nothing."""
    known = spark.createDataFrame([(n, *v) for n, v in BACKENDS.items()], "provider string, searches boolean, reads_records boolean")
    t = rows.once(table(spark, d, "search_results"), "result_id", "provider").groupBy("provider").agg(F.count("*").alias("n"))
    return t.join(F.broadcast(known), "provider", "left").select("provider", F.coalesce("searches", F.lit(False)).alias("searches"), F.coalesce("reads_records", F.lit(False)).alias("reads_records"), "n")


@query(
    """
with f as (select distinct fetch_id, url, content_type, error, fetch_success from cached_fetches),
m as (select fetch_id, not regexp_matches(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), '^(|text/.*|application/(json|xml|xhtml).*)$') as blocked, coalesce(not fetch_success, false) or error is not null as audited from f)
select fetch_id, blocked, audited from m where blocked or audited
"""
)
def violation_set(spark: SparkSession, d: str) -> DataFrame:
    """Fetches with a violation: of a type that isn't read, or found by the audit of their outcome."""
    t = table(spark, d, "cached_fetches").select("fetch_id", (~fx.content_type_allowed(F.col("content_type"))).alias("blocked"), (F.coalesce(~F.col("fetch_success"), F.lit(False)) | F.col("error").isNotNull()).alias("audited"), "url").distinct()
    return t.where("blocked or audited").select("fetch_id", "blocked", "audited").distinct()


#: Paragraphs of plain texts parted by empty lines and joined until they have 80 characters, in SQL, after the blocks of pages.
_PLAIN_SQL = r"""
pb as (select distinct cast(fetch_id as varchar) as id, body from cached_fetches where body is not null and not regexp_matches(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), '^(text/html|application/xhtml)')),
pl as (select id, list_filter(list_transform(regexp_split_to_array(body, '\n[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*\n'), lambda x: regexp_replace(x, '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') as ps from pb),
pf as (select id, ps, 1 as i, 1 as sub, cast(length(ps[1]) as bigint) as used from pl where len(ps) > 0
  union all select id, ps, i + 1, case when used >= 80 then sub + 1 else sub end, case when used >= 80 then length(ps[i + 1]) else used + 2 + length(ps[i + 1]) end from pf where i < len(ps)),
pj as (select id, sub, string_agg(ps[i], chr(10) || chr(10) order by i) as content from pf group by all),
pk as (select id, sub, content, string_split(content, chr(10)) as ls from pj),
pm as (select id, sub, content, case when len(list_filter(ls, lambda x: x[1] = '|' and instr(substr(x, 3), '|') > 0)) >= 2 or len(list_filter(ls, lambda x: instr(substr(x, 2), chr(9)) > 0 and instr(substr(x, 2), chr(9)) < length(x) - 1)) >= 2
    or (len(list_filter(ls, lambda x: x[1] = '|' and instr(substr(x, 3), '|') > 0)) >= 1 and len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[|:\-][|: \-]*$'))) >= 1) then 'table' else 'text' end as block_type from pk)
"""


@query(
    "with recursive "
    + _BLOCKS_SQL
    + ","
    + _PLAIN_SQL
    + """, m as (select distinct cast(fetch_id as varchar) as id, regexp_extract(lower(trim(split_part(coalesce(content_type, ''), ';', 1))), '^(text/html|application/xhtml)', 1) as parser from cached_fetches)
select b.id as fetch_id, m.parser, b.position, b.block_type, b.content from blocks b join m on m.id = b.id where m.parser <> ''
union all select id, '', cast(row_number() over (partition by id order by sub) - 1 as int), block_type, content from pm
"""
)
def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every fetch by the parser its type selects."""
    t = spread(rows.once(table(spark, d, "cached_fetches"), "fetch_id", "content_type", "body"))
    return parsing.parse_documents(t, "fetch_id", "content_type", "body")
