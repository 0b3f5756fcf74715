"""Queries of what is reported about a run: costs, caches, evaluations, cut and redacted texts, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as fx
from gleanery.operators import folds, rows, validation
from gleanery.plans.pipeline import search_ranking
from gleanery.plans.registry import query
from gleanery.sources.tables import table


@query(
    """
with e as (select event_type, dayofweek(ts) as day, cast(value as decimal(18, 4)) as amount, case event_type when 'purchase' then 0.00021 when 'error' then 0 else 0.00003 end as rate from events)
select event_type, cast(day as int) as day, count(*) as n, cast(sum(amount) as decimal(28, 4)) as amount, cast(round(sum(amount * cast(rate as decimal(9, 5))), 8) as decimal(28, 8)) as cost from e group by grouping sets ((event_type), (day), ())
"""
)
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Amounts and their cost at a rate by type, by day of the week, and in all: one pass with grouping sets, in decimals."""
    rate = F.when(F.col("event_type") == "purchase", F.lit("0.00021")).when(F.col("event_type") == "error", F.lit("0")).otherwise(F.lit("0.00003")).cast("decimal(9,5)")
    e = table(spark, d, "events").select("event_type", (F.dayofweek("ts") - 1).alias("day"), F.col("value").cast("decimal(18,4)").alias("amount")).withColumn("cost", F.col("amount") * rate)
    return e.groupingSets([["event_type"], ["day"], []], "event_type", "day").agg(F.count("*").alias("n"), F.sum("amount").cast("decimal(28,4)").alias("amount"), F.round(F.sum("cost"), 8).cast("decimal(28,8)").alias("cost"))


@query(
    """
with s as (select distinct synthesis_id, field_name, normalized_value from synthesis_results), v as (select distinct field_name, canonical_value from canonical_values), l as (select distinct field_name, lower(canonical_value) as low from canonical_values),
x as (select s.field_name, case when v.canonical_value is not null then 'match' when s.normalized_value is null or trim(s.normalized_value) = '' then 'blank' when l.low is not null then 'case' else 'other' end as kind
  from s left join v on v.field_name = s.field_name and v.canonical_value = s.normalized_value left join l on l.field_name = s.field_name and l.low = lower(s.normalized_value))
select field_name, kind, count(*) as n from x group by all
"""
)
def mismatch_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How syntheses differ from the expected spellings: matches, blanks, other case, others."""
    s = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "field_name", "normalized_value")
    v = table(spark, d, "canonical_values").select("field_name", "canonical_value").distinct()
    same = v.select("field_name", F.col("canonical_value").alias("normalized_value"), F.lit(True).alias("same"))
    low = v.select("field_name", F.lower("canonical_value").alias("_low"), F.lit(True).alias("alike")).distinct()
    x = s.join(same, ["field_name", "normalized_value"], "left").withColumn("_low", F.lower("normalized_value")).join(low, ["field_name", "_low"], "left")
    kind = F.when(F.col("same"), "match").when(F.col("normalized_value").isNull() | (F.trim("normalized_value") == ""), "blank").when(F.col("alike"), "case").otherwise("other")
    return x.groupBy("field_name", kind.alias("kind")).agg(F.count("*").alias("n"))


@query(
    """
with recursive g as (select event_id, user_id, event_type, cast(epoch_us(ts) as bigint) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as r from events),
f as (select user_id, event_type, r, t as last, 'miss' as status from g where r = 1
  union all select g.user_id, g.event_type, g.r, case when g.t - f.last > 259200000000 then g.t else f.last end, case when g.t - f.last > 604800000000 then 'expired' when g.t - f.last > 259200000000 then 'stale' else 'hit' end
  from f join g on g.user_id = f.user_id and g.event_type = f.event_type and g.r = f.r + 1)
select event_type, count(*) as n, count(*) filter (where status = 'hit') as n_hit, count(*) filter (where status = 'stale') as n_stale, count(*) filter (where status in ('miss', 'expired')) as n_miss from f group by event_type
"""
)
def cache_counts(spark: SparkSession, d: str) -> DataFrame:
    """Hits, stale entries and misses of a cache by type, the type being the mode that keeps its entries apart."""
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    s = folds.cache_aside(e, ["user_id", "event_type"], "t", "event_id", 259_200_000_000, 604_800_000_000, True)
    g = s.join(e.select("event_id", "event_type"), "event_id").groupBy("event_type")
    return g.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "hit").alias("n_hit"), F.count_if(F.col("status") == "stale").alias("n_stale"), F.count_if(F.col("status").isin("miss", "expired")).alias("n_miss"))


@query(
    """
with c as (select distinct chunk_id, chunk_role, token_count, content from chunks)
select chunk_role, cast(sum(coalesce(token_count, length(content) // 4)) as bigint) as tokens, count(*) filter (where coalesce(token_count, length(content) // 4) > 0) as n_calls, coalesce(bool_and(token_count is not null) filter (where coalesce(token_count, length(content) // 4) > 0), true) as all_reported from c group by chunk_role
"""
)
def call_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of the calls each role of chunk takes, calls without input left out, and whether every paid call's number was reported and not guessed."""
    n = F.coalesce(F.col("token_count").cast("bigint"), fx.token_floor(F.col("content")))
    c = table(spark, d, "chunks").select("chunk_id", "chunk_role", n.alias("n"), F.col("token_count").isNotNull().alias("reported")).distinct()
    return c.groupBy("chunk_role").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("n_calls"), F.coalesce(F.every(F.when(F.col("n") > 0, F.col("reported"))), F.lit(True)).alias("all_reported"))


#: Columns of a record that are never shown.
HIDDEN = ("url", "title", "snippet")


@query(
    """
select entity_id, cast(floor(result_id / 8) as bigint) as part, count(*) as n, '[redacted]' as entity, string_agg('{"url":"[redacted]","title":"[redacted]","snippet":"[redacted]","provider":"' || provider || '"}', ',' order by result_id) as documents
from (select distinct result_id, entity_id, provider from search_results where entity_id is not null and provider is not null) group by 1, 2
"""
)
def redacted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Lists of results with every hidden field of every entry replaced, the others as they are."""
    t = rows.once(table(spark, d, "search_results").where("entity_id is not null and provider is not null"), "result_id", "entity_id", "url", "title", "snippet", "provider")
    g = t.groupBy("entity_id", F.floor(F.col("result_id") / 8).alias("part")).agg(F.array_sort(F.collect_list(F.struct("result_id", "url", "title", "snippet", "provider"))).alias("a"))  # eight ids at most

    def masked(e):
        for c in HIDDEN:
            e = e.withField(c, F.lit("[redacted]"))
        return F.to_json(e.dropFields("result_id"))

    return g.select("entity_id", "part", F.size("a").cast("bigint").alias("n"), F.lit("[redacted]").alias("entity"), F.array_join(F.transform("a", masked), ",").alias("documents"))


@query(
    """
with t as (select distinct assessment_id, text from cached_assessments where text is not null)
select assessment_id, substr(text, 1, 400) as supporting, md5(substr(text, 1, 6000)) as context, md5(substr(text, 1, 1500) || case when length(text) > 1500 then ' [...]' else '' end) as prompt, md5(substr(text, 1, 4000)) as raw from t
"""
)
def truncations(spark: SparkSession, d: str) -> DataFrame:
    """The beginnings of texts that the steps show: excerpts, contexts, prompts (marked where they are cut) and raw answers."""
    t = rows.once(table(spark, d, "cached_assessments").where("text is not null"), "assessment_id", "text")
    md5 = lambda c: F.md5(c.cast("binary"))
    return t.select("assessment_id", fx.cut(F.col("text"), 400).alias("supporting"), md5(fx.cut(F.col("text"), 6000)).alias("context"), md5(fx.cut(F.col("text"), 1500, " [...]")).alias("prompt"), md5(fx.cut(F.col("text"), 4000)).alias("raw"))


#: Kinds of messages by the first phrase they hold; those of the hard kinds fail, each of the others costs a part.
MESSAGE_KINDS, HARD_KINDS, COST = [("name", "could not be resolved"), ("time", "timeout"), ("loop", "redirects"), ("read", "read error")], ("name",), 0.15


@query(
    """
with f as (select distinct fetch_id, error from cached_fetches),
k as (select fetch_id, case when error is null then null when contains(lower(error), 'could not be resolved') then 'name' when contains(lower(error), 'timeout') then 'time' when contains(lower(error), 'redirects') then 'loop' when contains(lower(error), 'read error') then 'read' else 'unknown' end as kind from f)
select fetch_id, coalesce(kind = 'name', false) as failed, cast(case when kind is null then 1.0 when kind = 'name' then 0.0 else 0.85 end as double) as score, kind from k
"""
)
def fetch_gate(spark: SparkSession, d: str) -> DataFrame:
    """Fetches by their message: hard ones fail, each soft or unknown one takes a part of the score."""
    t = table(spark, d, "cached_fetches").select("fetch_id", F.when(F.col("error").isNotNull(), F.array("error")).otherwise(F.array().cast("array<string>")).alias("m")).distinct()
    kinds = validation.message_kinds(F.col("m"), MESSAGE_KINDS)
    failed, score = validation.gate(kinds, HARD_KINDS, COST)
    return t.select("fetch_id", failed.alias("failed"), F.round(score, 4).alias("score"), F.try_element_at(kinds, F.lit(1)).alias("kind"))


@query(
    """
select synthesis_id, nullif(trim(value, ' '), '') as value, nullif(trim(normalized_value, ' '), '') as normalized_value, round(coalesce(nullif(case when isfinite(synthesis_confidence) then synthesis_confidence end, 0), 0.5), 6) as confidence, cast(coalesce(len(supporting_urls), 0) as int) as n_urls
from (select distinct synthesis_id, value, normalized_value, synthesis_confidence, supporting_urls from synthesis_results)
"""
)
def synthesis_rows(spark: SparkSession, d: str) -> DataFrame:
    """Syntheses as they are built from an answer: empty values are null, a missing or zero confidence counts 0.5."""
    t = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "value", "normalized_value", "synthesis_confidence", "supporting_urls")
    clean = lambda c: F.nullif(F.trim(c), F.lit("")).alias(c)
    sure = F.coalesce(F.nullif(fx.finite(F.col("synthesis_confidence")), F.lit(0.0)), F.lit(0.5))
    return t.select("synthesis_id", clean("value"), clean("normalized_value"), F.round(sure, 6).alias("confidence"), F.coalesce(F.size(F.col("supporting_urls")), F.lit(0)).alias("n_urls"))


@query(
    """
with t as (select distinct result_id, entity_id, title, url, snippet from search_results where entity_id is not null and title is not null),
n as (select entity_id, regexp_extract(arg_min(title, result_id), '(\\S+ \\S+)$', 1) as name from t group by entity_id),
k as (select t.*, list_filter(list_transform(regexp_extract_all(name, '[A-Za-z0-9]+'), lambda x: lower(x)), lambda x: length(x) > 2 and x not in ('inc', 'corp', 'corporation', 'ltd', 'limited', 'llc', 'ag', 'se', 'plc')) as tokens from t join n on n.entity_id = t.entity_id),
s as (select entity_id, result_id, url, round(case when len(list_filter(tokens, lambda x: contains(lower(url), x))) > 0 then 2.0 else 0.0 end + 0.5 * len(list_filter(tokens, lambda x: contains(lower(concat_ws(' ', url, title, snippet)), x)))
  + case when regexp_matches(lower(concat_ws(' ', url, title, snippet)), 'headquarters|about|company|corporate') then 0.5 else 0.0 end
  + case when regexp_matches(url, 'sec\\.gov|companieshouse') then 0.6 when regexp_matches(lower(url), '/about|/company|/corporate') then 0.4 else 0.0 end, 6) as score from k),
r as (select *, row_number() over (partition by entity_id order by score desc, result_id) as rank from s),
f as (select url, arg_max(fetch_id, (cached_at, fetch_id)) as fetch_id from (select distinct fetch_id, url, cached_at from cached_fetches where fetch_success and body is not null) group by url)
select r.entity_id, cast(r.rank as int) as rank, r.result_id, f.fetch_id from r left join f on f.url = r.url where r.rank <= 3
"""
)
def fetch_plan(spark: SparkSession, d: str) -> DataFrame:
    """The three best results of every entity with the newest good fetch of each, null where it is still to be fetched."""
    best = search_ranking(spark, d).where("rank <= 3").select("entity_id", "rank", "result_id")
    urls = rows.once(table(spark, d, "search_results"), "result_id", "url")
    good = table(spark, d, "cached_fetches").where("fetch_success and body is not null").select("fetch_id", "url", "cached_at").distinct()
    newest = good.groupBy("url").agg(F.max_by("fetch_id", F.struct("cached_at", "fetch_id")).alias("fetch_id"))
    return best.join(urls, "result_id").join(newest, "url", "left").select("entity_id", "rank", "result_id", "fetch_id")


@query(
    """
with e as (select date_trunc('day', ts) as day, event_type, value, cast(epoch_us(ts) as bigint) as t from events),
k as (select day, event_type, count(*) as n from e group by all), l as (select day, string_agg(event_type || ': ' || n, ', ' order by event_type) as by_kind from k group by day)
select strftime(e.day, '%Y-%m-%d %H:%M:%S') as trace, count(*) as n_spans, count(distinct e.event_type) as n_kinds, min(e.t) as began_us, max(e.t) - min(e.t) as took_us, count(*) filter (where e.event_type = 'error') as n_errors, round(max(e.value), 4) as longest, any_value(l.by_kind) as by_kind
from e join l on l.day = e.day group by e.day
"""
)
def trace_summary(spark: SparkSession, d: str) -> DataFrame:
    """Summary of every trace (here a day): spans by kind, errors, beginning, duration, longest."""
    e = table(spark, d, "events").select(F.date_trunc("day", "ts").alias("day"), "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    kinds = e.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("b"), F.max("value").alias("v"))  # a few kinds a day
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat(x["event_type"], F.lit(": "), x["n"].cast("string"))), ", ")
    g = kinds.groupBy("day").agg(F.sum("n").alias("n_spans"), F.count("*").alias("n_kinds"), F.min("a").alias("began_us"), (F.max("b") - F.min("a")).alias("took_us"), F.coalesce(F.sum(F.when(F.col("event_type") == "error", F.col("n"))), F.lit(0)).alias("n_errors"), F.round(F.max("v"), 4).alias("longest"), listed.alias("by_kind"))
    return g.select(F.date_format("day", "yyyy-MM-dd HH:mm:ss").alias("trace"), "n_spans", "n_kinds", "began_us", "took_us", "n_errors", "longest", "by_kind")


@query(
    """
with f as (select distinct fetch_id, url, final_url, content_type, octet_length(encode(body)) as n from cached_fetches),
h as (select *, list_filter([url, final_url], lambda u: u is not null) as hops, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) as mime from f),
s as (select *, len(hops) > 0 and len(list_filter(hops, lambda u: not coalesce(regexp_matches(lower(u), '^https?://([^/@]*@)?[^/:?#]*[g-wyz][^/:?#]*'), false) or regexp_matches(lower(u), '^https?://([^/@]*@)?([^/:?#]*[.])?localhost[.]?([/:?#]|$)'))) = 0 as safe, regexp_matches(mime, '^(|text/.*|application/(json|xml|xhtml).*)$') as readable from h)
select fetch_id, safe, readable, coalesce(n, 0) <= 5242880 as within, safe and readable and coalesce(n, 0) <= 5242880 as allowed from s
"""
)
def fetch_rules(spark: SparkSession, d: str) -> DataFrame:
    """Whether each fetch keeps the rules: every address on its way safe, a type that is read, a size within five megabytes."""
    safe, readable = fx.hops_safe(F.array_compact(F.array("url", "final_url"))), fx.content_type_allowed(F.col("content_type"))
    within = F.coalesce(F.octet_length("body"), F.lit(0)) <= 5_242_880
    return table(spark, d, "cached_fetches").select("fetch_id", safe.alias("safe"), readable.alias("readable"), within.alias("within"), (safe & readable & within).alias("allowed"), "url", "final_url", "content_type", F.xxhash64("body").alias("_h")).distinct().drop("url", "final_url", "content_type", "_h")


@query(
    """
with d as (select distinct assessment_id, title, assessment_id % 4 as kind from cached_assessments where title is not null)
select assessment_id, case kind when 1 then 'ISO-8859-1' when 2 then 'UTF-16' else 'UTF-8' end as charset, case when kind = 1 then array_to_string(list_transform(string_split(title, ''), lambda c: case when unicode(c) < 256 then c else '?' end), '') else title end as title from d
"""
)
def charsets(spark: SparkSession, d: str) -> DataFrame:
    """Titles written in the character set of a type of content and read again by it; what a set lacks is a question mark."""
    t = rows.once(table(spark, d, "cached_assessments").where("title is not null"), "assessment_id", "title")
    kind = F.when(F.col("assessment_id") % 4 == 1, "text/html; charset=ISO-8859-1").when(F.col("assessment_id") % 4 == 2, 'text/plain;charset="utf-16"').otherwise("text/html")
    fits = F.when(F.col("assessment_id") % 4 == 1, F.regexp_replace("title", "[^\\x00-\\xff]", "?")).otherwise(F.col("title"))
    sent = t.select("assessment_id", kind.alias("kind"), fits.alias("title")).withColumn("body", F.call_function("encode", F.col("title"), fx.charset(F.col("kind"))))
    return sent.select("assessment_id", fx.charset(F.col("kind")).alias("charset"), fx.decoded(F.col("body"), F.col("kind")).alias("title"))


@query(
    """
with s as (select distinct synthesis_id, normalized_value as t from synthesis_results),
m as (select synthesis_id, t, trim(upper(t)) as a, substr(regexp_replace(upper(t), '[^A-Z]', '', 'g'), 1, 3) as b from s),
r as (select synthesis_id, case when regexp_full_match(t, '[A-Z]{3}') then 0 when regexp_full_match(a, '[A-Z]{3}') then 1 when regexp_full_match(b, '[A-Z]{3}') then 2 else 3 end as k, t, a, b from m)
select synthesis_id, case k when 0 then t when 1 then a when 2 then b end as value, cast(least(k, 2) as int) as tries, cast(coalesce(length(t), 0) * least(k, 2) as bigint) as chars_sent, case when k = 3 then 'not mended' end as error from r
"""
)
def repair_loop(spark: SparkSession, d: str) -> DataFrame:
    """Values that are to be three-letter codes: mended in at most two tries, by case and blanks, then by letters alone; what fails is kept as an error with what it cost."""
    t = rows.once(table(spark, d, "synthesis_results"), "synthesis_id", "normalized_value")

    def mend(open_rows, k):
        v = F.upper("normalized_value")
        return open_rows.select("synthesis_id", (F.trim(v) if k == 1 else F.substring(F.regexp_replace(v, "[^A-Z]", ""), 1, 3)).alias("value"))

    return validation.repair(t, "synthesis_id", "normalized_value", lambda c: F.rlike(c, F.lit("^[A-Z]{3}$")), mend)


#: What a provider must have to be asked: each setting and whether it has to be filled.
SETTINGS = {"serper": ("key",), "tavily": ("key", "region"), "replay": ()}


@query(
    """
with p as (select distinct provider from search_results where provider is not null), c as (select * from (values ('serper', 'key', 'x'), ('tavily', 'key', 'y'), ('tavily', 'region', '')) t(provider, setting, value)),
n as (select * from (values ('serper', 'key'), ('tavily', 'key'), ('tavily', 'region')) t(provider, setting))
select provider, not exists (select 1 from n where n.provider = p.provider and not exists (select 1 from c where c.provider = n.provider and c.setting = n.setting and c.value <> '')) as ready from p
"""
)
def provider_ready(spark: SparkSession, d: str) -> DataFrame:
    """Whether each provider has every setting it needs filled."""
    config = spark.createDataFrame([("serper", "key", "x"), ("tavily", "key", "y"), ("tavily", "region", "")], "provider string, setting string, value string")
    have = config.where("value <> ''").groupBy("provider").agg(F.collect_set("setting").alias("have"))  # a few settings
    need = spark.createDataFrame([(n, list(v)) for n, v in SETTINGS.items()], "provider string, need array<string>")
    p = table(spark, d, "search_results").select("provider").where("provider is not null").distinct()
    return p.join(need, "provider", "left").join(have, "provider", "left").select("provider", F.coalesce(F.size(F.array_except("need", F.coalesce("have", F.array().cast("array<string>")))) == 0, F.lit(False)).alias("ready"))
