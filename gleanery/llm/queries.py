"""Queries of the training-data operators over the project's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.tables import spread, table, together

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- 2: splitting oversized items

#: size_limits holds one row per kind of item, so reading it on the driver is bounded by the number of kinds.
KINDS = {"chunk_content": ("chunks", "chunk_id", "content"), "block_content": ("content_blocks", "block_id", "content"), "block_table": ("content_blocks", "block_id", "table_data")}


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.llm.segment import split_oversized

    limits = {r.item_kind: (r.max_chars, r.overlap_chars) for r in table(spark, d, "size_limits").where(F.col("item_kind").isin(*KINDS)).collect()}
    return split_oversized([(table(spark, d, t), kind, key, column) for kind, (t, key, column) in KINDS.items() if kind in limits], limits)


@query(
    """
with sized as (
  select 'chunk_content' as item_kind, chunk_id as item_id, length(content) as n from chunks
  union all select 'block_content', block_id, length(content) from content_blocks
  union all select 'block_table', block_id, list_sum(list_transform(flatten(table_data), lambda x: length(coalesce(x, '')) + 1)) from content_blocks)
select distinct s.item_kind, s.item_id from sized s join size_limits l on s.item_kind = l.item_kind where s.n > l.max_chars
"""
)
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items beyond the limit of their kind: those of which the splitter made pieces."""
    return _pieces(spark, d).where("piece_no = 0").select("item_kind", "item_id")


@query()
def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces themselves."""
    return _pieces(spark, d)


# --- 6: top three hits of every document


@query(
    """
with h as (select distinct hit_id, score, coalesce(nullif(document_url, ''), chunk_document_url) as document_url from retrieval_results
           where score is not null and not isnan(score)),
r as (select *, row_number() over (partition by document_url order by score desc, hit_id) as k from h where document_url is not null)
select document_url, hit_id from r where k <= 3
"""
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The three best-scored hits of every document."""
    from gleanery.llm.topn import top_n_per_group

    hits = table(spark, d, "retrieval_results")
    url = F.coalesce(F.nullif(F.col("document_url"), F.lit("")), F.col("chunk_document_url"))
    return top_n_per_group(hits, url, "score", "hit_id", 3, group_as="document_url").select("document_url", "hit_id")


# --- 8: evaluation texts in training texts


@query(
    """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
g as (select item_id, w, unnest(range(1, greatest(1, len(w) - 10))) as k from i), e as (select distinct item_id, array_to_string(w[k:k + 11], ' ') as run from g),
h as (select doc_id, w, unnest(range(1, greatest(1, len(w) - 10))) as k from d)
select distinct h.doc_id, e.item_id from h join e on e.run = array_to_string(h.w[h.k:h.k + 11], ' ')
"""
)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold twelve or more consecutive words of an evaluation item, and the item."""
    from gleanery.llm.leakage import find_leaks

    return find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


# --- 10: text statistics


def _common(spark: SparkSession, d: str) -> set[str]:
    """The function words: a fixed table of a few hundred rows."""
    return {r.word.lower() for r in table(spark, d, "common_words").select("word").where("word is not null").collect()}


def _statistics(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.llm.quality import text_statistics

    return text_statistics(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", _common(spark, d))


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are mostly no natural prose."""
    from gleanery.llm.quality import not_prose

    return not_prose(_statistics(spark, d)).select("doc_id").dropDuplicates()


@query(
    """
with common as (select list(distinct lower(word)) as ws from common_words where word is not null),
d as (select distinct doc_id, coalesce(text, '') as t from documents),
x as (select doc_id, t, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') as w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]')) as lines,
  length(regexp_replace(t, '[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+', '', 'g')) as solid from d)
select doc_id, cast(len(w) as bigint) as n_words, cast(len(lines) as bigint) as n_lines, round(case when len(lines) > 0 and len(w) > 0 then length(array_to_string(w, '')) / len(w) end, 6) as mean_word_length,
  round(case when len(lines) > 0 then (solid - length(array_to_string(w, ''))) / solid end, 6) as symbol_ratio, round(case when len(lines) > 0 and len(w) > 0 then len(list_distinct(w)) / len(w) end, 6) as distinct_share,
  round(case when len(lines) > 0 then len(list_filter(lines, lambda l: regexp_matches(l, '[.!?…。！？:;]["'')\\]»”’ \\t\\r]*$'))) / len(lines) end, 6) as end_punct_share,
  round(case when len(lines) > 0 and len(w) > 0 then len(list_filter(w, lambda y: list_contains(ws, y))) / len(w) end, 6) as common_share
from x, common
"""
)
def p10_measures(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of every document that don't depend on labels."""
    shares = ("mean_word_length", "symbol_ratio", "distinct_share", "end_punct_share", "common_share")
    return _statistics(spark, d).select("doc_id", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in shares]).distinct()


@query()
def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every document."""
    return _statistics(spark, d).dropDuplicates(["doc_id"])


# --- 7: template residue and error pages


def _excluded(spark: SparkSession, d: str) -> DataFrame:
    from gleanery.llm.residue import residue

    return residue(table(spark, d, "cached_fetches").select("fetch_id", "url", "body"), "fetch_id", "url", "body")


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Fetches to exclude."""
    return _excluded(spark, d).select("fetch_id")


@query()
def p7_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Fetches to exclude and why."""
    return _excluded(spark, d)


# --- 9: mixing sources


def _mix(spark: SparkSession, d: str):
    import public_tokenizers

    from gleanery.llm.mixture import mix

    docs = spread(table(spark, d, "documents").select("doc_id", "text", "source"))
    return mix(docs, "doc_id", "text", "source", table(spark, d, "source_targets"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of the mixture, each with its number of repeats."""
    return _mix(spark, d)[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return _mix(spark, d)[1]


# --- 5: main content of pages


def _labeller(spark: SparkSession, d: str):
    """The line model, and what recurs on the pages of both tables."""
    from gleanery.llm.boilerplate import labeller

    pages = spread(table(spark, d, "cached_fetches").select(F.col("body").alias("text"))).unionByName(spread(table(spark, d, "cached_assessments").select(F.col("full_text").alias("text"))))
    return labeller(spark, pages, "text")


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines that show text but are no main content; excluded fetches are left out. Fetches are labelled and summarised for that in one pass."""
    from gleanery.llm.boilerplate import boilerplate_lines, label_lines
    from gleanery.llm.residue import filler_words, read_pages, residue_of

    fetched = table(spark, d, "cached_fetches").select("fetch_id", "url", "body")
    known, words = together(lambda: _labeller(spark, d), lambda: filler_words(fetched, "url", "body"))
    pages = read_pages(fetched, "fetch_id", "url", "body", lambda text: boilerplate_lines(text, *known.value), words)
    fetches = pages.select(F.col("k").alias("fetch_id"), F.explode("also").alias("line_no")).join(residue_of(pages, "fetch_id").select("fetch_id"), "fetch_id", "left_anti")
    fetches = fetches.select(F.lit("body").alias("field_name"), F.col("fetch_id").alias("record_id"), "line_no")
    texts = label_lines(spread(table(spark, d, "cached_assessments").select("assessment_id", "full_text")), "assessment_id", "full_text", known)
    texts = texts.select(F.lit("full_text").alias("field_name"), F.col("assessment_id").alias("record_id"), "line_no")
    return fetches.unionByName(texts).dropDuplicates(["field_name", "record_id", "line_no"])


@query()
def p5_bodies(spark: SparkSession, d: str) -> DataFrame:
    """Each fetched page with its main body only."""
    from gleanery.llm.boilerplate import main_bodies

    known, excluded = together(lambda: _labeller(spark, d), lambda: _excluded(spark, d))
    pages = main_bodies(spread(table(spark, d, "cached_fetches").select("fetch_id", "body")), "fetch_id", "body", known)
    return pages.join(excluded.select("fetch_id"), "fetch_id", "left_anti").dropDuplicates(["fetch_id"])


# --- 1: near-duplicates


def _similar(spark: SparkSession, d: str, name: str, key: str, text: str, bits: int, threshold: float, shingle: int, least: int):
    from gleanery.llm.neardup import similar

    return similar(spread(table(spark, d, name).select(key, text)), key, text, threshold, shingle, least, bits)


#: Field, table, id and bits of parity: two to four for a word of a usual record, as many as bound its distance well.
FIELDS = (("snippet", "search_results", "result_id", 128), ("body", "cached_fetches", "fetch_id", 512))


_PAIRS = """
{0} as (select distinct {1} as id, list_sort(list_distinct(regexp_extract_all(lower({2}), '[\\p{{L}}\\p{{N}}]+'))) as w from {3} where {2} is not null),
{0}s as (select id, w, len(w) as n from {0} where len(w) >= 20),
{0}p as (select a.id as id_a, b.id as id_b, a.n + b.n as total, len(list_intersect(a.w, b.w)) as shared from {0}s a join {0}s b on a.id < b.id and a.n >= 0.7 * b.n and b.n >= 0.7 * a.n)
"""


@query(
    "with "
    + ", ".join(_PAIRS.format(a, key, field, name) for a, (field, name, key, _) in zip("xy", FIELDS))
    + " select 'snippet' as field_name, id_a, id_b from xp where 10 * shared >= 7 * (total - shared) union all select 'body', id_a, id_b from yp where 10 * shared >= 7 * (total - shared)"
)
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records of which 0.7 of all their words are shared, of at least 20 words each."""
    from gleanery.llm.neardup import record_pairs

    def part(field, name, key, bits):
        return record_pairs(*_similar(spark, d, name, key, field, bits, 0.7, 1, 20)).select(F.lit(field).alias("field_name"), "id_a", "id_b")

    parts = together(*[partial(part, *f) for f in FIELDS])
    return parts[0].unionByName(parts[1])


_RUNS = """
{0}b as (select distinct {1} as id, regexp_extract_all(lower({2}), '[\\p{{L}}\\p{{N}}]+') as w from {3} where {2} is not null and {1} is not null),
{0}s as (select id, list_sort(list_distinct(list_transform(case when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) end, lambda x: hash(x)))) as s from {0}b where len(w) > 0),
{0}c as (select s, len(s) as n, min(id) as rep from {0}s group by s),
{0}p as (select a.rep as a, b.rep as b, a.n + b.n as total, len(list_intersect(a.s, b.s)) as shared from {0}c a join {0}c b on a.rep < b.rep and a.n >= 0.8 * b.n and b.n >= 0.8 * a.n),
{0}e as (select a, b from {0}p where 10 * shared >= 8 * (total - shared)), {0}l as (select a, b from {0}e union select b, a from {0}e),
{0}r as (select rep as start, rep as node from {0}c union select r.start, l.b from {0}r r join {0}l l on l.a = r.node),
{0}g as (select start as rep, min(node) as grp from {0}r group by start), {0}d as (select a as rep, count(*) as links from {0}l group by a)
"""
_RUN_ROWS = "select '{2}' as field_name, i.id as record_id, g.grp as group_id, coalesce(d.links, 0) as links from (select distinct {1} as id from {3} where {1} is not null) i left join {0}s s on s.id = i.id left join {0}c c on c.s = s.s left join {0}g g on g.rep = c.rep left join {0}d d on d.rep = c.rep"


@query("with recursive " + ", ".join(_RUNS.format(a, key, field, name) for a, (field, name, key, _) in zip("xy", FIELDS)) + " union all ".join(_RUN_ROWS.format(a, key, field, name) for a, (field, name, key, _) in zip("xy", FIELDS)))
def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of records whose five-word runs are 0.8 alike or more, one row per record with its number of links; a text of one to four words is one run, one without words has no group."""
    from gleanery.llm.neardup import groups

    def part(field, name, key, _):
        own = groups(*_similar(spark, d, name, key, field, 256, 0.8, 5, 1))
        every = table(spark, d, name).select(F.col(key).alias("id")).where("id is not null").distinct()
        return every.join(own, "id", "left").select(F.lit(field).alias("field_name"), F.col("id").alias("record_id"), F.col("group").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))

    parts = together(*[partial(part, *f) for f in FIELDS])
    return parts[0].unionByName(parts[1])


# --- 4: free-entered values


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry meant by every free-entered value, 0 for none."""
    from gleanery.llm.canonical import map_values

    ref = table(spark, d, "canonical_values")
    parts = []
    for name, key, column in (("fact_claims", "claim_id", "candidate_value"), ("synthesis_results", "synthesis_id", "normalized_value")):
        found = map_values(spread(table(spark, d, name).select(key, "field_name", column)), key, "field_name", column, ref)
        parts.append(found.select(F.lit(column).alias("field_name"), F.col(key).alias("record_id"), "value_id"))
    return parts[0].unionByName(parts[1])


# --- 3: personal details


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every different detail of each text, as written."""
    from gleanery.llm.pii import find_details

    parts = []
    for name, key, column in (("cached_assessments", "assessment_id", "text"), ("fact_claims", "claim_id", "supporting_excerpt")):
        found = find_details(spread(table(spark, d, name).select(key, column)), key, column)
        parts.append(found.select(F.lit(column).alias("field_name"), F.col(key).alias("record_id"), "pii_type", "pii_text"))
    return parts[0].unionByName(parts[1]).dropDuplicates()


@query()
def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The texts with typed placeholders."""
    from gleanery.llm.pii import redacted

    parts = []
    for name, key, column in (("cached_assessments", "assessment_id", "text"), ("fact_claims", "claim_id", "supporting_excerpt")):
        clean = redacted(spread(table(spark, d, name).select(key, column)), key, column)
        parts.append(clean.select(F.lit(column).alias("field_name"), F.col(key).alias("record_id"), F.col(column).alias("redacted")))
    return parts[0].unionByName(parts[1]).dropDuplicates(["field_name", "record_id"])
