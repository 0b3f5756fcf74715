"""Queries over pages, blocks, chunks and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions import text as fx
from gleanery.operators import chunking, parsing, rows
from gleanery.plans.registry import query
from gleanery.sources.tables import spread, table

#: White space as Python's strip reads it, for RE2.
_BLANK = r"[\t\n\x{0b}\f\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _windows_sql(source: str, size: str, overlap: str, least: int = 80) -> str:
    """Windows of the texts of ``source`` (document, kind, text) as common table expressions: v has (document, kind, k, piece).

    A window ends at the last space within its size, else at its full size; the next one
    begins ``overlap`` before that end, or at it where that would not be further on.
    """
    end = "case when {b} + size >= n then n when instr(substr(text, cast({b} + 2 as bigint), size - 1), ' ') > 0 then {b} + 1 + length(regexp_extract(substr(text, cast({b} + 2 as bigint), size - 1), '(?s)^(.*) ', 1)) else {b} + size end"
    following = "case when e - overlap > b then e - overlap else e end"
    return f"""
s as (select document, kind, text, cast(length(text) as bigint) as n, cast({size} as bigint) as size, cast({overlap} as bigint) as overlap from ({source}) where length(text) > 0),
w as (select document, kind, text, n, size, overlap, cast(0 as bigint) as b, cast({end.format(b="0")} as bigint) as e from s
  union all select document, kind, text, n, size, overlap, {following}, cast({end.format(b=f"({following})")} as bigint) from w where e < n),
p as (select document, kind, b, regexp_replace(substr(text, cast(b + 1 as bigint), cast(e - b as bigint)), '^{_BLANK}|{_BLANK}$', '', 'g') as piece from w),
v as (select document, kind, row_number() over (partition by document, kind order by b) - 1 as k, piece from p where length(piece) >= {least})
"""


_CHUNK_ROWS = "select document, cast(k as int) as index, piece as content, case when kind = 'table' then 'table' else 'text' end as chunk_type, substr(sha256(document || '|' || k || '|' || sha256(piece)), 1, 16) as chunk_id from v"
_SPACE = r"[\s  - 　]+"


@query(
    """
select provider, source_tier, count(*) as n, count(distinct domain) as n_domains, grouping(provider, source_tier) as level
from (select distinct result_id, provider, source_tier, domain from search_results)
group by grouping sets ((provider, source_tier), (provider), (source_tier), ())
"""
)
def scan_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Results by provider, tier, both and in all: one pass with grouping sets."""
    t = rows.once(table(spark, d, "search_results"), "result_id", "provider", "source_tier", "domain")
    t.createOrReplaceTempView("_scan_rollup")
    return spark.sql("select provider, source_tier, count(*) as n, count(distinct domain) as n_domains, grouping_id(provider, source_tier) as level from _scan_rollup group by grouping sets ((provider, source_tier), (provider), (source_tier), ())")


@query(
    """
with f as (select distinct fetch_id, content_type, octet_length(encode(body)) as n from cached_fetches),
m as (select fetch_id, lower(trim(split_part(coalesce(content_type, ''), ';', 1))) as mime, coalesce(n, 0) as n from f)
select mime, count(*) as n_pages, count(*) filter (where n <= 5242880) as n_within,
  bool_and(mime = '' or regexp_matches(mime, '^(text/|application/(json|xml|xhtml))')) as allowed
from m group by mime
"""
)
def content_types(spark: SparkSession, d: str) -> DataFrame:
    """Pages by type, with the allow list and the size cap of a fetch."""
    t = table(spark, d, "cached_fetches").select("fetch_id", "content_type", F.octet_length("body").alias("n")).distinct()
    m = t.select(fx.mime(F.col("content_type")).alias("mime"), F.coalesce("n", F.lit(0)).alias("n"), fx.content_type_allowed(F.col("content_type")).alias("ok"))
    return m.groupBy("mime").agg(F.count("*").alias("n_pages"), F.count_if(F.col("n") <= 5242880).alias("n_within"), F.bool_and("ok").alias("allowed"))


@query(
    """
with u as (select distinct result_id, url, domain from search_results),
h as (select result_id, domain, regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) as auth from u)
select result_id, regexp_replace(regexp_replace(auth, ':[0-9]+$', ''), '^www[.]', '') as host, auth as authority,
  coalesce(lower(trim(domain)) = regexp_replace(auth, ':[0-9]+$', ''), false) as same_domain
from h
"""
)
def url_parts(spark: SparkSession, d: str) -> DataFrame:
    """Host and authority of every result's address, and whether its domain column agrees."""
    t = rows.once(table(spark, d, "search_results"), "result_id", "url", "domain")
    auth = fx.authority(F.col("url"))
    same = F.lower(F.trim("domain")) == F.regexp_replace(auth, ":[0-9]+$", "")
    return t.select("result_id", fx.host(F.col("url")).alias("host"), auth.alias("authority"), F.coalesce(same, F.lit(False)).alias("same_domain"))


@query(
    """
with r as (select distinct result_id, provider, url from search_results),
h as (select provider, regexp_extract(lower(url), '^(https?)://(?:[^/@]*@)?([^/:?#]+)', 1) as scheme, regexp_extract(lower(url), '^(https?)://(?:[^/@]*@)?([^/:?#]+)', 2) as host from r)
select provider, count(*) as n, count(*) filter (where scheme <> '' and host <> 'localhost' and not ends_with(host, '.localhost') and regexp_matches(host, '[g-wyz]')) as n_safe from h group by provider
"""
)
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Results whose address may be fetched: http or https, and no private or reserved literal host."""
    t = rows.once(table(spark, d, "search_results"), "result_id", "provider", "url")
    return t.groupBy("provider").agg(F.count("*").alias("n"), F.count_if(fx.url_safe(F.col("url"))).alias("n_safe"))


@query(
    """
with b as (select distinct fetch_id, body from cached_fetches where body is not null),
x as (select fetch_id, regexp_replace(regexp_replace(regexp_replace(body, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g') as t from b),
e as (select fetch_id, replace(replace(replace(replace(replace(replace(t, '&quot;', '"'), '&nbsp;', ' '), '&#39;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as t from x)
select fetch_id, sha256(trim(regexp_replace(t, '[\\s  - 　]+', ' ', 'g'))) as text_hash from e
"""
)
def html_text(spark: SparkSession, d: str) -> DataFrame:
    """Visible text of every page, as a hash."""
    t = spread(table(spark, d, "cached_fetches").where("body is not null").select("fetch_id", "body"))
    return t.select("fetch_id", F.sha2(fx.html_text(F.col("body")), 256).alias("text_hash")).distinct()


_HEADING = r"(?is)<h([1-6])\b[^>]*>(.*?)</h[1-6]\s*>"


@query(
    f"""
with b as (select distinct fetch_id, body from cached_fetches where body is not null),
h as (select fetch_id, unnest(regexp_extract_all(body, '{_HEADING}', 1)) as lvl, unnest(regexp_extract_all(body, '{_HEADING}', 2)) as heading, unnest(range(len(regexp_extract_all(body, '{_HEADING}', 2)))) as pos from b)
select fetch_id, cast(pos as int) as position, cast(lvl as int) as level, trim(regexp_replace(regexp_replace(heading, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) as heading from h
"""
)
def html_headings(spark: SparkSession, d: str) -> DataFrame:
    """Headings of every page in order, with their level; markup within them goes."""
    t = table(spark, d, "cached_fetches").where("body is not null").select("fetch_id", F.regexp_extract_all("body", F.lit(_HEADING), F.lit(1)).alias("l"), F.regexp_extract_all("body", F.lit(_HEADING), F.lit(2)).alias("h")).distinct()
    x = t.select("fetch_id", F.posexplode(F.arrays_zip("l", "h")).alias("position", "z"))
    return x.select("fetch_id", "position", F.col("z.l").cast("int").alias("level"), F.trim(F.regexp_replace(F.regexp_replace("z.h", "<[^>]*>", " "), r"\s+", " ")).alias("heading"))


#: Blocks of pages in SQL: scripts go, tables and headings are cut out, the rest falls into paragraphs that are joined until they have 80 characters.
_BLOCKS_SQL = r"""
b as (select distinct cast(fetch_id as varchar) as id, regexp_replace(body, '(?is)<(script|style)\b[^>]*>.*?</(script|style)>', ' ', 'g') as body from cached_fetches where body is not null),
c as (select id, string_split(regexp_replace(body, '(?is)(<table\b.*?</table>|<h[1-6]\b[^>]*>.*?</h[1-6]>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) as cs from b),
u as (select id, unnest(cs) as piece, unnest(range(1, len(cs) + 1)) as no from c),
k as (select id, no, piece, no % 2 = 0 as whole, regexp_matches(piece, '(?i)^<table') and no % 2 = 0 as tab from u),
flat as (select id, no, tab, trim(regexp_replace(regexp_replace(piece, '<[^>]+>', ' ', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')) as txt, piece from k where whole),
cells as (select id, no, txt, tab, list_filter(list_transform(regexp_extract_all(piece, '(?is)<tr\b[^>]*>(.*?)</tr>', 1), lambda r: array_to_string(list_transform(regexp_extract_all(r, '(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>', 1), lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]+>', ' ', 'g'), '[\s\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g'))), ' | ')), lambda r: r <> '') as trs from flat),
fixed as (select id, no, 0 as sub, case when tab then 'table' else 'heading' end as block_type, case when tab and len(trs) > 0 then array_to_string(trs, chr(10)) else txt end as content from cells),
loose as (select id, no, replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(piece, '(?i)</?(?:p|div|br|li|ul|ol|section|article|header|footer|blockquote|pre|hr)\b[^>]*>', chr(10) || chr(10), 'g'), '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') as txt from k where not whole),
lines as (select id, no, list_filter(list_transform(regexp_split_to_array(txt, '\r\n|[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]'), lambda x: regexp_replace(regexp_replace(x, ' {2,}', ' ', 'g'), '^[\s\x{1c}-\x{1f}\x{85}\p{Z}]+|[\s\x{1c}-\x{1f}\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') as ps from loose),
fold as (select id, no, ps, 1 as i, 1 as sub, cast(length(ps[1]) as bigint) as used from lines where len(ps) > 0
  union all select id, no, ps, i + 1, case when used >= 80 then sub + 1 else sub end, case when used >= 80 then length(ps[i + 1]) else used + 2 + length(ps[i + 1]) end from fold where i < len(ps)),
joined as (select id, no, sub, string_agg(ps[i], chr(10) || chr(10) order by i) as content from fold group by all),
kinds as (select id, no, sub, content, string_split(content, chr(10)) as ls from joined),
made as (select id, no, sub, case when len(list_filter(ls, lambda x: x[1] = '|' and instr(substr(x, 3), '|') > 0)) >= 2 or len(list_filter(ls, lambda x: instr(substr(x, 2), chr(9)) > 0 and instr(substr(x, 2), chr(9)) < length(x) - 1)) >= 2
    or (len(list_filter(ls, lambda x: x[1] = '|' and instr(substr(x, 3), '|') > 0)) >= 1 and len(list_filter(ls, lambda x: regexp_matches(x, '^[ \t]*[|:\-][|: \-]*$'))) >= 1) then 'table' else 'text' end as block_type, content from kinds
  union all select id, no, sub, block_type, content from fixed where content <> ''),
blocks as (select id, cast(row_number() over (partition by id order by no, sub) - 1 as int) as position, block_type, content from made)
"""


@query("with recursive " + _BLOCKS_SQL + "select id as fetch_id, position, block_type, content from blocks")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every page: headings, tables and joined paragraphs in order."""
    t = spread(rows.once(table(spark, d, "cached_fetches"), "fetch_id", "body"))
    return parsing.extract_blocks(t, "fetch_id", "body").withColumnRenamed("url", "fetch_id")


@query(
    "with recursive "
    + _BLOCKS_SQL
    + """, o as (select *, sum(case when block_type = 'heading' then 1 else 0 end) over (partition by id order by position) as section from blocks),
g as (select id as url, cast(section as bigint) as section, max(case when block_type = 'heading' then content end) as heading, count(*) filter (where block_type <> 'heading') as n_blocks from o group by all)
select url, section, heading, case when section = 0 then 0 else 1 end as level, n_blocks, substr(sha256(url || '|' || section || '|' || coalesce(heading, '')), 1, 16) as section_id from g
"""
)
def page_sections(spark: SparkSession, d: str) -> DataFrame:
    """Section tree of every page."""
    t = spread(rows.once(table(spark, d, "cached_fetches"), "fetch_id", "body"))
    return parsing.section_tree(parsing.extract_blocks(t, "fetch_id", "body"))


@query(
    """
with b as (select distinct fetch_id, body from cached_fetches where body is not null),
l as (select fetch_id, unnest(string_split(body, chr(10))) as line, unnest(range(1, len(string_split(body, chr(10))) + 1)) as line_no from b),
s as (select fetch_id, line_no, sum(case when regexp_matches(line, '(?i)^\\s*<h[1-6][ >]') then 1 else 0 end) over (partition by fetch_id order by line_no) as section from l)
select fetch_id, cast(section as bigint) as section, count(*) as n_lines, cast(min(line_no) as bigint) as first_line from s group by fetch_id, section
"""
)
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    """Lines of every page by the heading they stand under: a running count of headings."""
    t = table(spark, d, "cached_fetches").where("body is not null").select("fetch_id", "body").distinct()
    lines = t.select("fetch_id", F.posexplode(F.split("body", "\n")).alias("p", "line"))
    run = Window.partitionBy("fetch_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    s = lines.select("fetch_id", "p", F.sum(F.when(F.rlike("line", F.lit(r"(?i)^\s*<h[1-6][ >]")), 1).otherwise(0)).over(run).alias("section"))
    return s.groupBy("fetch_id", "section").agg(F.count("*").alias("n_lines"), (F.min("p") + 1).cast("bigint").alias("first_line"))


@query(
    """
with c as (select distinct chunk_id, content, chunk_type from chunks where content is not null),
l as (select chunk_id, chunk_type, string_split(content, chr(10)) as ls from c),
n as (select chunk_type, len(list_filter(ls, lambda x: x[1] = '|' and instr(substr(x, 3), '|') > 0)) as barred, len(list_filter(ls, lambda x: instr(substr(x, 2), chr(9)) > 0 and instr(substr(x, 2), chr(9)) < length(x) - 1)) as tabbed,
  len(list_filter(ls, lambda x: trim(x, ' ' || chr(9)) <> '' and replace(replace(replace(replace(trim(x, ' ' || chr(9)), '|', ''), ':', ''), '-', ''), ' ', '') = '')) as rules from l)
select chunk_type, case when barred >= 2 or tabbed >= 2 or (rules >= 1 and barred >= 1) then 'table' else 'text' end as kind, count(*) as n from n group by all
"""
)
def text_tables(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by their declared type and by what their text looks like."""
    t = rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "content", "chunk_type")
    return t.groupBy("chunk_type", fx.text_table_kind(F.col("content")).alias("kind")).agg(F.count("*").alias("n"))


@query(
    """
select assessment_id, sha256(full_text) as text_hash, lower(trim(split_part(coalesce(mime_type, ''), ';', 1))) as mime, cast(length(full_text) as bigint) as n_chars,
  case when regexp_matches(lower(url), '/(about|company|corporate|contact)') then 'company_website' else 'unknown' end as url_type,
  case when lower(trim(split_part(coalesce(mime_type, ''), ';', 1))) in ('text/html', 'application/xhtml+xml') then 'html' when lower(trim(split_part(coalesce(mime_type, ''), ';', 1))) = 'application/pdf' then 'pdf' else 'text' end as parser
from (select distinct assessment_id, full_text, mime_type, url from cached_assessments)
"""
)
def parse_assembly(spark: SparkSession, d: str) -> DataFrame:
    """Assembled texts: hash, type, length, kind by address, and the parser their type selects."""
    t = table(spark, d, "cached_assessments")
    m = fx.mime(F.col("mime_type"))
    parser = F.when(m.isin("text/html", "application/xhtml+xml"), "html").when(m == "application/pdf", "pdf").otherwise("text")
    out = t.select("assessment_id", F.sha2("full_text", 256).alias("text_hash"), m.alias("mime"), F.char_length("full_text").cast("bigint").alias("n_chars"), fx.document_type(F.col("url")).alias("url_type"), parser.alias("parser"))
    return out.distinct()


@query(
    """
with c as (select distinct chunk_id, document_url, index, section_level from chunks)
select a.chunk_id, (select max(b.index) from c b where b.document_url = a.document_url and b.index < a.index and b.section_level < a.section_level) as parent_index from c a
"""
)
def outline_parents(spark: SparkSession, d: str) -> DataFrame:
    """For every chunk the nearest earlier chunk of a smaller level in its document."""
    t = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "index", "section_level")
    return rows.nearest_above(t, ["document_url"], "index", "section_level", "parent_index", coarse=F.floor(F.col("index") / 64)).select("chunk_id", "parent_index")


@query(
    """
with s as (select document_url, page, max(section_id) as section_id from (select distinct chunk_id, document_url, page, section_id from chunks where page is not null) group by all),
b as (select distinct block_id, document_url, page from content_blocks where page is not null)
select b.block_id, arg_max(s.section_id, s.page) as section_id from b left join s on b.document_url = s.document_url and s.page <= b.page group by b.block_id
"""
)
def asof_section(spark: SparkSession, d: str) -> DataFrame:
    """Section of every block: that of the last section start at or before its page."""
    s = rows.once(table(spark, d, "chunks").where("page is not null"), "chunk_id", "document_url", "page", "section_id").groupBy("document_url", "page").agg(F.max("section_id").alias("sid"))
    b = rows.once(table(spark, d, "content_blocks").where("page is not null"), "block_id", "document_url", "page")
    return rows.as_of(b, s, ["document_url"], "page", "page", "sid", "section_id", lambda p: F.floor(p / 64)).select("block_id", "section_id")


@query(
    """
select p.event_id, max(s.event_id) as signup_id from (select * from events where event_type = 'purchase') p
left join (select user_id, ts, max(event_id) as event_id from events where event_type = 'signup' group by all) s on s.user_id = p.user_id
  and s.ts = (select max(z.ts) from events z where z.event_type = 'signup' and z.user_id = p.user_id and z.ts <= p.ts)
group by p.event_id
"""
)
def asof_signup(spark: SparkSession, d: str) -> DataFrame:
    """For every purchase the user's last signup at or before it."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    s = e.where("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("signup"))
    purchases = e.where("event_type = 'purchase'").drop("event_type")
    return rows.as_of(purchases, s, ["user_id"], "ts", "ts", "signup", "signup_id", lambda t: F.date_trunc("week", t)).select("event_id", "signup_id")


@query(
    """
with r as (select p_partkey, p_brand, p_size, dense_rank() over (partition by p_brand order by p_size desc) as k from part)
select p_brand, case when k = 1 then 'title' when k = 2 then 'heading' when k = 3 then 'subheading' else 'body' end as tier, count(*) as n, cast(median(p_size) as double) as median_size from r group by all
"""
)
def size_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by the three largest different sizes of a group, with the median size of each."""
    k = F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.col("p_size").desc()))
    t = table(spark, d, "part").select("p_brand", "p_size", k.alias("k"))
    tier = F.when(F.col("k") == 1, "title").when(F.col("k") == 2, "heading").when(F.col("k") == 3, "subheading").otherwise("body")
    return t.groupBy("p_brand", tier.alias("tier")).agg(F.count("*").alias("n"), F.median("p_size").cast("double").alias("median_size"))


_EDGES = "select distinct document_url, section_id, parent_section_id from chunks where section_id is not null"


@query(
    f"""
with recursive e as ({_EDGES}), t as (
  select distinct document_url, section_id as ancestor, section_id as descendant from e
  union select t.document_url, t.ancestor, e.section_id from t join e on e.document_url = t.document_url and e.parent_section_id = t.descendant where e.section_id <> t.descendant)
select * from t union select distinct document_url, parent_section_id, section_id from e where parent_section_id is not null and parent_section_id <> ''
"""
)
def section_closure(spark: SparkSession, d: str) -> DataFrame:
    """All (ancestor, descendant) sections of every document, also below parents that have no chunk of their own."""
    e = table(spark, d, "chunks").where("section_id is not null").select("document_url", "section_id", "parent_section_id").distinct()
    return rows.closure(e, ["document_url"], "section_id", "parent_section_id")


@query(
    """
with recursive e as (select 'r' || r_regionkey as child, 'world' as parent from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation
  union all select 's' || s_suppkey, 'n' || s_nationkey from supplier union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
t as (select parent as ancestor, child as descendant from e union all select t.ancestor, e.child from t join e on e.parent = t.descendant)
select ancestor, count(*) as n_below from t group by ancestor
"""
)
def region_closure(spark: SparkSession, d: str) -> DataFrame:
    """Nodes below every node of the tree of regions, nations, suppliers and customers."""
    node = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    e = table(spark, d, "region").select(node("r", "r_regionkey").alias("child"), F.lit("world").alias("parent"))
    for name, child, parent in (("nation", ("n", "n_nationkey"), ("r", "n_regionkey")), ("supplier", ("s", "s_suppkey"), ("n", "s_nationkey")), ("customer", ("c", "c_custkey"), ("n", "c_nationkey"))):
        e = e.unionByName(table(spark, d, name).select(node(*child).alias("child"), node(*parent).alias("parent")))
    t = rows.closure(e, [], "child", "parent").where("ancestor <> descendant")
    return t.groupBy("ancestor").agg(F.count("*").alias("n_below"))


@query(
    """
with n as (select distinct document_url, section_path_str as path, section_id as node from chunks where section_path_str is not null and section_path_str <> '')
select distinct a.document_url, a.node as ancestor, b.node as descendant from n a join n b on a.document_url = b.document_url and (b.path = a.path or starts_with(b.path, a.path || '|'))
"""
)
def prefix_closure(spark: SparkSession, d: str) -> DataFrame:
    """Sections whose path begins with another's."""
    t = table(spark, d, "chunks").select("document_url", "section_path_str", "section_id")
    return rows.prefix_closure(t, ["document_url"], "section_path_str", "section_id")


@query("with recursive " + _windows_sql("select distinct cast(doc_id as varchar) as document, 'text' as kind, text from documents where text is not null", "1500", "200") + _CHUNK_ROWS)
def flat_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of every document."""
    t = spread(rows.once(table(spark, d, "documents"), "doc_id", "text"))
    return chunking.flat_chunks(t, "doc_id", "text")


@query("with recursive " + _windows_sql("select distinct block_id as document, coalesce(block_type, '') as kind, content as text from content_blocks where content is not null", "case when kind = 'table' then 4000 else 1500 end", "case when kind = 'table' then 0 else 200 end") + _CHUNK_ROWS)
def block_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of every block, tables whole or cut without overlap."""
    t = spread(rows.once(table(spark, d, "content_blocks"), "block_id", "content", "block_type"))
    return chunking.flat_chunks(t, "block_id", "content", "block_type")


@query(
    """
with recursive c as (select distinct chunk_id, coalesce(document_url, '') as document_url, coalesce(section_id, '') as section_id, index, coalesce(content, '') as txt, coalesce(chunk_type, '') = 'table' as tab, section_path_str as path from chunks),
b as (select *, row_number() over (partition by document_url, section_id order by index) as r, cast(length(txt) // 4 as bigint) as s from c),
h as (select document_url, section_id, case when coalesce(arg_min(path, r), '') <> '' then replace(arg_min(path, r), '|', ' > ') || chr(10) || chr(10) else '' end as head, string_agg(txt, chr(10) || chr(10) order by r) as whole, bool_or(txt <> '') as any_text from b group by all),
w as (select document_url, section_id, cast(0 as bigint) as r, cast(1 as bigint) as num, cast(0 as bigint) as used, true as vacant, cast(-1 as bigint) as pack from h
  union all select document_url, section_id, r, case when tab then pack + 1 when txt = '' then num when now >= 400 then pack + 1 else pack end, case when tab then 0 when txt = '' then used when now >= 400 then 0 else now end, case when tab then true when txt = '' then vacant else now >= 400 end, pack
  from (select b.document_url, b.section_id, b.r, b.tab, b.txt, w.num, w.used, w.vacant,
    case when b.tab then case when w.vacant then w.num else w.num + 1 end when b.txt = '' then -1 when not w.vacant and w.used + b.s > 800 then w.num + 1 else w.num end as pack,
    case when not w.vacant and w.used + b.s > 800 then b.s else w.used + b.s end as now
    from w join b on b.document_url = w.document_url and b.section_id = w.section_id and b.r = w.r + 1)),
g as (select w.document_url, w.section_id, w.pack, bool_or(b.tab) as tab, string_agg(b.txt, chr(10) || chr(10) order by b.r) as txt from w join b on b.document_url = w.document_url and b.section_id = w.section_id and b.r = w.r where w.pack > 0 group by all),
o as (select document_url, section_id, cast(0 as bigint) as pack, 'section_summary' as chunk_role, head || substr(whole, 1, 803) as content from h where any_text
  union all select g.document_url, g.section_id, g.pack, case when g.tab then 'table' else 'content' end, case when g.tab then g.txt else h.head || g.txt end from g join h on h.document_url = g.document_url and h.section_id = g.section_id where not g.tab or regexp_matches(g.txt, '\\S'))
select document_url, section_id, cast(row_number() over (partition by document_url, section_id order by pack) - 1 as int) as ordinal, chunk_role, content, cast(length(content) // 4 as int) as token_count from o
"""
)
def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Summary, table and packed content chunks of every section."""
    t = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "section_id", "index", "content", "chunk_type", "section_path_str")
    return chunking.section_chunks(t, ["document_url", "section_id"], "index", "content", "chunk_type", "section_path_str")


@query(
    """
with c as (select distinct chunk_id, document_url, index, content from chunks where content is not null)
select document_url, count(*) as n_chunks, md5(string_agg(content, chr(10) || chr(10) order by index, content)) as text_hash from c group by document_url
"""
)
def reassembled(spark: SparkSession, d: str) -> DataFrame:
    """Every document put together again from its chunks."""
    t = rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "document_url", "index", "content")
    return chunking.reassemble(t, "document_url", "index", "content").select("document_url", "n_chunks", F.md5(F.col("text").cast("binary")).alias("text_hash"))


@query(
    """
select lang, count(*) as n, cast(sum(cast(ceil(length(text) / 4.0) as bigint)) as bigint) as tokens_up, cast(sum(length(text) // 4) as bigint) as tokens_down from documents where text is not null group by lang
"""
)
def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens by language, rounded up and down."""
    t = table(spark, d, "documents").where("text is not null").select("lang", "text")
    return t.groupBy("lang").agg(F.count("*").alias("n"), F.sum(fx.token_estimate(F.col("text"))).alias("tokens_up"), F.sum(fx.token_floor(F.col("text"))).alias("tokens_down"))


@query(
    """
select chunk_id, substr(sha256(document_url || '|' || cast(index as varchar) || '|' || content_hash), 1, 16) as made_id, coalesce(char_count = length(content), false) as count_right
from (select distinct chunk_id, document_url, index, content_hash, content, char_count from chunks)
"""
)
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of chunks made from their parts, and whether the stored length is right."""
    t = rows.once(table(spark, d, "chunks"), "chunk_id", "document_url", "index", "content_hash", "content", "char_count")
    return t.select("chunk_id", fx.short_id(F.col("document_url"), F.col("index").cast("string"), F.col("content_hash")).alias("made_id"), F.coalesce(F.col("char_count") == F.char_length("content"), F.lit(False)).alias("count_right"))


@query(
    """
with f as (select distinct fetch_id, url, cache_version from cached_fetches)
select fetch_id, 'fetch:' || coalesce(cache_version || ':', '') || substr(sha256(url), 1, 16) as cache_key from f
"""
)
def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of fetches, apart by version."""
    t = rows.once(table(spark, d, "cached_fetches"), "fetch_id", "url", "cache_version")
    return t.select("fetch_id", fx.cache_key("fetch", F.col("cache_version"), F.col("url")).alias("cache_key"))


@query(
    """
select chunk_id, cast(len(table_data) as int) as n_rows, cast(list_sum(list_transform(table_data, lambda r: len(r))) as bigint) as n_cells, cast(list_sum(list_transform(flatten(table_data), lambda x: length(coalesce(x, '')))) as bigint) as n_chars
from (select distinct chunk_id, table_data from chunks where table_data is not null)
"""
)
def table_codec(spark: SparkSession, d: str) -> DataFrame:
    """Tables encoded as JSON and decoded again, with their rows, cells and characters."""
    t = table(spark, d, "chunks").where("table_data is not null").select("chunk_id", F.to_json("table_data", {"ignoreNullFields": "false"}).alias("j")).distinct()
    x = t.select("chunk_id", F.from_json("j", "array<array<string>>").alias("a"))
    cells = F.flatten("a")
    return x.select("chunk_id", F.size("a").alias("n_rows"), F.aggregate("a", F.lit(0).cast("bigint"), lambda s, r: s + F.size(r)).alias("n_cells"), F.aggregate(cells, F.lit(0).cast("bigint"), lambda s, c: s + F.char_length(F.coalesce(c, F.lit("")))).alias("n_chars"))


@query(
    """
with t as (select distinct assessment_id, text from cached_assessments where text is not null),
a as (select assessment_id, text, list_transform(regexp_extract_all(text, '\\b[A-Z]{2}\\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\\b'), lambda x: replace(x, ' ', '')) as accounts from t),
d as (select assessment_id, text, list_filter(list_transform(accounts, lambda x: list_transform(string_split(array_to_string(list_transform(string_split(substr(x, 5) || substr(x, 1, 4), ''), lambda c: case when c between 'A' and 'Z' then cast(ascii(c) - 55 as varchar) else c end), ''), ''), lambda c: cast(c as int))), lambda ds: list_reduce(ds, lambda s, c: (s * 10 + c) % 97) = 1) as good from a)
select assessment_id, cast(len(regexp_extract_all(text, '[\\p{L}\\p{N}._+%-]+@(?:[\\p{L}\\p{N}-]+\\.)+\\p{L}{2,}')) as int) as emails, cast(len(good) as int) as accounts,
  cast(len(list_filter(regexp_extract_all(text, '\\b[A-Z]{2}(?: ?\\d{2}){3} ?[A-D]\\b'), lambda x: regexp_matches(x, '^[^DFIQUV][^DFIQUVO]') and substr(x, 1, 2) not in ('BG', 'GB', 'KN', 'NK', 'NT', 'TN', 'ZZ'))) as int) as insurance_numbers, substr(text, 1, 500) as excerpt from d
"""
)
def detail_scan(spark: SparkSession, d: str) -> DataFrame:
    """E-mail addresses, account and insurance numbers by form, and the excerpt of every assessed text."""
    t = rows.once(table(spark, d, "cached_assessments").where("text is not null"), "assessment_id", "text")
    mails, accounts, insurance = fx.detail_counts(F.col("text"))
    return t.select("assessment_id", mails.alias("emails"), accounts.alias("accounts"), insurance.alias("insurance_numbers"), F.left("text", F.lit(500)).alias("excerpt"))


@query(
    """
with c as (select distinct chunk_id, content from chunks where content is not null),
h as (select chunk_id, list_transform(range(1, 9), lambda k: (instr('0123456789abcdef', substr(sha256(content), k, 1)) - 1) / 15.0) as v from c)
select chunk_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as first, round(v[8] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) as last from h
"""
)
def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in vectors of every chunk: their first and last parts."""
    from gleanery.functions.tables import hash_vector

    t = table(spark, d, "chunks").where("content is not null").select("chunk_id", hash_vector(F.col("content")).alias("v")).distinct()
    return t.select("chunk_id", F.round(F.element_at("v", 1), 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query(
    "with recursive c as (select distinct chunk_id, document_url, index, content from chunks where content is not null), o as (select document_url as document, 'text' as kind, count(*) as n_chunks, string_agg(content, chr(10) || chr(10) order by index, content) as text from c group by document_url), "
    + _windows_sql("select document, kind, text from o", "1600", "320")
    + "select o.document as document_url, o.n_chunks, coalesce(m.n_new, 0) as n_new from o left join (select document, count(*) as n_new from v group by document) m on m.document = o.document"
)
def migration(spark: SparkSession, d: str) -> DataFrame:
    """Every document's chunks joined and cut anew: chunks before and after."""
    t = rows.once(table(spark, d, "chunks").where("content is not null"), "chunk_id", "document_url", "index", "content")
    old = chunking.reassemble(t, "document_url", "index", "content")
    new = chunking.flat_chunks(old, "document_url", "text", size=1600, overlap=320).groupBy(F.col("document").alias("document_url")).agg(F.count("*").alias("n_new"))
    return old.select("document_url", "n_chunks").join(new, "document_url", "left").select("document_url", "n_chunks", F.coalesce("n_new", F.lit(0)).alias("n_new"))


@query(
    """
with recursive c as (select distinct chunk_id, document_url, section_id, parent_section_id, section_path_str as path from chunks where section_id is not null),
p as (select document_url, bool_or(coalesce(parent_section_id, '') <> '') as by_parent from c group by document_url),
e as (select distinct c.document_url, section_id, parent_section_id from c join p on p.document_url = c.document_url where by_parent),
t as (select distinct document_url, section_id as ancestor, section_id as descendant from e union select t.document_url, t.ancestor, e.section_id from t join e on e.document_url = t.document_url and e.parent_section_id = t.descendant where e.section_id <> t.descendant),
x as (select distinct c.document_url, section_id, path from c join p on p.document_url = c.document_url where not by_parent and path is not null and path <> ''),
u as (select * from t union select distinct document_url, parent_section_id, section_id from e where parent_section_id <> '' union select a.document_url, a.section_id, b.section_id from x a join x b on a.document_url = b.document_url and (b.path = a.path or starts_with(b.path, a.path || '|')))
select document_url, count(*) as n_pairs from u group by document_url
"""
)
def section_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of sections by parent where a document has any parents, else by path."""
    c = table(spark, d, "chunks").where("section_id is not null").select("document_url", "section_id", "parent_section_id", "section_path_str").distinct()
    kind = c.groupBy("document_url").agg(F.bool_or(F.coalesce("parent_section_id", F.lit("")) != "").alias("by_parent"))
    c = c.join(kind, "document_url")
    tree = rows.closure(c.where("by_parent"), ["document_url"], "section_id", "parent_section_id")
    path = rows.prefix_closure(c.where("not by_parent"), ["document_url"], "section_path_str", "section_id")
    return tree.unionByName(path).groupBy("document_url").agg(F.count("*").alias("n_pairs"))
