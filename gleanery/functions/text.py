"""Column functions over text, addresses and identities. All are built-in expressions, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a run of letters, digits and underscores of any script, alike in Spark and in RE2 dialects.
WORD = r"[\p{L}\p{N}_]+"

# Legal suffixes left out of company tokens.
LEGAL_SUFFIXES = ("inc", "corp", "corporation", "ltd", "limited", "llc", "ag", "se", "plc")

# Words that make a question numeric; currency and percent signs do so too.
NUMERIC_WORDS = (
    "revenue", "profit", "loss", "earnings", "ebitda", "eps", "shares", "employees", "headcount", "staff", "salary", "wage", "cost", "price", "total", "sum", "count", "number",
    "million", "billion", "thousand", "percent", "quarterly", "annual", "fiscal", "q1", "q2", "q3", "q4", "fy", "ytd",
)


def host(url: Column) -> Column:
    """Host of an address: lower case, without user, port and a leading www; '' where there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"^www\.", ""), F.lit(""))


def authority(url: Column) -> Column:
    """Host and port of an address in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def keyword_score(query: Column, text: Column) -> Column:
    """Share of the query's different words that the text has; 0 for a query without words."""
    terms = F.array_distinct(words(query))
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, words(text))) / F.size(terms)).otherwise(F.lit(0.0))


def company_tokens(name: Column) -> Column:
    """Runs of ASCII letters and digits in lower case, longer than two and no legal suffix."""
    parts = F.transform(F.regexp_extract_all(name, F.lit("([A-Za-z0-9]+)"), F.lit(1)), F.lower)
    return F.filter(parts, lambda t: (F.length(t) > 2) & ~t.isin(*LEGAL_SUFFIXES))


def entity_match(name: Column, text: Column) -> Column:
    """1 where the first three tokens of a name stand side by side in a text, else the share of its tokens found in it; 0 without tokens."""
    tokens, low = company_tokens(name), F.lower(text)
    edge = r"[^\p{L}\p{N}_]"
    phrase = F.concat(F.lit(f"(?:^|{edge})"), F.array_join(F.slice(tokens, 1, 3), r"\s+"), F.lit(f"(?:{edge}|$)"))
    hits = F.size(F.filter(tokens, lambda t: F.contains(low, t)))
    return F.when(F.size(tokens) == 0, F.lit(0.0)).when(F.rlike(low, phrase), F.lit(1.0)).otherwise(hits / F.size(tokens))


def search_score(name: Column, url: Column, title: Column, snippet: Column) -> Column:
    """Additive relevance of a search result to a company name."""
    tokens = company_tokens(name)
    low_url = F.lower(url)
    corpus = F.lower(F.concat_ws(" ", url, title, snippet))
    in_url = F.exists(tokens, lambda t: F.contains(low_url, t))
    hits = F.size(F.filter(tokens, lambda t: F.contains(corpus, t)))
    about = F.rlike(corpus, F.lit("headquarters|about|company|corporate"))
    regulatory = F.rlike(url, F.lit(r"sec\.gov|companieshouse"))
    official = F.rlike(low_url, F.lit("/about|/company|/corporate"))
    return F.when(in_url, 2.0).otherwise(0.0) + hits * 0.5 + F.when(about, 0.5).otherwise(0.0) + F.when(regulatory, 0.6).when(official, 0.4).otherwise(0.0)


def search_tier(url: Column) -> Column:
    """Kind of source an address stands for."""
    low = F.lower(url)
    return (
        F.when(F.rlike(url, F.lit(r"sec\.gov|companieshouse")), "regulatory")
        .when(F.rlike(low, F.lit("/about|/company|/corporate")), "official")
        .when(F.rlike(low, F.lit(r"wikipedia\.org|linkedin\.com|reuters\.com")), "reference")
        .otherwise("other")
    )


def document_type(url: Column) -> Column:
    """company_website where the path has a marker of a firm's own pages, else unknown."""
    return F.when(F.rlike(F.lower(url), F.lit("/(about|company|corporate|contact)")), "company_website").otherwise("unknown")


def is_numeric_question(query: Column) -> Column:
    """Whether a question asks for figures, by its words or by a currency or percent sign."""
    return F.arrays_overlap(words(query), F.array(*[F.lit(w) for w in NUMERIC_WORDS])) | F.rlike(query, F.lit("[$€£¥%]"))


def table_boost(query: Column, chunk_type: Column) -> Column:
    return F.when((chunk_type == "table") & is_numeric_question(query), 0.1).otherwise(0.0)


def html_text(body: Column) -> Column:
    """Visible text of a page in one line: scripts, styles and tags go, common entities are decoded once, space is collapsed."""
    x = F.regexp_replace(body, r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    for entity, sign in (("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(x, "[\\s  - 　]+", " "))


def text_table_kind(text: Column) -> Column:
    """table where two lines begin with a bar and have another one, or two lines have tabs between words, or one such barred line stands with a line of dashes, bars and colons only; else text."""
    barred = F.regexp_count(text, F.lit(r"(?m)^\|[^\n]+\|"))
    tabbed = F.regexp_count(text, F.lit(r"(?m)^[^\n]+\t[^\n]"))
    rule = F.rlike(text, F.lit(r"(?m)^[ \t]*[|:\-][|: \-]*$"))
    return F.when((barred >= 2) | (tabbed >= 2) | (rule & (barred >= 1)), "table").otherwise("text")


def mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))


def content_type_allowed(content_type: Column, *more: str) -> Column:
    """Whether a type is read: text, JSON, XML and XHTML by the beginning of their names, an empty one, and those in ``more`` (PDF where a parser for it is there)."""
    m = mime(content_type)
    out = m == ""
    for name in ("text/", "application/json", "application/xml", "application/xhtml", *more):
        out = out | m.startswith(name)
    return out


#: Blocks of IPv4 addresses that are not routed over the internet, by the public registry of special addresses.
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.88.99.0/24", "192.168.0.0/16",
    "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "224.0.0.0/4", "240.0.0.0/4",
)


def ipv4_number(host: Column) -> Column:
    """The address a host spells in digits as a number, in any form resolvers read (one to four parts, decimal, octal or hexadecimal); -1 for digits that are no address, null for a name."""
    parts = F.split(host, r"\.")
    n = F.size(parts)

    def number(p):
        base = F.when(F.rlike(p, F.lit("^0x")), F.conv(F.substring(p, 3, 20), 16, 10)).when(F.rlike(p, F.lit("^0[0-7]+$")), F.conv(p, 8, 10)).when(F.rlike(p, F.lit("^[0-9]{1,12}$")), p)
        return F.coalesce(base.cast("decimal(20,0)").cast("double"), F.lit(1e18))

    values = F.transform(parts, number)
    whole = F.aggregate(F.transform(values, lambda v, k: F.when(k < n - 1, v * F.pow(F.lit(256.0), F.lit(3) - k)).otherwise(v)), F.lit(0.0), lambda s, v: s + v)
    fits = F.forall(F.transform(values, lambda v, k: F.struct(v.alias("v"), F.when(k < n - 1, F.lit(256.0)).otherwise(F.pow(F.lit(256.0), F.lit(5) - n)).alias("most"))), lambda x: x["v"] < x["most"])
    return F.when(F.rlike(host, F.lit(r"^(?:0x[0-9a-f]+|[0-9]+)(?:\.(?:0x[0-9a-f]+|[0-9]+))*$")), F.when((n <= 4) & fits, whole.cast("bigint")).otherwise(F.lit(-1).cast("bigint")))


def url_safe(url: Column) -> Column:
    """http or https with a host that may be a public one: no loopback name, and no literal address outside the globally routed unicast ranges, however it is spelt. Names are not looked up."""
    scheme, h = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("HOST"))), r"\.$", "")
    v4 = ipv4_number(h)
    inside = v4 < 0
    for block in NOT_GLOBAL:
        base, bits = block.split("/")
        a, b, c, d = map(int, base.split("."))
        low = ((a * 256 + b) * 256 + c) * 256 + d
        inside = inside | v4.between(low, low + 2 ** (32 - int(bits)) - 1)
    # IPv6: global unicast is 2000::/3, without the blocks for protocols, documentation and tunnels
    groups = F.split(F.regexp_replace(h, r"[\[\]]|%.*$", ""), ":")
    group = lambda k: F.coalesce(F.conv(F.nullif(F.try_element_at(groups, F.lit(k)), F.lit("")), 16, 10).cast("bigint"), F.lit(0))
    first, second = group(1), group(2)
    v6_global = first.between(0x2000, 0x3FFF) & ~((first == 0x2001) & ((second < 0x200) | (second == 0xDB8))) & (first != 0x2002) & ~((first == 0x3FFF) & (second < 0x1000))
    public = F.when(h.startswith("["), v6_global).when(v4.isNotNull(), ~inside).otherwise((h != "") & (h != "localhost") & ~h.endswith(".localhost"))
    return F.coalesce(scheme.isin("http", "https") & public, F.lit(False))


def hops_safe(hops: Column, most: int = 10) -> Column:
    """Whether a request and its redirects, an array of addresses in order, may be followed: at most ``most`` redirects, every address safe; nulls are left out, an empty list is not safe."""
    return F.coalesce((F.size(hops) > 0) & (F.size(hops) <= most + 1) & F.forall(F.filter(hops, lambda u: u.isNotNull()), url_safe), F.lit(False))


#: Character sets that are read, by the names pages give them; others are read as UTF-8.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "windows-1252": "ISO-8859-1", "utf-16": "UTF-16"}


def charset(content_type: Column) -> Column:
    """The character set a type of content names, UTF-8 where it names none that is known."""
    named = F.lower(F.regexp_extract(F.coalesce(content_type, F.lit("")), "(?i)charset\\s*=\\s*[\"']?([\\w-]+)", 1))
    out = F.lit("UTF-8")
    for name, known in CHARSETS.items():
        out = F.when(named == name, known).otherwise(out)
    return out


def decoded(body: Column, content_type: Column) -> Column:
    """The bytes of a body as text, by the character set of its type."""
    return F.call_function("decode", body, charset(content_type))


def short_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of parts joined by pipes."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def cache_key(kind: str, mode: Column, *parts: Column) -> Column:
    """Key of a cached value, apart by mode."""
    return F.concat_ws(":", F.lit(kind), mode, *[F.substring(F.sha2(p, 256), 1, 16) for p in parts])


def token_estimate(text: Column) -> Column:
    """Tokens at four characters each, rounded up."""
    return F.ceil(F.char_length(text) / 4).cast("bigint")


def token_floor(text: Column) -> Column:
    """Tokens at four characters each, rounded down: the measure of the section chunker."""
    return F.floor(F.char_length(text) / 4).cast("bigint")


def unit(x: Column) -> Column:
    """A score held to 0..1. Null stays null; NaN and infinities raise an error and never become 1."""
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    return F.when(bad, F.raise_error(F.lit("score is not finite"))).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def finite(x: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def iso3(value: Column) -> Column:
    """A trimmed three-letter code in capitals, else null."""
    v = F.upper(F.trim(value))
    return F.when(F.rlike(v, F.lit("^[A-Z]{3}$")), v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double arithmetic; 0 where one has no length."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def json_object(text: Column) -> Column:
    """The text from the first opening to the last closing brace; null without both."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def without_fence(text: Column) -> Column:
    """Text without the code fence lines around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n?", ""), r"\n?```\s*$", ""))


def truthy(text: Column) -> Column:
    """1, true, yes and on are true, all else false; null stays null."""
    return F.lower(F.trim(text)).isin("1", "true", "yes", "on")


#: Letters and digits that may make an account number, and those of an insurance number, in the spaced or unspaced public formats.
_ACCOUNT = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"
_INSURANCE = r"\b[ABCEGHJ-PRSTW-Z][ABCEGHJ-NPRSTW-Z](?: ?\d{2}){3} ?[A-D]\b"
#: Pairs of letters that no insurance number begins with.
_NO_PREFIX = r"\b(?:BG|GB|KN|NK|NT|TN|ZZ)(?: ?\d{2}){3} ?[A-D]\b"


def account_valid(number: Column) -> Column:
    """Whether an international bank account number has a length and check digits that fit: read as digits, its first four signs moved to the end, it leaves 1 when divided by 97."""
    x = F.regexp_replace(number, " ", "")
    turned = F.concat(F.substring(x, 5, 40), F.substring(x, 1, 4))
    digits = F.array_join(F.transform(F.split(turned, ""), lambda c: F.when(F.rlike(c, F.lit("[A-Z]")), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    rest = F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * 10 + c.cast("int")) % 97)
    return F.char_length(x).between(15, 34) & (rest == 1)


def detail_counts(text: Column) -> tuple[Column, Column, Column]:
    """Number of e-mail addresses, bank account numbers (by form and check digits) and British insurance numbers (spaced or not, without the letter pairs never given out)."""
    mails = F.regexp_count(text, F.lit(r"[\p{L}\p{N}._+%\-]+@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}"))
    accounts = F.size(F.filter(F.regexp_extract_all(text, F.lit(_ACCOUNT), F.lit(0)), account_valid))
    return mails, accounts, F.regexp_count(text, F.lit(_INSURANCE)) - F.regexp_count(text, F.lit(_NO_PREFIX))


def cut(text: Column, most: int, mark: str = "") -> Column:
    """The first ``most`` characters of a text, with a mark where more were there."""
    head = F.left(text, F.lit(most))
    return F.concat(head, F.when(F.char_length(text) > most, mark).otherwise("")) if mark else head


def similarity(a: Column, b: Column) -> Column:
    """Cosine held to 0 and above, as a score."""
    return F.greatest(F.lit(0.0), cosine(a, b))
