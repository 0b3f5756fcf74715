"""Template residue and error pages: masked lines, grouped by hash across sources, read by phrase and placeholder rules."""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import checkpoint, spread

#: Fields a template engine or an author leaves where a value belongs.
PLACEHOLDER = (
    r"\{\{[^{}\n]{1,60}\}\}|\{%[^%\n]{1,80}%\}|[$#@]\{[^{}\n]{1,60}\}|<%[^%\n]{1,80}%>|\[\[[^\[\]\n]{1,60}\]\]|\[%[^%\n]{1,60}%\]"
    r"|%[A-Za-z][A-Za-z_.]*(?: [a-z]+){0,3}%|__[A-Za-z](?:[A-Za-z_. ]{0,30}?[A-Za-z])?__|<(?:[a-z_.]+ here|(?:insert|your|enter) [a-z_. ]+)>"
    r"|(?<![\w$#@{])\{[a-z][A-Za-z]*(?:[_. ][A-Za-z]+){0,4}\}(?!\})"
    r"|\[(?:[a-z]+(?:[_.][a-z]+)+|(?:insert|your|enter|add)\b[^\[\]\n]{0,40}|[^\[\]\n]{1,40} here|(?:name|title|date|author|city|country|company|amount|email|phone|address|ceo|value|year|company name)|[A-Z]+(?:_[A-Z]+)+)\]"
)
#: A sentence with one of these writes about a field and leaves none unfilled.
MENTION = r"\b(?:such as|templates?|placeholders?|syntax|written as|vorlage|modèle|plantilla)\b"
#: Messages that stand where a page should be.
MESSAGE = (
    r"\b[45]0\d\b.{0,40}(?:error|not found|found|forbidden|denied|unavailable|gateway|missing|timeout|bad)|(?:error|fehler|erreur|err|status|http)[: ]{1,3}[45]?0\b"
    r"|page not found|not found|could ?n.t be found|no longer (?:exists?|available)|has (?:been )?(?:moved|removed|deleted)|can.?t find (?:that|the|this)|page (?:is )?missing|does not exist"
    r"|nicht (?:gefunden|mehr vorhanden|verfügbar|mehr verfügbar)|introuvable|no (?:se ha )?encontrad[ao]|no existe|n.existe (?:pas|plus)"
    r"|access (?:is )?denied|forbidden|not authori[sz]ed|permission to|is blocked|been blocked|from your region|zugriff verweigert|accès (?:refusé|interdit)|acceso denegado"
    r"|internal server error|bad gateway|temporarily unavailable|service unavailable|gateway time-?out|timed out|connection (?:failed|reset|refused)|server (?:is )?(?:busy|error)|unexpected error|something went wrong|try again later"
    r"|too many requests|rate limit|slow down|unusual traffic|checking (?:that you|your browser|if the site)|are (?:you )?(?:a )?human|captcha|verify (?:that )?you|cloudflare"
    r"|maintenance|be back soon|be right back|wartungsarbeiten|en mantenimiento|under construction|coming soon"
    r"|domain (?:name )?(?:is |has |may be |.{0,40})(?:parked|for sale|expired|available)|buy this domain|session (?:has )?expired|log ?in again"
    r"|(?:java ?)?script(?:s|ing)?\b.{0,50}\b(?:off|disabled|required|enable[ds]?|blocked|inactive|deaktiviert|desactiv|activ|aktivier|permitir|allow)|(?:enable|allow|requires?|needs?|turn on|activate|activer|aktivieren|activar?|habilitar?|run|without|kein)\b.{0,30}\b(?:java ?)?scripts?|unsupported browser|browser (?:does not|is not|doesn.t)|turn it on and reload"
)
#: Furniture of pages that may read like sentences.
NOTICE = r"cookies?\b|privacy|newsletter|rights reserved|all rights|sign up|subscribe|reproduction|consent\b|adverts?\b|advertis|liability for|no advice|forward-looking|may prove wrong|terms of use|continue reading|read more|maybe you meant|try one of these|browse now|©|\(c\) \d|copyright"
#: What filler is made of: letters of which some stand in every phrase, and the phrases.
FILLER_LETTERS = ("lorem ipsum", "dolor sit amet", "sample text", "xxx", "text goes here")
FILLER = r"lorem ipsum|dolor sit amet|(?:sample text\W+){2}|(?:\bxxx\W*){2}|text goes here"


_BLOCK = re.compile(r"<(script|style)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[A-Za-z!][^<>]*>")
_FIELD = re.compile(PLACEHOLDER)
_IN_TAG = re.compile(r"<[^<>\x02]*\x02[^<>]*>")
_ABOUT = re.compile(r"[^.!?\n]*" + MENTION + r"[^.!?\n]*", re.I)
_FILL = re.compile(FILLER, re.I)
_WORDS = re.compile(r"[^\W_]+")
_STOP = re.compile(r"[.!?…。！？؟।։][\"')\]»”’」]*$")
#: Letters of scripts written without spaces: two of them count as a word.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\U00020000-\U0003ffff]")
_ADDRESS = re.compile(r"\S+@\S+\.\w+|\w+://\S+|\bwww\.\S+")
_DIGIT = re.compile(r"\d")
_CODE = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b")
_FIGURE = re.compile(r"\b\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}\b|\d+(?:[.,:]\d+)*")
_UNMARKED = re.compile(r"[\w@~#]+")
_NAMES = re.compile(r"(?<=[\w,] )(?=[^\W\d_])[^\sA-ZÀ-ÖØ-Þ]*[A-ZÀ-ÖØ-Þ]\S*(?: [^\sA-ZÀ-ÖØ-Þ]*[A-ZÀ-ÖØ-Þ]\S*)*")


def masked(line: str) -> str:
    """A line with addresses, dates, names within it, marks and numbers masked, so one message has one form."""
    line = _NAMES.sub("~", line).lower()
    if "@" in line or "://" in line or "www." in line:  # a plain search is far faster than a pattern
        line = _ADDRESS.sub("@", line)
    if _DIGIT.search(line):
        line = _FIGURE.sub("0", _CODE.sub("#", line))
    return " ".join(_UNMARKED.findall(line))


def unfilled(text: str) -> bool:
    """Whether a template field stands where a value belongs; sentences that write about such fields don't count."""
    if not _FIELD.search(text):
        return False
    return "\x02" in _IN_TAG.sub(" ", _ABOUT.sub(" ", _FIELD.sub("\x02", text)))


def units(line: str) -> int:
    """Words of a line parted by spaces; in scripts without spaces two letters are a word."""
    n = len(line.split())
    return n if line.isascii() or len(line) < 2 * n + 8 else max(n, len(_UNSPACED.findall(line)) // 2)


def sentence(line: str) -> int:
    """Words of a line that may be a sentence in whatever language, else 0: eight words with a sentence mark at the end, or eighteen, at least two fifths of them different."""
    n = units(line)
    if n < 8 or (n < 18 and not _STOP.search(line)):
        return 0
    words = line.split()
    return n if len(words) < 8 or len(set(words)) >= 0.4 * len(words) else 0


def sentences(body: str) -> list[tuple[str, int]]:
    """The lines of a page that may be sentences, as they show, with their words."""
    out = []
    for line in body.split("\n"):
        line = html.unescape(_TAG.sub(" ", line)).strip()
        if n := sentence(line):
            out.append((line, n))
    return out


def _host(url: str) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(F.col(url), F.lit("HOST"))), F.lit(""))


def filler_words(df: DataFrame, url: str, body: str, sources: int = 3, share: float = 0.005) -> frozenset[int]:
    """Hashes of the words that filler is made of, learnt from lines with a filler phrase.

    A word counts if it stands in lines with a filler phrase at ``sources`` hosts or more and
    in at least ``share`` of such lines, four times as often as in the other lines of the
    same pages, so words of articles that mention filler drop out. The JVM finds the pages
    that may hold such a phrase; their words are counted per task before they are shuffled. At most
    (mean words of such a line) / share come to the driver.
    """

    def count(batches):
        import pyarrow as pa
        import xxhash

        def out(counts):
            keys = list(counts)
            cols = [[k[0] for k in keys], [k[1] for k in keys], [counts[k][0] for k in keys], [counts[k][1] for k in keys]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["h", "host", "f", "o"])

        counts: dict[tuple[int, str], list[int]] = {}
        for b in batches:
            for host, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not _FILL.search(text):
                    continue
                for line, _ in sentences(_BLOCK.sub(" ", text)):
                    mine = 0 if _FILL.search(line) else 1
                    for h in [0, *(xxhash.xxh64_intdigest(w) >> 1 for w in set(_WORDS.findall(line.lower())))]:
                        counts.setdefault((h, host), [0, 0])[mine] += 1
            if len(counts) > 500_000:
                yield out(counts)
                counts = {}
        yield out(counts)

    held = lambda low: reduce(Column.__or__, [F.contains(low, F.lit(x)) for x in FILLER_LETTERS])
    # the text is lowered once, and plain searches are faster than a pattern; the pages that are left are tried for the phrases
    pages = df.where(F.exists(F.array(F.lower(body)), held)).select(_host(url).alias("host"), F.col(body).alias("body")).distinct()
    seen = pages.mapInArrow(count, "h bigint, host string, f bigint, o bigint").groupBy("h", "host").agg(F.sum("f").alias("f"), F.sum("o").alias("o"))
    words = checkpoint(seen.groupBy("h").agg(F.count_if(F.col("f") > 0).alias("hosts"), F.sum("f").alias("f"), F.sum("o").alias("o")).where(F.col("hosts") >= sources))
    lines = words.where("h = 0").first()
    if lines is None:
        return frozenset()
    own = (F.col("h") != 0) & (F.col("f") >= share * lines.f) & (F.col("f") * max(lines.o, 1) >= 4 * F.col("o") * lines.f)
    return frozenset(r.h for r in words.where(own).select("h").collect())


def _flagged(lines: list[str]) -> list[bool]:
    """Which lines hold a phrase of a message or of page furniture."""
    import pyarrow as pa
    import pyarrow.compute as pc

    return pc.match_substring_regex(pa.array([x.lower() for x in lines], pa.string()), f"{MESSAGE}|{NOTICE}").to_pylist() if lines else []


class _Filler:
    """Whether a line is filler: it holds a filler phrase, or three fifths of its words are filler words."""

    def __init__(self, words: frozenset[int]):
        self.words, self.known = words, {}

    def __call__(self, line: str) -> bool:
        low = line.lower()
        for letters in FILLER_LETTERS:  # a plain search is far faster than that for the phrases
            if letters in low:
                if _FILL.search(line):
                    return True
                break
        if not self.words:
            return False
        import xxhash

        if len(self.known) > 200_000:
            self.known.clear()
        known, hit, own = self.known, 0, set(_WORDS.findall(low))
        for w in own:
            k = known.get(w)
            if k is None:
                k = known[w] = xxhash.xxh64_intdigest(w) >> 1 in self.words
            hit += k
        return hit >= 0.6 * max(1, len(own))


def summaries(bodies: list[str | None], filler: _Filler) -> list[tuple[bool, bool, int, list[tuple[str, int]]]]:
    """For each page (blank, template, words of sentences that are certainly no residue, masked lines with a phrase and their words)."""
    out, pages, lines = [], [], []
    for k, body in enumerate(bodies):
        if body is None or not body.strip():
            out.append((True, False, 0, []))
            continue
        body = _BLOCK.sub(" ", body)
        out.append((False, unfilled(body), 0, []))
        own = [s for s in sentences(body) if not filler(s[0])]
        pages += [k] * len(own)
        lines += own
    sure = [0] * len(bodies)
    for k, (line, n), flagged in zip(pages, lines, _flagged([x for x, _ in lines])):
        if flagged:
            out[k][3].append((masked(line), n))
        else:
            sure[k] += n
    return [(blank, template, n, own) for (blank, template, _, own), n in zip(out, sure)]


def read_pages(df: DataFrame, key: str, url: str, body: str, also: Callable[[str], list[int]] | None = None, words: frozenset[int] | None = None) -> DataFrame:
    """What ``residue`` needs of every page, without its text: (k, host, blank, template, sure, own, also).

    ``also``: a function of the text whose numbers are kept beside, so that another step
    reads the pages in the same pass. ``words``: the filler words where they were learnt
    before. Written to the shared checkpoint.
    """
    filler = df.sparkSession.sparkContext.broadcast(filler_words(df, url, body) if words is None else words)

    def run(batches):
        import pyarrow as pa

        is_filler = _Filler(filler.value)
        own_type = pa.list_(pa.struct([("m", pa.string()), ("n", pa.int32())]))
        for b in batches:
            texts = b.column(2).to_pylist()
            found = summaries(texts, is_filler)
            blank, template, sure, own = zip(*found) if found else ((),) * 4
            own = [[{"m": m, "n": n} for m, n in x] for x in own]
            more = [also(t) if also and t is not None else [] for t in texts]
            arrays = [pa.array(blank, pa.bool_()), pa.array(template, pa.bool_()), pa.array(sure, pa.int64()), pa.array(own, own_type), pa.array(more, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *arrays], names=["k", "host", "blank", "template", "sure", "own", "also"])

    rows = df.select(F.col(key).cast("bigint").alias("k"), _host(url).alias("host"), F.col(body).cast("string").alias("body")).where("k is not null")
    rows = spread(rows).mapInArrow(run, "k bigint, host string, blank boolean, template boolean, sure bigint, own array<struct<m:string,n:int>>, also array<bigint>")
    return checkpoint(rows.withColumn("own", F.transform("own", lambda s: F.struct(F.xxhash64(s["m"]).alias("h"), s["n"].alias("n")))))


def residue_of(pages: DataFrame, key: str, least_words: int = 8, sources: int = 5) -> DataFrame:
    """The records to exclude among pages read by ``read_pages``: (key, reason)."""
    one = pages.dropDuplicates(["k"])
    done = one.where("blank or template").select("k", F.when(F.col("blank"), "blank").otherwise("template").alias("reason"))
    # only pages that aren't decided look at the hashes, but the lines of all pages count towards a message's hosts
    lines = one.where(~F.col("blank") & ~F.col("template") & (F.col("sure") < least_words)).select("k", "sure", F.explode_outer("own").alias("s")).select("k", "sure", F.col("s.n").alias("n"), F.col("s.h").alias("h"))
    seen = pages.select("host", F.explode(F.transform("own", lambda s: s["h"])).alias("h")).distinct()
    often = seen.groupBy("h").count().where(F.col("count") >= sources).select("h", F.lit(True).alias("often"))
    left = lines.join(often, "h", "left").groupBy("k").agg(F.max("sure").alias("sure"), F.sum(F.when(F.col("often"), 0).otherwise(F.coalesce("n", F.lit(0)))).alias("own"))
    poor = left.where(F.col("sure") + F.col("own") < least_words).select("k", F.lit("no_article").alias("reason"))
    return done.unionByName(poor).withColumnRenamed("k", key)


def residue(df: DataFrame, key: str, url: str, body: str, least_words: int = 8, sources: int = 5) -> DataFrame:
    """Records to exclude, one row per key with the reason: ``blank``, ``template`` or ``no_article``.

    A page has an article if its sentences come to ``least_words`` words. Sentences are told
    by form alone, in any language: lines of eight words with a sentence mark or of
    eighteen words, not of the same words over and over; in scripts without spaces two
    letters count as a word. A sentence is residue if its masked form recurs at ``sources``
    hosts or more and it holds a phrase of a message or notice; neither is enough alone, so
    articles about such things and copied articles stay. Filler is told by its phrases and
    by the words learnt from lines with them (``filler_words``).

    Lines with a phrase are masked and hashed where they are read, each (hash, host) counted
    once before the shuffle; a page's few figures are kept at the shared checkpoint.

    Null, empty and blank bodies are ``blank``. Copies of a row count once. A null url is a
    host of its own. Rows with a null key are left out. Columns out: key, reason.
    """
    return residue_of(read_pages(df, key, url, body), key, least_words, sources)
