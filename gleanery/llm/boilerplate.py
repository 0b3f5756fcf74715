"""Main content of pages: a minimum cut between content and boilerplate over the lines of a page."""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, deque
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.residue import masked
from gleanery.sources.tables import checkpoint

_WORD = re.compile(r"[^\W_]+")
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>|<!--.*?-->|<![^<>]*>", re.S)
_HIDDEN_BLOCK = re.compile(r"<(script|style|template)\b.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)", re.S | re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|/|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("div main section article aside nav header footer td tr table ul ol dl form fieldset body".split())
_FURNITURE_TAG = frozenset("nav footer aside form button".split())
_FURNITURE_CLASS = re.compile(r"\b(?:bar|nav|menu|foot\w*|side\w*|promo|share|social|cookie|banner|widget|related|breadcrumb|teaser|ads?)\b", re.I)
_END = re.compile(r"[.!?…。！？][\"')\]»”’]*$")
_BULLET = re.compile(r"^(?:[-*•·–]|\(?\d{1,3}[.)])\s+")
_BARS = r"\s*[|•·›»/>]\s*|\s{2,}|\s+[–—]\s+"
_CELLS, _SPLIT = re.compile(_BARS), re.compile(_BARS + r"|(?<=[.!?:;])\s+")
_NUMBER = re.compile(r"^[\d\s.,%€$£+\-–/]*\d[\d\s.,%€$£+\-–/]*$|^n/?a$", re.I)
_NOTHING = re.compile(r"[\s0#~@]*")
#: Words beyond which a line is a paragraph.
PARAGRAPH = 30
#: Words of the head of a form, and what stands for a form that is known not to recur.
HEAD, _ONCE = 8, -1
#: A head of words that no mask touches.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ][a-zß-öø-ÿ]*)" + r"[ ,;-]+([a-zß-öø-ÿ]+)" * (HEAD - 1) + r"(?=[,;]* )")


class Line:
    """A line that shows text: its number from 1, text, first tag, that tag's attributes, and the open block elements around it."""

    __slots__ = ("number", "text", "tag", "attrs", "path")

    def __init__(self, number: int, text: str, tag: str = "", attrs: str = "", path: tuple[int, ...] = ()):
        self.number, self.text, self.tag, self.attrs, self.path = number, text, tag, attrs, path


def visible_lines(text: str) -> list[Line]:
    """The lines of a page that show text.

    Text in scripts, styles, comments and in elements that are hidden, or lie within hidden
    ones, doesn't show; other text of the same line does.
    """
    if "<" not in text:
        return [Line(k, line.strip()) for k, line in enumerate(text.split("\n"), 1) if line.strip()]
    text = _HIDDEN_BLOCK.sub(lambda m: "\n" * m.group().count("\n"), text)
    out: list[Line] = []
    stack: list[tuple[str, bool, int]] = []  # open elements: name, hidden, number of a block element or 0
    path: tuple[int, ...] = ()
    hiding = made = 0
    for k, line in enumerate(text.split("\n"), 1):
        if "<" not in line:
            flat, tag, attrs, own = ("" if hiding else line), "", "", path
        else:
            tag = attrs = ""
            shown, at, own = [], 0, path
            for m in _TAG.finditer(line):
                if not hiding:
                    shown.append(line[at : m.start()])
                at = m.end()
                name = (m.group(2) or "").lower()
                if not name:
                    continue
                if m.group(1):
                    depth = next((d for d in range(len(stack) - 1, -1, -1) if stack[d][0] == name), None)
                    if depth is not None:
                        for _, hidden, _ in stack[depth:]:
                            hiding -= hidden
                        del stack[depth:]
                        path = tuple(b for _, _, b in stack if b)
                    continue
                if not tag or tag in ("html", "body"):
                    tag, attrs = name, m.group(3)
                if name in _VOID or m.group(3).endswith("/"):
                    continue
                hidden = bool(m.group(3)) and bool(_HIDDEN.search(m.group(3)))
                block = 0
                if name in _BLOCKS:
                    block = made = made + 1
                stack.append((name, hidden, block))
                hiding += hidden
                if block:
                    path = (*path, block)
            if not hiding:
                shown.append(line[at:])
            flat = " ".join(shown)
            own = path if len(path) > len(own) and not line.rstrip().endswith(">") else own
        flat = (html.unescape(flat) if "&" in flat else flat).replace("​", "").strip()
        if flat:
            out.append(Line(k, flat, tag, attrs, own))
    return out


def distance(a: tuple[int, ...], b: tuple[int, ...]) -> int:
    """Steps from one place to another in the tree of block elements."""
    same = 0
    for x, y in zip(a, b):
        if x != y:
            break
        same += 1
    return len(a) + len(b) - 2 * same


def _parts(text: str, at: re.Pattern = _SPLIT) -> list[str]:
    bullet = _BULLET.match(text)
    text = text[bullet.end() :] if bullet else text
    if at is _SPLIT and not any(c in text for c in "|•·›»/>–—") and " ".join(text.split()) == text:
        for c in ".!?:;":  # only single spaces after a mark are left to split at, which needs no pattern
            text = text.replace(f"{c} ", f"{c}\n")
        return [p for p in text.split("\n") if p]
    return [p for p in at.split(text) if p]


def _code(form: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(form) >> 1


def _head(text: str) -> str:
    """The first words of ``masked(text)``, from no more of the text than they need: no mask reaches over a space, but for names in a row, which are one sign however many."""
    plain = _PLAIN.match(text)
    if plain:
        return " ".join(plain.groups()).lower()
    n = HEAD + 1
    while True:
        words = text.split(None, n)
        whole = len(words) <= n
        head = masked(text if whole else text[: len(text) - len(words[n])]).split()[:HEAD]
        if whole or len(head) == HEAD:
            return " ".join(head)
        n *= 2


def _form(text: str, heads: frozenset[int] | None) -> int | None:
    """Hash of a masked text; None for numbers and names alone, ``_ONCE`` where its head isn't among ``heads``."""
    if heads is not None:
        head = _head(text)
        if _code(head) not in heads and not _NOTHING.fullmatch(head):
            return _ONCE
    form = masked(text)
    return None if _NOTHING.fullmatch(form) else _code(form)


def _read(text: str, heads: frozenset[int] | None = None) -> tuple[int | None, list[int]]:
    own, parts = _form(text, heads), _parts(text)
    if len(parts) < 2:
        return own, [own] if own is not None else []
    return own, [h for h in (_form(p, heads) for p in parts) if h is not None]


class _Memory(dict):
    """What ``read`` makes of a line, remembered. Emptied when it has grown large: most lines met again are furniture."""

    def __init__(self, read):
        self.read = read

    def __missing__(self, text: str):
        if len(self) > 100_000:
            self.clear()
        out = self[text] = self.read(text)
        return out


def _heads(text: str) -> set[int]:
    return {_code(_head(t)) for t in (text, *_parts(text))}


_FORMS, _HEADS = _Memory(_read), _Memory(_heads)


def forms(line: Line, words: int, heads: frozenset[int] | None = None) -> tuple[int | None, list[int]]:
    """Hashes of the masked line and of its masked parts (those between bars or sentences), however long; none for numbers and names alone.

    ``heads``: hashes of the heads of all forms that may recur. Paragraphs are masked only where they begin so; ``_ONCE`` stands for each other form of theirs.
    """
    return _read(line.text, heads) if words > PARAGRAPH else _FORMS[line.text]


def recurring_heads(lines: list[Line]) -> set[int]:
    """Hashes of the heads of all forms of a page."""
    out: set[int] = set()
    for line in lines:
        out |= _heads(line.text) if len(line.text.split()) > PARAGRAPH else _HEADS[line.text]
    return out


def recurring_forms(lines: list[Line], heads: frozenset[int] | None = None) -> dict[int, list[int]]:
    """What a page adds to the counts of its forms: page, heading, before, between or after its paragraphs."""
    words = [len(line.text.split()) for line in lines]
    most = max(words, default=0)
    anchors = [k for k, n in enumerate(words) if n >= min(25, most)]
    out: dict[int, list[int]] = {}
    for k, line in enumerate(lines):
        own, parts = forms(line, words[k], heads)
        place = 2 if k < anchors[0] else 4 if k > anchors[-1] else 3
        for h in {own, *parts} - {None, _ONCE}:
            c = out.setdefault(h, [1, 0, 0, 0, 0])
            c[1] |= line.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
            c[place] = 1
    return out


class Recurring:
    """Masked lines and parts of lines that recur: hash to (share of all pages, share of its pages in headings, before, between and after paragraphs). ``heads``: see ``forms``."""

    def __init__(self, pages: int, counts: dict[int, tuple[int, ...]], heads: frozenset[int] | None = None):
        self.pages, self.heads = pages, heads
        self.of = {h: (c[0] / max(1, pages), *(x / c[0] for x in c[1:])) for h, c in counts.items()}

    @staticmethod
    def least(pages: int, share: float) -> float:
        return max(3.0, pages * share)


def recurring(texts: DataFrame, text: str, share: float = 0.0005) -> Recurring:
    """The forms that stand on at least ``share`` of all pages (and on three): at most (mean forms of a page) / share, so the
    table sent to the tasks is bounded however many pages there are. Counted on every page, per task before the shuffle.

    A form can't stand on more pages than its head does. A first pass counts the heads, which are cheap to read; the second
    masks lines up to ``PARAGRAPH`` words, and of longer ones whatever has a head on as many pages as a form must be on."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).cast("string").alias("text"))

    def sums(read, *names):
        """Sums over all pages of what ``read`` makes of the lines of each, by hash; those of three pages or more, and the number of pages at -1."""

        def run(batches):
            import pyarrow as pa

            counts: dict[int, list[int]] = {}
            pages = 0

            def out():
                cols = [[-1, *counts], *([pages if k == 0 else 0, *(c[k] for c in counts.values())] for k in range(len(names)))]
                return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["h", *names])

            for b in batches:
                for t in b.column(0).to_pylist():
                    lines = visible_lines(t)
                    pages += bool(lines)
                    for h, c in read(lines).items() if lines else ():
                        have = counts.get(h)
                        if have is None:
                            counts[h] = c
                        else:
                            for k in range(len(names)):
                                have[k] += c[k]
                if len(counts) > 500_000:
                    yield out()
                    counts, pages = {}, 0
            yield out()

        columns = ", ".join(f"{c} bigint" for c in ("h", *names))
        found = checkpoint(rows.mapInArrow(run, columns).groupBy("h").agg(*[F.sum(c).alias(c) for c in names]).where("n >= 3 or h = -1"))
        pages = (found.where("h = -1").first() or {"n": 0})["n"]
        return pages, found.where((F.col("h") != -1) & (F.col("n") >= Recurring.least(pages, share))).collect()

    _, found = sums(lambda lines: {h: [1] for h in recurring_heads(lines)}, "n")
    heads = frozenset(r.h for r in found)
    known = rows.sparkSession.sparkContext.broadcast(heads)
    pages, found = sums(lambda lines: recurring_forms(lines, known.value), "n", "heads", "before", "between", "after")
    return Recurring(pages, {r.h: tuple(r)[1:] for r in found}, heads)


#: Features, and those of them that say how a paragraph recurs, from ``_AGAIN`` on.
_N, _AGAIN = 52, 48
#: Shares of pages from which a form recurs often, and from which a paragraph's place says nothing of where an article begins and ends.
OFTEN, NOTICE = 0.008, 0.02


def features(lines: list[Line], seen: Recurring) -> np.ndarray:
    """What each line looks like, where it stands, whether it recurs on other pages and whether its words occur in the paragraphs of its page. No feature looks at what a word means."""
    n = len(lines)
    x = np.zeros((n, _N))
    info, body, shares = [], set(), []
    for line in lines:
        w = _WORD.findall(line.text.lower())
        m = len(w)
        count = len(line.text.split())
        own, parts = forms(line, count, seen.heads)
        rec = seen.of.get(own) if own is not None else None
        part_rec = sum(p in seen.of for p in parts) / len(parts) if parts else 0.0
        longish = (m >= 10 and bool(_END.search(line.text))) or m >= 18
        long = longish and rec is None and part_rec < 0.5
        share = 0.0
        if count > PARAGRAPH and longish:  # it may be a notice, or an article's and copied: how it recurs is said apart
            if rec is not None or part_rec >= 0.5:
                share = rec[0] if rec is not None else sorted(seen.of[p][0] if p in seen.of else 0.0 for p in parts)[len(parts) // 2]
                share = max(share - 2 * math.sqrt(share / seen.pages), 1e-9)  # at least this: among few pages three copies are a large share
            long, rec, part_rec = True, None, 0.0
        info.append((w, m, rec, parts, part_rec, longish, long))
        shares.append(share if count > PARAGRAPH else None)
    own = [k for k in range(n) if not (shares[k] or 0.0) >= NOTICE]
    longs = [k for k in own if info[k][6]] or [k for k in own if info[k][5] and (info[k][2] or (0.0,))[0] < OFTEN]
    for k in longs:
        body.update(info[k][0])
    first, last = (longs[0], longs[-1]) if longs else (n, -1)
    marked = heads = 0
    for k, line in enumerate(lines):
        w, m, rec, parts, part_rec, longish, long = info[k]
        r, t = x[k], line.text
        r[0] = 1
        if shares[k]:
            r[48], r[49], r[50] = 1, min(1.0, math.log10(shares[k] / 0.0005 + 1e-9) / 3) if shares[k] > 0.0005 else 0.0, shares[k] >= OFTEN
            r[51] = not any(s is not None and s >= shares[k] / 2 for j, s in enumerate(shares) if j != k)
        r[20] = line.tag in _FURNITURE_TAG or bool(line.attrs and _FURNITURE_CLASS.search(line.attrs))
        if long:
            marked = 0
            r[1], r[2] = 1, m > PARAGRAPH
            continue
        before, after, between = k < first, k > last, first < k < last
        r[3] = longish
        bullet = bool(_BULLET.match(t))
        bits = _parts(t, _CELLS)
        numbers = sum(1 for p in bits if _NUMBER.match(p))
        in_heads = 0.0
        if rec is not None:
            in_heads = rec[1]
            r[4], r[5], r[6], r[7] = 1, min(1.0, math.log10(rec[0] / 0.0005 + 1e-9) / 3) if rec[0] > 0.0005 else 0.0, in_heads, in_heads < 0.05
            r[8], r[9], r[10] = rec[2], rec[4], rec[3]
        r[11] = len(bits) >= 3 and not numbers
        r[12] = part_rec
        r[13] = part_rec > 0.99 and len(bits) > 1 and not numbers
        r[14] = len(bits) >= 2 and numbers >= 1
        r[15] = bullet and rec is None
        r[16] = m <= 2
        r[17] = m <= 2 and rec is not None
        rare = [a for a in w if len(a) > 3]
        hit = sum(a in body for a in rare) / len(rare) if rare else 0.0
        named = any(a[:1].isupper() for a in t.split()[1:])
        furniture = part_rec > 0.5 and in_heads < 0.04 and not named and (rec is None or rec[0] > OFTEN)
        head = 2 <= m <= 14 and not numbers and not _END.search(t) and len(bits) < 3 and not bullet
        r[18] = head
        r[19] = line.tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        r[21], r[22], r[23] = before, after, between
        r[24] = hit
        r[25] = head and hit < 0.34
        r[26] = head and hit < 0.34 and between
        r[27] = marked
        if rec is not None and in_heads < 0.04 and m <= 8 and not numbers:
            marked = 1
        if head and before and not furniture:
            r[28] = heads == 0
            r[29] = heads > 0 and hit < 0.34
            heads += 1
        r[30] = before and heads > 0 and rec is None and not head and len(bits) < 3
        r[31] = between and rec is not None and in_heads >= 0.04
        often = rec is not None and rec[0] >= OFTEN
        r[32] = between and rec is not None and in_heads < 0.04
        r[40] = often and in_heads < 0.04
        r[41] = between and often and in_heads < 0.04
        r[42] = rec is not None and not often
        r[46] = rec is not None and rec[0] >= 0.02 and in_heads < 0.02
        r[47] = r[46] and between
        if m >= 8 and part_rec and not numbers:
            of_parts = [seen.of[p][0] if p in seen.of else 0.0 for p in parts]
            r[43], r[44], r[45] = part_rec > 0.99, max(of_parts) >= OFTEN, min(of_parts) >= 0.004
        r[33] = between and rec is None and part_rec < 0.5
        near = [info[j][4] for j in (k - 2, k - 1, k + 1, k + 2) if 0 <= j < n]
        r[34] = sum(near) / len(near) if near else 0.0
        r[35] = after and head and rec is None
        r[36] = before and rec is not None and in_heads < 0.05
        r[37] = bool(rec) and rec[3] > 0.8
        r[38] = named and head and rec is not None
        r[39] = named and head and hit >= 0.5
    return x


def _pages(rng: random.Random, count: int):
    """Labelled pages of our own making in an invented language: (lines, 1 for content). Words carry no meaning, so only form, place and recurrence can be learnt."""
    syllables = [a + b for a in "bdfgklmnprstvz" for b in ("a", "e", "i", "o", "u", "an", "el", "or")]
    invent = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4)))
    nouns, small = [invent() for _ in range(400)], [rng.choice(syllables) for _ in range(40)]
    places = [invent().title() for _ in range(300)]
    word = lambda: rng.choice(small) if rng.random() < 0.4 else rng.choice(nouns)
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    cap = lambda s: s[:1].upper() + s[1:]
    menu = [cap(phrase(1, 3)) for _ in range(60)]
    sites = [f"{invent().title()} {invent().title()}" for _ in range(80)]
    slots = lambda s: s if rng.random() < 0.6 else rng.choice((f"{{d}} {s}", f"{s} {{n}} {phrase(1, 3)}", f"{s} ({{d}})"))
    tools = [slots(cap(phrase(n, n))) for n in (1, 1, 1, 1, 2, 2, 2, 2, 3, 3, 3, 4, 4, 5, 5, 6, 7, 8)]
    buttons = [cap(phrase(1, 2)) for _ in range(5)]
    notices = [cap(f"{phrase(2, 5)} {{n}} {rng.choice((phrase(2, 4), phrase(2, 4)))} {phrase(3, 6)}") + "." for _ in range(20)] + [cap(phrase(4, 12)) + "." for _ in range(24)]
    ends = [f"{rng.choice(('©', '(c)', cap(invent())))} {{y}} {{n}}. {cap(phrase(2, 5))}." for _ in range(8)]
    marks = [cap(phrase(1, 5)) + rng.choice(("", "", ":")) for _ in range(7)]
    subheads = [cap(phrase(2, 2)) for _ in range(2)]
    shapes = [f"{cap(phrase(1, 2))} {{p}}", f"{cap(word())} {word()} {{o}} {word()} {{p}} {word()}", f"{{p}}: {{o}} {word()}", "{O} {o} " + word() + " {p}", "{p} " + word() + " {o} " + word() + " {p2}"]

    def fill(s, firm=None, place=None):
        p = firm or place or rng.choice(places)
        return s.format(n=rng.choice(sites), d=rng.randint(2, 60), y=rng.randint(2005, 2024), p=p, p2=rng.choice(places), o=rng.choice(nouns), O=cap(rng.choice(nouns)))

    def sentence(firm):
        s = [word() for _ in range(rng.randint(8, 22))]
        for _ in range(rng.randint(1, 2)):
            s.insert(rng.randrange(1, len(s)), rng.choice((firm, firm, rng.choice(places), str(rng.randint(3, 9000)))))
        return cap(" ".join(s)) + rng.choice(".....?;")

    articles: list[list[tuple[str, int, str]]] = []
    wholes: list[list[list[tuple[str, int, str]]]] = []
    for _ in range(count):
        firm = f"{invent().title()} {cap(rng.choice(nouns))}"
        site = rng.choice(sites)
        html_page = rng.random() < 0.6
        semantic, misused = html_page and rng.random() < 0.55, rng.random() < 0.5
        groups: list[list[tuple[str, int, str]]] = [[], [], []]

        def add(g, t, y, tag=""):
            groups[g].append((t.replace("{n}", site) if "{n}" in t else t, y, tag))  # noqa: B023

        sep = rng.choice((" | ", " • ", " · ", " / ", " › ", " > ", "  "))
        for t in rng.sample(tools, rng.randint(0, 2)):
            add(0, fill(t.replace("{n}", site)), 0)
        if rng.random() < 0.8:
            items = rng.sample(menu, rng.randint(3, 8))
            for t in [sep.join(items)] if rng.random() < 0.6 else items:
                add(0, t, 0)
        if rng.random() < 0.4:
            add(0, rng.choice((" › ", " > ", " / ")).join([*rng.sample(menu, 2), cap(rng.choice(nouns))]), 0)
        if rng.random() < 0.4:
            groups[rng.choice((0, 2))].append((fill(rng.choice(notices).replace("{n}", site)) + rng.choice(("", f" {rng.choice(buttons)}", f" {rng.choice(buttons)} {rng.choice(buttons)}")), 0, ""))
        rng.shuffle(groups[0])
        add(1, fill(rng.choice(shapes), firm if rng.random() < 0.75 else None), 1, "h1" if semantic else "")
        if rng.random() < 0.2:
            add(1, fill(rng.choice(shapes), firm), 1, "h2" if semantic else "")
        for _ in range(rng.randint(1, 6)):
            u = rng.random()
            if u < 0.22:
                mark = rng.choice(("- ", "• ", "", ""))
                for _ in range(rng.randint(2, 4)):
                    add(1, mark + rng.choice((f"{cap(word())} {rng.choice(nouns)} {word()} {rng.choice(nouns)}", f"{rng.randint(2, 900)} {rng.choice(nouns)} {rng.choice(nouns)}", f"{cap(word())} {invent()} {rng.choice(nouns)}")), 1, "li" if semantic else "")
            elif u < 0.34:
                for _ in range(rng.randint(2, 4)):
                    add(1, f"{cap(rng.choice(nouns))} | {rng.randint(10, 99999)} | {rng.randint(10, 99999)}", 1)
            elif u < 0.5:
                v = rng.random()
                add(1, rng.choice(subheads) if v < 0.35 else cap(rng.choice(nouns)) if v < 0.5 else cap(f"{rng.choice(nouns)} {subheads[0].split()[-1]}") if v < 0.65 else fill(rng.choice(shapes), firm), 1, "h2" if semantic else "")
            if rng.random() < 0.3:
                add(1, fill(rng.choice(tools).replace("{n}", site)), 0)
            if rng.random() < 0.04:
                add(1, rng.choice(marks), 0)
                for _ in range(rng.randint(1, 3)):
                    add(1, fill(rng.choice(shapes)), 0)
            add(1, " ".join(sentence(firm) for _ in range(rng.choice((1, 2, 2, 3, 3, 4)))), 1)
        if articles and rng.random() < 0.3:  # a copy of an article at another site
            groups[1] = [(t, y, tag if semantic else "") for t, y, tag in rng.choice(articles[-12:])]
        elif rng.random() < 0.4:
            articles.append([x for x in groups[1] if x[1]])
        if rng.random() < 0.6:
            add(2, rng.choice(marks), 0)
            for _ in range(rng.randint(1, 5)):
                add(2, fill(rng.choice(shapes)), 0)
        for t in rng.sample(ends, rng.randint(0, 1)) + rng.sample([x for x in notices if "{n}" not in x], rng.randint(0, 2)):
            add(2, fill(t.replace("{n}", site)), 0)
        if rng.random() < 0.7:
            add(2, sep.join(rng.sample(menu, rng.randint(2, 5))), 0)
        if wholes and rng.random() < 0.15:  # a copy of a page with all its furniture
            groups = [[(t, y, tag if semantic else "") for t, y, tag in g] for g in rng.choice(wholes[-8:])]
        elif rng.random() < 0.25:
            wholes.append(groups)
        lines, labels, made = [], [], 1
        whole = (1,) if html_page else ()
        for group in groups:
            path = whole
            if html_page and rng.random() < 0.6:
                made += 1
                path = (*whole, made)
            for t, y, tag in group:
                if semantic and not tag:
                    tag = rng.choice(("nav", "footer", "p", "div", "li")) if y == 0 or misused and rng.random() < 0.15 else rng.choice(("p", "p", "div", "li"))
                lines.append(Line(len(lines) + 1, t, tag, "", path))
                labels.append(y)
        yield lines, labels


def _with_notices(rng: random.Random, rows: list[tuple[list[Line], list[int]]], count: int = 24):
    """The pages with notices of more than ``PARAGRAPH`` words on a part of them, made of the words of their own language: each notice on few pages or many. Single paragraphs of articles are copied, too."""
    words = sorted({w for lines, _ in rows for line in lines for w in line.text.split() if w.isalpha()})
    low = [w for w in words if w.islower()]

    def sentence():
        return " ".join([rng.choice(words).title(), *[rng.choice(low) for _ in range(rng.randint(6, 20))]]) + "."

    notices = []
    for _ in range(count):
        text = sentence()
        while len(text.split()) <= PARAGRAPH + 5:
            at = text.index(" ", rng.randrange(len(text) // 2))
            text = f"{text[:at]} {rng.choice(('{n}', '{d}', '{n}', '2{d}0'))}{text[at:]} {sentence()}"
        notices.append((text, 0.3 * 100 ** -rng.random(), rng.choice((0, 2, 2, 2, 1))))
    paragraphs = [line.text for lines, labels in rows for line, y in zip(lines, labels) if y and len(line.text.split()) > PARAGRAPH]
    copied = rng.sample(paragraphs, min(len(paragraphs), max(1, len(rows) // 25)))
    for lines, labels in rows:
        if rng.random() < 0.2:
            at = rng.choice([k for k, y in enumerate(labels) if y])
            lines.insert(at + 1, Line(0, rng.choice(copied), lines[at].tag and "p", "", lines[at].path))
            labels.insert(at + 1, 1)
        for text, share, place in notices:
            if rng.random() < share / 2:
                at = (0, rng.randint(0, len(lines)), len(lines))[place]
                near = lines[min(at, len(lines) - 1)]
                n = f"{rng.choice(words).title()} {rng.choice(words).title()}"
                lines.insert(at, Line(0, text.replace("{n}", n).replace("{d}", str(rng.randint(2, 99))), near.tag and rng.choice(("p", "div", "footer")), "", near.path))
                labels.insert(at, 0)
        for k, line in enumerate(lines, 1):
            line.number = k
    return rows


class Model:
    """Weights of the line classifier and of the edges."""

    def __init__(self, weights: np.ndarray, adjacent: float, near: float):
        self.weights, self.adjacent, self.near = weights, adjacent, near

    def costs(self, lines: list[Line], seen: Recurring) -> list[float]:
        return np.clip(features(lines, seen) @ self.weights, -6, 6).tolist()

    def edges(self, lines: list[Line]) -> dict[tuple[int, int], float]:
        """Smoothness between neighbours in the text, falling with their distance in the tree, and between neighbours within a block element when others stand between."""
        out: dict[tuple[int, int], float] = {}
        latest: dict[tuple[int, ...], int] = {}
        for k, line in enumerate(lines):
            if k:
                out[k - 1, k] = self.adjacent + self.near * 0.5 ** distance(lines[k - 1].path, line.path)
            j = latest.get(line.path)
            if j is not None and j < k - 1:
                out[j, k] = self.near / 2
            latest[line.path] = k
        return out

    def content(self, lines: list[Line], seen: Recurring) -> list[bool]:
        return cut(self.costs(lines, seen), self.edges(lines))


def generated(seed: int, pages: int, notices: bool = False):
    """Labelled pages and what recurs on them. ``notices``: with furniture as long as paragraphs."""
    rows = list(_pages(random.Random(seed), pages))
    if notices:
        rows = _with_notices(random.Random(seed), rows)
    least = Recurring.least(len(rows), 0.0005)
    of_heads = Counter(h for lines, _ in rows for h in recurring_heads(lines))
    heads = frozenset(h for h, n in of_heads.items() if n >= least)
    counts: dict[int, list[int]] = {}
    for lines, _ in rows:
        for h, c in recurring_forms(lines, heads).items():
            have = counts.setdefault(h, [0] * 5)
            for k in range(5):
                have[k] += c[k]
    return rows, Recurring(len(rows), {h: tuple(c) for h, c in counts.items() if c[0] >= least}, heads)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(12):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (p - y) + 0.5 * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.5 * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


@lru_cache(maxsize=2)
def fit(seed: int = 11, pages: int = 1200) -> Model:
    """Line weights by logistic regression on two corpora of ``pages`` generated labelled pages, each in a language of its own, then edge weights by least errors of the cut on two others.

    The weights of how a paragraph recurs are fitted last, on a corpus with long notices, beside the others.
    """

    def corpora(seeds, notices):
        xs, ys = [], []
        for k in seeds:
            rows, seen = generated(k, pages, notices)
            xs += [features(lines, seen) for lines, _ in rows]
            ys += [v for _, labels in rows for v in labels]
        return np.vstack(xs), np.array(ys, float)

    x, y = corpora((seed, seed + 1), False)
    w = np.zeros(_N)
    w[:_AGAIN] = _logistic(x[:, :_AGAIN], y)
    wrong: Counter = Counter()
    for k in (2, 3):
        rows, seen = generated(seed + k, pages)
        costs = [Model(w, 0, 0).costs(lines, seen) for lines, _ in rows]
        for adjacent, near in ((a, b) for a in (0.0, 0.1, 0.2, 0.4) for b in (0.0, 0.2, 0.4, 0.8)):
            model = Model(w, adjacent, near)
            wrong[adjacent, near] += sum(a != (b == 1) for c, (lines, labels) in zip(costs, rows) for a, b in zip(cut(c, model.edges(lines)), labels))
    x, y = corpora((seed + 4,), True)
    again = x[:, _AGAIN] == 1
    w[_AGAIN:] = _logistic(x[again, _AGAIN:], y[again])
    w[_AGAIN] -= w[:3].sum()  # that it is a paragraph says no more
    return Model(w, *min(wrong, key=lambda x: (wrong[x], x)))


def max_flow_labels(source: dict[int, float], sink: dict[int, float], edges: dict[tuple[int, int], float]) -> set[int]:
    """Nodes on the source side of a minimum cut: shortest augmenting paths, then what the source still reaches."""
    s, t = -1, -2
    cap: dict[int, dict[int, float]] = {s: {}, t: {}}
    for v in source.keys() | sink.keys():
        cap[v] = {}
    for v, c in source.items():
        if c > 0:
            cap[s][v] = c
            cap[v].setdefault(s, 0.0)
    for v, c in sink.items():
        if c > 0:
            cap[v][t] = c
            cap[t].setdefault(v, 0.0)
    for (a, b), c in edges.items():
        cap[a][b] = cap[a].get(b, 0.0) + c
        cap[b][a] = cap[b].get(a, 0.0) + c
    while True:
        parent = {s: s}
        queue = deque([s])
        while queue and t not in parent:
            a = queue.popleft()
            for b, c in cap[a].items():
                if c > 1e-9 and b not in parent:
                    parent[b] = a
                    queue.append(b)
        if t not in parent:
            return set(parent) - {s}
        flow, b = float("inf"), t
        while b != s:
            flow = min(flow, cap[parent[b]][b])
            b = parent[b]
        b = t
        while b != s:
            a = parent[b]
            cap[a][b] -= flow
            cap[b][a] = cap[b].get(a, 0.0) + flow
            b = a


def cut(logit: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Content or not for every line: the labelling of least cost.

    A line whose own cost outweighs all its edges keeps its label in every minimum cut; it is
    settled first, its edges moving to the neighbours' costs, until nothing changes. The
    flow then runs over what is left.
    """
    n = len(logit)
    cost = list(logit)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    label: list[bool | None] = [None] * n
    todo = list(range(n))
    while todo:
        k = todo.pop()
        if label[k] is None and abs(cost[k]) > sum(near[k].values()):
            label[k] = cost[k] > 0
            for j, c in near[k].items():
                cost[j] += c if label[k] else -c
                del near[j][k]
                todo.append(j)
            near[k] = {}
    left = [k for k in range(n) if label[k] is None]
    if left:
        inner = {(a, b): c for a in left for b, c in near[a].items() if a < b}
        content = max_flow_labels({k: max(cost[k], 0) for k in left}, {k: max(-cost[k], 0) for k in left}, inner)
        for k in left:
            label[k] = k in content
    return label


def boilerplate_lines(text: str, model: Model, seen: Recurring) -> list[int]:
    """Numbers of the lines of a page that show text but are no main content."""
    lines = visible_lines(text)
    return [line.number for line, content in zip(lines, model.content(lines, seen)) if not content] if lines else []


def main_text(text: str, model: Model, seen: Recurring) -> str:
    """The lines of a page that are main content, as they show."""
    lines = visible_lines(text)
    return "\n".join(line.text for line, content in zip(lines, model.content(lines, seen)) if content) if lines else ""


def labeller(spark, texts: DataFrame, text: str, share: float = 0.0005):
    """What the tasks need to label pages: the model, fitted once on the driver, and what recurs on the pages of ``texts``, both of bounded size."""
    return spark.sparkContext.broadcast((fit(), recurring(texts, text, share)))


def label_lines(df: DataFrame, key: str, text: str, known=None) -> DataFrame:
    """Lines of every page that show text and are no main content: (key, line_no).

    One pass over the pages counts what recurs (``recurring``; ``known`` hands it in where it
    was counted over more tables), a second labels them, without a shuffle of text. Lines
    are split at the newline and counted from 1. Null and blank texts give no rows; copies
    of a row give copies. Texts without markup are read as plain lines. A page without
    sentences may have no main content. Long pages are labelled whole.
    """
    known = known or labeller(df.sparkSession, df, text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ids, nos = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = boilerplate_lines(t, *known.value)
                ids += [i] * len(found)
                nos += found
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nos, pa.int64())], names=["id", "line_no"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id bigint, line_no bigint").withColumnRenamed("id", key)


def main_bodies(df: DataFrame, key: str, text: str, known=None) -> DataFrame:
    """Every page with its main body only: (key, main_text); null texts stay null."""
    known = known or labeller(df.sparkSession, df, text)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [None if t is None else main_text(t, *known.value) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["id", "main_text"])

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "id bigint, main_text string").withColumnRenamed("id", key)
