"""Free-entered values mapped to a reference list: a trie of its entries searched with a Levenshtein automaton."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_PLAIN = str.maketrans({"ø": "o", "đ": "d", "ð": "d", "ł": "l", "ı": "i", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss", "ŧ": "t", "ħ": "h", "’": "'", "‐": "-", "‑": "-", "–": "-", "—": "-"})
_SIGNS = re.compile(r"[™®©\"“”„«»`*#_]+|(?<!\w)'|'(?!\w)")
_BRACKETS = re.compile(r"[(\[{]([^()\[\]{}]*)[)\]}]")
_GAP = re.compile(r"[\s\-/.,;:&]+")
#: Words that may stand beside an entry without changing what is meant.
QUALIFIERS = frozenset(
    "the a an of in and greater metro metropolitan central city town area region district county state country nation mainland brand brands product products line range family label group holding company co ltd inc plc corp sector industry industries segment field business role position post acting interim deputy former ad temporary main head office headquarters hq based near approx around ca primary current new site location republic kingdom federation commonwealth".split()
)
#: Greatest length at which so many edits are allowed, 0 edits first.
EDITS = (3, 5, 9)


def plain(text: str) -> str:
    """Lower case, without accents, signs and doubled space; marks between words become one space, a full stop after a shortened word stays."""
    text = unicodedata.normalize("NFKD", unicodedata.normalize("NFKC", text).casefold().translate(_PLAIN))
    text = _SIGNS.sub("", "".join(c for c in text if not unicodedata.combining(c)).translate(_PLAIN))
    return re.sub(r"\s+", " ", re.sub(r"[\s\-/,;:]+", " ", text)).strip()


def allowed(length: int) -> int:
    """Edits allowed for an entry or value of this length."""
    return next((k for k, most in enumerate(EDITS) if length <= most), len(EDITS))


class Trie:
    """Entries and their aliases by letter. A path ends in the entries it names: (value id, exact only, path)."""

    def __init__(self):
        self.root: dict = {}

    def add(self, text: str, value_id: int, exact: bool = False) -> None:
        node = self.root
        for c in text:
            node = node.setdefault(c, {})
        node.setdefault("", []).append((value_id, exact, text))

    def within(self, query: str, edits: int) -> list[tuple[int, int, str]]:
        """All entries within the distance: (edits, value id, path).

        The automaton has a state for every place in the query and number of edits, held as
        bits: it takes each letter of a path as equal, replaced, put in, left out or swapped
        with the one before. A branch ends where no state is left. Each path's own length
        bounds its edits too.
        """
        n = len(query)
        full = (1 << (n + 1)) - 1
        at: dict[str, int] = {}
        for k, c in enumerate(query):
            at[c] = at.get(c, 0) | 1 << k
        start = [((1 << (e + 1)) - 1) & full for e in range(edits + 1)]
        out: list[tuple[int, int, str]] = []
        stack = [(self.root, start, None, "")]
        while stack:
            node, states, before, last = stack.pop()
            for c, child in node.items():
                if c == "":
                    e = next((e for e, r in enumerate(states) if r >> n & 1), None)
                    if e is not None:
                        out += [(e, v, path) for v, exact, path in child if e == 0 or (not exact and e <= allowed(len(path)))]
                    continue
                m = at.get(c, 0)
                new = [(states[0] & m) << 1]
                swap = m & (at.get(last, 0) >> 1) if before is not None else 0
                for e in range(1, edits + 1):
                    r = (states[e] & m) << 1 | states[e - 1] | states[e - 1] << 1 | new[e - 1] << 1
                    if swap:
                        r |= (before[e - 1] & swap) << 2
                    new.append(r & full)
                if new[-1]:
                    stack.append((child, new, states, c))
        return out

    def shortened(self, query: str) -> list[tuple[int, int, str]]:
        """Entries of which every word is the query's, or begins with it where that ends in a full stop."""
        if "." not in query:
            return []
        words = query.split()
        out = []

        def walk(node, k, rest, loose):
            if rest:
                child = node.get(rest[0])
                if child is not None:
                    walk(child, k, rest[1:], loose)
                return
            if loose:
                for c, child in node.items():
                    if c not in ("", " "):
                        walk(child, k, "", True)
            if k + 1 == len(words):
                out.extend((1, v, path) for v, exact, path in node.get("", []) if not exact)
            elif " " in node:
                w = words[k + 1]
                walk(node[" "], k + 1, w.rstrip("."), w.endswith(".") and len(w) > 2)

        walk(self.root, 0, words[0].rstrip("."), words[0].endswith(".") and len(words[0]) > 2)
        return out


#: Ranks of a value spelt as an entry, and of one without an entry.
IDENTICAL, NOTHING = (-1, 0, 0, 0), (1 << 30, 0, 0, 0)


class Matcher:
    """Reference entries by field; remembers the values it has seen."""

    def __init__(self, entries: list[tuple[int, str, str, str | None, list[str] | None]]):
        self.tries: dict[str, Trie] = {}
        self.exact: dict[str, set[str]] = {}
        self.names: dict[int, str] = {}
        for v, field, value, code, aliases in entries:
            trie = self.tries.setdefault(field, Trie())
            self.exact.setdefault(field, set()).add(value)
            self.names[v] = value.casefold()
            for k, x in enumerate((value, *(aliases or []), code)):
                if x and (p := plain(x).replace(".", "")):
                    short = len(p) <= EDITS[0] or k > len(aliases or [])
                    trie.add(p, v, exact=short)
                    if k <= len(aliases or []) and " " in p and not short:
                        trie.add(p.replace(" ", ""), v, exact=True)
        self.seen: dict[tuple[str | None, str], tuple[int, int, int, int]] = {}

    def __getstate__(self):
        return {**self.__dict__, "seen": {}}

    def match(self, field: str | None, value: str | None) -> int | None:
        """The value id meant, 0 for none; None where the value is null, blank or an entry as it is spelt there."""
        rank = self.rank(field, value)
        return None if rank is None or rank == IDENTICAL else rank[-1]

    def rank(self, field: str | None, value: str | None) -> tuple[int, int, int, int] | None:
        """The best entry as (reading, edits, unlike letters, value id), so that answers over parts of a list can be compared; None for a null or blank value."""
        if value is None or not value.strip():
            return None
        if value in self.exact.get(field, ()):
            return IDENTICAL
        key = (field, value)
        if key not in self.seen:
            if len(self.seen) > 200_000:
                self.seen.clear()
            self.seen[key] = self._find(field, value)
        return self.seen[key]

    def _best(self, trie: Trie, query: str, value: str):
        flat = query.replace(".", "").strip()
        if not flat:
            return None
        found: list = []
        most = allowed(len(flat) + 1)
        for edits in sorted({0, 1, most}):  # fewest edits win, so a wider search is only made where a narrower one finds nothing
            if edits <= most and (found := trie.within(flat, edits)):
                break
        if not found:
            found = [(len(EDITS) + 1, v, path) for _, v, path in trie.shortened(query)]  # after any entry within the distance
        if not found:
            return None
        spelt = value.casefold()
        return min((e, sum(a != b for a, b in zip(self.names[v], spelt)), v) for e, v, _ in found)

    def _find(self, field, value) -> tuple[int, int, int, int]:
        trie = self.tries.get(field)
        if trie is not None:
            for k, query in enumerate(self._readings(value)):
                if best := self._best(trie, query, value):
                    return (k, *best)
        return NOTHING

    @staticmethod
    def _readings(value: str):
        """The value, then the parts of it that may name an entry: without brackets, before a comma or dash, without qualifiers, within brackets, its words in turned order."""
        whole = plain(_BRACKETS.sub(r" \1 ", value) if _BRACKETS.fullmatch(value.strip()) else value)
        out = [whole]
        bare = _BRACKETS.sub(" ", value)
        if plain(bare) != whole:
            out.append(plain(bare))
        for cut in (r",", r"\s[-–—|/:]\s|[;|]"):
            parts = re.split(cut, bare)
            if len(parts) > 1:
                out.append(plain(parts[0]))
        words = plain(bare).split()
        lo, hi = 0, len(words)
        while lo < hi and words[lo].rstrip(".") in QUALIFIERS:
            lo += 1
        while hi > lo and words[hi - 1].rstrip(".") in QUALIFIERS:
            hi -= 1
        if (lo, hi) != (0, len(words)) and lo < hi:
            out += [" ".join(words[a:b]) for a, b in dict.fromkeys(((lo, len(words)), (0, hi), (lo, hi)))]
        out += [plain(m) for m in _BRACKETS.findall(value)]
        if 1 < len(words) < 9:
            out += [" ".join(words[k:] + words[:k]) for k in range(1, len(words))]
        return [x for x in dict.fromkeys(out) if x]


def map_values(df: DataFrame, key: str, field: str, value: str, reference: DataFrame, block: int = 100_000) -> DataFrame:
    """The reference entry meant by every value: (key, value_id), 0 where its field's list has none.

    ``reference``: columns value_id, field_name, canonical_value, code, aliases. Values that
    are null, blank or spelt as an entry of their field give no row. Case, accents, signs,
    brackets, qualifiers and shortened words are seen through; entries within the edits
    allowed for their length count, of several the one with fewest edits, then the one
    most alike letter by letter, then the smallest id. Codes and names of up to three
    letters must be met exactly. Copies of a row give one row. A field without a list
    gives 0. The list is counted first and taken in blocks of at most ``block`` entries, so
    what is broadcast is bounded; a field with more entries is divided by a hash of their
    ids, and the best answer over its parts counts. Rows are matched where they are, each
    task remembering the values it has met; only ids and answers are shuffled.
    """
    spark = df.sparkSession
    ref = reference.where("value_id is not null and field_name is not null and canonical_value is not null").select("value_id", "field_name", "canonical_value", "code", "aliases")
    sizes = sorted((r.field_name, r["count"]) for r in ref.groupBy("field_name").count().collect())
    blocks: list[tuple[list[str], int, int]] = []  # fields, part, parts
    names, room = [], block
    for name, n in sizes:
        if n > block:
            parts = -(-n * 5 // (block * 4))  # hashed parts differ a little in size
            blocks += [([name], k, parts) for k in range(parts)]
            continue
        if n > room:
            blocks.append((names, 0, 1))
            names, room = [], block
        names.append(name)
        room -= n
    blocks.append((names, 0, 1))
    rows = df.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(field).alias("field"), F.col(value).alias("value"))

    def search(matcher):
        def run(batches):
            import pyarrow as pa

            m = matcher.value
            for b in batches:
                found = [(i, *r) for i, f, x in zip(*(b.column(k).to_pylist() for k in range(3))) if (r := m.rank(f, x)) is not None]
                cols = list(zip(*found)) if found else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "reading", "edits", "unlike", "value_id"])

        return run

    parts = []
    for names, part, of in blocks:
        own = ref.where(F.col("field_name").isin(names)) if names else ref.limit(0)
        own = own.where(F.pmod(F.xxhash64("value_id"), F.lit(of)) == part) if of > 1 else own
        entries = [tuple(r) for r in own.orderBy("value_id").collect()]
        mine = F.col("field").isin(names) if len(blocks) > 1 and names else F.lit(len(blocks) == 1 or not names)
        if len(blocks) > 1 and (names, part, of) == blocks[-1]:  # rows of no listed field go with the last block
            mine = (F.col("field").isin(names) if names else F.lit(False)) | F.col("field").isNull() | ~F.col("field").isin([n for n, _ in sizes])
        parts.append(rows.where(mine).mapInArrow(search(spark.sparkContext.broadcast(Matcher(entries))), "id bigint, reading bigint, edits bigint, unlike bigint, value_id bigint"))
    best = reduce(DataFrame.union, parts).groupBy("id").agg(F.min(F.struct("reading", "edits", "unlike", "value_id")).alias("best"))
    return best.where("best.reading >= 0").select(F.col("id").alias(key), F.col("best.value_id").alias("value_id"))
