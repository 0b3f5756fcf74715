"""Near-duplicate records: an exact Jaccard join by prefix filtering.

The method asked for puts records into Voronoi regions around pivots drawn from them and
replicates those near a border by the triangle inequality. ``pivot_windows`` measures what
that would cost: unlike texts are all about as far from each other, farther than twice
the threshold less their distance to the nearest pivot, so each record would be copied into
93 to 98 of 100 regions (figures in the README). So it is not used here.

Instead regions are keyed by words. A record A that is at least t alike another shares
ceil(t * n) words with it, so in any fixed order of words its partner holds one of A's first
n - ceil(t * n) + 1 words: prefix filtering, rare words first. A record is copied into
the regions of these words, and pairs meet in a region or nowhere. The region of a frequent
word is divided by keys of two, three or more words, the k-th taken from one place further
down the record, until the expected region is small; what still overflows is divided into
blocks, each region into as many as its own size asks for, and pairs of blocks are joined.

Within a region, the parity of the records' words over a fixed number of bits gives a
lower bound of their distance (each differing word turns at most one bit), and pairs
beyond the threshold go at once. The rest are compared word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import checkpoint

_WORD = re.compile(r"[^\W_]+")


def shingles(text: str, size: int) -> set[str]:
    """The different words of a text, or its runs of ``size`` words; a text of fewer words is one run of all of them."""
    w = _WORD.findall(text.lower())
    return set(w) if size == 1 else {" ".join(w[a : a + size]) for a in range(max(1, len(w) - size + 1))} - {""}


#: Numbers from here on are those of frequent words, in the order of their frequency.
_FREQUENT = 1 << 61


class _Hash(dict):
    """Word to its number: a hash below 2**61, or for a frequent word its rank beyond that. Emptied when it has grown large."""

    def __init__(self, ranks: dict[int, int] | None = None):
        super().__init__()
        self.ranks = ranks or {}

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 400_000:
            self.clear()
        h = xxhash.xxh64_intdigest(word) >> 3
        h = self[word] = self.ranks.get(h, h)
        return h


class _Sets:
    """The set of a text as numbers: of its words, or of its runs of words, each run's number made of those of its words.
    A text of fewer words than a run has one run, of all of them."""

    def __init__(self, size: int, ranks: dict[int, int] | None = None):
        self.size, self.ranks = size, ranks or {}
        self.words = _Hash(self.ranks if size == 1 else None)

    def __call__(self, text: str) -> list[int]:
        h, w = self.words, _WORD.findall(text.lower())
        if self.size == 1:
            return [h[x] for x in set(w)]
        if not w:
            return []
        size = min(self.size, len(w))
        n = len(w) - size + 1
        a = np.array([h[x] for x in w], np.uint64)
        runs = a[:n].copy()
        for k in range(1, size):
            runs *= np.uint64(0x9E3779B97F4A7C15)
            runs ^= runs >> np.uint64(29)
            runs += a[k : k + n]
        runs *= np.uint64(0xBF58476D1CE4E5B9)
        out = np.unique(runs >> np.uint64(3)).astype(np.int64).tolist()
        return [self.ranks.get(x, x) for x in out] if self.ranks else out


#: Stands for the number of records among the counts of words.
_RECORDS = -1


def _document_counts(size: int, least: int, frequent: float):
    """Records per word, and the number of records. Runs of words met once are left out where so many records were counted
    together that this takes at most half of the share of a frequent one; which are frequent decides on speed only."""

    def run(batches):
        import pyarrow as pa

        numbers, counts, records = _Sets(size), Counter(), 0

        def out():
            sent = [x for x in counts.items() if x[1] > 1] if size > 1 and records * frequent >= 2 else list(counts.items())
            sent.append((_RECORDS, records))
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in sent], pa.int64()), pa.array([x[1] for x in sent], pa.int64())], names=["h", "n"])

        for b in batches:
            for t in b.column(1).to_pylist():
                s = numbers(t)
                records += 1
                if len(s) >= least:
                    counts.update(s)
            if len(counts) > 1_000_000:
                yield out()
                counts.clear()
                records = 0
        yield out()

    return run


def _entries(size: int, least: int, t: Fraction, words: int, stats, cap: int):
    """Rows (key, cls, id, n, parity...): one for the class of equal sets, one for each region of the record's window.

    The words of the smaller record of a pair that may come first among the shared ones are
    fewer: where a record comes only as the larger one, n is negative. Rows of that kind
    are not compared with each other.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        ranks, shares, total = stats.value
        numbers, seen, mask = _Sets(size, ranks), set(), 64 * words - 1
        wide = [k for k, share in enumerate(shares) if total * share > cap]
        first_wide = _FREQUENT + wide[0] if wide else 1 << 63

        def regions(w, n):
            """Keys of the pivots the record is replicated to; True where a record may meet larger ones there."""
            need = math.ceil(t * n)  # words shared with any partner
            p = n - need + 1  # towards any record
            q = n - math.ceil(2 * t / (1 + t) * n) + 1  # towards one at least as large
            keys = {}

            def extend(start, key, size, depth, own):
                # the depth-th shared word stands at most depth - 1 places beyond the window
                for a in range(start, min(n, p + depth)):
                    x = w[a]
                    k = x if depth == 0 else (key * 0x9E3779B97F4A7C15 + x) & 0x7FFFFFFFFFFFFFFF
                    smaller = own and a < q + depth
                    share = shares[x - _FREQUENT] if x >= _FREQUENT else 0.0
                    longer = size * share > cap and depth < 5 and a + 1 < n
                    if longer:
                        extend(a + 1, k, size * share, depth + 1, smaller)
                    if not longer or need <= depth + 1:  # the shared words may end here: a partner can't follow a longer key
                        keys[k] = smaller or keys.get(k, False)

            if w[p - 1] < first_wide:
                return dict(zip(w[:p], [True] * q + [False] * (p - q)))
            extend(0, 0, float(total), 0, True)
            return keys

        for b in batches:
            keys, sizes, docs, marks = [], [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = numbers(text)
                n = len(w)
                if not n or n < least:
                    continue
                w.sort()
                cls = xxhash.xxh64_intdigest(np.array(w, np.int64).tobytes()) >> 1
                parity = 0
                keys.append(-1 - cls)
                sizes.append(n)
                m = 1
                if cls not in seen:
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(cls)
                    for x in w:
                        parity ^= 1 << (x & mask)
                    own = regions(w, n)
                    keys += own
                    sizes += [n if smaller else -n for smaller in own.values()]
                    m += len(own)
                docs.append((cls, i, m))
                marks.append(parity.to_bytes(8 * words, "little"))
            cls, ids, m = (np.array([d[k] for d in docs], np.int64) for k in range(3))
            planes = np.frombuffer(b"".join(marks), np.int64).reshape(-1, words)
            arrays = [np.array(keys, np.int64), np.repeat(cls, m), np.repeat(ids, m), np.array(sizes, np.int32), *[np.repeat(planes[:, k], m) for k in range(words)]]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["key", "cls", "id", "n", *[f"b{k}" for k in range(words)]])

    return run


def _region_pairs(t: float, words: int, cap: int, blocks: bool):
    """Join the rows of each region, rows being sorted by key. Out: kind 0 a candidate pair, 1 a member of a class of equal
    sets, 2 a row of a region beyond ``cap``, kept for the next round. With blocks, rows of side 0 meet those of side 1."""
    names = ["kind", "a", "b", "i", "j", "n", *[f"b{k}" for k in range(words)]]

    def run(batches):
        import pyarrow as pa

        def emit(kind, a, b, i, j, n=None, bits=None):
            m = len(a)
            zero = np.zeros(m, np.int64)
            arrays = [np.full(m, kind, np.int32), a, b, i, j, np.zeros(m, np.int32) if n is None else n, *([zero] * words if bits is None else bits)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], names=names)

        half = max(1, words // 2)

        def near(x, y, bits_x, bits_y):
            """Whether half the parity leaves the distance within the threshold; x and y are the sizes times (1 - t) / (1 + t)."""
            diff = np.bitwise_count(bits_x[0] ^ bits_y[0])
            for p, q in zip(bits_x[1:half], bits_y[1:half]):
                diff = diff.astype(np.uint16) + np.bitwise_count(p ^ q)
            return diff <= x + y

        def nearer(x, y, room, bits):
            """Those of the index pairs which all of the parity leaves."""
            diff = np.zeros(len(x), np.uint16)
            for p in bits:
                diff += np.bitwise_count(p[x] ^ p[y])
            ok = diff <= room[x] + room[y]
            return x[ok], y[ok]

        def join(r):
            """All regions of sorted rows: small ones together, row against the row so many places on; larger ones as tables."""
            key, n = r["key"], len(r["key"])
            edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
            size = np.diff(edge)
            bits = [p.view(np.uint64) for p in r["bits"]]
            count = np.abs(r["n"])
            lead = r["n"] > 0
            room = (count * ((1 - t) / (1 + t)) + 1e-6).astype(np.float32)
            found = []
            small = np.flatnonzero((size > 1) & (size <= 24))
            if len(small):
                small = small[np.argsort(size[small], kind="stable")]
                length = size[small]
                starts = np.cumsum(length) - length
                at = np.repeat(edge[small] - starts, length) + np.arange(length.sum())
                own, part_bits, part_room, part_lead = np.repeat(np.arange(len(small)), length), [p[at] for p in bits], room[at], lead[at]
                for lag in range(1, int(length[-1])):
                    lo = starts[np.searchsorted(length, lag, side="right")]
                    ok = (own[lo:-lag] == own[lo + lag :]) & (part_lead[lo:-lag] | part_lead[lo + lag :]) & near(part_room[lo:-lag], part_room[lo + lag :], [p[lo:-lag] for p in part_bits], [p[lo + lag :] for p in part_bits])
                    k = np.flatnonzero(ok) + lo
                    found.append(nearer(at[k], at[k + lag], room, bits))
            for k in np.flatnonzero(size > 24):
                lo, hi = edge[k], edge[k + 1]
                if hi - lo > cap and not blocks:
                    continue
                step = max(1, 200_000 // (hi - lo))
                first = np.flatnonzero(lead[lo:hi]) + lo
                for row in range(0, len(first), step):
                    i = first[row : row + step]
                    ok = near(room[i, None], room[None, lo:hi], [p[i, None] for p in bits], [p[None, lo:hi] for p in bits])
                    x, y = np.nonzero(ok)
                    x, y = i[x], y + lo
                    up = (x != y) & ((y > x) | ~lead[y])
                    found.append(nearer(x[up], y[up], room, bits))
            if found:
                x, y = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
                nx, ny = count[x], count[y]
                ok = (np.minimum(nx, ny) >= t * np.maximum(nx, ny) - 1e-9) & (r["cls"][x] != r["cls"][y])
                if blocks:
                    sx, sy = r["side"][x], r["side"][y]
                    ok &= (sx + sy == 1) | (sx == 2) & (sy == 2)
                x, y = x[ok], y[ok]
                swap = r["cls"][x] > r["cls"][y]
                x, y = np.where(swap, y, x), np.where(swap, x, y)
                if len(x):
                    a, b = r["cls"][x], r["cls"][y]
                    code = np.lexsort((b, a))
                    keep = np.concatenate(([True], (a[code][1:] != a[code][:-1]) | (b[code][1:] != b[code][:-1])))
                    x, y = x[code][keep], y[code][keep]
                    yield emit(0, r["cls"][x], r["cls"][y], r["id"][x], r["id"][y])
            if not blocks:
                for k in np.flatnonzero(size > cap):
                    s = slice(edge[k], edge[k + 1])
                    yield emit(2, key[s], r["cls"][s], r["id"][s], key[s] * 0, r["n"][s], [p[s] for p in r["bits"]])

        def rows(b):
            c = {name: b.column(k).to_numpy(zero_copy_only=False) for k, name in enumerate(b.schema.names)}
            return {"key": c["key"], "cls": c["cls"], "id": c["id"], "n": c["n"], "bits": [c[f"b{k}"] for k in range(words)], "side": c.get("side")}

        def cat(parts):
            out = {k: np.concatenate([p[k] for p in parts]) for k in ("key", "cls", "id", "n")}
            out["bits"] = [np.concatenate([p["bits"][k] for p in parts]) for k in range(words)]
            out["side"] = np.concatenate([p["side"] for p in parts]) if blocks else None
            return out

        def part(r, s):
            return {"key": r["key"][s], "cls": r["cls"][s], "id": r["id"][s], "n": r["n"][s], "bits": [p[s] for p in r["bits"]], "side": r["side"][s] if blocks else None}

        def unique(r):
            """Sorted rows, a class once per region (and side)."""
            keys = (r["id"], -r["n"], r["cls"], r["side"], r["key"]) if blocks else (r["id"], -r["n"], r["cls"], r["key"])
            order = np.lexsort(keys)
            r = part(r, order)
            same = (r["key"][1:] == r["key"][:-1]) & (r["cls"][1:] == r["cls"][:-1])
            if blocks:
                same &= r["side"][1:] == r["side"][:-1]
            return part(r, np.concatenate(([True], ~same)))

        left, spilled, last_member = None, None, None
        for b in batches:
            if not b.num_rows:
                continue
            r = rows(b)
            equal = r["key"] < 0
            if not blocks and equal.any():  # rows of equal sets come first, class by class: passed on as they are
                e = part(r, equal)
                yield emit(1, e["cls"], e["cls"], e["id"], e["id"])
                r = part(r, ~equal)
                if not len(r["key"]):
                    continue
            if spilled is not None:  # the rest of a region that overflowed
                more = r["key"] == spilled
                if more.any():
                    e = part(r, more)
                    yield emit(2, e["key"], e["cls"], e["id"], e["key"] * 0, e["n"], e["bits"])
                    r = part(r, ~more)
                if not len(r["key"]):
                    continue
                spilled = None
            if left is not None:
                r = cat([left, r])
            last = r["key"] == r["key"][-1]
            done = part(r, ~last)
            left = part(r, last)
            if len(done["key"]):
                yield from join(unique(done))
            if not blocks and len(left["key"]) > cap:
                left = unique(left)
                if len(left["key"]) > cap:
                    yield emit(2, left["key"], left["cls"], left["id"], left["key"] * 0, left["n"], left["bits"])
                    spilled, left = left["key"][-1], None
        if left is not None and len(left["key"]):
            yield from join(unique(left))

    return run


def _token_arrays(size: int):
    def run(batches):
        import pyarrow as pa

        numbers = _Sets(size)
        for b in batches:
            sets = [numbers(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "w"])

    return run


def similar(df: DataFrame, key: str, text: str, threshold: float = 0.8, shingle: int = 5, least: int = 1, bits: int = 256, frequent: float = 0.001, cap: int = 16384, overflow: int = 65536, broadcast_ids: int = 1_000_000, ranked: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Classes of equal word sets, and the pairs of classes whose Jaccard similarity reaches the threshold. Exact.

    Sets are of the different words of the lower-cased text (maximal runs of letters and
    digits), or of runs of ``shingle`` words, a text of fewer words being one run. Records with fewer than ``least`` of them, a
    null key or a null or wordless text are in no class. Copies of a row, and other records with the
    same set, are members of one class, however many; pairs stand between classes.
    Words are told apart by 61-bit hashes, classes by 63-bit ones.

    Texts are read three times: to count words, to place records, and, of the records that
    may be alike, to compare words. ``frequent``: words in at least this share of the records are ordered by frequency, at
    the end, the ``ranked`` most frequent of them (any order of words gives the same pairs, so
    this bounds what is broadcast and nothing else); there are at most (mean words of a record) / frequent of them, which bounds
    what is broadcast. ``cap``: expected records of a region beyond which pivots get
    another word. ``overflow``: rows of a region beyond which it is joined in blocks by
    other tasks. ``broadcast_ids``: number of records to verify up to which their ids are
    broadcast; beyond it they are joined by shuffle.

    Returns (members: cls, id; pairs: a, b with a < b, similarity).
    """
    spark = df.sparkSession
    t = Fraction(threshold).limit_denominator(10_000)
    words = max(1, bits // 64)
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    counts = docs.mapInArrow(_document_counts(shingle, least, frequent), "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    counts = checkpoint(counts.where("n > 1 or h = -1"))
    n = (counts.where(F.col("h") == _RECORDS).first() or {"n": 0})["n"]
    often = counts.where((F.col("h") != _RECORDS) & (F.col("n") >= max(2.0, n * frequent))).orderBy(F.col("n").desc(), "h").limit(ranked).collect()
    often.sort(key=lambda r: (r.n, r.h))
    stats = spark.sparkContext.broadcast(({r.h: _FREQUENT + k for k, r in enumerate(often)}, [r.n / max(n, 1) for r in often], n))

    planes = "".join(f", b{k} bigint" for k in range(words))
    entries = docs.mapInArrow(_entries(shingle, least, t, words, stats, cap), f"key bigint, cls bigint, id bigint, n int{planes}")
    spread = entries.repartition("key").sortWithinPartitions("key")
    shape = f"kind int, a bigint, b bigint, i bigint, j bigint, n int{planes}"
    met = checkpoint(spread.mapInArrow(_region_pairs(float(t), words, overflow, False), shape))
    found = met.where("kind = 0").select("a", "b", "i", "j")
    over = met.where("kind = 2")
    sizes = over.groupBy("a").count().select("a", F.greatest(F.lit(2), F.ceil(F.col("count") / (overflow // 2))).cast("int").alias("g"))
    regions = over.select("a").distinct().count()
    if regions:
        # each overflowing region has its own number of blocks; there are at most (all entries) / overflow of them
        with_g = over.join(F.broadcast(sizes) if regions <= broadcast_ids else sizes, "a").withColumn("own", F.pmod(F.xxhash64("b", F.lit(5)), F.col("g")).cast("int"))
        rows = with_g.select(
            F.col("a").alias("region"), F.col("b").alias("cls"), F.col("i").alias("id"), "n", *[f"b{k}" for k in range(words)],
            F.explode(F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("x"), F.greatest(x, F.col("own")).alias("y"), F.when(x == F.col("own"), 2).when(F.col("own") < x, 0).otherwise(1).alias("side")))).alias("p"),
        )
        rows = rows.select(F.xxhash64("region", "p.x", "p.y").alias("key"), "cls", "id", "n", *[f"b{k}" for k in range(words)], F.col("p.side").alias("side"))
        rows = rows.repartition("key").sortWithinPartitions("key")
        more = rows.mapInArrow(_region_pairs(float(t), words, overflow, True), shape).where("kind = 0")
        found = found.unionByName(more.select("a", "b", "i", "j"))
    found = found.groupBy("a", "b").agg(F.min("i").alias("i"), F.min("j").alias("j"))

    ids = found.select(F.explode(F.array("i", "j")).alias("id")).distinct()
    if ids.count() <= broadcast_ids:
        ids = F.broadcast(ids)
    sets = docs.join(ids, "id", "left_semi").mapInArrow(_token_arrays(shingle), "id bigint, w array<bigint>").dropDuplicates(["id"])
    both = found.join(sets.select(F.col("id").alias("i"), F.col("w").alias("u")), "i").join(sets.select(F.col("id").alias("j"), F.col("w").alias("v")), "j")
    both = both.withColumn("shared", F.size(F.array_intersect("u", "v")))
    whole = F.size("u") + F.size("v") - F.col("shared")
    pairs = both.where(F.col("shared") * F.lit(t.denominator) >= whole * F.lit(t.numerator)).select("a", "b", (F.col("shared") / whole).alias("similarity"))
    members = met.where("kind = 1").select(F.col("a").alias("cls"), F.col("i").alias("id")).distinct()
    return members, pairs


def record_pairs(members: DataFrame, pairs: DataFrame, block: int = 2000) -> DataFrame:
    """All pairs of records (id_a < id_b): those of linked classes, and those within a class.

    Classes are dealt into blocks of about ``block`` members by a hash of the id, and pairs of
    blocks are joined, so a class of a third of all records is many tasks; what one key
    gives is bounded by ``block`` squared.
    """
    sizes = members.groupBy("cls").count().select("cls", F.ceil(F.col("count") / block).cast("int").alias("g"))
    placed = members.join(sizes, "cls").withColumn("p", F.pmod(F.xxhash64("id", F.lit(7)), F.col("g")).cast("int"))
    blocks = lambda g: F.sequence(F.lit(0), g - 1)
    left = placed.select("cls", F.col("p").alias("lo"), F.explode(F.sequence("p", F.col("g") - 1)).alias("hi"), F.col("id").alias("x"))
    right = placed.select("cls", F.explode(F.sequence(F.lit(0), "p")).alias("lo"), F.col("p").alias("hi"), F.col("id").alias("y"))
    within = left.join(right, ["cls", "lo", "hi"]).where("lo < hi or x < y").select("x", "y")
    side = lambda c, p, i: placed.select(F.col("cls").alias(c), F.col("p").alias(p), F.col("id").alias(i))
    dealt = pairs.select("a", "b").join(sizes.select(F.col("cls").alias("a"), F.col("g").alias("ga")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("g").alias("gb")), "b")
    dealt = dealt.select("a", "b", "gb", F.explode(blocks(F.col("ga"))).alias("pa")).select("a", "b", "pa", F.explode(blocks(F.col("gb"))).alias("pb"))
    across = dealt.join(side("a", "pa", "x"), ["a", "pa"]).join(side("b", "pb", "y"), ["b", "pb"]).select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def pivot_windows(df: DataFrame, key: str, text: str, threshold: float, shingle: int, least: int, pivots: int = 64, seed: int = 3) -> dict[str, float]:
    """What a join around record pivots would cost: a measurement, no part of the join.

    ``pivots`` records are drawn by a seeded hash (the only sample here, of bounded size); every
    record's distance to all of them is taken. Returns the mean number of regions a
    record is replicated to when a region's window is twice the distance threshold, as the
    triangle inequality asks, the share of pivots that takes, and the share of distances at 0.9 or more.
    """
    docs = df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    numbers = _Sets(shingle)
    drawn = [s for r in docs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pivots * 4).collect() if len(s := frozenset(numbers(r.text))) >= least][:pivots]
    own = df.sparkSession.sparkContext.broadcast(drawn)
    window = 2 * (1 - threshold)

    def run(batches):
        import pyarrow as pa

        sets, regions, far, all_ = _Sets(shingle), 0, 0, 0
        records = 0
        for b in batches:
            for t in b.column(1).to_pylist():
                s = set(sets(t))
                if len(s) < least:
                    continue
                d = [1 - len(s & p) / len(s | p) for p in own.value]
                near = min(d, default=1.0)
                records += 1
                regions += sum(x <= near + window for x in d)
                far += sum(x >= 0.9 for x in d)
                all_ += len(d)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (records, regions, far, all_)], names=["records", "regions", "far", "all_"])

    r = docs.mapInArrow(run, "records bigint, regions bigint, far bigint, all_ bigint").agg(*[F.sum(c).alias(c) for c in ("records", "regions", "far", "all_")]).first()
    if not r.records or not drawn:
        return {"pivots": float(len(drawn)), "regions_per_record": 0.0, "share_of_pivots": 0.0, "share_beyond_0.9": 0.0}
    return {"pivots": float(len(drawn)), "regions_per_record": r.regions / r.records, "share_of_pivots": r.regions / r.all_, "share_beyond_0.9": r.far / r.all_}


def components(nodes: DataFrame, links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components: (node, group), the group being its smallest node.

    Alternating large-star and small-star rounds on the links, each written to the shared
    checkpoint; stars are aggregated by node before and after the shuffle, and joined with one
    row per node, so a hub's links may be split over tasks (adaptive skew join). It ends when no
    link changes; a graph whose rounds don't suffice raises an error.
    """
    e = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small_of = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_of, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_of.select("u", F.col("m").alias("v"))).distinct()
        new = checkpoint(small)
        changed = new.join(e, ["u", "v"], "left_anti").limit(1).count() + e.join(new, ["u", "v"], "left_anti").limit(1).count()
        e = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return nodes.join(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("group")), "node", "left").select("node", F.coalesce("group", "node").alias("group"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row per record: (id, group, links): the component of its class, named by the smallest id in it, and the number of other classes its class is linked to."""
    names = checkpoint(members.groupBy("cls").agg(F.min("id").alias("rep")))
    name = lambda c: names.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"))
    links = pairs.select("a", "b").join(name("a"), "a").join(name("b"), "b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"))
    links = checkpoint(links)
    part = components(names.select(F.col("rep").alias("node")), links)
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("links"))
    one = names.join(part.join(degree, "node", "left").select(F.col("node").alias("rep"), "group", F.coalesce("links", F.lit(0)).alias("links")), "rep")
    return members.join(one.select("cls", "group", "links"), "cls").select("id", "group", "links")
