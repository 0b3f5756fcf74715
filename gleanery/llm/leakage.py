"""Evaluation passages inside a corpus: BM25 index of the test items, searched with block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
_K1, _B = 1.2, 0.75
_EPS = 1e-9


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def word_runs(text: str, keep: int, size: int = 1 << 20) -> Iterator[list[str]]:
    """The words of a text in stretches; each begins with the last ``keep`` words of the one before, so no run is cut."""
    if len(text) <= size:
        yield words(text)
        return
    start, tail = 0, []
    while start < len(text):
        end = min(len(text), start + size)
        while end < len(text) and (text[end - 1].isalnum() and text[end].isalnum()):
            end += 1
        run = tail + words(text[start:end])
        yield run
        tail, start = (run[-keep:] if keep else []), end


class ItemIndex:
    """Inverted index of items with normalised BM25 impacts.

    The impact of a word for an item is divided by the least score that any run of
    ``span`` words of the item has on its own. A passage that holds such a run therefore
    scores 1 or more, whatever else it holds: retrieving all items at 1 or above loses none.
    Postings are ordered by item and kept in blocks with the block's largest impact.
    """

    def __init__(self, items: list[tuple[int, str]], span: int, block: int = 32):
        self.span, self.block = span, block
        docs = [(i, w) for i, t in sorted(items) if len(w := words(t or "")) >= span]
        self.ids = [i for i, _ in docs]
        n, mean = len(docs), sum(len(w) for _, w in docs) / max(1, len(docs))
        df = Counter(x for _, w in docs for x in set(w))
        self.term = {w: k for k, w in enumerate(df)}
        postings: list[list[tuple[int, float]]] = [[] for _ in df]
        self.runs: dict[tuple, set[int]] = defaultdict(set)
        for k, (_, w) in enumerate(docs):
            norm = _K1 * (1 - _B + _B * len(w) / mean)
            impact = {x: math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * f * (_K1 + 1) / (f + norm) for x, f in Counter(w).items()}
            grams = [w[a : a + span] for a in range(len(w) - span + 1)]
            least = min(sum(impact[x] for x in set(g)) for g in grams)
            for x, v in impact.items():
                postings[self.term[x]].append((k, v / least))
            for g in grams:
                self.runs[tuple(self.term[x] for x in g)].add(k)
        self.items = [[k for k, _ in p] for p in postings]
        self.impacts = [[v for _, v in p] for p in postings]
        self.block_max = [[max(v[a : a + block]) for a in range(0, len(v), block)] for v in self.impacts]
        self.upper = np.array([max(v) for v in self.impacts] or [0.0])

    def search(self, terms: set[int]) -> list[int]:
        """Items whose score for a set of words is 1 or more, by block-max WAND.

        Lists are kept by their next item. The pivot is the first item at which the largest
        impacts of the lists up to it reach 1. If the maxima of the blocks it would stand in
        don't, none of the items up to the end of the first of these blocks (or to the next
        list's item) can: the lists go on behind it, by binary search.
        """
        lists = [[self.items[t][0], 0, t] for t in terms]
        found, size = [], self.block
        while lists:
            lists.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(lists):
                bound += self.upper[t]
                if bound >= 1 - _EPS:
                    pivot = k
                    break
            if pivot < 0:
                return found
            item = lists[pivot][0]
            while pivot + 1 < len(lists) and lists[pivot + 1][0] == item:
                pivot += 1
            tight, end = 0.0, lists[pivot + 1][0] if pivot + 1 < len(lists) else 1 << 62
            for x in lists[: pivot + 1]:
                p = self.items[x[2]]
                x[1] = bisect_left(p, item, x[1])
                if x[1] < len(p):
                    tight += self.block_max[x[2]][x[1] // size]
                    end = min(end, p[min((x[1] // size + 1) * size, len(p)) - 1] + 1)
            if tight >= 1 - _EPS:
                score = sum(self.impacts[t][a] for _, a, t in lists[: pivot + 1] if a < len(self.items[t]) and self.items[t][a] == item)
                if score >= 1 - _EPS:
                    found.append(item)
                end = item + 1
            for x in lists[: pivot + 1]:
                p = self.items[x[2]]
                x[1] = bisect_left(p, end, x[1])
                x[0] = p[x[1]] if x[1] < len(p) else -1
            lists = [x for x in lists if x[0] >= 0]
        return found

    def leaks(self, run: list[str]) -> set[int]:
        """Items of which ``span`` consecutive words stand in a run of words.

        The passages are all runs of ``span`` words. The bound of WAND's first step, the sum
        of the words' largest impacts, is taken for all of them at once; the passages that
        reach it are searched where they overlap as one, and what is retrieved is verified
        word by word.
        """
        n, span = len(run), self.span
        if n < span or not self.ids:
            return set()
        get = self.term.get
        ids = np.fromiter((get(w, -1) for w in run), dtype=np.int32, count=n)
        known = ids >= 0
        bound = np.where(known, self.upper[ids], 0.0)
        sums = np.concatenate(([0.0], np.cumsum(bound)))
        inside = np.concatenate(([0], np.cumsum(known)))
        hot = (sums[span:] - sums[:-span] >= 1 - 1e-6) & (inside[span:] - inside[:-span] == span)
        starts = np.flatnonzero(hot)
        if not len(starts):
            return set()
        out: set[int] = set()
        for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            part = ids[stretch[0] : stretch[-1] + span].tolist()
            found = set(self.search(set(part)))
            if found:
                for a in range(len(part) - span + 1):
                    out |= self.runs.get(tuple(part[a : a + span]), set()) & found
        return {self.ids[k] for k in out}


def _search(index):
    def run(batches):
        import pyarrow as pa

        ix = index.value
        for b in batches:
            docs, items = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                hits: set[int] = set()
                for part in word_runs(text, ix.span - 1):
                    hits |= ix.leaks(part)
                docs += [i] * len(hits)
                items += sorted(hits)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64())], names=["doc", "item"])

    return run


def find_leaks(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, span: int = 12, block_chars: int = 20_000_000) -> DataFrame:
    """Pairs (document, item) where the document holds at least ``span`` consecutive words of the item.

    Words are maximal runs of letters and digits of the lower-cased text. The items are
    measured first and indexed in hash blocks of about ``block_chars`` characters, so what
    is broadcast is bounded; every document is searched against every block, in one scan
    and without a shuffle. Rows with a null id or text, items of fewer than ``span`` words
    and empty tables give no pairs; of copies of a row one pair counts. Long texts are
    read in stretches that overlap, whole. Columns out: ``doc_id``, ``item_id`` as named.
    """
    spark = corpus.sparkSession
    docs = corpus.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text"))
    tests = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("text"))
    total = tests.agg(F.sum(F.char_length("text")).alias("n")).first().n or 0
    blocks = max(1, -(-total // block_chars))
    parts = []
    for k in range(blocks):
        own = tests if blocks == 1 else tests.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k)
        index = ItemIndex([tuple(r) for r in own.collect()], span)
        parts.append(docs.mapInArrow(_search(spark.sparkContext.broadcast(index)), "doc bigint, item bigint"))
    return reduce(DataFrame.union, parts).dropDuplicates().select(F.col("doc").alias(doc_id), F.col("item").alias(item_id))
