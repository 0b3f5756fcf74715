"""Top N items of every group: sorted runs, a loser-tree merge, and a seek to the next group."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LoserTree:
    """Merge of sorted sequences: each inner node keeps the loser of its match, the root the overall winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs, self.k = runs, len(runs)
        self.at = [0] * self.k
        self.loser = [-1] * max(1, self.k)
        for i in range(self.k):
            self._enter(i)

    def _key(self, i: int) -> tuple | None:
        return self.runs[i][self.at[i]] if self.at[i] < len(self.runs[i]) else None

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._key(a), self._key(b)
        return y is None or (x is not None and x <= y)

    def _enter(self, i: int) -> None:
        """First match of a run: it waits in the first empty node on its way up."""
        node = (i + self.k) >> 1
        while node and self.loser[node] >= 0:
            if not self._beats(i, self.loser[node]):
                i, self.loser[node] = self.loser[node], i
            node >>= 1
        self.loser[node] = i

    def _replay(self, i: int) -> None:
        node = (i + self.k) >> 1
        while node:
            if not self._beats(i, self.loser[node]):
                i, self.loser[node] = self.loser[node], i
            node >>= 1
        self.loser[0] = i

    def pop(self) -> tuple | None:
        i = self.loser[0]
        x = self._key(i)
        if x is not None:
            self.at[i] += 1
            self._replay(i)
        return x


def merge_first(runs: list[list[tuple]], n: int) -> list[tuple]:
    """The n smallest different entries of sorted runs; the rest is never read."""
    if len(runs) == 1:
        return list(dict.fromkeys(runs[0]))[:n]
    tree, out = LoserTree(runs), []
    while len(out) < n and (x := tree.pop()) is not None:
        if not out or x != out[-1]:
            out.append(x)
    return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b.column(i).to_pylist() for i in range(b.num_columns)))


def _out(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)


def _cut_runs(n: int):
    """Of rows sorted by (group, score descending, id), the first n different ones of each group."""

    def cut(batches):
        group, kept, last = None, 0, None
        for b in batches:
            out = []
            for g, s, i in zip(*(b.column(c).to_pylist() for c in range(3))):
                if g != group:
                    group, kept, last = g, 0, None
                if kept < n and (s, i) != last:
                    out.append((g, s, i))
                    kept, last = kept + 1, (s, i)
            if out:
                yield _out(out, b.schema)

    return cut


def _merge_runs(n: int, schema: pa.Schema):
    """Rows come sorted by (group, run, score descending, id): merge the runs of a group, then go on to the next."""

    def finish(group, runs):
        return [(group, -x[0], x[1]) for x in merge_first(runs, n)]

    def merge(batches):
        group, run, runs, out = None, None, [], []
        for g, r, s, i in _groups(batches):
            if g != group:
                if runs:
                    out += finish(group, runs)
                    if len(out) > 8000:
                        yield _out(out, schema)
                        out = []
                group, run, runs = g, None, []
            if r != run:
                runs.append([])
                run = r
            runs[-1].append((-s, i))
        if runs:
            out += finish(group, runs)
        if out:
            yield _out(out, schema)

    return merge


def top_n_per_group(df: DataFrame, group, score, item: str, n: int = 3, fan: int = 64, group_as: str = "group") -> DataFrame:
    """The n items with the highest score of every group, ties going to the smaller item id.

    Each input partition is sorted once (in the JVM, spilling) into a run ordered by
    (group, score, id) and cut to n rows per group before anything is shuffled, so a
    group of a third of all rows costs n rows per run. Runs meet in buckets of groups;
    a loser tree merges the runs of one group and stops after n. Where there are more
    than ``fan`` runs, they are first merged in salted sets of ``fan`` runs, so one task
    never sees more than about ``n * fan`` rows of a group.

    Columns out: ``group_as``, ``item``, ``score``. Rows with a null group, null or NaN score
    or null id never count. Exact copies of a row count once; an id delivered with two
    scores in a group counts as two entries. Empty input gives an empty result. Other
    columns are not read.
    """
    g, s = (F.col(x) if isinstance(x, str) else x for x in (group, score))
    rows = df.select(g.cast("string").alias("g"), s.cast("double").alias("s"), F.col(item).cast("bigint").alias("i"))
    rows = rows.where("g is not null and s is not null and not isnan(s) and i is not null")
    runs = rows.rdd.getNumPartitions()
    order = [F.col("s").desc(), F.col("i")]
    cut = rows.sortWithinPartitions("g", *order).mapInArrow(_cut_runs(n), "g string, s double, i bigint")
    cut = cut.withColumn("run", F.spark_partition_id())
    flat = pa.schema([("g", pa.string()), ("s", pa.float64()), ("i", pa.int64())])
    shape = "g string, s double, i bigint"
    while runs > fan:
        salt = (F.col("run") / fan).cast("int")
        part = cut.withColumn("salt", salt).repartition("g", "salt")
        merged = part.withColumn("g", F.concat_ws("\u0001", F.col("salt").cast("string"), "g")).sortWithinPartitions("g", "run", *order)
        merged = merged.select("g", "run", "s", "i").mapInArrow(_merge_runs(n, flat), shape)
        cut = merged.select(F.expr("substring(g, instr(g, '\u0001') + 1)").alias("g"), "s", "i", F.expr("cast(substring(g, 1, instr(g, '\u0001') - 1) as int)").alias("run"))
        runs = -(-runs // fan)
    last = cut.select("g", "run", "s", "i").repartition("g").sortWithinPartitions("g", "run", *order)
    out = last.mapInArrow(_merge_runs(n, flat), shape)
    return out.select(F.col("g").alias(group_as), F.col("i").alias(item), F.col("s").alias("score"))
