"""Operators over sets of rows: deliveries, first seen, ranks, as-of joins, closures, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.sources.tables import written


def once(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Rows of the columns, exact copies counting once.

    Select what is needed: all of it is shuffled. Copies are whole, so all columns are the
    grouping key; that aggregates by hash, where keeping the first text per id would sort twice.
    """
    return df.select(key, *columns).distinct()


def first_seen(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of every key. The window keeps one row per key before the shuffle as well."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of every key with their rank from 1; Spark limits each group on the map side already."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, value: str, name: str, coarse: Callable[[Column], Column] | None = None) -> DataFrame:
    """For every left row the value of the last right row of its key at or before it; null where there is none.

    Both sides meet in one sorted pass: a union and a running last value, so no pairs are
    made and the shuffle is by key only. Right rows at the same place come first; of right
    rows at one place the greatest value counts. With ``coarse``, which maps a place to a
    stretch in order (a day, a range of pages), a key is divided into its stretches: what the
    right side has at the end of each stretch, one row, is carried into the next stretch that
    has any row. A key of a third of all rows is then as many tasks as it has stretches.
    """
    extra = [c for c in left.columns if c not in keys and c != at]
    l = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*[F.col(c) for c in extra]).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"))  # noqa: E741
    r = right.select(*keys, F.col(since).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    both, parts = l.unionByName(r), list(keys)
    if coarse:
        # the ends of stretches come from the right side alone, and go to the start of every stretch of the left side after them
        both, parts = both.withColumn("_part", coarse(F.col("_at"))), [*keys, "_part"]
        ends = r.where("_v is not null").groupBy(*keys, coarse(F.col("_at")).alias("_part")).agg(F.max_by("_v", F.struct("_at", "_v")).alias("_end"))
        starts = l.select(*keys, coarse(F.col("_at")).alias("_part"), F.lit(None).cast(right.schema[value].dataType).alias("_end")).distinct()
        before = Window.partitionBy(*keys).orderBy("_part", F.col("_end").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.unionByName(starts).withColumn("_c", F.last("_end", ignorenulls=True).over(before)).where("_end is null and _c is not null")
        both = both.unionByName(carried.select(*keys, F.lit(None).cast(l.schema["_at"].dataType).alias("_at"), F.lit(-1).alias("_side"), F.lit(None).cast(l.schema["_row"].dataType).alias("_row"), F.col("_c").alias("_v"), "_part"))
    run = Window.partitionBy(*parts).orderBy(F.col("_at").asc_nulls_first(), "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn(name, F.last("_v", ignorenulls=True).over(run)).where("_side = 1")
    return own.select(*keys, F.col("_at").alias(at), *[F.col(f"_row.{c}").alias(c) for c in extra], name)


def _joined(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left rows with what the right side has for their keys; nulls are equal."""
    other = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, on, "left").drop(*[f"_r_{k}" for k in keys])


def nearest_above(df: DataFrame, keys: list[str], order: str, level: str, name: str, most: int = 200, coarse: Column | None = None) -> DataFrame:
    """For every row the place of the nearest earlier row of a smaller level, its parent in an outline; null at the top.

    One running maximum per level, all in the same sort. The levels are read from the data
    first; an outline of more than ``most`` different levels raises ValueError. With
    ``coarse`` (stretches in the order of the rows) a key is divided into its stretches, and
    the last place of each level before a stretch is carried in.
    """
    levels = sorted(r[0] for r in df.select(level).where(F.col(level).isNotNull()).distinct().limit(most + 1).collect())
    if len(levels) > most:
        raise ValueError(f"more than {most} levels in {level}")
    rows, parts = (df, list(keys)) if coarse is None else (df.withColumn("_part", coarse), [*keys, "_part"])
    at = lambda d: F.when(F.col(level) == d, F.col(order))
    run = Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wide = rows.select("*", *[F.max(at(d)).over(run).alias(f"_l{k}") for k, d in enumerate(levels)])
    last = [F.col(f"_l{k}") for k in range(len(levels))]
    if coarse is not None and levels:
        before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        ends = rows.groupBy(*parts).agg(*[F.max(at(d)).alias(f"_e{k}") for k, d in enumerate(levels)])
        wide = _joined(wide, ends.select(*parts, *[F.max(f"_e{k}").over(before).alias(f"_c{k}") for k in range(len(levels))]), parts)
        last = [F.coalesce(c, F.col(f"_c{k}")) for k, c in enumerate(last)]
    above = F.array_max(F.array(*[F.when(F.lit(d) < F.col(level), c) for d, c in zip(levels, last)], F.lit(None).cast(df.schema[order].dataType)))
    return wide.withColumn(name, above).select(*df.columns, name)


def previous(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, coarse: Column) -> DataFrame:
    """The value of the row before each row of its key, null for the first. A key is divided into stretches; the last value before a stretch is carried in."""
    rows, parts = df.withColumn("_part", coarse), [*keys, "_part"]
    own = rows.withColumn("_own", F.lag(F.struct(value)).over(Window.partitionBy(*parts).orderBy(*order)))
    ends = rows.groupBy(*parts).agg(F.max_by(F.struct(value), F.struct(*order)).alias("_end"))
    carried = ends.select(*parts, F.lag("_end").over(Window.partitionBy(*keys).orderBy("_part")).alias("_before"))
    return _joined(own, carried, parts).withColumn(name, F.coalesce("_own", "_before")[value]).select(*df.columns, name)


def evict(store: DataFrame, gone: DataFrame, document: str) -> DataFrame:
    """A chunk store without the documents named; the names are joined, so their number doesn't matter."""
    return store.join(gone.select(document).distinct(), document, "left_anti")


def closure(edges: DataFrame, keys: list[str], child: str, parent: str, rounds: int = 40) -> DataFrame:
    """All (ancestor, descendant) pairs of trees within keys, every node with itself, by doubling.

    Each round joins the pairs found last with all pairs known, so depth d takes about log2(d)
    rounds and no pair is extended twice from the same side; pairs keep their distance, which
    makes the new ones of a round those beyond the last. Each round is a table in the shared
    folder. A cycle adds no new pair and so ends.
    """
    names = [*keys, "ancestor", "descendant"]
    e = edges.select(*keys, F.col(parent).alias("ancestor"), F.col(child).alias("descendant")).where("ancestor is not null and ancestor <> '' and ancestor <> descendant").distinct()
    parts = [written(e)[0]]
    read = lambda *paths: edges.sparkSession.read.schema(e.schema).parquet(*paths)
    for _ in range(rounds):
        known, fresh = read(*parts), read(parts[-1])
        more = fresh.withColumnRenamed("descendant", "_mid").join(known.withColumnRenamed("ancestor", "_mid"), [*keys, "_mid"]).select(*names).distinct()
        path, n = written(more.join(known, names, "left_anti"))
        if not n:
            break
        parts.append(path)
    nodes = edges.select(*keys, F.col(child).alias("ancestor"), F.col(child).alias("descendant")).distinct()
    return read(*parts).unionByName(nodes).distinct()


def prefix_closure(df: DataFrame, keys: list[str], path: str, node: str) -> DataFrame:
    """(ancestor, descendant) pairs by path: a node lies below another if its path begins with the other's and a bar.

    Each path is exploded into its own prefixes, at most as many as it has parts, and these
    are joined by equality: no range join and no pairs of unrelated paths.
    """
    nodes = df.select(*keys, F.col(path).alias("_path"), F.col(node).alias("_node")).where("_path is not null and _path <> ''").distinct()
    parts = F.split("_path", r"\|")
    own = nodes.select(*keys, F.col("_node").alias("descendant"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "|"))).alias("_path"))
    return own.join(nodes.withColumnRenamed("_node", "ancestor"), [*keys, "_path"]).select(*keys, "ancestor", "descendant").distinct()


def running_before(df: DataFrame, keys: list[str], order: list[str], value: str, name: str, coarse: Column) -> DataFrame:
    """Sum of the values before each row of its key, null for the first.

    A key is divided into stretches (``coarse``, in the order of the rows): sums run within
    a stretch, and the sum of the stretches before is carried in, one row per stretch, so
    a hot key is as many tasks as it has stretches.
    """
    rows = df.withColumn("_part", coarse)
    parts = [*keys, "_part"]
    own = F.sum(value).over(Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    carried = rows.groupBy(*parts).agg(F.sum(value).alias("_sum")).select(*parts, before.alias("_before"))
    both = _joined(rows.withColumn("_own", own), carried, parts)
    total = F.when(F.col("_own").isNull() & F.col("_before").isNull(), None).otherwise(F.coalesce("_own", F.lit(0)) + F.coalesce("_before", F.lit(0)))
    return both.withColumn(name, total).drop("_part", "_own", "_before")


def within_budget(df: DataFrame, keys: list[str], order: list, size: str, budget: int, coarse: Column | None = None) -> DataFrame:
    """Each row's share of a budget spent in order: (used before, taken, left). With ``coarse`` a key is divided into stretches as in ``running_before``."""
    if coarse is not None:
        rows = running_before(df, keys, order, size, "_sum_before", coarse)
        before = F.coalesce(F.col("_sum_before"), F.lit(0))
    else:
        rows = df
        before = F.coalesce(F.sum(size).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col(size), F.lit(budget) - F.col("used_before")))
    return rows.withColumn("used_before", before).withColumn("taken", taken).withColumn("budget_left", F.greatest(F.lit(0), F.lit(budget) - F.col("used_before") - F.col("taken"))).drop("_sum_before")


def upsert_documents(store: DataFrame, new: DataFrame, document: str, key: str) -> DataFrame:
    """A chunk store after an upsert: chunks of replaced documents go where they are not in the new set, the new ones come in."""
    kept = store.join(new.select(document).distinct(), document, "left_anti")
    return kept.unionByName(new.dropDuplicates([key]))


def stale_ids(store: DataFrame, new: DataFrame, document: str, key: str) -> DataFrame:
    """Ids of chunks that an upsert would remove: of a replaced document, and not in the new set."""
    old = store.join(new.select(document).distinct(), document, "left_semi")
    return old.join(new.select(key), key, "left_anti")
