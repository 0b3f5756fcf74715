"""Typed values from text, and constraints as a list of what is violated."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.sources.tables import checkpoint


def typed(text: Column, schema: str) -> Column:
    """A JSON text as a typed value; a field that doesn't fit its type is null, the others stay. Fences and words around the object go."""
    from gleanery.functions.text import json_object, without_fence

    return F.from_json(json_object(without_fence(text)), schema, {"mode": "PERMISSIVE"})


def violations(**rules: tuple[Column, str]) -> Column:
    """Messages "name: text" of the rules that don't hold; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name.replace('__', '.')}: {text}")) for name, (ok, text) in rules.items()]))


def sums_agree(rows: Column, part: str, total: Column, tolerance: float = 0.02) -> Column:
    """Whether the parts of an array of structs add up to a total, within a share of it, in decimals."""
    whole = F.aggregate(rows, F.lit(0).cast("decimal(38,6)"), lambda s, r: (s + r[part].cast("decimal(28,6)")).cast("decimal(38,6)"))
    return F.abs(whole - total.cast("decimal(28,6)")) <= F.abs(total.cast("decimal(28,6)")) * F.lit(tolerance).cast("decimal(9,6)")


def percentages_agree(rows: Column, part: str, low: float = 95.0, high: float = 105.0) -> Column:
    """Whether shares add up to about a hundred; true where any row lacks one."""
    given = F.forall(rows, lambda r: r[part].isNotNull())
    return ~given | F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.coalesce(r[part].cast("double"), F.lit(0.0))).between(low, high)


def message_kinds(messages: Column, kinds: list[tuple[str, str]]) -> Column:
    """Each message as the kind of the first phrase it holds, else unknown."""

    def kind(m):
        out = F.lit("unknown")
        for name, phrase in reversed(kinds):
            out = F.when(F.contains(F.lower(m), F.lit(phrase)), name).otherwise(out)
        return out

    return F.transform(messages, kind)


def gate(kinds: Column, hard: tuple[str, ...], cost: float) -> tuple[Column, Column]:
    """Whether an array of message kinds fails (one is hard), and the score it leaves: 0 where it fails, else 1 less a cost for each, at least 0."""
    failed = F.exists(kinds, lambda k: k.isin(*hard))
    return failed, F.when(failed, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.size(kinds) * cost))


def tagged(df: DataFrame, tag: str, value: str, schemas: dict[str, str]) -> DataFrame:
    """JSON values of several shapes as one column per shape, only that of the row's tag filled."""
    cols = [F.when(F.col(tag) == name, typed(F.col(value), schema)).alias(name) for name, schema in schemas.items()]
    return df.select("*", *cols)


def repair(df: DataFrame, key: str, text: str, valid: Callable[[Column], Column], mend: Callable[[DataFrame, int], DataFrame], rounds: int = 2) -> DataFrame:
    """Answers that are valid as they are, and those mended within ``rounds`` tries: (key, value, tries, chars_sent, error).

    ``mend`` takes (key, text) rows and the number of the try and gives (key, value); it always gets the
    text as it first was. Only what is still invalid goes on, kept at the shared
    checkpoint between tries. What no try mends is an error row without value, with the
    characters of all tries; a row for which ``mend`` gives nothing counts as not mended.
    """
    rows = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    ok = lambda c: F.coalesce(valid(F.col(c)), F.lit(False))
    done = rows.where(ok("_t")).select("_k", F.col("_t").alias("value"), F.lit(0).alias("tries"), F.lit(0).cast("bigint").alias("chars_sent"))
    failing, sent = rows.where(~ok("_t")), F.coalesce(F.char_length("_t"), F.lit(0)).cast("bigint")
    for k in range(1, rounds + 1):
        tried = mend(failing.select(F.col("_k").alias(key), F.col("_t").alias(text)), k).select(F.col(key).alias("_k"), "value")
        step = checkpoint(failing.join(tried, "_k", "left"))
        done = done.unionByName(step.where(ok("value")).select("_k", "value", F.lit(k).alias("tries"), (sent * k).alias("chars_sent")))
        failing = step.where(~ok("value")).select("_k", "_t")
    lost = failing.select("_k", F.lit(None).cast("string").alias("value"), F.lit(rounds).alias("tries"), (sent * rounds).alias("chars_sent"), F.lit("not mended").alias("error"))
    return done.withColumn("error", F.lit(None).cast("string")).unionByName(lost).withColumnRenamed("_k", key)
