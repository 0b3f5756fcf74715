"""Steps that depend on what came before them in a key's rows: read in order, one pass per partition, holding one key's state only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_sorted(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple[object, tuple]], schema: str) -> DataFrame:
    """Run ``step`` over the rows of every key in order, carrying its state from row to row.

    Rows are shuffled by key and sorted once, spilling; a task streams through its
    partition in Arrow batches and holds one state, so a key of any length needs no more
    memory than a short one. ``step`` takes the state and the row's ``columns`` and gives the new
    state and an output row for ``schema``. The rows of one key are one task's: a state that
    hangs on all earlier rows can't be divided.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape, n = to_arrow_schema(StructType.fromDDL(schema)), len(keys)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key, state = None, None
        for b in batches:
            out = []
            for row in zip(*(b.column(k).to_pylist() for k in range(b.num_columns))):
                if row[:n] != key:
                    key, state = row[:n], start()
                state, made = step(state, row[n:])
                out.append(made)
            cols = list(zip(*out)) if out else [()] * len(shape)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, shape)], schema=shape)

    rows = df.select(*[F.col(k) for k in keys], *columns)
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def cache_aside(accesses: DataFrame, keys: list[str], at_us: str, item: str, stale_us: int, expire_us: int, refetch_stale: bool) -> DataFrame:
    """Each access of a key as miss, expired, stale or hit, with what is done: (item, status, action).

    An entry is set at a miss and lives ``expire_us`` from then, not from its last access; past
    ``stale_us`` it is stale. With ``refetch_stale`` a stale entry is fetched and set anew,
    otherwise it is served as it is. Accesses of one time go by their item.
    """

    def step(state, row):
        now, i = row
        age = None if state is None else now - state
        status = "miss" if age is None else "expired" if age > expire_us else "stale" if age > stale_us else "hit"
        fetch = status in ("miss", "expired") or (status == "stale" and refetch_stale)
        return (now if fetch else state), (i, status, "fetch" if fetch else "serve")

    kind = accesses.schema[item].dataType.simpleString()
    return fold_sorted(accesses, keys, [at_us, item], [at_us, item], lambda: None, step, f"`{item}` {kind}, status string, action string")


def embed_batches(df: DataFrame, key: str, text: str, embed: Callable[[list[str]], list[tuple[int, list[float]]]], size: int = 100) -> DataFrame:
    """Vectors of texts from a source that takes up to ``size`` at once: (key, vector, batch_error).

    ``embed`` gives (index, vector) in any order; they are put back in the order of the texts.
    A batch that raises leaves its texts without vectors, with the message and how many
    texts of its task were done before it; the other batches keep theirs. Null texts are
    not sent and have neither.
    """

    def run(batches):
        import pyarrow as pa

        done = 0
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            vectors: list = [None] * len(ids)
            errors: list = [None] * len(ids)
            sent = [k for k, t in enumerate(texts) if t is not None]
            for a in range(0, len(sent), size):
                part = sent[a : a + size]
                try:
                    found = dict(embed([texts[k] for k in part]))
                    for j, k in enumerate(part):
                        vectors[k] = found[j]
                    done += len(part)
                except Exception as e:  # noqa: BLE001
                    for k in part:
                        errors[k] = f"{type(e).__name__} after {done} texts: {e}"
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vectors, pa.list_(pa.float64())), pa.array(errors, pa.string())], names=["id", "vector", "batch_error"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, vector array<double>, batch_error string").withColumnRenamed("id", key)


def line_groups(df: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """Texts cut between lines into groups of at most ``most`` tokens (a quarter of the characters, rounded down), a longer line alone: (key, part, content)."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part, lines, used = 0, [], 0
                for line in t.split("\n"):
                    n = len(line) // 4
                    if lines and used + n > most:
                        rows.append((i, part, "\n".join(lines)))
                        part, lines, used = part + 1, [], 0
                    lines.append(line)
                    used += n
                rows.append((i, part, "\n".join(lines)))
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string())], names=["id", "part", "content"])

    rows = df.where(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id string, part int, content string").withColumnRenamed("id", key)
