"""Event streams: windows, sessions and keyed state with expiry, driven by event time."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from gleanery.sources.tables import shared_dir

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """The events below a path as a stream with a watermark; the stored time has no zone and is taken as UTC."""
    raw = spark.readStream.schema(SCHEMA).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def run_available(stream: DataFrame, mode: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Process all that is there and return the sink's rows. Progress and output lie in the shared folder, so a lost executor or a restart repeats nothing twice.

    ``update``: each micro-batch writes the rows that changed, under its number, and of every
    key the row written last counts; state the watermark has passed is freed. ``complete``
    keeps all state and is meant for sessions, which Spark can't update.
    """
    spark = stream.sparkSession
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/progress")
    if mode in ("complete", "update"):

        def put(batch: DataFrame, number: int) -> None:
            # overwriting the folder of its number makes a repeated batch harmless
            batch.write.mode("overwrite").parquet(f"{at}/out" if mode == "complete" else f"{at}/out/batch={number}")

        started = writer.outputMode(mode).foreachBatch(put).start()
    else:
        started = writer.outputMode("append").format("parquet").option("path", f"{at}/out").start()
    started.awaitTermination()
    if mode != "update":
        return spark.read.schema(stream.schema).parquet(f"{at}/out")
    rows = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]).select(*stream.columns)


def windowed(events: DataFrame, size: str = "1 day") -> DataFrame:
    """Events by type in tumbling windows of event time."""
    w = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_micros("window.start").alias("start_us"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Sessions of every user: events less than a gap apart."""
    w = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


def access_status(events: DataFrame, stale_us: int, expire_us: int) -> DataFrame:
    """Each access of a key as hit, stale or miss, from state that holds the key's last access only.

    State ends ``expire_us`` after the last access, by event time: a timer drops it once the
    watermark is past, and an access that comes later is a miss whether or not the timer
    has run. Late rows behind the watermark are not read.
    """

    def step(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])  # one micro-batch of the key
        last = state.get[0] if state.exists else None
        out = []
        for i, t in zip(rows["event_id"], rows["ts"]):
            now = t.value // 1000
            gap = None if last is None else now - last
            out.append((i, "miss" if gap is None or gap > expire_us else "stale" if gap > stale_us else "hit"))
            last = now
        state.update((last,))
        state.setTimeoutTimestamp(max((last + expire_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "status"])

    keyed = events.select("event_id", "ts", "user_id", "event_type").groupBy("user_id", "event_type")
    return keyed.applyInPandasWithState(step, "event_id bigint, status string", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def source_path(sf_dir: str, name: str) -> str:
    """A glob that a file stream takes for a single file as well as for a folder."""
    return f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet"


