"""The same operators on streams: rates, replays, newest messages, debounced work, expiring notes, derived tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream; it may be one file or a folder of them."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 8).parquet(f"{folder}/{name}.parquet*")


def rate_counts(events: DataFrame, by: str, at: str, limit: int, late: str = "10 minutes") -> DataFrame:
    """by, minute, n, over_limit: fixed windows of a minute; events later than `late` are left out of windows that are closed."""
    counted = events.withWatermark(at, late).groupBy(by, F.window(at, "1 minute")).agg(F.count("*").alias("n"))
    return counted.select(by, F.col("window.start").alias("minute"), "n", (F.col("n") > limit).alias("over_limit"))


def replay_once(events: DataFrame, keys: list[str], at: str, horizon: str = "24 hours") -> DataFrame:
    """Each key once, however often its event is sent again within the horizon."""
    return events.withWatermark(at, horizon).dropDuplicatesWithinWatermark(keys)


def newest(messages: DataFrame, by: str, at: str, text: str, n: int) -> DataFrame:
    """by, at, text, place: after each batch the newest n messages of the threads that it touched. State is n messages a thread."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held = sorted([*held, *zip(part[at].astype("int64").tolist(), part[text].tolist())])[-n:]
        state.update((tuple(h[0] for h in held), tuple(h[1] for h in held)))
        yield pd.DataFrame({by: [key[0]] * len(held), "at": pd.to_datetime([h[0] for h in held], unit="us"), "text": [h[1] for h in held], "place": range(1, len(held) + 1)})

    kinds = {f.name: f.dataType.simpleString() for f in messages.schema}
    micros = messages.select(by, F.unix_micros(F.col(at).cast("timestamp")).alias(at), F.col(text).cast("string").alias(text))
    return micros.groupBy(by).applyInPandasWithState(update, f"{by} {kinds[by]}, at timestamp, text string, place int", "at array<bigint>, text array<string>", "update", GroupStateTimeout.NoTimeout)


def debounced(events: DataFrame, by: str, at: str, seconds: int) -> DataFrame:
    """by, at of events that start work: the first, and the first that comes `seconds` or more after the last one that did."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for moment in sorted(m for part in parts for m in part[at].astype("int64").tolist()):
            if last is None or moment - last >= seconds * 1_000_000:
                out.append(moment)
                last = moment
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({by: [key[0]] * len(out), "at": pd.to_datetime(out, unit="us")})

    kinds = {f.name: f.dataType.simpleString() for f in events.schema}
    micros = events.select(by, F.unix_micros(F.col(at).cast("timestamp")).alias(at))
    return micros.groupBy(by).applyInPandasWithState(update, f"{by} {kinds[by]}, at timestamp", "last bigint", "append", GroupStateTimeout.NoTimeout)


def working_memory(notes: DataFrame, by: str, at: str, text: str, most: int, ttl: str = "30 minutes") -> DataFrame:
    """by, notes: a capped list for each run that goes when nothing was noted for the time to live (event time)."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({by: [key[0]], "notes": [[]]})
            return
        held = list(zip(*state.get)) if state.exists else []
        for part in parts:
            held = sorted([*held, *zip(part["_us"].tolist(), part[text].tolist())])[-most:]
        state.update((tuple(h[0] for h in held), tuple(h[1] for h in held)))
        state.setTimeoutTimestamp(max(held[-1][0] // 1000 + int(pd.Timedelta(ttl).total_seconds() * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({by: [key[0]], "notes": [[h[1] for h in held]]})

    kinds = {f.name: f.dataType.simpleString() for f in notes.schema}
    moments = notes.withWatermark(at, "1 minute").withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    return moments.select(by, at, "_us", text).groupBy(by).applyInPandasWithState(update, f"{by} {kinds[by]}, notes array<string>", "at array<bigint>, text array<string>", "update", GroupStateTimeout.EventTimeTimeout)


def into_tables(stream: DataFrame, folder: str, tables: dict[str, Callable[[DataFrame], DataFrame]], checkpoint: str):
    """Derived tables of each batch in one foreachBatch, under the batch's number, so that a batch that runs again writes over itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, make in tables.items():
            make(batch).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def drained(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now into parquet files, then end it."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
