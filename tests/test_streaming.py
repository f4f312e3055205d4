import pandas as pd
import pytest
from pyspark.sql import functions as F

from sedge.operators import conversation
from sedge.streaming import state

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def events(spark, tmp_path):
    df = spark.read.parquet(f"{FOLDER}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    days = [r.d for r in df.select(F.date_trunc("week", "ts").alias("d")).distinct().orderBy("d").collect()]
    for day in days:  # files in order of time, as they come
        df.where(F.date_trunc("week", "ts") == day).coalesce(1).write.mode("append").parquet(str(tmp_path / "in.parquet"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in.parquet"))
    return df, stream


def test_rate_windows_equal_the_batch(spark, events, tmp_path):
    df, stream = events
    state.drained(state.rate_counts(stream, "user_id", "ts", 2, "40 days"), str(tmp_path / "out"), str(tmp_path / "ck"))
    # Windows that the watermark has closed; none is, with so late a one, so complete mode gives all.
    q = state.rate_counts(stream, "user_id", "ts", 2, "40 days").writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("rates").collect()))
    want = sorted(map(tuple, df.groupBy("user_id", F.date_trunc("minute", "ts").alias("minute")).agg(F.count("*").alias("n")).withColumn("o", F.col("n") > 2).collect()))
    assert got == want


def test_replays_count_once(spark, events, tmp_path):
    df, stream = events
    twice = stream.union(stream)
    state.drained(state.replay_once(twice, ["event_id"], "ts", "60 days"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == df.count()


def test_newest_messages_equal_the_window(spark, events):
    df, stream = events
    q = state.newest(stream, "user_id", "ts", "event_type", 3).writeStream.outputMode("update").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {}
    for r in spark.table("newest").orderBy("user_id", "at").collect():
        last.setdefault(r.user_id, set()).add(r.at)
    want = {}
    for r in df.select("user_id", "ts").collect():
        want.setdefault(r.user_id, []).append(r.ts)
    assert {u: sorted(x)[-3:] for u, x in last.items()} == {u: sorted(x)[-3:] for u, x in want.items()}


def test_work_is_debounced_from_the_first_event(spark, events):
    df, stream = events
    q = state.debounced(stream, "user_id", "ts", 7200).writeStream.outputMode("append").format("memory").queryName("work").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.user_id, r.at) for r in spark.table("work").collect())
    want = []
    for user, part in df.select("user_id", "ts").toPandas().groupby("user_id"):
        last = None
        for at in sorted(part["ts"]):
            if last is None or at - last >= pd.Timedelta(hours=2):
                want.append((user, at.to_pydatetime()))
                last = at
    assert got == sorted(want)


def test_notes_are_capped_and_expire(spark, tmp_path):
    for k, rows in enumerate([[(1, "2024-01-01 10:00:00", f"n{j}") for j in range(8)], [(2, "2024-01-01 12:00:00", "x")], [(2, "2024-01-01 12:01:00", "y")], [(3, "2024-01-02 12:01:00", "z")]]):
        spark.createDataFrame(rows, "run long, ts string, note string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("run long, ts timestamp, note string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = state.working_memory(stream, "run", "ts", "note", 5, "30 minutes").writeStream.outputMode("update").format("memory").queryName("notes").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [(r.run, list(r.notes)) for r in spark.table("notes").collect()]
    assert rows[0] == (1, ["n3", "n4", "n5", "n6", "n7"]) and (1, []) in rows and (2, ["x", "y"]) in rows


def test_tables_of_each_batch(spark, events, tmp_path):
    df, stream = events
    state.into_tables(stream, str(tmp_path / "t"), {"by_type": lambda b: b.groupBy("event_type").count()}, str(tmp_path / "ck")).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "t/by_type")).agg(F.sum("count")).first()[0] == df.count()


def test_segments_come_back(spark):
    turns = spark.read.parquet(f"{FOLDER}/conversations.parquet")
    coded = conversation.encode_segments(conversation.plan_segments(turns, 200, 3)).collect()
    found = sorted((m["conv_id"], m["turn"], m["text"]) for r in coded for m in conversation.decode_segment(bytes(r.payload), r.sha256))
    assert found == sorted((r.conv_id, r.turn, r.text) for r in turns.collect())
    assert all(r.n <= 3 for r in coded)
