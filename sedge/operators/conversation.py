"""Threads of messages: sequence, windows, preceding message, turns, rolling digests, archive segments."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import text as t


def with_sequence(messages: DataFrame, thread: str, *order: str, source_key: str | None = None) -> DataFrame:
    """messages with a gap-free one-based sequence in each thread; with source_key, one row of each key (the first) stays."""
    if source_key:
        first = Window.partitionBy(thread, source_key).orderBy(*order)
        messages = messages.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return messages.withColumn("sequence", F.row_number().over(Window.partitionBy(thread).orderBy(*order)))


def newest_turns(messages: DataFrame, turns: int, thread: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """Messages from the n-th newest user message on; all of them where there are fewer."""
    after = Window.partitionBy(thread).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    later = F.coalesce(F.sum((F.col(role) == "user").cast("int")).over(after), F.lit(0))
    return messages.withColumn("_later", later).where(F.col("_later") < max(turns, 1)).drop("_later")


def budget_window(messages: DataFrame, budget: int, thread: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages that fit a token budget, the newest one always; used is the sum up to each."""
    back = Window.partitionBy(thread).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(Window.partitionBy(thread).orderBy(F.desc(order)))
    sized = messages.withColumn("used", F.sum(t.estimate_tokens(F.col(text)) + 4).over(back)).withColumn("_n", place)
    return sized.where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def preceding(messages: DataFrame, thread: str, at: str, key: str, within: str | None = None) -> DataFrame:
    """messages with the key and time of the one before in the thread, if it is within the interval (an as-of self-join by lag)."""
    line = Window.partitionBy(thread).orderBy(at, key)
    out = messages.withColumn("before", F.lag(key).over(line)).withColumn("before_at", F.lag(at).over(line))
    if within:
        near = F.col("before_at") >= F.col(at) - F.expr(f"INTERVAL {within}")
        out = out.withColumn("before", F.when(near, F.col("before"))).withColumn("before_at", F.when(near, F.col("before_at")))
    return out


def turn_units(messages: DataFrame, thread: str = "conv_id", order: str = "turn", role: str = "role") -> DataFrame:
    """messages with unit: how many user messages there are up to each, so a question and its answers share a unit."""
    line = Window.partitionBy(thread).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return messages.withColumn("unit", F.sum((F.col(role) == "user").cast("int")).over(line))


def digest_line(role: Column, text: Column, limit: int = 160) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.concat(role, F.lit(": "), F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("…"))).otherwise(flat))


def rolling_digest(messages: DataFrame, every: int = 20, keep: int = 2000, thread: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """thread, version, digest: after every `every` messages the newest lines that fit into `keep` characters."""
    place = F.row_number().over(Window.partitionBy(thread).orderBy(order))
    lines = messages.select(thread, order, digest_line(F.col(role), F.col(text)).alias("line"), place.alias("n"))
    last = lines.groupBy(thread).agg(F.max("n").alias("size"))
    many = F.floor(F.col("size") / every).cast("int")
    versions = last.where(F.col("size") >= every).select(thread, F.explode(F.sequence(F.lit(1), many)).alias("version"))
    span = lines.join(versions, thread).where(F.col("n") <= F.col("version") * every)
    back = Window.partitionBy(thread, "version").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    sized = span.withColumn("chars", F.sum(F.length("line") + 1).over(back)).where(F.col("chars") <= keep + 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"])
    return sized.groupBy(thread, "version").agg(F.count("*").alias("lines"), F.array_join(ordered, "\n").alias("digest"))


def plan_segments(messages: DataFrame, target: int, most: int, ratio: float = 5.0, thread: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """messages with segment: runs of a thread whose projected compressed size or number stays within bounds.

    A fold over a thread in order, so it runs per thread; only sizes go through it.
    """
    budget = int(target * ratio)
    sizes = messages.select(thread, order, (F.octet_length(text) + 256).alias("size"))

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        out, segment, used, n = [], 0, 0, 0
        for size in table.column("size").to_pylist():
            if n and (used + size > budget or n >= most):
                segment, used, n = segment + 1, 0, 0
            used, n = used + size, n + 1
            out.append(segment)
        return pa.table({thread: table.column(thread), order: table.column(order), "segment": pa.array(out, pa.int64())})

    kinds = {f.name: f.dataType.simpleString() for f in sizes.schema}
    placed = sizes.groupBy(thread).applyInArrow(fold, f"{thread} {kinds[thread]}, {order} {kinds[order]}, segment long")
    return messages.join(placed, [thread, order])


def encode_segments(planned: DataFrame, thread: str = "conv_id", order: str = "turn", level: int = 3) -> DataFrame:
    """thread, segment, n, first, last, sha256, payload: each segment as zstandard-compressed JSON lines. A segment is bounded by its plan."""
    others = [c for c in planned.columns if c not in ("segment",)]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        raw = "".join(json.dumps({c: (v.item() if hasattr(v, "item") else v) for c, v in zip(others, row)}, ensure_ascii=False, sort_keys=True) + "\n" for row in pdf[others].itertuples(index=False)).encode()
        return pd.DataFrame([{thread: pdf[thread].iloc[0], "segment": pdf["segment"].iloc[0], "n": len(pdf), "first": pdf[order].iloc[0], "last": pdf[order].iloc[-1], "sha256": hashlib.sha256(raw).hexdigest(), "payload": zstandard.compress(raw, level)}])

    kinds = {f.name: f.dataType.simpleString() for f in planned.schema}
    return planned.groupBy(thread, "segment").applyInPandas(pack, f"{thread} {kinds[thread]}, segment long, n long, first {kinds[order]}, last {kinds[order]}, sha256 string, payload binary")


def decode_segment(payload: bytes, sha256: str | None = None) -> list[dict]:
    raw = zstandard.decompress(payload, 1 << 31)
    if sha256 and hashlib.sha256(raw).hexdigest() != sha256:
        raise ValueError("the segment's checksum differs")
    return [json.loads(line) for line in raw.decode().splitlines()]
