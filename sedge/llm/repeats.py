"""What the two operators on repeated passages share: winnowed windows of documents, exact windows, removal of spans.

A window is `window` consecutive symbols (bytes or words) of one document. Each window has an anchor, a place inside it
that its own content decides (winnowing), so equal windows have their anchors at the same place. An anchor stands for a
run of neighbouring windows, and all of them hold the `window - width + 1` symbols from the anchor on, its core. So windows
can only be equal where cores are; an anchor's context is the text that all its windows cover together.

Documents are known by (id, salt). Salt is 0 for an id that one row has; rows that share an id, or have none, are told
apart by a hash of their text, so that places of rows with equal id and text are equal. A null id comes before all others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, anchors, find_words, rest_of, slices

_U = np.uint64
_NONE = -(1 << 63)
ROW = "id long, salt long, start long, n long"
#: Rows of a group of equal cores that one task compares in memory; larger ones are dealt by window.
GROUP = 4096


def keyed(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, salt, text of each row of docs, and the rest of it (which a plan that doesn't use it doesn't read)."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), rest_of(docs, text_col).alias("rest"))
    often = scratch.table(rows.groupBy("id").count().where("count > 1 or id is null").select(F.col("id").alias("same")), "often")
    joined = rows.join(often.withColumn("hit", F.lit(True)), F.col("id").eqNullSafe(F.col("same")), "left")
    return joined.select("id", F.when(F.col("hit"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("salt"), "text", "rest")


def told_apart(scratch: Scratch) -> bool:
    """Whether keyed() has found no id that several rows have, and none without one."""
    return scratch.spark.read.schema("same long").parquet(f"{scratch.root}/often").isEmpty()


def symbols(raw: np.ndarray, bounds: np.ndarray, unit: str, seed: int) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """A slice's symbols, each row's bounds in them, and for words where they start and end in the bytes."""
    if unit == "byte":
        return raw, bounds, None
    starts, ends, counts = find_words(raw, bounds)
    return Rolling(raw, seed).spans(starts, ends), np.append(0, np.cumsum(counts)), (starts, ends)


def _repeat(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def windows(docs: DataFrame, unit: str, window: int, width: int, gram: int, blocks: tuple[int, ...], after=None, schema: str | None = None) -> DataFrame:
    """id, salt, start, n, ctx, and b0, b1, ..: an anchor's first window and number of windows, and hashes.

    ctx is of the whole context, b0 to bk are of the core cut at `blocks`, counted from the anchor. `after` may turn
    the batch of each slice into another, of the given schema.
    """
    if window < width + gram - 1:
        raise ValueError("an anchor must lie inside its window")
    core = window - width + 1
    cuts = (0, *blocks, core)

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            found, at, _ = symbols(raw, bounds, unit, 11)
            roll = Rolling(found, 12)
            hashes, rows, places, firsts, counts = roll.windows(gram), [], [], [], []
            for k in np.flatnonzero(np.diff(at) >= window):
                runs = int(at[k + 1] - at[k]) - window + 1
                a, f = anchors(hashes[at[k] : at[k] + runs + width - 1], width)
                rows.append(np.full(len(a), k))
                places.append(a + at[k])
                firsts.append(f)
                counts.append(np.diff(f, append=runs))
            if not rows:
                continue
            rows, places, firsts, counts = (np.concatenate(x) for x in (rows, places, firsts, counts))
            begin = at[rows] + firsts
            out = [_repeat(part.column(0), rows), _repeat(part.column(1), rows), pa.array(firsts), pa.array(counts), pa.array(roll.spans(begin, begin + counts - 1 + window).view(np.int64))]
            out += [pa.array(roll.spans(places + a, places + b).view(np.int64)) for a, b in zip(cuts, cuts[1:])]
            found = pa.RecordBatch.from_arrays(out, names)
            yield after(found) if after else found

    names = ["id", "salt", "start", "n", "ctx", *(f"b{i}" for i in range(len(cuts) - 1))]
    return docs.select("id", "salt", "text").mapInArrow(run, schema or ROW + ", " + ", ".join(f"{x} long" for x in names[4:]))


def same(left: str, right: str) -> Column:
    return F.col(f"{left}.id").eqNullSafe(F.col(f"{right}.id")) & (F.col(f"{left}.salt") == F.col(f"{right}.salt"))


def window_hashes(docs: DataFrame, edges: DataFrame, unit: str, window: int) -> DataFrame:
    """For edges (key, id, salt, start, n): key, id, salt, start and the hashes of the n windows, from the texts."""
    picks = edges.groupBy("id", "salt").agg(F.collect_list(F.struct("key", "start", "n")).alias("picks"))  # no longer than the document
    rows = docs.alias("d").join(picks.alias("p"), same("d", "p")).select("d.id", "d.salt", "text", "picks")

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            found, at, _ = symbols(raw, bounds, unit, 21)
            roll = Rolling(found, 22)
            lists = part.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            key, start, n = flat.field(0), flat.field(1).to_numpy(), flat.field(2).to_numpy()
            row = np.repeat(np.arange(part.num_rows), sizes)
            begin = np.repeat(at[row] + start, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hashes = roll.spans(begin, begin + window).view(np.int64)
            yield pa.RecordBatch.from_arrays([key, _repeat(part.column(0), row), _repeat(part.column(1), row), pa.array(start), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(hashes))], ["key", "id", "salt", "start", "hashes"])

    return rows.mapInArrow(run, "key long, id long, salt long, start long, hashes array<long>")


def _runs(key: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of neighbouring places that share a key."""
    new = np.flatnonzero((np.diff(places, prepend=-2) != 1) | (np.diff(key, prepend=-1) != 0))
    return new, np.diff(new, append=len(places))


def repeated_windows(hashed: DataFrame, scratch: Scratch, later_only: bool) -> DataFrame:
    """id, salt, start, n of runs of windows that occur elsewhere too, or with later_only, earlier too.

    Groups of equal cores are compared inside a task. A group of more than GROUP rows is dealt by window instead: counts
    (or least places) are aggregated and joined back, so no task holds it.
    """
    hashed = scratch.table(hashed, "hashed")
    sizes = hashed.groupBy("key").count()
    large = scratch.table(sizes.where(F.col("count") > GROUP).select("key"), "large")

    def run(batches):
        held = None

        def solve(t: pa.Table):
            t = t.combine_chunks()
            if later_only and t.num_rows > 1:  # a document's copies under its own id stand at one place
                first = np.ones(t.num_rows, bool)
                first[1:] = np.any([pc.fill_null(pc.not_equal(pc.fill_null(t.column(c)[1:], _NONE), pc.fill_null(t.column(c)[:-1], _NONE)), False).to_numpy() for c in ("key", "id", "salt", "start")], axis=0)
                t = t.filter(pa.array(first)).combine_chunks()
            lists = t.column("hashes").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(t.num_rows), sizes)
            step = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            key, value, place = t.column("key").to_numpy()[row], lists.flatten().to_numpy(), t.column("start").to_numpy()[row] + step
            order = np.lexsort((place, row, value, key))  # rows are in order of (key, id, salt, start)
            k, v = key[order], value[order]
            again = (np.diff(k, prepend=k[0] - 1) == 0) & (np.diff(v, prepend=v[0] - 1) == 0)
            hit = again if later_only else again | np.append(again[1:], False)
            hit = np.sort(order[hit])
            if not len(hit):
                return
            new, n = _runs(row[hit], place[hit])
            rows = row[hit][new]
            yield pa.RecordBatch.from_arrays([_repeat(t.column("id").combine_chunks(), rows), _repeat(t.column("salt").combine_chunks(), rows), pa.array(place[hit][new]), pa.array(n.astype(np.int64))], ["id", "salt", "start", "n"])

        for batch in batches:
            t = pa.table(batch)
            t = pa.concat_tables([held, t]) if held else t
            key = t.column("key").to_numpy()
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield from solve(t.slice(0, last))
            held = t.slice(last)
        if held and held.num_rows:
            yield from solve(held)

    n = int(hashed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = hashed.join(large, "key", "left_anti").repartition(n, "key").sortWithinPartitions("key", "id", "salt", "start")
    out = small.mapInArrow(run, ROW)
    if large.isEmpty():
        return out
    flat = hashed.join(large, "key").select("key", "id", "salt", "start", F.posexplode("hashes").alias("step", "value"))
    flat = flat.select("key", "value", "id", "salt", (F.col("start") + F.col("step")).alias("start"))
    place = F.struct("id", "salt", "start")
    facts = flat.groupBy("key", "value").agg(F.count("*").alias("many"), F.min(place).alias("first")).where("many > 1")
    hit = flat.join(facts, ["key", "value"])
    if later_only:
        hit = hit.where(place != F.col("first"))
    return out.union(hit.select("id", "salt", "start", F.lit(1).cast("long").alias("n")))


def with_spans(docs: DataFrame, spans: DataFrame, window: int, more: tuple[str, ...] = ()) -> DataFrame:
    """id, text, spans and the columns more: docs with the (start, end) of the symbols that runs of windows (id, salt, start, n) cover."""
    by = spans.groupBy("id", "salt").agg(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("n") - 1 + window).alias("end"))).alias("spans"))
    return docs.alias("d").join(by.alias("s"), same("d", "s"), "left").select(F.col("d.id").alias("id"), "text", "spans", *more)


def covered(part: pa.RecordBatch, at: np.ndarray) -> np.ndarray:
    """Whether each symbol of a slice is inside a span of its row; spans is column 2."""
    depth = np.zeros(int(at[-1]) + 1, np.int64)
    lists = part.column(2)
    sizes = np.diff(lists.offsets.to_numpy())
    sizes[lists.is_null().to_numpy(zero_copy_only=False)] = 0
    flat = lists.flatten()
    base = np.repeat(at[:-1], sizes)
    np.add.at(depth, base + flat.field(0).to_numpy(zero_copy_only=False), 1)
    np.add.at(depth, base + flat.field(1).to_numpy(zero_copy_only=False), -1)
    return np.cumsum(depth[:-1]) > 0
