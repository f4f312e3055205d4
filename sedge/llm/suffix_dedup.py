"""Suffix-array removal of repeated byte strings, by distributed prefix doubling over a sparse set of positions.

Method. Of all byte positions only anchors are sorted: winnowing picks, in each run of WIDTH neighbouring grams, the one of
least hash, so equal texts have equal anchors. The anchor after an anchor is the least one of the run that begins just behind it, so
the way on is decided by what follows alone. An anchor's first name is that of the bytes up to the next one. Spark sorts
(name, position) by range; an anchor's place among the distinct names is its rank, and an anchor whose name stands
alone is unique and leaves. Then offsets double: with ranks that tell texts of h steps apart, an anchor's rank is paired
with that of the anchor h steps on (a join on document and position, which also brings the position 2h steps on), the pairs are sorted
by range, and their places are the ranks for 2h, until no anchor that is left reaches that far.

An anchor stands for the windows (strings of `window` bytes) in whose first WIDTH grams it is least; they all hold its core,
the `window - WIDTH + 1` bytes from it. Its reach is the number of steps that the core alone decides, so that equal
cores have equal reach. Once the offset is past half the reach, the ranks of the anchor and of the one h steps before
the reach's end, which overlap, name all the bytes to that end; with the name of the core's remaining bytes they name the
core. Anchors whose core has one name have equal cores, which is past the threshold for all but the bytes around.

Those are told by the anchor's context, all the bytes that its windows cover: (core, context) is sorted a last time, and where it is
shared all windows are repeated. Where a core has several contexts, one anchor of each is compared window by window
(repeats.repeated_windows). Pairs at the ends of that sort's ranges, which may go on in the next one, are compared in
that way too, so that equal pairs may be dealt to many tasks and none has to know its neighbours.

Names are 64-bit hashes of content, and so is a core's key in the last sort; a wrong match needs a collision of both the core's and the context's, 128 bits.

Rows. Null counts as empty. Every row is a document: rows that repeat an id and a text are copies of each other like any
two rows with that text; rows that share an id with other text, or have no id, are told apart. Ties of the least hash go to
the first gram. A very long text is a slice of its own, in NumPy arrays of some ten times its length. Columns that the
input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import repeats
from .common import Rolling, Scratch, anchors, parts_for, slices

#: Winnowing: grams of which the least is an anchor, and bytes hashed at each.
WIDTH, GRAM = 128, 24
#: MB of input for each task of a sort.
TASK_MB = 16
#: Ends of ranges (four numbers each) that are broadcast at most.
FIXES = 100_000
#: Rows of one rank that a task holds at most.
PART = 1 << 18
_RANK = 40  # bits of a rank that number the pairs of one task
_TIE = ["id", "salt", "start"]
#: What a position doesn't change on its way is packed into one number (the way back from its place, n, reach, the way ahead to mid), as each column costs in each exchange.
_BACK, _AHEAD = 8, 23  # bits of the first two and of the last two
_UNPACKED = {
    "start": f"place - (pack & {(1 << _BACK) - 1})",
    "n": f"shiftright(pack, {_BACK}) & {(1 << _BACK) - 1}",
    "reach": f"shiftright(pack, {2 * _BACK}) & {(1 << _AHEAD) - 1}",
    "mid": f"place + shiftright(pack, {2 * _BACK + _AHEAD})",
}


def steps(place: np.ndarray, first: np.ndarray, last_run: np.ndarray, decided: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor of a slice: the next one, reach, the anchor 2**k steps before the reach's end (2**k at most the reach), that at the end.

    first: the first run of each anchor; last_run: that of its text; a step is decided by the core if it starts fewer than
    `decided` bytes behind it. The last anchors of a text, behind which no run begins, have no step (-1) and no reach.
    """
    m = len(place)
    after = np.where(place < last_run, np.searchsorted(first, place + 1, "right") - 1, -1)
    reach, end = np.zeros(m, np.int64), np.arange(m)
    go = end
    while (go := go[(after[end[go]] >= 0) & (place[end[go]] < place[go] + decided)]).size:
        end[go] = after[end[go]]
        reach[go] += 1
    left = reach - (1 << np.floor(np.log2(np.maximum(reach, 1))).astype(np.int64))
    mid, go = np.arange(m), np.flatnonzero(left > 0)
    while go.size:
        mid[go] = after[mid[go]]
        left[go] -= 1
        go = go[left[go] > 0]
    return after, reach, mid, end


def positions(docs: DataFrame, window: int) -> DataFrame:
    """Anchors of each text: place; start and n of their windows (n is 0 past the last window); reach; the places of the next anchor (on) and
    of the one that ends with the reach (mid); name of the bytes up to the next anchor, tail (name of the core's bytes after
    the reach), ctx (name of all that the windows cover)."""
    core = window - WIDTH + 1
    decided = core - GRAM - WIDTH + 1  # a step from so far behind the core's begin uses a run that ends inside it
    if decided < 1:
        raise ValueError("a core must hold two runs of grams")
    if WIDTH >= 1 << _BACK or window + WIDTH >= 1 << _AHEAD:
        raise ValueError(f"a run has fewer than {1 << _BACK} grams, a window fewer than {(1 << _AHEAD) - WIDTH} bytes")

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            roll = Rolling(raw, 12)
            hashes = roll.windows(GRAM)
            long = np.flatnonzero(np.diff(bounds) >= window)
            found = [anchors(hashes[bounds[k] : bounds[k + 1] - GRAM + 1], WIDTH) for k in long]
            if found:
                rows = np.repeat(long, [len(place) for place, _ in found])
                low, size = bounds[rows], np.diff(bounds)[rows]
                place, first = (np.concatenate(x) + low for x in zip(*found))
                after, reach, mid, end = steps(place, first, low + size - GRAM - WIDTH + 1, decided)
                windows = low + size - window + 1
                until = np.append(np.where(rows[1:] == rows[:-1], first[1:], windows[:-1]), windows[-1:])
                owned = np.clip(np.minimum(until, windows) - first, 0, None)
                tail = np.maximum(np.minimum(place + core, low + size), place[end])
                far = np.minimum(first + np.maximum(owned, 1) - 1 + window, low + size)
                on, mid, last = place[after], place[mid], place[end]
                use = np.flatnonzero(after >= 0)  # past the last window an anchor only lends its ranks
                rows, place, first, owned, reach, on, mid, last, tail, far, low = (x[use] for x in (rows, place, first, owned, reach, on, mid, last, tail, far, low))
                name, tail, ctx = roll.spans(place, on), roll.spans(last, tail), roll.spans(first, far)
                place, first, on, mid = place - low, first - low, on - low, mid - low
                repeat = lambda i: part.column(i).take(pa.array(rows))
                pack = place - first | owned << _BACK | reach << 2 * _BACK | mid - place << 2 * _BACK + _AHEAD
                yield pa.RecordBatch.from_arrays([repeat(0), repeat(1), pa.array(place), pa.array(on), pa.array(pack), *(pa.array(x.view(np.int64)) for x in (name, tail, ctx))], ["id", "salt", "place", "on", "pack", "name", "tail", "ctx"])

    found = docs.select("id", "salt", "text").mapInArrow(run, "id long, salt long, place long, on long, pack long, name long, tail long, ctx long")
    return unpacked(found, *found.columns, *_UNPACKED)


def unpacked(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns of rows, and of what its pack holds."""
    return rows.selectExpr(*(f"{_UNPACKED[c]} AS {c}" if c in _UNPACKED else f"`{c}`" for c in columns))


def rerank(rows: DataFrame, pair: list[str], keep: list[str], scratch: Scratch, name: str, n: int) -> DataFrame:
    """rank and the columns of keep, of the rows whose pair others have too; ranks follow the order of pairs.

    rows are dealt by range of (pair, id, salt, place), so a pair that many rows have goes to several tasks, and sorted by pair.
    Each task numbers its distinct pairs; its first and last pair, which a neighbour may share, are told to the driver, two
    rows a task, and join back, by broadcast if they are no more than FIXES. With a broadcast the ranks aren't written
    again: they are read from the table `name`-pairs, which has to stay as long as they are used. It has pairs only of those two rows.
    """
    ordered = rows.select(*(F.col(c).alias(f"p{i}") for i, c in enumerate(pair)), *keep)
    pair = [f"p{i}" for i in range(len(pair))]
    ordered = ordered.repartitionByRange(n, *pair, *(c for c in ("id", "salt", "place") if c in keep)).sortWithinPartitions(*pair)

    def run(batches):
        base = TaskContext.get().partitionId() << _RANK
        held, before, local = None, False, -1  # the row held back; whether it equals the one before; its number
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch)
            t = pa.concat_tables([held, t]) if held is not None else t
            keys = [t.column(p).to_numpy() for p in pair]
            equal = np.ones(t.num_rows, bool)
            for k in keys:
                equal[1:] &= k[1:] == k[:-1]
            equal[0] = before
            start = local - (held is not None and not before)
            number = start + np.cumsum(~equal)
            both = equal.copy()
            both[:-1] |= equal[1:]
            out, edge = both | (number == 0), ~equal & (number == 0)
            yield from emit(t.slice(0, t.num_rows - 1), base + number[:-1], both[:-1], out[:-1], edge[:-1])
            held, before, local = t.slice(t.num_rows - 1), bool(equal[-1]), int(number[-1])
        if held is not None:
            yield from emit(held, np.array([base + local]), np.array([before]), np.array([True]), np.array([True]))

    def emit(t: pa.Table, number, both, out, edge):
        keys = [pa.array(t.column(p).to_numpy()[out], mask=~edge[out]) for p in pair]
        rest = t.select(keep).filter(pa.array(out))
        t = pa.table([*keys, *rest.columns, pa.array(number[out].astype(np.int64)), pa.array(~both[out]), pa.array(edge[out])], names=[*pair, *keep, "local", "alone", "edge"])
        yield from t.combine_chunks().to_batches()

    kinds = ", ".join(f"{c} {t}" for c, t in ordered.dtypes)
    found = scratch.table(ordered.mapInArrow(run, f"{kinds}, local long, alone boolean, edge boolean"), f"{name}-pairs")
    ends: dict[int, list[tuple]] = {}
    for r in sorted(tuple(r) for r in found.where("edge").select("local", *pair, "alone").collect()):
        ends.setdefault(r[0] >> _RANK, []).append(r)
    fixes, last = [], None  # where a task's first pair goes on from the task before, it has that one's rank
    for low, *high in ends.values():
        goes_on = last is not None and last[0] == low[1:-1]
        rank = last[1] if goes_on else low[0]
        fixes.append([low[0], rank, low[-1] and not goes_on])
        if goes_on and last[2] is not None:
            last[2][2] = False  # the row before was not alone
        if not high or high[0][0] == low[0]:
            last = [low[1:-1], rank, fixes[-1]]
        else:
            fixes.append([high[0][0], high[0][0], high[0][-1]])
            last = [high[0][1:-1], high[0][0], fixes[-1]]
    table = found.sparkSession.createDataFrame(fixes, "local long, fixed long, drop boolean")
    few = len(fixes) <= FIXES
    joined = found.join(F.broadcast(table) if few else table, "local", "left").where("not coalesce(drop, alone)")
    ranks = joined.select(F.coalesce("fixed", "local").alias("rank"), *keep)
    return ranks if few else scratch.table(ranks, f"{name}-ranks")


def paired(rows: DataFrame, ranks: DataFrame, there: Column) -> DataFrame:
    """rows with rank2 and on2, the rank and the way on of the anchor at the place `there`; rows whose partner is unique, and so has no rank, go.

    Rows that repeat a document have the same ranks, so one of them is enough to look up; without a salt no row repeats another.
    """
    salted = "salt" in ranks.columns
    here = ["id", "salt", "place"] if salted else ["id", "place"]
    known = ranks.select(*here, F.col("rank").alias("rank2"), F.col("on").alias("on2"))
    known = known.groupBy(*here).agg(F.first("rank2").alias("rank2"), F.first("on2").alias("on2")) if salted else known
    a, b = rows.withColumn("there", there).alias("a"), known.alias("b")
    document = repeats.same("a", "b") if salted else F.col("a.id") == F.col("b.id")
    return a.join(b, document & (F.col("a.there") == F.col("b.place"))).select("a.*", "b.rank2", "b.on2").drop("there")


def named_cores(docs: DataFrame, window: int, scratch: Scratch, n: int, once: bool = False) -> DataFrame:
    """key (of the core's name), id, salt, place, pack, ctx of the anchors whose core others may have too."""
    carried = ["id", *([] if once else ["salt"]), "place", "on", "pack", "tail", "ctx"]
    found = scratch.table(positions(docs, window).select("name", *carried), "positions")
    ranks = rerank(found, ["name"], carried, scratch, "h1", n)
    scratch.drop("positions")
    h, ready = 1, []
    while True:
        # An anchor that reaches h steps but not 2h is named by two overlapping ranks; the others go on. One join looks both up.
        far = F.expr(f"{_UNPACKED['reach']} >= {2 * h}")
        asked = ranks.where(far | F.expr(f"{_UNPACKED['n']} > 0 and {_UNPACKED['reach']} >= {h}"))
        step = paired(asked, ranks, F.when(far, F.col("on")).otherwise(F.expr(_UNPACKED["mid"])))
        key = F.when(~far, F.xxhash64(F.lit(h), "rank", "rank2", "tail")).alias("key")
        on = [F.when(far, F.col(c)) for c in ("rank", "rank2", "tail", "on2")]  # of no use to the others
        step = step.select(key, *(c for c in carried if c not in ("on", "tail")), *(x.alias(c) for x, c in zip(on, ("rank", "rank2", "tail", "on"))))
        step = scratch.table(step, f"step{h}")
        ready.append(step.where("key is not null").select("key", "id", (F.lit(0).cast("long") if once else F.col("salt")).alias("salt"), "place", "pack", "ctx"))
        on = step.where("key is null")
        scratch.drop(f"h{h}-pairs", f"h{h}-ranks")
        if on.isEmpty():
            break
        ranks = rerank(on, ["rank", "rank2"], carried, scratch, f"h{2 * h}", n)
        h *= 2
    whole = ready[0]
    for part in ready[1:]:
        whole = whole.union(part)
    return whole


def equal_cores(docs: DataFrame, window: int, scratch: Scratch, n: int, once: bool = False) -> DataFrame:
    """rank, id, salt, start, n, ctx of the anchors whose core others have too; equal ranks are equal cores."""
    ranks = rerank(named_cores(docs, window, scratch, n, once), ["key"], ["id", "salt", "place", "pack", "ctx"], scratch, "cores", n)
    return unpacked(ranks, "rank", *_TIE, "n", "ctx")


def contexts(cores: DataFrame, n: int) -> DataFrame:
    """id, salt, start, n, key, whole: anchors whose context is shared (whole), and one of each context to compare (key is its core's).

    cores: of named_cores(). One sort by (key, context) tells equal cores and equal contexts together; a key is the hash of a
    core's name, called rank here. A range's first and last one may go on in the next: one anchor of each of their contexts is to be compared.
    """
    ordered = unpacked(cores.withColumnRenamed("key", "rank"), "rank", "ctx", *_TIE, "n").repartitionByRange(n, "rank", "ctx", *_TIE).sortWithinPartitions("rank", "ctx")

    def run(batches):
        held, opening, parted = None, None, None  # rows of the last rank so far; the first rank of the task; the last one met in parts

        def solve(t: pa.Table, ends: bool):
            """Whole ranks, or with ends, the last of the task."""
            rank, ctx = t.column("rank").to_numpy(), t.column("ctx").to_numpy()
            new_rank = np.append(True, rank[1:] != rank[:-1])
            new = new_rank | np.append(True, ctx[1:] != ctx[:-1])
            shared = ~new
            shared[:-1] |= ~new[1:]
            many = np.add.reduceat(new, np.flatnonzero(new_rank)) > 1
            at_end = (rank == opening) | (rank == parted)
            at_end |= ends
            compared = new & (many[np.cumsum(new_rank) - 1] | at_end)
            for mark, rows in ((True, shared), (False, compared)):
                if rows.any():
                    out = t.filter(pa.array(rows)).combine_chunks()
                    yield pa.RecordBatch.from_arrays([*(out.column(c).combine_chunks() for c in ("id", "salt", "start", "n", "rank")), pa.array(np.full(out.num_rows, mark))], ["id", "salt", "start", "n", "key", "whole"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.table(batch)
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            rank = t.column("rank").to_numpy()
            opening = rank[0] if opening is None else opening
            if len(rank) > PART and rank[0] == rank[-1]:  # a rank without end: its contexts are met one part after the other
                ctx = t.column("ctx").to_numpy()
                last = int(np.flatnonzero(np.append(True, ctx[1:] != ctx[:-1]))[-1])
                last = last or len(ctx) - 1
                yield from solve(t.slice(0, last), True)
                held, parted = t.slice(last), rank[0]
                continue
            last = int(np.searchsorted(rank, rank[-1]))
            if last:
                yield from solve(t.slice(0, last), False)
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from solve(held, True)

    return ordered.mapInArrow(run, "id long, salt long, start long, n long, key long, whole boolean")


def repeated_spans(docs: DataFrame, window: int, scratch: Scratch, n: int, once: bool = False) -> DataFrame:
    """id, salt, start, n: runs of windows that also start elsewhere. docs: id, salt, text of repeats.keyed(); n: tasks of a sort; once: no row repeats another."""
    told = scratch.table(contexts(named_cores(docs, window, scratch, n, once), n), "contexts")
    place = ["id", "salt", "start", "n"]
    parts = repeats.repeated_windows(repeats.window_hashes(docs, told.where("not whole").select("key", *place), "byte", window), scratch, later_only=False)
    return told.where("whole").select(*place).union(parts)


def remove_repeats(docs: DataFrame, window: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_removed, n_spans, kept (binary: the bytes that are left)."""
    scratch = Scratch(docs.sparkSession, "suffix")
    rows = repeats.keyed(docs, scratch, id_col, text_col)
    spans = scratch.table(repeated_spans(rows, window, scratch, parts_for(docs, TASK_MB), repeats.told_apart(scratch)), "spans")

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            gone = repeats.covered(part, bounds)
            kept = [raw[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])]
            edge = gone.copy()
            edge[1:] &= ~gone[:-1]
            inner = bounds[:-1][bounds[:-1] < bounds[1:]]
            edge[inner] = gone[inner]
            spans_, removed = np.append(0, np.cumsum(edge)), np.append(0, np.cumsum(gone))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(bounds)), pa.array(np.diff(removed[bounds])), pa.array(np.diff(spans_[bounds])), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    cut = repeats.with_spans(rows, spans, window).mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return cut.withColumnRenamed("id", id_col)
