"""Incremental removal of repeated word windows with a log-structured fingerprint index.

Method. The index holds sorted, immutable runs. An entry is the fingerprint of a winnowed window anchor (see repeats): the
hash of its core as key, the hash of its context, and the earliest place that has them. A new batch becomes a run: its
entries are dealt by key, sorted, and every place after the first of a (key, context) is known to be repeated. The run
is merge-joined with each older run, bucket by bucket and without a shuffle, as all runs are bucketed and sorted alike:
entries with key and context in an older run are repeated too; where only the key is shared, the windows of both sides
are fetched from their texts and verified one by one. Two runs of one size are compacted into the next larger one by a
merge join that keeps the earliest place. Key and context are 128 bits of hash, key and window hash likewise; words
themselves aren't compared beyond that. Runs are read as they were sorted, so the merge joins sort nothing again.

An index with a folder of its own lasts: save() writes its list of runs beside them, open() reads it in another session, and
clean_batch() takes the next batch of documents against it.

A key that very many rows share is met once for each slice of text before it is dealt; the other places that the slice
has are known to be repeated already and are dealt evenly.

Rows. Null counts as a text without words. Rows that repeat an id and a text stand at the same place, so neither makes
the other's windows repeated, and each gets a row; rows that share an id with other text, or have no id (these come
first), are told apart and ordered by a hash of the text. Columns that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import repeats
from .common import MOST_TASKS, Scratch, find_words, input_bytes, mix, slices, whole_rows

#: Words of a window; places of which the least is an anchor, and words hashed at each.
WINDOW, WIDTH, GRAM = 20, 15, 6
#: Batches that the whole-table query feeds to the index, in order of ids.
BATCHES = 4
#: MB of input for each bucket of a run.
BUCKET_MB = 16
_COLUMNS = ["key", "ctx", "id", "salt", "start", "n", "kind"]
_SCHEMA = "key long, ctx long, id long, salt long, start long, n long, kind int"
FIRST, LATER = 0, 1


def _marked(t: pa.RecordBatch, held: tuple | None = None) -> tuple[pa.RecordBatch, tuple | None]:
    """Sorted rows with kind FIRST for the first place of a (key, context), LATER for others; copies of a place go.

    held: key, context and place of the last first row before these.
    """
    key, ctx = t.column(0).to_numpy(), t.column(1).to_numpy()
    n = len(key)
    if not n:
        return t, held
    places = [pc.fill_null(t.column(i), -(1 << 63)).to_numpy() for i in (2, 3, 4)]
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]) | (ctx[1:] != ctx[:-1])
    if held:
        new[0] = (key[0], ctx[0]) != held[:2]
    lead = np.maximum.accumulate(np.where(new, np.arange(n), -1))
    same = np.ones(n, bool)
    for i, p in enumerate(places):
        same &= p == np.where(lead >= 0, p[lead], held[2 + i] if held else 0)
    kind = np.where(new, FIRST, LATER)
    keep = new | ~same
    k = lead[-1]
    held = (key[k], ctx[k], *(p[k] for p in places)) if k >= 0 else held
    out = pa.RecordBatch.from_arrays([*t.columns[:6], pa.array(kind.astype(np.int32))], _COLUMNS)
    return out.filter(pa.array(keep)), held


def _first_of_slice(found: pa.RecordBatch) -> pa.RecordBatch:
    """Of one slice's anchors, a (key, context) goes under its key once; its other places go under keys of their own."""
    t = found.select(["b0", "ctx", "id", "salt", "start", "n"])
    order = np.lexsort([*(pc.fill_null(t.column(i), -(1 << 63)).to_numpy() for i in (4, 3, 2)), t.column(1).to_numpy(), t.column(0).to_numpy()])
    out, _ = _marked(t.take(pa.array(order)))
    later = out.column(6).to_numpy() == LATER
    key, own = out.column(0).to_numpy().copy(), out.column(4).to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ out.column(1).to_numpy().view(np.uint64)
    key[later] = mix(own[later] + np.arange(later.sum(), dtype=np.uint64)).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(key), *out.columns[1:]], _COLUMNS)


def _sorted_marks(batches):
    held = None
    for batch in batches:
        apart = batch.column(6).to_numpy() == LATER  # known already
        if apart.any():
            yield batch.filter(pa.array(apart))
            batch = batch.filter(pa.array(~apart))
        if batch.num_rows:
            out, held = _marked(batch, held)
            yield out


@contextmanager
def _bucket_joins(spark: SparkSession):
    """Joins on (key, context) may use that both sides are bucketed by key, and sorted: each bucket is one sorted file."""
    wanted = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


class FingerprintIndex:
    """Runs of earlier batches. add() takes a batch's anchors and tells what is repeated and what must be verified."""

    def __init__(self, spark: SparkSession, scratch: Scratch, buckets: int, folder: str | None = None):
        self.spark, self.scratch, self.buckets, self.folder = spark, scratch, buckets, folder
        self.files = -(-buckets // 4)  # what joins find is small beside the runs: four buckets share a file
        self.name, self.made = f"sedge_run_{uuid.uuid4().hex[:12]}", 0
        self.runs: list[tuple[str, int]] = []  # table, batches in it
        self.spans: list[DataFrame] = []
        self.edges: list[DataFrame] = []

    def save(self) -> None:
        """Write the list of runs into the index's folder."""
        said = json.dumps({"buckets": self.buckets, "name": self.name, "made": self.made, "runs": self.runs})
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/runs")

    @classmethod
    def open(cls, spark: SparkSession, scratch: Scratch, folder: str) -> "FingerprintIndex":
        """The index that save() has left in a folder, in any session."""
        said = json.loads(spark.read.text(f"{folder}/runs").first().value)
        index = cls(spark, scratch, said["buckets"], folder)
        index.name, index.made, index.runs = said["name"], said["made"], [tuple(r) for r in said["runs"]]
        for name, _ in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_SCHEMA}) USING parquet CLUSTERED BY (key) SORTED BY (key, ctx) INTO {index.buckets} BUCKETS LOCATION '{folder}/{name}'")
        return index

    def _write(self, df: DataFrame) -> str:
        name = f"{self.name}_{self.made}"
        self.made += 1
        df.write.bucketBy(self.buckets, "key").sortBy("key", "ctx").option("compression", "zstd").option("path", f"{self.folder or self.scratch.root}/{name}").saveAsTable(name)
        return name

    def _firsts(self, name: str) -> DataFrame:
        return self.spark.table(name).where(F.col("kind") == FIRST)

    def _edges(self, found: DataFrame) -> None:
        self.edges.append(self.scratch.table(found.select("key", "id", "salt", "start", "n"), f"edges-{len(self.edges)}", self.files))

    def add(self, anchors: DataFrame) -> None:
        order = ["key", "ctx", "id", "salt", "start"]
        run = anchors.repartition(self.buckets, "key").sortWithinPartitions(*order).mapInArrow(_sorted_marks, _SCHEMA)
        place = ["id", "salt", "start", "n"]
        with _bucket_joins(self.spark):
            name = self._write(run)
            new = self._firsts(name)
            self.spans.append(self.scratch.table(self.spark.table(name).where(F.col("kind") == LATER).select(*place), f"later-{name}", self.files))
            often = new.groupBy("key").count().where("count > 1").select("key")
            self._edges(new.join(often.hint("merge"), "key", "left_semi"))
            for old, _ in self.runs:  # each join is a job of its own, so that one pair of sorted runs is in memory at a time
                was = self._firsts(old)
                self.spans.append(self.scratch.table(new.join(was.select("key", "ctx").hint("merge"), ["key", "ctx"], "left_semi").select(*place), f"met-{name}-{old}", self.files))
                self._edges(new.join(was.select("key").hint("merge"), "key", "left_semi"))
                self._edges(was.join(new.select("key").hint("merge"), "key", "left_semi"))
            self.runs.append((name, 1))
            while len(self.runs) > 1 and self.runs[-1][1] >= self.runs[-2][1]:
                self._compact()

    def _compact(self) -> None:
        (a, m), (b, n) = self.runs[-2:]
        x, y = (self._firsts(t).select("key", "ctx", F.struct("id", "salt", "start", "n").alias(side)) for t, side in ((a, "x"), (b, "y")))
        both = x.join(y.hint("merge"), ["key", "ctx"], "full_outer").select("key", "ctx", F.least("x", "y").alias("at"))
        name = self._write(both.select("key", "ctx", "at.*", F.lit(FIRST).alias("kind")))
        for old in (a, b):
            self._drop(old)
        self.runs[-2:] = [(name, m + n)]

    def _drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        if self.folder:
            self.scratch.drop_path(f"{self.folder}/{name}")
        else:
            self.scratch.drop(name)

    def close(self) -> None:
        """Forget the runs; their files go, unless the index has a folder of its own."""
        for name, _ in self.runs:
            if self.folder:
                self.spark.sql(f"DROP TABLE {name}")
            else:
                self._drop(name)
        self.runs = []


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def buckets_for(docs: DataFrame) -> int:
    """Buckets of a run: by the input alone, as every one is a file of each run."""
    size = input_bytes(docs)
    return 8 if size >= 1 << 60 else int(max(6, min(MOST_TASKS, size / (BUCKET_MB * 1e6))))


def clean_batch(index: FingerprintIndex, docs: DataFrame, history: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, n_removed, kept of a new batch, whose ids come after those of all batches before; the index has it then.

    history: the documents of the batches before (id_col, text_col); only those are read again whose windows must be compared.
    """
    scratch = index.scratch = Scratch(docs.sparkSession, "substring")
    rows = repeats.keyed(docs, scratch, id_col, text_col)
    old = repeats.keyed(history.select(id_col, text_col), Scratch(docs.sparkSession, "substring-old"), id_col, text_col)
    width = min(WIDTH, window - GRAM + 1)
    index.spans, index.edges = [], []
    index.add(repeats.windows(rows, "word", window, width, window - width + 1, (), _first_of_slice, _SCHEMA))
    texts = rows.select("id", "salt", "text").union(old.select("id", "salt", "text"))
    verified = repeats.repeated_windows(repeats.window_hashes(texts, _union(index.edges).distinct(), "word", window), scratch, later_only=True)
    spans = scratch.table(_union(index.spans).union(verified), "spans")
    return cut_words(repeats.with_spans(rows, spans, window)).withColumnRenamed("id", id_col)


def repeated_spans(rows: DataFrame, scratch: Scratch, buckets: int, window: int = WINDOW, batches: int = BATCHES) -> DataFrame:
    """id, salt, start, n: runs of word windows that also start earlier. rows: id, salt, text of repeats.keyed()."""
    spark = rows.sparkSession
    index = FingerprintIndex(spark, scratch, buckets)
    cuts = rows.agg(F.percentile_approx("id", [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    cuts = sorted(set(cuts or []))
    width = min(WIDTH, window - GRAM + 1)
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = rows
        if low is not None:
            part = part.where(F.col("id") > low)
        if high is not None:
            part = part.where((F.col("id") <= high) | F.col("id").isNull() if low is None else F.col("id") <= high)
        found = repeats.windows(part, "word", window, width, window - width + 1, (), _first_of_slice, _SCHEMA)
        index.add(found)
    spans, edges = _union(index.spans), _union(index.edges).distinct()
    verified = repeats.repeated_windows(repeats.window_hashes(rows, edges, "word", window), scratch, later_only=True)
    out = scratch.table(spans.union(verified), "spans")
    index.close()
    return out


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """id_col, n_words, n_removed, kept (the words that are left, joined by one space)."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = repeats.keyed(docs, scratch, id_col, text_col)
    spans = repeated_spans(rows, scratch, buckets_for(docs), window, batches)
    return cut_words(repeats.with_spans(rows, spans, window)).withColumnRenamed("id", id_col)


def cut_words(marked: DataFrame, as_they_are: bool = False) -> DataFrame:
    """id, n_words, n_removed, kept, and the columns after the first three, of rows with id, text and spans of words.

    as_they_are: a text without removed words is kept with its own white space.
    """

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            starts, ends, counts = find_words(raw, bounds)
            at = np.append(0, np.cumsum(counts))
            gone = repeats.covered(part, at)
            removed = np.append(0, np.cumsum(gone))
            kept = []
            for a, b, s, e in zip(at, at[1:], bounds, bounds[1:]):
                if removed[a] == removed[b] and as_they_are:
                    kept.append(raw[s:e].tobytes())
                elif removed[a] == removed[b]:
                    kept.append(b" ".join(raw[starts[a] : ends[b - 1]].tobytes().split()) if b > a else b"")
                else:
                    left = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join(raw[i:j].tobytes() for i, j in zip(starts[left], ends[left])))
            out = [part.column(0), pa.array(counts), pa.array(np.diff(removed[at])), pa.array(kept, pa.binary()).cast(pa.string()), *part.columns[3:]]
            yield pa.RecordBatch.from_arrays(out, names)

    names = ["id", "n_words", "n_removed", "kept", *marked.columns[3:]]
    schema = T.StructType.fromDDL("id long, n_words long, n_removed long, kept string")
    for c in marked.columns[3:]:
        schema = schema.add(marked.schema[c])
    return marked.mapInArrow(run, schema)


def cleaned(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """docs, all their columns, without the repeated words; a row with none stays as it is, one with no other words goes."""
    scratch = Scratch(docs.sparkSession, "substring")
    rows = repeats.keyed(docs, scratch, id_col, text_col)
    spans = repeated_spans(rows, scratch, buckets_for(docs), window, batches)
    cut = cut_words(repeats.with_spans(rows, spans, window, ("rest",)), as_they_are=True)
    left = cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return whole_rows(left, docs.columns, text_col, F.col("kept"))
