"""Shared pieces of the training-data operators: shared-folder tables, byte-level word splitting, rolling hashes.

Everything that works on text here works on the UTF-8 bytes of an Arrow batch, a bounded slice at a time, so a task's
memory follows the slice (or one document, if that is longer) and never the partition.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space bytes that separate words: \x20 and \x09-\x0D.
SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes of text that one vectorised step looks at.
SLICE = 1 << 20

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one machine (tests) gets a temporary one and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="sedge-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder that cut lineage; what a result still reads goes when the session ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def table(self, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
        """Write df and read it back with its own schema (so that an empty one reads too), in so many files at most."""
        df = df if files is None else df.coalesce(max(1, files))
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def settle(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when their objects are collected."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        for name in names:
            self.drop_path(f"{self.root}/{name}")

    def drop_path(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def rest_of(docs: DataFrame, text_col: str) -> Column:
    """A struct of all columns but the text, and whether that is null: a row's text then travels once."""
    return F.struct(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text_col), F.col(text_col).isNull().alias("no_text"))


def whole_rows(df: DataFrame, columns: list[str], text_col: str, text: Column) -> DataFrame:
    """The columns again, from `rest` and a text that is null again where it was."""
    back = F.when(~F.col("rest.no_text"), text)
    return df.select(*(back.alias(c) if c == text_col else F.col(f"rest.c{i}").alias(c) for i, c in enumerate(columns)))


def input_bytes(df: DataFrame) -> int:
    """Spark's own estimate of the bytes that a scan of df reads; only used to size partitions."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Tasks of one job at most: the driver keeps something for each of them.
MOST_TASKS = 100_000


def parts_for(df: DataFrame, mb: float, most: int = MOST_TASKS) -> int:
    """A number of partitions of about so many MB each, no fewer than the session's shuffle partitions; larger ones beyond `most`."""
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), input_bytes(df)
    return least if size >= 1 << 60 else int(max(least, min(most, size / (mb * 1e6))))  # rows that come from no file have no size


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and its rows' bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(batches, text: str, size: int = SLICE):
    """(batch, bytes, bounds) for runs of rows of about `size` bytes of text; a longer row comes alone."""
    for batch in batches:
        raw, bounds = as_bytes(batch.column(batch.schema.get_field_index(text)))
        i, n = 0, batch.num_rows
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + size, "right")) - 1)
            yield batch.slice(i, j - i), raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
            i = j


def numbers(column: pa.Array) -> np.ndarray:
    """A non-null integer column as a NumPy array."""
    return column.to_numpy(zero_copy_only=False)


def find_words(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in raw, and each row's number of words; no word crosses a row's bounds."""
    inside = ~SPACES[raw]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(raw):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        first, last = bounds[:-1], bounds[1:]
        full = last > first
        before[first[full]] = False
        after[last[full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, bounds))
    return starts, ends, counts


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift and odd multipliers) that spreads a polynomial hash over all its bits."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Polynomial hashes modulo 2**64 of any span of an array of symbols from prefix sums; seed picks the symbols' codes.

    All seeds share one base, so a worker holds one table of its powers, as long as the longest array it has seen.
    """

    _base = int(np.random.Generator(np.random.PCG64(0)).integers(1 << 60, 1 << 61)) * 8 + 5  # odd, and of maximal order
    _codes: dict[int, np.ndarray] = {}
    _powers = [np.ones(1, _U), np.ones(1, _U)]  # of the base and of its inverse

    def __init__(self, symbols: np.ndarray, seed: int = 1):
        if seed not in self._codes:
            self._codes[seed] = np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        codes, powers, n = self._codes[seed], self._powers, len(symbols)
        for k, b in enumerate((self._base, pow(self._base, -1, 1 << 64))):
            if len(powers[k]) <= n:
                p = np.full(max(n + 1, 1 << 16), b, _U)
                p[0] = 1
                powers[k] = np.multiply.accumulate(p)
        values = codes[symbols] if symbols.dtype == np.uint8 else mix(symbols ^ codes[0])
        self.prefix = np.zeros(n + 1, _U)
        np.cumsum(values * powers[0][:n], out=self.prefix[1:])
        self.back = powers[1]

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of symbols[start:end]."""
        return mix((self.prefix[ends] - self.prefix[starts]) * self.back[starts] + (ends - starts).astype(_U))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all the spans of one width."""
        n = len(self.prefix) - 1
        if n < width:
            return np.zeros(0, _U)
        return mix((self.prefix[width:] - self.prefix[: n + 1 - width]) * self.back[: n + 1 - width] + _U(width))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima of blocks to both sides."""
    n = len(values)
    if n < width:
        return values[:0]
    top = np.iinfo(values.dtype).max
    padded = np.full(-(-n // width) * width, top, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


#: Hashes are compared by their high 40 bits, so that a place fits into the low ones; ties go to the earlier place.
_PLACE = 24


def anchors(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Winnowing. For each run of `width` neighbouring hashes, the place of the first least one is its anchor.

    Returns the anchors in order and, for each, the first run it stands for; it stands for those from there up to the
    one that starts just before the first run of the next anchor. An anchor is decided by its run's content alone.
    """
    runs, step = len(hashes) - width + 1, (1 << _PLACE) - width
    if runs < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.empty(runs, np.int64)
    for s in range(0, runs, step):
        part = hashes[s : s + step + width - 1]
        packed = part >> _U(_PLACE) << _U(_PLACE) | np.arange(len(part), dtype=_U)
        at[s : s + step] = s + (sliding_min(packed, width) & _U((1 << _PLACE) - 1)).astype(np.int64)
    new = np.flatnonzero(np.diff(at, prepend=-1))
    return at[new], new
