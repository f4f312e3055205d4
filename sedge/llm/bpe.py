"""Byte-level BPE encoding and decoding by overlapping chunks.

Method. A text is cut into chunks that overlap. Each chunk is pre-tokenised on its own; its last few pre-tokens are not
trusted, as the cut may have changed them. Pre-tokenising depends only on what follows a boundary, so where a
boundary of one chunk is also one of the next, the two agree from there on: there the chunks are stitched. If an
overlap holds no common boundary (one pre-token longer than the overlap), the next chunk is read again from the last
trusted boundary and grows until that pre-token ends. The pieces are then encoded by rank, each distinct piece once in
a bounded table, and ids are written straight as little-endian 32-bit integers. Decoding concatenates the raw bytes.

Texts longer than SPREAD characters are pre-tokenised and encoded chunk by chunk in different tasks: a chunk's row
carries its overlap, and gives for each of its pre-token boundaries in the overlap where its ids begin, so that the
document's row only compares boundaries and joins id runs. Where two such chunks have no boundary in common, the text
is read by one task, in the way above.

Rows. Null counts as empty: no ids, digests of nothing. Repeated rows each get a row; a null id stays null. Columns
that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Characters of a chunk and of its overlap with the next.
CHUNK, OVERLAP = 512, 64
#: Characters above which a text is dealt to several tasks, in chunks of so many.
SPREAD = 1 << 16
#: Pre-tokens at a chunk's cut end that are not trusted: the cut can change the last one and white space before it.
UNSURE = 2
#: Distinct pieces that a worker remembers at most.
PIECES = 150_000


@lru_cache(4)
def coder(path: str, pattern: str):
    return Coder(path, pattern)


class Coder:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.find = regex.compile(pattern)
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.known: dict[str, bytes] = {}

    def piece(self, text: str) -> bytes:
        """The ids of one pre-token as little-endian 32-bit integers."""
        ids = self.core.encode_single_piece(text.encode())
        if len(self.known) >= PIECES:
            self.known.clear()
        found = self.known[text] = struct.pack(f"<{len(ids)}I", *ids)
        return found

    def ids(self, pieces: list[str]) -> bytes:
        known, piece = self.known, self.piece
        return b"".join([known.get(p) or piece(p) for p in pieces])

    def decode(self, ids: bytes) -> bytes:
        """Raw bytes of packed ids, joined."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def pieces(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
        """The pre-tokens of a whole text, chunk by chunk, stitched where boundaries meet."""
        if len(text) <= chunk + overlap:
            return self.find.findall(text)
        out: list[str] = []
        at, size = 0, chunk  # `at` is a boundary of the whole text
        start = 0
        while start < len(text):
            stop = min(len(text), start + size + overlap)
            found = self.find.findall(text[start:stop])
            if stop < len(text):
                del found[-UNSURE:]
            # The first boundary of this chunk that the whole text is known to have; what was read before stays as it is.
            place, k = start, 0
            while k < len(found) and place < at:
                place += len(found[k])
                k += 1
            if place != at or (k == len(found) and stop < len(text)):
                if start != at:  # no boundary in common: read again from the last sure one
                    start = at
                else:  # one pre-token longer than the chunk
                    size *= 2
                continue
            out += found[k:]
            at += sum(map(len, found[k:]))
            if stop == len(text):
                break
            start, size = max(at - overlap, start + 1), chunk
        return out

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> bytes:
        return self.ids(self.pieces(text, chunk, overlap))


def _chunk_ids(use: Coder, text: str, start: int, last: bool, overlap: int) -> dict:
    """One chunk's ids, and its boundaries (place in the text, ids before it) near its two ends."""
    found = use.find.findall(text)
    if not last:
        del found[-UNSURE:]
    places, before = [start], [0]
    ids = [use.known.get(p) or use.piece(p) for p in found]
    for p, x in zip(found, ids):
        places.append(places[-1] + len(p))
        before.append(before[-1] + len(x) // 4)
    near = [i for i, p in enumerate(places) if p <= start + overlap or p >= start + len(text) - overlap]
    return {"start": start, "places": [places[i] for i in near], "before": [before[i] for i in near], "ids": b"".join(ids)}


def stitch(chunks: list[dict]) -> bytes | None:
    """A text's ids from its chunks in order; None where two neighbours have no boundary in common."""
    out, begin = [], 0
    for k, c in enumerate(chunks):
        end = len(c["ids"]) // 4
        if k + 1 < len(chunks):
            own, more = dict(zip(c["places"], c["before"])), dict(zip(chunks[k + 1]["places"], chunks[k + 1]["before"]))
            # Past `begin`, so that a chunk never hands on less than it took over.
            meet = next((p for p in sorted(own.keys() & more.keys()) if own[p] >= begin), None)
            if meet is None:
                return None
            end, then = own[meet], more[meet]
        out.append(c["ids"][4 * begin : 4 * end])
        begin = then if k + 1 < len(chunks) else 0
    return b"".join(out)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """id_col, n_tokens, ids (binary: packed little-endian 32-bit ids)."""
    schema = "id long, n_tokens long, ids binary"

    def whole(batches):
        use = coder(path, pattern)
        for batch in batches:
            yield from _out(batch, (use.encode(t or "", chunk, overlap) for t in batch.column(1).to_pylist()))

    def part(batches):
        use = coder(path, pattern)
        for batch in batches:
            for row in batch.to_pylist():
                got = _chunk_ids(use, row["text"], row["start"], row["last"], overlap)
                yield pa.RecordBatch.from_pylist([{"rid": row["rid"], "id": row["id"]} | got], pa.schema([("rid", pa.int64()), ("id", pa.int64()), ("start", pa.int64()), ("places", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("ids", pa.binary())]))

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("start").to_pylist()
        ids = stitch(rows)
        return pa.table({"rid": pa.array([rows[0]["rid"]], pa.int64()), "id": pa.array([rows[0]["id"]], pa.int64()), "n_tokens": pa.array([None if ids is None else len(ids) // 4], pa.int64()), "ids": pa.array([ids], pa.binary())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    out = rows.where(size <= spread).mapInArrow(whole, schema)
    scratch = Scratch(docs.sparkSession, "bpe")
    long = scratch.table(rows.where(size > spread).withColumn("rid", F.monotonically_increasing_id()), "long")
    if not long.isEmpty():
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.length("text").cast("long") - 1, F.lit(spread).cast("long")))
        cut = long.select("rid", "id", starts.alias("start"), "text").select("rid", "id", "start", F.expr(f"substring(text, cast(start as int) + 1, {spread + overlap})").alias("text"), (F.col("start") + spread + overlap >= F.length("text")).alias("last"), F.length("text").alias("size"))
        cut = cut.where((F.col("start") == 0) | (F.col("start") + overlap < F.col("size"))).drop("size")  # the chunk before holds the rest
        parts = cut.repartition("rid", "start").mapInArrow(part, "rid long, id long, start long, places array<long>, before array<long>, ids binary")
        joined = scratch.table(parts.groupBy("rid").applyInArrow(join, "rid long, id long, n_tokens long, ids binary"), "joined")
        unmet = long.join(joined.where("ids is null").select("rid"), "rid", "left_semi")
        out = out.union(joined.where("ids is not null").select("id", "n_tokens", "ids")).union(unmet.select("id", "text").mapInArrow(whole, schema))
    return out.withColumnRenamed("id", id_col)


def _out(batch: pa.RecordBatch, found, size: int = 1 << 24):
    """Batches of (id, n_tokens, ids) of bounded size."""
    start, held, rows = 0, 0, []
    for ids in found:
        rows.append(ids)
        held += len(ids)
        if held > size:
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array(rows, pa.binary())], ["id", "n_tokens", "ids"])
            start, held, rows = start + len(rows), 0, []
    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(rows)), pa.array([len(x) // 4 for x in rows], pa.int64()), pa.array(rows, pa.binary())], ["id", "n_tokens", "ids"])


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """coded's id_col, n_tokens and ids, and decoded (binary): the raw bytes that the ids stand for."""

    def run(batches):
        use = coder(path, pattern)
        for batch in batches:
            texts = [use.decode(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    return coded.select(F.col(id_col).alias("id"), "n_tokens", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, decoded binary").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, spread: int = SPREAD) -> DataFrame:
    """id_col, n_tokens, ids and decoded of encode() and decode(), texts of one task's size in one pass of one worker."""
    schema = "id long, n_tokens long, ids binary, decoded binary"

    def both(batches):
        use = coder(path, pattern)
        for batch in batches:
            for part in _out(batch, (use.encode(t or "", chunk, overlap) for t in batch.column(1).to_pylist())):
                texts = [use.decode(x) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], ["id", "n_tokens", "ids", "decoded"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))
    whole = rows.where(size <= spread).mapInArrow(both, schema)
    long = rows.where(size > spread)
    if long.isEmpty():
        return whole.withColumnRenamed("id", id_col)
    dealt = decode(encode(long, path, pattern, "id", "text", chunk, overlap, spread), path, pattern, "id")
    return whole.union(dealt).withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """id_col, n_tokens, ids_sha256, decoded_sha256 of round_trip()."""
    return round_trip(docs, path, pattern, id_col).select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
