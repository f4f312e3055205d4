"""Token counts from distinct pre-tokens.

Method. The pieces of the model never hold white space after other characters, nor a line feed, so merges never cross
these places: text between them is a pre-token. Documents are read in blocks. A block keeps its (document, pre-token, n)
frequencies, packed, and sends its distinct pre-tokens, dealt to BUCKETS by a hash of the pre-token. A bucket gathers those of
all blocks, so that each distinct pre-token of the whole input is counted once, by the library, and answers every
block with the counts of the pre-tokens it has sent, in their order. The answers are joined to the block's frequencies by
place and summed for each document; ids of documents are never made.

A block sends a pre-token once however often it occurs, so a frequent one costs a bucket one entry a block and no bucket is
hot. The number of buckets is fixed, so messages grow with the blocks alone; what one bucket holds at a time is its share of
the distinct pre-tokens.

Rows. Null counts as empty, with no bytes and no tokens. Repeated rows each get a row; a null id stays null. A very long text
is one block. Columns that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

#: Bytes of text of a block; buckets of pre-tokens.
BLOCK, BUCKETS = 12 << 20, 1024
_COUNT = "<u4"


@lru_cache(2)
def counter(path: str) -> "PieceCounter":
    return PieceCounter(path)


class PieceCounter:
    """Counts the pieces of pre-tokens as the model gives them inside a text."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_byte(i) or self.model.is_unknown(i))]
        if any(re.search("[^▁]▁|\n", p) for p in plain) or self.model.normalize("A  ﬁ\n ") != "▁A▁▁ﬁ\n▁":
            raise ValueError(f"{path}: this model joins pieces over white space, so that its pre-tokens aren't known")

    def count(self, pre_tokens: list[str]) -> np.ndarray:
        """Pieces of each pre-token. A line feed before it keeps the library's own space away from it."""
        out = np.zeros(len(pre_tokens), np.int64)
        for s in range(0, len(pre_tokens), 4096):
            part = pre_tokens[s : s + 4096]
            out[s : s + len(part)] = [len(ids) - 2 for ids in self.model.encode(["\n" + p for p in part], num_threads=1)]
        return out


_SPLIT = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n").findall


def pre_tokens(text: str) -> list[str]:
    """The library puts a space before a text that isn't empty."""
    return _SPLIT(" " + text) if text else []


def bucket_of(token: str) -> int:
    return zlib.crc32(token.encode()) % BUCKETS


def pack(tokens: list[str]) -> bytes:
    """Pre-tokens, each ended by the bytes 0 2; a text's own zero byte is written as 0 1."""
    return zstandard.compress(b"".join(t.encode().replace(b"\x00", b"\x00\x01") + b"\x00\x02" for t in tokens), 3)


def unpack(blob: bytes) -> list[str]:
    raw = zstandard.decompress(blob, 1 << 34).split(b"\x00\x02")[:-1]
    return [t.replace(b"\x00\x01", b"\x00").decode() for t in raw]


def frequencies(texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct pre-tokens by bucket, and of each document: how many it has, steps from one's place in the block's order to the next's, how often."""
    number: dict[str, int] = defaultdict()
    number.default_factory = number.__len__
    sizes, places, times = [], [], []
    for text in texts:
        found = Counter(pre_tokens(text))
        sizes.append(len(found))
        places.append(np.fromiter(map(number.__getitem__, found), np.int64, len(found)))
        times.append(np.fromiter(found.values(), np.int64, len(found)))
    number.default_factory = None
    tokens = list(number)
    bucket = np.fromiter(map(bucket_of, tokens), np.int64, len(tokens))
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(tokens), np.int64)
    place[order] = np.arange(len(tokens))
    cuts = np.append(0, np.cumsum(np.bincount(bucket, minlength=BUCKETS))).tolist()
    ordered = [tokens[i] for i in order.tolist()]
    flat = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
    sizes, times = np.array(sizes, np.int64), flat(times)
    key = np.repeat(np.arange(len(sizes)) << 32, sizes) | place[flat(places)]
    order = np.argsort(key)
    at = key[order] & 0xFFFFFFFF
    step = np.diff(at, prepend=0)
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    step[first] = at[first]
    return [ordered[a:b] for a, b in zip(cuts, cuts[1:])], sizes, step, times[order]


def _planes(*columns: np.ndarray) -> bytes:
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype(_COUNT).view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns), 3)


def _columns(blob: bytes, n: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob, 1 << 34), np.uint8).reshape(n, 4, -1)
    return [np.ascontiguousarray(c.T).view(_COUNT).ravel().astype(np.int64) for c in raw]


def token_counts(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, make=None) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit (more than `limit` tokens). make: another PieceCounter."""
    scratch = Scratch(docs.sparkSession, "tokens")

    def read(batches):
        from pyspark import TaskContext

        name, k = TaskContext.get().partitionId() << 32, 0
        for part, raw, bounds in gathered(batches, block):
            sent, sizes, step, times = frequencies([raw[a:b].tobytes().decode() for a, b in zip(bounds, bounds[1:])])
            facts = _planes(sizes), _planes(step, times)
            yield pa.RecordBatch.from_arrays([pa.array([name + k]), pa.array([part.to_pylist()], pa.list_(pa.int64())), pa.array([np.diff(bounds)], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in facts), pa.array([[pack(t) if t else None for t in sent]], pa.list_(pa.binary()))], ["block", "ids", "n_bytes", "sizes", "frequencies", "sent"])
            k += 1

    def answer(batches):
        use, now, held = make(path) if make else counter(path), None, []
        for batch in batches:
            for bucket, name, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now and held:  # rows come by bucket, so one is in memory at a time
                    yield solved(use, now, held)
                    held = []
                now = bucket
                held.append((name, blob))
        if held:
            yield solved(use, now, held)

    def solved(use: PieceCounter, bucket: int, held: list[tuple[int, bytes]]):
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        asked = [np.fromiter(map(number.__getitem__, unpack(blob)), np.int64) for _, blob in held]
        counts = use.count(list(number))
        return pa.RecordBatch.from_arrays([pa.array([name for name, _ in held], pa.int64()), pa.array([bucket] * len(held), pa.int32()), pa.array([_planes(counts[x]) for x in asked], pa.binary())], ["block", "bucket", "counts"])

    def total(key, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        counts = np.concatenate([np.zeros(0, np.int64), *(_columns(b, 1)[0] for b in answers.sort_by("bucket").column("counts").to_pylist())])
        for row in blocks.to_pylist():  # one, as blocks have names of their own
            (sizes,), (step, times) = _columns(row["sizes"], 1), _columns(row["frequencies"], 2)
            ends, upto = np.cumsum(sizes), np.append(0, np.cumsum(step))
            places = upto[1:] - np.repeat(upto[ends - sizes], sizes)
            sums = np.append(0, np.cumsum(counts[places] * times))
            out.append(pa.table({"id": pa.array(row["ids"], pa.int64()), "n_bytes": pa.array(row["n_bytes"], pa.int64()), "n_tokens": pa.array(sums[ends] - sums[ends - sizes])}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("id", "n_bytes", "n_tokens")})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks = scratch.table(rows.mapInArrow(read, "block long, ids array<long>, n_bytes array<long>, sizes binary, frequencies binary, sent array<binary>"), "blocks")
    sent = blocks.select("block", F.posexplode("sent").alias("bucket", "blob")).where("blob is not null")
    asked = sent.select("bucket", "block", "blob").repartition("bucket").sortWithinPartitions("bucket", "block")
    answers = asked.mapInArrow(answer, "block long, bucket int, counts binary")
    counted = blocks.drop("sent").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(total, "id long, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def gathered(batches, size: int):
    """(ids, bytes, bounds) of runs of rows of about `size` bytes, over the bounds of batches; a longer row may come with others."""
    ids, parts, bounds, n = [], [], [np.zeros(1, np.int64)], 0
    for part, raw, b in slices(batches, "text", size):
        if n and n + len(raw) > size:
            yield pa.concat_arrays(ids), np.concatenate(parts), np.concatenate(bounds)
            ids, parts, bounds, n = [], [], [np.zeros(1, np.int64)], 0
        ids.append(part.column(0))
        parts.append(raw)
        bounds.append(b[1:] + n)
        n += len(raw)
    if ids:
        yield pa.concat_arrays(ids), np.concatenate(parts), np.concatenate(bounds)
