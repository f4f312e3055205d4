"""Language-model scores by deleted interpolation.

Method. Maximum-likelihood estimates of the orders 1 to ORDER and a uniform one are mixed. The weights depend on the bucket
of the context: the longest one that was seen, and the logarithm of its count. They are learnt by expectation-maximisation on
counts of a held-out part of the training documents (fold HELD of 10), under the estimates of the other training
documents; scores then use the counts of all of them. Under these a bucket can occur that no held-out token had; with
`nearest`, as in the query, it takes the weights of the nearest learnt bucket of its order, or of a lower order where its own has none.

Data flow. Documents are dealt to blocks. A block sends its distinct n-grams, as sorted hashes (64 bits for
words, 48 or more by the input's size for longer ones) with counts, cut by ranges of the hash; a range's task sums the counts of all blocks and answers each block in the order
of its own list, so answers need no keys. A block's n-grams are found again from its documents. So what is
shuffled follows the distinct n-grams of blocks, a frequent word costs no more than a rare one, and no table of counts is ever in one place.

Tokens are the words of a text, A-Z in lower case, then one end; the end also stands before the first word as its context.

Rows. Null counts as empty, which is one end. A null id is in fold 0, held out from learning. Repeated rows each count and
each get a row. With no training document the base and the model are uniform. Columns that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Rolling, Scratch, as_bytes, find_words, input_bytes, mix

ORDER = 3
#: Fold (of 10) of the training documents on which weights are learnt; fold 0 is not trained on.
HELD = 9
#: MB of input for a block of documents: at least and at most. In between it grows as the root of the input, so that a block's
#: message to a range stays worth a row (MESSAGE bytes of input or so) as both become more. A range has RANGE as much as a block.
BLOCK_MB, BLOCK_MB_MOST, MESSAGE, RANGE = 2, 64, 4096, 0.75
#: Rounds of expectation-maximisation at most, and the gain in log10 probability per token at which they end.
ROUNDS, GAIN = 12, 1e-5
_U = np.uint64
_END = _U(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def pack(*columns: np.ndarray) -> bytes:
    """Unsigned integers as zstandard-compressed planes of their bytes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes() for c in columns), 3)


def unpack(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob, 1 << 34), np.uint8).reshape(columns, 8, -1)
    return [np.ascontiguousarray(c.T).view("<u8").ravel().astype(_U) for c in raw]


class Block:
    """N-grams of a block of texts: for each order k its sorted distinct hashes, and where each token's one is."""

    def __init__(self, texts: pa.Array, order: int, bits: int = 64):
        raw, bounds = as_bytes(texts)
        raw = _LOWER[raw]
        starts, ends, counts = find_words(raw, bounds)
        self.sizes = counts + 2  # the end before the first word, the words, the end
        self.at = np.append(0, np.cumsum(self.sizes))
        tokens = np.full(int(self.at[-1]), _END)
        inner = np.ones(len(tokens), bool)
        inner[self.at[:-1]] = inner[self.at[1:] - 1] = False
        tokens[inner] = Rolling(raw, 51).spans(starts, ends)
        self.place = np.arange(len(tokens)) - np.repeat(self.at[:-1], self.sizes)
        self.hashes, self.where = [], []
        gram = tokens
        for k in range(1, order + 1):
            if k > 1:
                # As many tokens before as the document has; those with fewer than k - 1 are no n-grams of this order.
                gram = np.append(gram[:1], mix(gram[:-1] * _U(0xBF58476D1CE4E5B9) + tokens[1:])) >> _U(64 - bits)
            valid = self.place >= k - 1
            found, inverse = np.unique(gram[valid], return_inverse=True)
            where = np.full(len(tokens), -1, np.int64)
            where[valid] = inverse
            self.hashes.append(found)
            self.where.append(where)

    def counts(self, k: int, docs: np.ndarray) -> np.ndarray:
        """How often each n-gram of order k + 1 occurs in the documents that docs marks."""
        use = np.repeat(docs, self.sizes) & (self.place > 0) & (self.where[k] >= 0)
        return np.bincount(self.where[k][use], minlength=len(self.hashes[k]))


def packed(rows: DataFrame) -> DataFrame:
    """block, blob: rows (id, text, fold, block) of a batch and block together, compressed, as they are shuffled twice."""

    def run(batches):
        for batch in batches:
            block = batch.column(3).to_numpy()
            order = np.argsort(block, kind="stable")
            batch, block = batch.take(pa.array(order)).select([0, 1, 2]), block[order]
            at = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block)).tolist()
            for s in range(0, len(at) - 1, 64):  # a few blobs at a time
                pieces = []
                for a, b in zip(at[s : s + 64], at[s + 1 : s + 65]):
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, batch.schema) as out:
                        out.write_batch(batch.slice(a, b - a))
                    pieces.append(zstandard.compress(sink.getvalue().to_pybytes(), 3))
                yield pa.RecordBatch.from_arrays([pa.array(block[at[s : s + len(pieces)]].astype(np.int32)), pa.array(pieces, pa.binary())], ["block", "blob"])

    return rows.select("id", "text", "fold", "block").mapInArrow(run, "block int, blob binary")


def unpacked(blobs: list[bytes]) -> pa.Table:
    """The rows (id, text, fold) of packed blobs."""
    return pa.concat_tables([pa.ipc.open_stream(zstandard.decompress(b, 1 << 34)).read_all() for b in blobs]).combine_chunks()


def _cuts(hashes: np.ndarray, ranges: int, bits: int) -> np.ndarray:
    """Where each of the equal ranges of the hash begins in a sorted list."""
    return np.searchsorted(hashes, np.array([(r << bits) // ranges for r in range(1, ranges)], _U)) if ranges > 1 else np.zeros(0, np.int64)


def hash_bits(size: int) -> int:
    """Bits of the hash of a longer n-gram: enough that about one n-gram in a million of such an input meets another."""
    return min(64, max(48, 19 + max(1, size).bit_length())) if size else 64


def _answers(found: list[tuple[int, list[np.ndarray]]], order: int) -> tuple[list[tuple[int, bytes]], int, int, int, int]:
    """Sums over the blocks of a range: (block, answer) each, and of words: kinds and tokens of main and of all training."""
    sums: list[list[np.ndarray]] = [[] for _ in found]
    facts = (0, 0, 0, 0)
    for k in range(order):
        hashes = np.concatenate([f[1][3 * k] for f in found])
        order_ = np.argsort(hashes, kind="stable")
        lead = np.flatnonzero(np.append(True, np.diff(hashes[order_]) != 0)) if len(hashes) else np.zeros(0, np.int64)
        number = np.empty(len(hashes), np.int64)
        number[order_] = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(hashes))))
        totals = []
        for c in (1, 2):
            part = np.concatenate([f[1][3 * k + c] for f in found])
            totals.append(np.add.reduceat(part[order_], lead) if len(lead) else part)
        if k == 0:
            main, all_ = totals[0], totals[0] + totals[1]
            facts = (int((main > 0).sum()), int(main.sum()), int((all_ > 0).sum()), int(all_.sum()))
        s = 0
        for i, f in enumerate(found):
            own = number[s : s + len(f[1][3 * k])]
            s += len(own)
            sums[i] += [totals[0][own], totals[1][own]]
    blobs = []
    for (block, _), columns in zip(found, sums):
        blobs.append((block, b"".join(len(b).to_bytes(8, "little") + b for b in (pack(*columns[2 * k : 2 * k + 2]) for k in range(order)))))
    return blobs, *facts


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


class Model:
    """Estimates from a block's answers, mixed by weights: bucket -> one for each of uniform, order 1, 2, .."""

    def __init__(self, block: Block, answers: list[tuple[int, bytes]], order: int, main_only: bool, kinds: int, tokens: int):
        columns = [_split(b) for _, b in sorted(answers)]
        self.counts = []
        for k in range(order):
            parts = [unpack(c[k], 2) for c in columns]
            total = np.concatenate([p[0] if main_only else p[0] + p[1] for p in parts]) if parts else np.zeros(0, _U)
            where = block.where[k]
            self.counts.append(np.where(where >= 0, total[np.maximum(where, 0)] if len(total) else 0, 0).astype(np.float64))
        real = block.place > 0
        n = len(real)
        self.estimates = [np.full(n, 1 / (kinds + 1)), self.counts[0] / max(1, tokens)]
        self.bucket = np.zeros(n, np.int64)
        for k in range(1, order):
            context = np.append(0, self.counts[k - 1][:-1])
            context[block.place < k] = 0  # the context begins before the document
            seen = context > 0
            self.estimates.append(np.where(seen, self.counts[k] / np.maximum(context, 1), 0.0))
            self.bucket[seen] = 64 * k + np.log2(context[seen]).astype(np.int64)
        self.real = real

    def log10(self, weights: dict[int, list[float]], fallback: list[float], nearest: bool) -> np.ndarray:
        buckets, inverse = np.unique(self.bucket, return_inverse=True)
        table = np.array([weights_of(int(b), weights, fallback) if nearest else weights.get(int(b), fallback) for b in buckets])
        p = sum(table[inverse, k] * e for k, e in enumerate(self.estimates))
        return np.log10(p)


def weights_of(bucket: int, weights: dict[int, list[float]], fallback: list[float]) -> list[float]:
    """A bucket's weights; of one that is not learnt, those of the nearest learnt count (the smaller of two) of its order, else of a lower order."""
    for order in range(bucket // 64, 0, -1):
        learnt = [b for b in weights if b // 64 == order]
        if learnt:
            return weights[min(learnt, key=lambda b: (abs(b % 64 - bucket % 64), b))]
    return weights.get(0, fallback)


def fold(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % 10


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, nearest: bool = False) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score.

    nearest: a bucket that is not learnt takes the weights of the nearest one (the query does so); else those of unseen contexts.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    size = min(input_bytes(docs), 1 << 60) if input_bytes(docs) < 1 << 60 else 0
    block = min(BLOCK_MB_MOST * 1e6, max(BLOCK_MB * 1e6, (MESSAGE * size) ** 0.5))
    blocks, ranges = max(2, int(size / block)), max(2, int(size / (RANGE * block)))
    apart, bits = max(1, blocks // 9), hash_bits(size)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), fold(F.col(id_col)).cast("int").alias("fold"))
    spread = F.xxhash64("id", "text")
    rows = rows.withColumn("block", F.when(F.col("fold") == HELD, blocks + F.pmod(spread, F.lit(apart))).otherwise(F.pmod(spread, F.lit(blocks))).cast("int"))

    def send(batches):
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for b, blob in zip(*(c.to_pylist() for c in batch.columns)):
                held.setdefault(b, []).append(blob)
        while held:
            b, blobs = held.popitem()
            t = unpacked(blobs)
            own, f = Block(t.column("text"), order, bits), t.column("fold").to_numpy()
            columns = []
            for k in range(order):
                at = _cuts(own.hashes[k], ranges, 64 if k == 0 else bits)
                main, aside = own.counts(k, (f != 0) & (f != HELD)), own.counts(k, f == HELD)
                columns.append([np.split(x, at) for x in (own.hashes[k], main, aside)])
            for r in range(ranges):
                blob = b"".join(len(x).to_bytes(8, "little") + x for x in (pack(np.diff(h[r], prepend=_U(0)), m[r], a[r]) for h, m, a in columns))
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([b], pa.int32()), pa.array([blob], pa.binary())], ["part", "block", "blob"])

    def answer(batches):
        held: list[tuple[int, bytes]] = []
        now = None
        for batch in batches:
            for part, block, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if part != now and held:  # rows come by part, so one is in memory at a time
                    yield from solved(now, held)
                    held = []
                now = part
                held.append((block, blob))
        if held:
            yield from solved(now, held)

    def solved(part: int, sent: list[tuple[int, bytes]]):
        found = []
        for block, blob in sent:
            got = []
            for piece in _split(blob):
                delta, main, aside = unpack(piece, 3)
                got += [np.cumsum(delta, dtype=_U), main.astype(np.uint32), aside.astype(np.uint32)]
            found.append((block, got))
        blobs, *facts = _answers(found, order)
        for i, (block, blob) in enumerate(blobs):
            own = facts if i == 0 else [0] * 4
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([blob], pa.binary()), *(pa.array([x], pa.int64()) for x in own)], ["block", "part", "blob", "main_kinds", "main_tokens", "kinds", "tokens"])

    sent = packed(rows).repartition(blocks, "block").mapInArrow(send, "part int, block int, blob binary")
    answers = scratch.table(sent.repartition(ranges, "part").sortWithinPartitions("part", "block").mapInArrow(answer, "block int, part int, blob binary, main_kinds long, main_tokens long, kinds long, tokens long"), "answers")
    facts = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("main_kinds", "main_tokens", "kinds", "tokens"))).first()

    del sent
    scratch.settle()

    def tuples(key, blobs: pa.Table, got: pa.Table) -> pa.Table:
        own = Block(unpacked(blobs.column("blob").to_pylist()).column("text"), order, bits)
        model = Model(own, list(zip(got.column("part").to_pylist(), got.column("blob").to_pylist())), order, True, facts.main_kinds, facts.main_tokens)
        rows = np.column_stack([model.bucket, *model.estimates[1:]])[model.real]
        kinds, n = np.unique(rows, axis=0, return_counts=True)
        return pa.table({"bucket": pa.array(kinds[:, 0].astype(np.int32)), **{f"p{k}": pa.array(kinds[:, k]) for k in range(1, order + 1)}, "n": pa.array(n, pa.int64())})

    given = answers.select("block", "part", "blob")
    aside = packed(rows.where(F.col("fold") == HELD)).groupBy("block").cogroup(given.where(F.col("block") >= blocks).groupBy("block"))
    held = scratch.table(aside.applyInArrow(tuples, "bucket int, " + ", ".join(f"p{k} double" for k in range(1, order + 1)) + ", n long"), "held")
    weights = learn_weights(held, order, 1 / (facts.main_kinds + 1))
    fallback = weights.get(0) or [0.1, 0.9] + [0.0] * (order - 1)

    def scores(key, blobs: pa.Table, got: pa.Table) -> pa.Table:
        texts = unpacked(blobs.column("blob").to_pylist())
        own = Block(texts.column("text"), order, bits)
        model = Model(own, list(zip(got.column("part").to_pylist(), got.column("blob").to_pylist())), order, False, facts.kinds, facts.tokens)
        lead = own.at[:-1]
        total = lambda x: np.add.reduceat(np.where(model.real, x, 0), lead) if len(lead) else np.zeros(0)
        count = model.counts[0]
        base = np.log10((count + 0.1) / (facts.tokens + 0.1 * (facts.kinds + 1)))
        return pa.table({"id": texts.column("id"), "fold": texts.column("fold"), "n_tokens": pa.array(own.sizes - 1), "n_known": pa.array(total(count > 0).astype(np.int64)), "base_score": pa.array(total(base)), "score": pa.array(total(model.log10(weights, fallback, nearest)))})

    both = packed(rows).groupBy("block").cogroup(given.groupBy("block"))
    out = both.applyInArrow(scores, "id long, fold int, n_tokens long, n_known long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), (F.col("fold") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def learn_weights(held: DataFrame, order: int, uniform: float) -> dict[int, list[float]]:
    """Weights of each bucket by expectation-maximisation. held: bucket, p1.., and how many held-out tokens have them.

    A round is one aggregation; a few numbers for each bucket come to the driver, of which there are some 64 an order.
    """
    spark, names = held.sparkSession, [f"w{k}" for k in range(order + 1)]
    estimates = [F.lit(uniform), *(F.col(f"p{k}") for k in range(1, order + 1))]
    now: dict[int, list[float]] = {}
    for r in held.select("bucket").distinct().collect():
        longest = max(1, r.bucket // 64 + 1)
        now[r.bucket] = [0.1] + [0.9 / longest] * longest + [0.0] * (order - longest)
    last = None
    for _ in range(ROUNDS if now else 0):
        table = spark.createDataFrame([(b, *w) for b, w in now.items()], "bucket int, " + ", ".join(f"{x} double" for x in names))
        joined = held.join(F.broadcast(table), "bucket")
        mixed = sum((F.col(x) * e for x, e in zip(names[1:], estimates[1:])), F.col("w0") * estimates[0])
        joined = joined.withColumn("mixed", mixed)
        got = joined.groupBy("bucket").agg(*(F.sum(F.col("n") * F.col(x) * e / F.col("mixed")).alias(x) for x, e in zip(names, estimates)), F.sum("n").alias("n"), F.sum(F.col("n") * F.log10("mixed")).alias("gain")).collect()
        # The uniform estimate keeps a little weight, so that every text has a probability.
        for r in got:
            shares = [max(r[x] / r.n, 1e-6 if k == 0 else 0.0) for k, x in enumerate(names)]
            now[r.bucket] = [s / sum(shares) for s in shares]
        gain = sum(r.gain for r in got) / sum(r.n for r in got)
        if last is not None and gain - last < GAIN:
            break
        last = gain
    return now
