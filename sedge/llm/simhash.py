"""SimHash near-duplicates: fingerprints, a Manhattan grid join over segment bit counts, exact check, components.

Method. A fingerprint's 64 bits are cut into 32 segments of two; the vector of the segments' bit counts embeds it so
that the Manhattan distance of two vectors is never above the Hamming distance of the fingerprints. The segments are
dealt to three groups that may hold distances 0, 1 and 1: were all three above, the sum would be above four, so
every pair within four bits meets in one group's grid cell or in a neighbouring cell one step up. Cells are joined,
candidates pass the Manhattan bound and then the exact Hamming distance.

Copies share one fingerprint and enter once. A crowded cell is dealt to blocks, and a block hands on a spanning forest
of its links instead of all pairs: classes are the same, and no task or output grows with a cell's square.

Rows. Null and empty texts, and those without words, have fingerprint zero and are linked like any other. Repeated
rows each get a row. A row without an id gets a fingerprint and no component. Columns that the input has besides are
left out. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, rest_of, slices, whole_rows

_U = np.uint64
_ODD = _U(0x5555555555555555)
#: Segments of each group and the Manhattan distance that it may hold; sum(allowed + 1) is above MAX_BITS.
GROUPS = ((8, 0), (12, 1), (12, 1))
MAX_BITS = 4
#: Fingerprints of a cell that one block holds.
BLOCK = 2048


def text_fingerprints(raw: np.ndarray, bounds: np.ndarray, shingle: int = 4, seed: int = 42) -> np.ndarray:
    """SimHash of each row of a slice of UTF-8 bytes."""
    n, digest, hashes, sizes = len(bounds) - 1, xxhash.xxh64_intdigest, [], np.zeros(len(bounds) - 1, np.int64)
    for k in range(n):
        words = raw[bounds[k] : bounds[k + 1]].tobytes().lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) < shingle:
            found = [digest(joined, seed)]
        else:
            lens = np.fromiter(map(len, words), np.int64, len(words))
            ends = np.cumsum(lens + 1) - 1
            starts = (ends - lens)[: len(words) - shingle + 1].tolist()
            found = [digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
        hashes.append(np.array(found, _U))
        sizes[k] = len(found)
    out = np.zeros(n, _U)
    if hashes:
        ones = np.zeros((n, 64), np.int64)
        at = np.repeat(np.arange(n), sizes)
        flat = np.concatenate(hashes)
        for s in range(0, len(flat), 1 << 16):
            part, rows = flat[s : s + (1 << 16)], at[s : s + (1 << 16)]
            bits = np.unpackbits(part.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.diff(rows, prepend=-1))
            ones[rows[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        above = ones * 2 > sizes[:, None]
        out = np.packbits(above, axis=1, bitorder="little").view("<u8").ravel().astype(_U)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """id, fp: a row for each row of docs, fp as a signed 64-bit integer."""

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text_fingerprints(raw, bounds, shingle, seed).view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def embed(fp: np.ndarray) -> np.ndarray:
    """Segment bit counts in unary, two bits a segment, so that xor's bit count is the Manhattan distance."""
    both = fp & (fp >> _U(1)) & _ODD
    return (fp | fp >> _U(1)) & _ODD | both << _U(1)


def _cells(batches):
    """Each fingerprint as a member (kind 0) of a cell for every group, and as a visitor (kind 1) of the cells one up."""
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).view(_U)
        rep, u = batch.column(1).to_numpy(zero_copy_only=False), embed(fp)
        out, low = [], 0
        for g, (segments, allowed) in enumerate(GROUPS):
            cell = u >> _U(2 * low) & _U((1 << 2 * segments) - 1)
            out.append((np.full(len(fp), g), cell, np.zeros(len(fp)), fp, rep))
            for s in range(segments if allowed else 0):
                count = cell >> _U(2 * s) & _U(3)
                can = count < _U(3)
                up = cell | ((count << _U(1) | _U(1)) & _U(3)) << _U(2 * s)
                out.append((np.full(can.sum(), g), up[can], np.ones(can.sum()), fp[can], rep[can]))
            low += segments
        g, cell, kind, fps, reps = (np.concatenate(x) for x in zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(cell.astype(np.int64)), pa.array(kind.astype(np.int32)), pa.array(fps.view(np.int64)), pa.array(reps)], ["grp", "cell", "kind", "fp", "rep"])


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Whether a and b are linked: the Manhattan bound first, then the exact distance of those that pass."""
    ok = np.bitwise_count(embed(a) ^ embed(b)) <= most
    ok &= np.bitwise_count(a ^ b) <= most
    return ok


class _Block:
    """A large cell's block: members stay, visitors pass by; keeps the members' classes and gives a spanning forest."""

    def __init__(self, most: int):
        self.most, self.fp, self.rep, self.label = most, np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, kind: np.ndarray, fp: np.ndarray, rep: np.ndarray):
        """Edges that the rows bring; members come before visitors."""
        out, m = [], int((kind == 0).sum())
        for k in range(m):  # at most BLOCK or so
            near = np.flatnonzero(_near(self.fp, fp[k], self.most))
            out += self._join(near, rep[k])
            self.fp, self.rep = np.append(self.fp, fp[k]), np.append(self.rep, rep[k])
            self.label = np.append(self.label, self.label[near[0]] if len(near) else len(self.label))
        for s in range(m, len(fp), 512):
            x, r = fp[s : s + 512], rep[s : s + 512]
            ok = _near(x[:, None], self.fp[None, :], self.most) & (x[:, None] != self.fp[None, :])
            for k in np.flatnonzero(ok.any(axis=1)):
                out += self._join(np.flatnonzero(ok[k]), r[k])
        return out

    def _join(self, near: np.ndarray, rep: int) -> list[tuple[int, int]]:
        if not len(near):
            return []
        classes, first = np.unique(self.label[near], return_index=True)
        if len(classes) > 1:
            self.label[np.isin(self.label, classes)] = classes[0]
        return [(int(rep), int(self.rep[near[k]])) for k in first]


def _links(most: int):
    def run(batches):
        key, block = None, None

        def edges(pairs):
            a, b = (np.asarray(x, np.int64) for x in (zip(*pairs) if isinstance(pairs, list) and pairs else pairs or ((), ())))
            keep = a != b
            a, b = a[keep], b[keep]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            grp, cell, blk, kind, fp, rep = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            fp, n = fp.view(_U), len(fp)
            new = np.flatnonzero((np.diff(grp, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0) | (np.diff(blk, prepend=-1) != 0))
            if not len(new) or new[0] != 0:
                new = np.append(0, new)
            ends = np.append(new[1:], n)
            members = np.add.reduceat(kind == 0, new)
            big = members * (ends - new) > 1 << 14
            big[0] = big[-1] = True  # may go on in another batch
            end_of = np.repeat(np.where(big, new, ends), ends - new)
            left = np.flatnonzero((kind == 0) & (end_of > np.arange(n) + 1))
            more = end_of[left] - left - 1
            for s in range(0, len(left), 256):
                i = np.repeat(left[s : s + 256], more[s : s + 256])
                j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(more[s : s + 256]) - more[s : s + 256], more[s : s + 256])
                ok = _near(fp[i], fp[j], most)
                if ok.any():
                    yield edges((rep[i[ok]], rep[j[ok]]))
            for k in np.flatnonzero(big):
                s, e = new[k], ends[k]
                if key != (now := (grp[s], cell[s], blk[s])):
                    key, block = now, _Block(most)
                if found := block.add(kind[s:e], fp[s:e], rep[s:e]):
                    yield edges(found)

    return run


def links(nodes: DataFrame, scratch: Scratch, most: int = MAX_BITS) -> DataFrame:
    """a, b: edges between representatives whose classes are those of all pairs within `most` bits. nodes: fp, rep."""
    if sum(t + 1 for _, t in GROUPS) <= most:
        raise ValueError(f"the grid finds pairs within {sum(t + 1 for _, t in GROUPS) - 1} bits")
    cells = scratch.table(nodes.select("fp", "rep").mapInArrow(_cells, "grp int, cell long, kind int, fp long, rep long"), "cells")
    counts = cells.groupBy("grp", "cell").agg(F.sum((F.col("kind") == 0).cast("long")).alias("members"), F.count("*").alias("rows"))
    met = counts.where("members > 0 and rows > 1").select("grp", "cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A member of a crowded cell stays in its own block and visits the others.
    rows = cells.join(met, ["grp", "cell"]).select("grp", "cell", "fp", "rep", "kind", own.alias("own"), F.explode(everywhere).alias("blk"))
    rows = rows.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("own") == F.col("blk")), 0).otherwise(1))
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("grp", "cell", "blk", "kind", "fp", "rep").repartition(n, "grp", "cell", "blk").sortWithinPartitions("grp", "cell", "blk", "kind", "fp")
    return dealt.mapInArrow(_links(most), "a long, b long").distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """node, component: every node of an edge with the least node it reaches. Alternating large and small stars.

    Each round is two aggregations and joins over the edges and is written to the shared folder; hubs are spread by
    partial aggregation and by splitting skewed joins, and no neighbour list is ever gathered.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))
        if not large:
            both = both.where("v < u")
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        near = both.join(least, "u")
        if large:
            return near.where("v > u").select(F.col("least").alias("a"), F.col("v").alias("b")).where("a < b")
        own = least.select(F.col("least").alias("a"), F.col("u").alias("b"))
        return near.select(F.col("least").alias("a"), F.col("v").alias("b")).where("a < b").union(own.where("a < b"))

    now, state, k = scratch.table(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), f"{tag}0"), None, 0
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or not seen[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select("a", "a").distinct())
        state, k = tuple(seen), k + 1
        now = scratch.table(star(star(now, True).distinct(), False).distinct(), f"{tag}{k}")
        if k > 1:
            scratch.drop(f"{tag}{k - 2}")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = MAX_BITS) -> DataFrame:
    """id_col, fingerprint, component_id (the least id reachable over links of `most` bits or fewer)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.table(fingerprints(docs, id_col, text_col, shingle, seed), "prints")
    nodes = prints.groupBy("fp").agg(F.min("id").alias("rep"))
    edges = links(nodes.where("rep is not null"), scratch, most)
    classes = components(edges, scratch)
    known = nodes.join(classes, nodes.rep == classes.node, "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    joined = prints.join(known, prints.fp == known.of, "left")
    return joined.select(F.col("id").alias(id_col), hex_of(F.col("fp")).alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, most: int = MAX_BITS) -> DataFrame:
    """docs, all their columns, with one row of each class: that of the least id (if several of the class have it, of the least text).

    Classes are of fingerprints, so rows that share an id with an unrelated text are in classes of their own. Rows without an
    id are in no class and stay.
    """
    scratch = Scratch(docs.sparkSession, "simhash")

    def run(batches):
        for part, raw, bounds in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text_fingerprints(raw, bounds, shingle, seed).view(np.int64))], ["id", "text", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    marked = rows.mapInArrow(run, "id long, text string, fp long").select("id", "fp", F.sha2("text", 256).alias("text"))
    prints = scratch.table(marked, "prints")
    nodes = prints.groupBy("fp").agg(F.min(F.struct("id", "text")).alias("first"))
    classes = components(links(nodes.select("fp", F.col("fp").alias("rep")), scratch, most), scratch)
    heads = nodes.join(classes, nodes.fp == classes.node, "left").groupBy(F.coalesce("component", "fp").alias("class")).agg(F.min("first").alias("first"))
    first = scratch.table(heads.select(F.col("first.id").alias("first"), F.col("first.text").alias("head")).distinct(), "heads")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    whole = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), rest_of(docs, text_col).alias("rest"))
    kept = whole.join(first, (F.col("id") == F.col("first")) & (F.sha2(F.col("text"), 256) == F.col("head")), "left_semi")
    often = scratch.table(prints.groupBy("id", "text").count().where("count > 1").select(F.col("id").alias("same"), F.col("text").alias("hash")), "often")
    if not often.isEmpty():  # of rows that repeat an id and a text one stays
        kept = kept.groupBy("id", F.sha2("text", 256)).agg(F.first(F.struct("text", "rest")).alias("row")).select("id", "row.text", "row.rest")
    both = kept.select("text", "rest").union(whole.where("id is null").select("text", "rest"))
    return whole_rows(both, docs.columns, text_col, F.col("text"))
