"""Benchmark decontamination by greedy string tiling.

Method. Every item's seeds are its runs of SEED words, hashed. A fixed-size bitmap of all seeds goes to the scan of the
documents, where windows that it lacks fall out; what is left joins the items' seeds and gives candidate pairs. With `least`,
pairs that can't cover so much of the item need not be found: tiles that cover a share of its words hold at least so many seeds, so an
item leaves out its most frequent seeds as long as fewer than that many are left out, and common phrases pair nothing. A
document's words travel once, ahead of the items it is compared with. Each pair is tiled: matches of the largest remaining length are found by a running Karp-Rabin hash over unmarked words, compared,
and marked where they don't overlap, longest first, down to SEED words. Tiles may lie in any order, so
passages whose parts were moved are caught. The share of an item's words under tiles is its coverage; a document is
contaminated by items whose coverage reaches the threshold. Words are runs of letters and digits, ASCII letters compared
in lower case; any character outside ASCII counts as a letter.

An item with fewer than SEED words has one seed, all its words.

Ties go to the earlier place in the item, then in the text. A very long text is one row of hashes, eight bytes a word.

Rows. Null and empty texts have no words and match nothing, nor do items without words. Repeated rows of documents each
get a row; items that repeat an id are items of their own and the best coverage counts. Null ids stay null; items with
a null id contaminate as others do and count for the coverage, only the list of items can't name them. Columns that the inputs have besides are left out. No documents
in, no rows out; with no items no document is contaminated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Rolling, Scratch, as_bytes, find_words, rest_of, slices, whole_rows

#: Words of a seed, which is also the shortest tile.
SEED = 4
#: Share of an item's words that tiles must cover.
THRESHOLD = 0.5
#: Bits of the bitmap of seeds, a fixed 2 MB; beyond some million seeds it lets more pass and the join does the rest.
BITS = 1 << 24
_U = np.uint64
#: ASCII letters in lower case, digits and bytes of other characters as they are; all else separates words.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_FOLD[0x41:0x5B] = range(0x61, 0x7B)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """64-bit hashes of the words of each row of a slice."""
    folded = _FOLD[raw]
    starts, ends, counts = find_words(folded, bounds)
    return np.split(Rolling(folded, 41).spans(starts, ends), np.cumsum(counts)[:-1]) if len(counts) else []


def seeds_of(words: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of the runs of `seed` words; of all words where there are fewer."""
    if not len(words):
        return words
    return Rolling(words, 42).windows(min(seed, len(words)))


def tile(item: np.ndarray, text: np.ndarray, shortest: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in text, words) of non-overlapping matches, longest first.

    Lengths fall from the longest common run. At each one, unmarked windows of the text are met by the running hash of
    the item's unmarked windows and compared; ties go to the earlier place in the item, then in the text.
    """
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    tiles = []
    hash_item, hash_text = Rolling(item, 43), Rolling(text, 43)

    def open_windows(free: np.ndarray, n: int) -> np.ndarray:
        blocked = np.append(0, np.cumsum(~free))
        return np.flatnonzero(blocked[n:] == blocked[: len(free) + 1 - n])

    def common(n: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = open_windows(free_item, n), open_windows(free_text, n)
        x, y = hash_item.spans(a, a + n), hash_text.spans(b, b + n)
        return a[np.isin(x, y)], b[np.isin(y, x)]

    n = min(len(item), len(text))
    shortest = max(1, min(shortest, len(item)))
    while n >= shortest:
        # The longest length that still has a match, by halving: if windows of n words match, so do shorter ones.
        low, high = shortest - 1, n
        while low < high:
            mid = (low + high + 1) // 2
            if len(common(mid)[0]) if mid <= min(len(item), len(text)) else False:
                low = mid
            else:
                high = mid - 1
        n = low
        if n < shortest:
            break
        at_item, at_text = common(n)
        where: dict[int, list[int]] = {}
        for b, h in zip(at_text.tolist(), hash_text.spans(at_text, at_text + n).tolist()):
            where.setdefault(h, []).append(b)
        for a, h in zip(at_item.tolist(), hash_item.spans(at_item, at_item + n).tolist()):
            if not free_item[a : a + n].all():
                continue
            for b in where.get(h, ()):
                if free_text[b : b + n].all() and (item[a : a + n] == text[b : b + n]).all():
                    free_item[a : a + n] = free_text[b : b + n] = False
                    tiles.append((a, b, n))
                    break
        n -= 1
    return tiles


def _bitmap(seeds: DataFrame) -> bytes:
    """Which of BITS places the seeds' hashes have; at most BITS / 64 words come to the driver, whatever the items' number."""
    place = F.pmod(F.col("seed"), F.lit(BITS))
    words = seeds.select(F.floor(place / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(seed, {BITS}) % 64 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()
    out = np.zeros(BITS // 64, np.int64)
    out[[r.word for r in found]] = [r.bits for r in found]
    return out.tobytes()


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    """Arrays of hashes as a list column, without Python numbers."""
    flat = np.concatenate([np.zeros(0, np.int64), *(v.view(np.int64) for v in values)])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(v) for v in values])).astype(np.int32)), pa.array(flat))


def _kept_seeds(parts: DataFrame, candidates: DataFrame, seed: int, least: float) -> DataFrame:
    """seed, iid: an item's seeds without its most frequent ones, as far as no pair of `least` coverage or more is lost.

    Tiles of n words hold n - seed + 1 places of seeds, at least n / seed; so a pair that covers `least` of the item's words
    shares size * least / seed places, and if fewer are left out, shares one that is not.
    """
    seeds = parts.select("iid", "size", F.explode(F.arrays_zip("seeds", "times")).alias("of")).select("iid", "size", F.col("of.seeds").alias("seed"), F.col("of.times").alias("times"))
    if not least:
        return seeds.select("seed", "iid")
    often = candidates.select(F.explode("seeds").alias("seed")).groupBy("seed").count()
    line = Window.partitionBy("iid").orderBy(F.desc(F.coalesce("count", F.lit(0))), "seed")
    ranked = seeds.join(often, "seed", "left").withColumn("out", F.sum("times").over(line))
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * least / seed - 1e-9))
    return ranked.where(F.col("out") >= need).select("seed", "iid")


def tilings(docs: DataFrame, items: DataFrame, scratch: Scratch, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, least: float = 0.0) -> DataFrame:
    """rid, item, coverage, tiles of every pair that shares a seed (with least: and of all that cover so much of the item); docs have a string rid besides."""
    spark = docs.sparkSession

    def item_seeds(batches):
        for batch in batches:
            hashes = word_hashes(*as_bytes(batch.column(2)))
            found = [np.unique(seeds_of(h, seed), return_counts=True) for h in hashes]
            times = _lists([n.astype(np.int64) for _, n in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(h) for h in hashes], pa.int32()), _lists(hashes), _lists([x for x, _ in found]), times], ["iid", "item", "size", "words", "seeds", "times"])

    rows = items.select(F.monotonically_increasing_id().alias("iid"), F.col(item_id).cast("long").alias("item"), F.col(item_text).cast("string").alias("text"))
    parts = scratch.table(rows.mapInArrow(item_seeds, "iid long, item long, size int, words array<long>, seeds array<long>, times array<long>").where("size > 0"), "items")
    short = sorted(r.size for r in parts.where(F.col("size") < seed).select("size").distinct().collect())  # fewer than `seed` numbers
    bitmap = spark.sparkContext.broadcast(_bitmap(parts.select(F.explode("seeds").alias("seed"))))

    def doc_seeds(batches):
        bits = np.frombuffer(bitmap.value, _U)
        for part, raw, bounds in slices(batches, "text"):
            hashes = word_hashes(raw, bounds)
            kept, found = [], []
            for i, h in enumerate(hashes):
                roll, hits = Rolling(h, 42), []
                for k in (*short, seed):
                    all_seeds = roll.windows(k)
                    place = all_seeds & _U(BITS - 1)
                    hit = all_seeds[(bits[place >> _U(6)] >> (place & _U(63)) & _U(1)).astype(bool)]
                    if len(hit):
                        hits.append(np.unique(hit))
                if hits:
                    kept.append(i)
                    found.append(np.concatenate(hits))
            if kept:
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(kept, pa.int64())), _lists([hashes[i] for i in kept]), _lists(found)], ["rid", "words", "seeds"])

    texts = docs.select("rid", F.col(doc_text).cast("string").alias("text")).where("text is not null")
    candidates = scratch.table(texts.mapInArrow(doc_seeds, "rid string, words array<long>, seeds array<long>"), "candidates")
    kept = _kept_seeds(parts, candidates, seed, least)
    pairs = scratch.table(candidates.select("rid", F.explode("seeds").alias("seed")).join(kept, "seed").select("rid", "iid").distinct(), "pairs")
    meant = candidates.join(pairs.select("rid").distinct(), "rid", "left_semi").select("rid", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("item"), "words")
    asked = pairs.join(parts, "iid").select("rid", F.lit(1).alias("kind"), "item", "words")

    def run(batches):
        now, text = None, None
        for batch in batches:
            rids, shares, counts, own = batch.column(0).to_pylist(), [], [], []
            lists = batch.column(3)
            flat, at = lists.values.to_numpy().view(_U), lists.offsets.to_numpy()
            for i, kind in enumerate(batch.column(1).to_pylist()):
                words = flat[at[i] : at[i + 1]]
                if kind == 0:
                    now, text = rids[i], words.copy()
                elif rids[i] == now:
                    tiles = tile(words, text, seed)
                    own.append(i)
                    shares.append(sum(n for _, _, n in tiles) / max(1, len(words)))
                    counts.append(len(tiles))
            if own:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(own)), batch.column(2).take(pa.array(own)), pa.array(shares, pa.float64()), pa.array(counts, pa.int32())], ["rid", "item", "coverage", "tiles"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = meant.union(asked).repartition(n, "rid").sortWithinPartitions("rid", "kind")
    found = dealt.mapInArrow(run, "rid string, item long, coverage double, tiles int")
    return found.where(F.col("coverage") >= least) if least else found


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD, least: float = 0.0) -> DataFrame:
    """doc_id, contaminated, coverage (of the most covered item, 0 if none shares a seed), items (ids that reach the threshold, in order).

    least: up to the threshold; coverages below it are not told (0), and what can't reach it is not compared.
    """
    return mark(docs, items, doc_id, doc_text, item_id, item_text, seed, threshold, least).select(doc_id, "contaminated", "coverage", "items")


def mark(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD, least: float = 0.0) -> DataFrame:
    """The columns of docs that have other names, and contaminated, coverage and items."""
    scratch = Scratch(docs.sparkSession, "tiling")
    own = [c for c in docs.columns if c not in ("rid", "contaminated", "coverage", "items")]
    numbered = docs.select(*own).withColumn("rid", F.md5(F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(doc_text).cast("string"), F.lit("")))))
    hits = tilings(numbered, items, scratch, doc_id, doc_text, item_id, item_text, seed, min(least, threshold))
    best = hits.groupBy("rid", "item").agg(F.max("coverage").alias("share"))  # repeated rows and items
    found = scratch.table(best.groupBy("rid").agg(F.max("share").alias("most"), F.sort_array(F.collect_list(F.when(F.col("share") >= threshold, F.col("item")))).alias("found")), "found")
    joined = numbered.join(found, "rid", "left")
    coverage, ids = F.coalesce("most", F.lit(0.0)), F.coalesce("found", F.array().cast("array<long>"))
    return joined.select(*own, (coverage >= threshold).alias("contaminated"), coverage.alias("coverage"), ids.alias("items"))


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", seed: int = SEED, threshold: float = THRESHOLD) -> DataFrame:
    """docs, all their columns, without the contaminated rows."""
    rows = docs.select(F.col(doc_id).alias("of"), F.col(doc_text).alias("text"), rest_of(docs, doc_text).alias("rest"))
    kept = mark(rows, items, "of", "text", item_id, item_text, seed, threshold, threshold).where(~F.col("contaminated"))
    return whole_rows(kept, docs.columns, doc_text, F.col("text"))
