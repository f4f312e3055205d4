"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Method. Shingles of five words are hashed once; the hash's high bits choose one of BINS bins and each bin keeps its least
hash. A bin that no shingle reached borrows from one that some did (optimal densification): bins are tried in an order that a
hash of the empty bin's number draws, alike for all texts, and after TRIES of them the full bin whose hash with that number
is least. BITS low bits of each bin are stored, packed into 64-bit words. The share of equal bins overstates likeness, as
different hashes share their low bits once in 2**BITS; the estimate takes this out.

A document's next one is found by one shuffle: documents are dealt to ranges of ids, cut at ids that exist, so a
range's first document is known in advance and also goes, as a sentinel, to the range before.

Rows. Null counts as empty. A text of fewer than five words is one shingle; one without words has an empty fingerprint,
like only to its kind (1), unlike all others (0). Rows are ordered by id, null first, and those that share an id by text;
each gets a row. A single row is its own next. Columns that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parts_for

SHINGLE = 5
#: Bins, which must be 2 to a power, and stored bits of each.
BINS, BITS = 256, 8
#: Bins that an empty one tries before it looks at all.
TRIES = 8
#: MB of input for a range of ids; several ranges go to a task, so that tasks come out even.
RANGE_MB = 2
#: Ranges at most, as their cuts are part of the plan; beyond, a range is larger and its sort spills.
MOST_RANGES = 50_000
_SPLIT = "[\\x20\\x09-\\x0D]+"
_LANES = 64 // BITS


def _let(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A 64-bit hash of each run of `size` words; of all words where there are fewer; none without words."""

    def of(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
        hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPLIT), "")
    return _let(F.transform(words, lambda w: F.xxhash64(w)), of)


def fingerprint(text: Column, bins: int = BINS, tries: int = TRIES) -> Column:
    """Packed low bits of the bins (array of 64-bit words), empty for a text without words."""
    shift = 64 - (bins.bit_length() - 1)
    free = (1 << shift) - 1  # what an empty bin holds: the largest hash of the bin

    def full(x: Column) -> Column:
        return x.bitwiseAND(F.lit(free)) != F.lit(free)

    def least(hashes: Column) -> Column:
        """The least hash of each bin; hashes are sorted and hold the largest one of every bin."""
        return F.filter(hashes, lambda x, i: (i == 0) | (F.shiftrightunsigned(x, shift) != F.shiftrightunsigned(F.get(hashes, F.greatest(i - 1, F.lit(0))), shift)))

    def dense(found: Column) -> Column:
        def borrow(j: Column) -> Column:
            tried = []
            for t in range(tries):
                other = F.get(found, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(bins)).cast("int"))
                tried.append(F.when(full(other), other))
            ranked = F.transform(found, lambda x, i: F.when(full(x), F.struct(F.xxhash64(j, i).alias("order"), x.alias("hash"))))
            return F.coalesce(*tried, F.array_min(ranked).getField("hash"))

        return F.transform(found, lambda x, j: F.when(full(x), x).otherwise(borrow(j)))

    def packed(found: Column) -> Column:
        def word(g: Column) -> Column:
            out = None
            for k in range(_LANES):
                lane = F.shiftleft(F.get(found, g * _LANES + k).bitwiseAND(F.lit((1 << BITS) - 1)), 64 - BITS * (k + 1))
                out = lane if out is None else out.bitwiseOR(lane)
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(bins // _LANES - 1)), word)

    ends = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda j: F.shiftleft(j.cast("bigint"), shift).bitwiseOR(F.lit(free)))

    def of(hashes: Column) -> Column:
        chain = _let(F.sort_array(F.concat(hashes, ends)), least)
        return F.when(F.size(hashes) > 0, _let(_let(chain, dense), packed)).otherwise(F.array().cast("array<bigint>"))

    return _let(shingle_hashes(text), of)


def likeness(a: Column, b: Column, bins: int = BINS) -> Column:
    """Estimated Jaccard likeness of the shingles of two packed fingerprints, from 0 to 1."""

    def unequal(x: Column, y: Column) -> Column:
        t = x.bitwiseXOR(y)
        step = BITS
        while step > 1:
            step //= 2
            mask = sum(((1 << step) - 1) << BITS * k for k in range(_LANES))
            t = t.bitwiseOR(F.shiftrightunsigned(t, step)).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        return F.bit_count(t)

    def estimate(differ: Column) -> Column:
        chance = 2.0**-BITS
        return F.greatest(F.lit(0.0), (1 - differ / bins - chance) / (1 - chance))

    differ = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x)
    both = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(both, estimate(differ)).otherwise((F.size(a) == F.size(b)).cast("double"))


def text_of(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def with_next(rows: DataFrame, n: int, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """rows with next_<c> of the row that follows in order (after the last: the first) for each of columns.

    key: a column of non-null 64-bit integers that comes first in the order. One shuffle, of n ranges or so.
    """
    facts = rows.agg(F.min(key).alias("low"), F.percentile_approx(key, [k / n for k in range(1, n)] or [0.5], 10 * n).alias("cuts")).first()
    cuts = sorted({c for c in facts.cuts or [] if c > facts.low})  # each opens a range, and exists
    steps = F.array(*(F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1))) if cuts else None
    if cuts:
        ids = F.lit(cuts).cast("array<bigint>")
        opens = lambda at: F.get(ids, at - 1)  # noqa: E731  the id at which range `at` begins
        place = F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (opens(at + s) <= F.col(key)), at + s).otherwise(at))  # binary search
    else:
        place = F.lit(0)
    rows = rows.withColumn("range", place)
    first = F.col(key) == (F.when(F.col("range") == 0, F.lit(facts.low)).otherwise(F.get(F.lit(cuts).cast("array<bigint>"), F.col("range") - 1)) if cuts else F.lit(facts.low))
    before = F.when(F.col("range") == 0, F.lit(len(cuts))).otherwise(F.col("range") - 1)
    own = F.struct(F.col("range").alias("at"), F.lit(False).alias("sentinel"))
    copies = F.when(first, F.array(own, F.struct(before.alias("at"), F.lit(True).alias("sentinel")))).otherwise(F.array(own))
    dealt = rows.withColumn("copy", F.explode(copies)).select("*", F.col("copy.at").alias("at"), F.col("copy.sentinel").alias("sentinel")).drop("copy", "range")
    line = Window.partitionBy("at").orderBy("sentinel", *order)
    return dealt.select("*", *(F.lead(c).over(line).alias(f"next_{c}") for c in columns)).where("not sentinel").drop("at", "sentinel")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited (text), packed, edited_packed, next_packed: each text, its edited text and the next one's.

    The edited text has the last half (rounded down) replaced by as many first characters of the next document's text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.coalesce("id", F.lit(-(1 << 63)).cast("long")).alias("key"), fingerprint(F.col("text")).alias("packed"))
    pairs = with_next(rows, parts_for(docs, RANGE_MB, MOST_RANGES), "key", ["key", "text"], ["text", "packed"])
    size = F.length("text")
    half = F.floor(size / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - half), F.substring("next_text", F.lit(1), half))
    out = pairs.select(F.col("id").alias(id_col), size.cast("long").alias("n_chars"), edited.alias("edited"), "packed", "next_packed")
    return out.select(id_col, "n_chars", "edited", "packed", "next_packed", fingerprint(F.col("edited")).alias("edited_packed"))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    out = compare_edited(docs, id_col, text_col)
    return out.select(
        id_col,
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        text_of(F.col("packed")).alias("fingerprint"),
        text_of(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("edited_packed")).alias("near_edited"),
        likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
