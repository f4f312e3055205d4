"""Duplicates by text: exact, normalised, contained, by likeness; statements; connection candidates."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import text as t
from sedge.functions.python import flat_map

#: Of the words that two alike sets share, so many more than one must meet before a pair is counted.
SPARE = 0.02


def groups(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """kept (least id), n, key of each group of rows with an equal key. Partial counts come first, so copies cost little."""
    return rows.groupBy(key.alias("key")).agg(F.min(id_col).alias("kept"), F.count("*").alias("n"))


def marked(rows: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Each row's id with the id that is kept for its group."""
    keyed = rows.select(F.col(id_col).alias("id"), key.alias("key"))
    return keyed.join(keyed.groupBy("key").agg(F.min("id").alias("kept")), "key").select("id", "kept")


def contained(parts: DataFrame, holders: DataFrame, part_id: str, holder_id: str, text_col: str = "text", least: int = 25, gram: int = 12) -> DataFrame:
    """id, inside: parts whose normalised text, of `least` characters or more, is a part of a holder's; the least holder.

    Blocked without loss: a part's words but the first and last are whole words of its holder, so the second to fourth
    (or, of three or four words, the second) must be a run there. Parts of two words or one have a long word, whose first
    characters must be a gram of a long word there.
    """
    norm = lambda df, i: df.select(F.col(i).alias("id"), t.normalize(F.col(text_col)).alias("n")).withColumn("w", F.split("n", " "))
    longest = F.array_max(F.transform("w", lambda x: F.struct(F.length(x).alias("size"), x.alias("word"))))["word"]
    key = F.when(F.size("w") >= 5, F.array_join(F.slice("w", 2, 3), " ")).when(F.size("w") >= 3, F.get("w", F.lit(1))).otherwise(F.concat(F.lit("#"), F.substring(longest, 1, gram)))
    short = norm(parts, part_id).where(F.length("n") >= least).select("id", F.col("n").alias("part"), key.alias("key"))
    threes = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.array_join(F.slice("w", i, 3), " "))).otherwise(F.array().cast("array<string>"))
    long_words = F.filter("w", lambda x: F.length(x) >= gram)
    grams = F.flatten(F.transform(long_words, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - gram + 1), lambda i: F.concat(F.lit("#"), F.substring(x, i, F.lit(gram))))))
    keys = F.array_distinct(F.concat("w", threes, grams))
    held = norm(holders, holder_id).where(F.length("n") >= least).select(F.col("id").alias("inside"), "n", keys.alias("keys"))
    # explode_outer: for explode() the optimizer would filter on the size of an array that it then computes once for each element
    met = short.join(held.select("inside", F.explode_outer("keys").alias("key")), "key").select("id", "inside").distinct()
    both = met.join(short.select("id", "part"), "id").join(held.select("inside", "n"), "inside").where(F.col("n").contains(F.col("part")))
    return both.groupBy("id").agg(F.min("inside").alias("inside"), F.count("*").alias("holders"))


def commonness(rows: DataFrame, id_col: str, found: Column | None = None) -> dict[str, int]:
    """Words by rising count, learnt from one in 16 rows. Any order and any choice of words give the same pairs, these few candidates and short codes."""
    some = rows.where(F.pmod(F.xxhash64(id_col), F.lit(16)) == 0)
    least = max(4, some.count() // 16384)
    words = some.select(F.explode_outer(t.tokens(F.col("text")) if found is None else found).alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).collect()
    return {r.word: k for k, r in enumerate(sorted((r for r in counts if r.word), key=lambda r: (r.n, r.word)))}


def word_sets(rows: DataFrame, id_col: str, order: dict[str, int], found: Column | None = None, within: str | None = None) -> DataFrame:
    """id, part, size, words of each row that has an id and a part, dealt by its id; part is the value of `within`, found its words (else those of text).

    words: words that `order` lacks, in order and between spaces, a line end, then the others' places there in rising order, as
    steps, their first bytes, then the second, third and fourth. Equal sets have equal bytes; an exchange packs them to a byte or two a word.
    """
    part = F.lit("") if within is None else F.col(within).cast("string")
    kept = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), part.alias("part"), F.array_join(t.tokens(F.col("text")) if found is None else found, " ").alias("w"))

    def coded(i, part, w):
        if part is None:
            return
        words = w.split(" ") if w else []
        known = np.sort(np.array([order[x] for x in words if x in order], "<u4"))
        steps = np.diff(known, prepend=np.zeros(1, "<u4")).astype("<u4")
        yield i, part, len(words), " ".join(sorted(x for x in words if x not in order)).encode() + b"\n" + steps.view("u1").reshape(-1, 4).T.tobytes()

    return flat_map(kept, coded, f"id {kept.schema['id'].dataType.simpleString()}, part string, size int, words binary").where("id is not null and part is not null and words is not null").repartition("id")


def _places(words: bytes) -> tuple[list[str], np.ndarray]:
    """The words that the order lacks, and the places of the others."""
    cut = words.index(b"\n")
    steps = np.frombuffer(words, "u1", offset=cut + 1).reshape(4, -1).T.copy().view("<u4")
    return words[:cut].decode().split(" ") if cut else [], np.cumsum(steps, dtype="i8")


def alike(a: DataFrame, b: DataFrame, least: float) -> DataFrame:
    """a, b, jaccard, and the numbers of words shared and in all, of rows of `word_sets`, of one order, that are alike in one part.

    a and b may be the same rows, then they are read once.

    Words stand in one order, rarer ones first. Two sets that share `need` words share need - rest of those that stand before the
    last `rest` of either, whatever the rest: with one near to need only few, rare words meet, and pairs that share too few of them
    aren't looked at. Their words go only to the pairs that are left, which are counted exactly.
    """
    low = least - 5e-7  # likeness is rounded to 6 places
    part_of = low / (1 + low)

    def prefix(i, part, size, words):
        if not size:
            return
        need = math.ceil((size + math.ceil(size * low - 1e-6)) * part_of - 1e-6)  # with the smallest set that can be alike
        n = size - (need - math.floor(need * SPARE) - 1) + 1
        rare, known = _places(words)
        yield i, part, size, (rare + [f"\n{k}" for k in known[: max(0, n - len(rare))].tolist()])[:n]

    def postings(rows: DataFrame, name: str) -> DataFrame:
        flat = flat_map(rows.select("id", "part", "size", "words"), prefix, f"id {rows.schema['id'].dataType.simpleString()}, part string, size int, first array<string>")
        each = flat.select("id", "size", "part", F.posexplode("first").alias("place", "word"))
        return each.select(F.col("id").alias(name), F.col("size").alias(f"{name}_size"), F.col("place").alias(f"{name}_place"), F.xxhash64("part", "word").alias("key"))

    need = F.ceil((F.col("a_size") + F.col("b_size")) * F.lit(part_of) - 1e-6)
    rest = need - F.floor(need * SPARE) - 1
    sizes = (F.col("a_size") >= low * F.col("b_size")) & (F.col("b_size") >= low * F.col("a_size"))
    early = (F.col("a_place") < F.col("a_size") - rest) & (F.col("b_place") < F.col("b_size") - rest)
    met = postings(a, "a").join(postings(b, "b"), "key").where(sizes & early).groupBy("a", "b").agg(F.count("*").alias("n"), F.min((need - rest).cast("int")).alias("need")).where("n >= need").select("a", "b")
    side = lambda rows, name: rows.select(F.col("id").alias(name), F.col("part").alias(f"{name}_part"), F.col("size").alias(f"{name}_size"), F.col("words").alias(f"{name}_words"))
    both = met.join(side(a, "a"), "a").join(side(b, "b"), "b").where("a_part >= b_part and a_part <= b_part")  # "=" would deal rows by it too
    schema = f"a {a.schema['id'].dataType.simpleString()}, b {b.schema['id'].dataType.simpleString()}, shared int, total int"
    last = [b"", None]  # pairs come in order of b, so its words are unpacked once

    def count(a_id, b_id, x, y, x_size, y_size):
        if last[0] != y:
            rare, known = _places(y)
            last[:] = y, (set(rare), known)
        rare, known = _places(x)
        k = len(last[1][0].intersection(rare)) + len(np.intersect1d(known, last[1][1], assume_unique=True))
        yield a_id, b_id, k, x_size + y_size - k

    counted = flat_map(both.select("a", "b", "a_words", "b_words", "a_size", "b_size"), count, schema)
    return counted.select("a", "b", F.round(F.col("shared") / F.col("total"), 6).alias("jaccard"), "shared", "total").where(F.col("jaccard") >= least)


def likeness_pairs(left: DataFrame, right: DataFrame, least: float, left_id: str, right_id: str, within: str | None = None) -> DataFrame:
    """a, b, jaccard of pairs whose sets of words are alike (no pair without a shared word is looked at); see `alike`.

    within: a column of both sides that pairs must agree in; a word of another value is another word then.
    """
    order = commonness(left, left_id)
    a = word_sets(left, left_id, order, within=within)
    return alike(a, a if left is right and left_id == right_id else word_sets(right, right_id, order, within=within), least).drop("shared", "total")


def statements(hits: DataFrame) -> DataFrame:
    """Forms of one statement (query, speaker, said_at) as one: best rank of each arm, closed up, and the standing form.

    hits: query, arm, id, rank, speaker, said_at, referred, verbatim.
    """
    best = hits.groupBy("query", "arm", "speaker", "said_at").agg(F.min("rank").alias("rank"), F.min(F.struct((~F.col("referred")).alias("a"), (~F.col("verbatim")).alias("b"), "rank", "id")).alias("form"))
    closed = F.dense_rank().over(Window.partitionBy("query", "arm").orderBy("rank"))
    return best.select("query", "arm", "speaker", "said_at", F.col("form.id").alias("id"), closed.alias("rank"))
