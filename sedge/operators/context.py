"""What an answer is given: rendered pages of facts, timelines, pinned sections, standing rules, cached bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import text as t


def handles(items: DataFrame, by: str, letter: str, *order: Column) -> DataFrame:
    """items with the short name by which an answer cites them, such as m1."""
    return items.withColumn("handle", F.concat(F.lit(letter), F.row_number().over(Window.partitionBy(by).orderBy(*order)).cast("string")))


def timeline(items: DataFrame, by: str) -> DataFrame:
    """by, lines: a line for each dated item in order of time, its handle in front. items: by, handle, at, text."""
    line = F.concat(F.lit("["), F.col("handle"), F.lit("] "), F.date_format("at", "yyyy-MM-dd"), F.lit(": "), F.col("text"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "handle", line.alias("line")))), lambda x: x["line"])
    return items.groupBy(by).agg(F.array_join(ordered, "\n").alias("lines"))


def person_page(beliefs: DataFrame, facets: list[str], history: int = 3) -> DataFrame:
    """person, page: lines by facet, then by date; of earlier values the newest few, each with the day until which it held.

    beliefs: person, facet, text, since, until.
    """
    past = F.row_number().over(Window.partitionBy("person", "facet", F.col("until").isNotNull()).orderBy(F.desc(F.coalesce("until", "since")), "text"))
    kept = beliefs.withColumn("n", past).where(F.col("until").isNull() | (F.col("n") <= history))
    place = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(f) for f in facets)), F.col("facet")), F.lit(0)), F.lit(len(facets) + 1))
    line = F.concat(F.col("text"), F.when(F.col("until").isNotNull(), F.concat(F.lit(" (until "), F.date_format("until", "yyyy-MM-dd"), F.lit(")"))).otherwise(""))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(place.alias("p"), F.col("until").isNotNull().alias("old"), "since", "text", line.alias("line")))), lambda x: x["line"])
    return kept.groupBy("person").agg(F.array_join(ordered, "\n").alias("page"))


def pinned(sections: DataFrame, budget: int, share: float = 0.5, order: tuple[str, ...] = ("profile", "thread_summary", "skills", "tools", "people")) -> DataFrame:
    """by, section, tokens of the sections that fit into a share of the budget, in their fixed order. sections: query, section, tokens."""
    place = F.array_position(F.array(*(F.lit(x) for x in order)), F.col("section"))
    line = Window.partitionBy("query").orderBy(place, "section")
    used = F.sum("tokens").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return sections.withColumn("used", used).where(F.col("used") <= int(budget * share))


def standing(rules: DataFrame, tasks: DataFrame, least: int = 1) -> DataFrame:
    """task, rule, shared: a person's rules that apply to a task of theirs, as both share words or the rule always holds.

    rules: rule, person, text, always; tasks: task, person, text.
    """
    words = lambda df, key: df.select(key, "person", F.explode_outer(t.tokens(F.col("text"))).alias("word"))
    by_word = words(rules, "rule").where("word is not null").join(words(tasks, "task"), ["person", "word"]).groupBy("task", "rule").agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    general = tasks.select("task", "person").join(rules.where("always").select("rule", "person"), "person").select("task", "rule", F.lit(0).cast("long").alias("shared"))
    return by_word.union(general.join(by_word.select("task", "rule"), ["task", "rule"], "left_anti"))


def guarded_signature(question: Column, scope: Column) -> Column:
    """Key of a cached answer: the scope, the figures and negation of the question, which near-equal vectors may not tell apart."""
    return F.sha2(F.concat_ws("|", scope, F.array_join(F.array_sort(t.figures(question)), ","), t.has_negation(question).cast("string")), 256)


def cached(asked: DataFrame, kept: DataFrame, least: float = 0.98) -> DataFrame:
    """query, bundle, near: the nearest kept bundle under the same signature. Both: signature, vector of length one; kept also revision, current."""
    dot = F.aggregate(F.zip_with("vector", "v", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    met = asked.join(kept.where("revision = current").select("signature", "bundle", F.col("vector").alias("v")), "signature").withColumn("near", F.round(dot, 6)).where(F.col("near") >= least)
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("near"), "bundle"))).where("_n = 1").select("query", "bundle", "near")


def evidence_status(found: Column, exact: Column, shares_term: Column, subject_supported: Column, missing: Column, packed: Column, companions_cut: Column) -> Column:
    """INSUFFICIENT, INCOMPLETE or COMPLETE by the first rule that holds."""
    return (
        F.when(~found | ~packed, "INSUFFICIENT")
        .when(exact, "COMPLETE")
        .when(~shares_term, "INSUFFICIENT")
        .when(~subject_supported | missing | companions_cut, "INCOMPLETE")
        .otherwise("COMPLETE")
    )
