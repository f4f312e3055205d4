"""Judgements: counts by target, one vote a voter, run labels, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def votes_by_target(votes: DataFrame, target: str, counted: Column, voter: Column, at: str) -> DataFrame:
    """target, n, counted, voters, last."""
    return votes.groupBy(target).agg(F.count("*").alias("n"), F.count_if(counted).alias("counted"), F.countDistinct(voter).alias("voters"), F.max(at).alias("last"))


def counted_votes(votes: DataFrame) -> DataFrame:
    """votes with state: of a voter's approved votes on a target, in order, the first of each run of one thumb counts; the
    others are dismissed and point to it; the last run's vote is current, earlier ones are replaced.

    votes: voter, target, at, id, thumb.
    """
    line = Window.partitionBy("voter", "target").orderBy("at", "id")
    new = F.lag("thumb").over(line).isNull() | (F.lag("thumb").over(line) != F.col("thumb"))
    islands = votes.withColumn("_new", new).withColumn("_run", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = Window.partitionBy("voter", "target")
    head = F.min(F.when(F.col("_new"), F.struct("at", "id"))).over(Window.partitionBy("voter", "target", "_run"))["id"]
    state = F.when(~F.col("_new"), "dismissed").when(F.col("_run") == F.max("_run").over(runs), "current").otherwise("replaced")
    return islands.withColumn("state", state).withColumn("replaced_by", F.when(~F.col("_new"), head)).drop("_new", "_run")


def run_labels(labels: DataFrame, precedence: dict[str, int]) -> DataFrame:
    """run, success, source: the label of the source that goes first, the newest of it."""
    order = F.create_map(*(F.lit(x) for kv in precedence.items() for x in kv))
    rank = F.coalesce(F.try_element_at(order, F.col("source")), F.lit(-1))
    best = F.max(F.struct(rank.alias("r"), "at", "id", "success", "source"))
    return labels.groupBy("run").agg(best.alias("b")).select("run", "b.success", "b.source")


def review_counts(votes: DataFrame, by: str, state: str, states: list[str]) -> DataFrame:
    return votes.groupBy(by).pivot(state, states).count().na.fill(0, states)


def token_f1(predicted: Column, gold: Column) -> Column:
    """F1 of two arrays of words as multisets."""
    distinct = F.array_distinct(predicted)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    shared = F.aggregate(F.transform(distinct, lambda w: F.least(count(predicted, w), count(gold, w))), F.lit(0), lambda a, x: a + x)
    return F.when((F.size(predicted) == 0) | (F.size(gold) == 0) | (shared == 0), 0.0).otherwise(2.0 * shared / (F.size(predicted) + F.size(gold)))


def bleu1(predicted: Column, gold: Column) -> Column:
    """Share of predicted words that the gold answer has, each as often as there, with the brevity penalty."""
    distinct = F.array_distinct(predicted)
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    shared = F.aggregate(F.transform(distinct, lambda w: F.least(count(predicted, w), count(gold, w))), F.lit(0), lambda a, x: a + x)
    penalty = F.when(F.size(predicted) >= F.size(gold), 1.0).otherwise(F.exp(1 - F.size(gold) / F.size(predicted)))
    return F.when(F.size(predicted) == 0, 0.0).otherwise(penalty * shared / F.size(predicted))


def usage_daily(calls: DataFrame) -> DataFrame:
    """tenant, day, use, calls, tokens: the ledger of model use."""
    return calls.groupBy("tenant", F.to_date("at").alias("day"), "use").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))


def answer_step(votes: DataFrame, step: float = 0.05) -> DataFrame:
    """memory, steps in order of time: what verdicts on answers that cited a memory do to its confidence. votes: memory, at, id, up."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "id", F.when(F.col("up"), step).otherwise(-step).alias("d"))))
    return votes.groupBy("memory").agg(F.transform(ordered, lambda x: x["d"]).alias("steps"))
