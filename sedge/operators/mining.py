"""Process mining over tool calls: steps, edges, support, sequences, outcomes, statistics, approvals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values.
MIN_PATH_COVERAGE = 0.5
# Ends of fixed values.

RUN = ["run"]


def steps(calls: DataFrame) -> DataFrame:
    """run, step, tool, ok, latency, at, tries: consecutive calls of one tool as one step, the last that worked, or else the last.

    calls: run, at, call, tool, ok, latency.
    """
    line = Window.partitionBy("run").orderBy("at", "call")
    new = (F.lag("tool").over(line).isNull() | (F.lag("tool").over(line) != F.col("tool"))).cast("int")
    islands = calls.withColumn("_new", new).withColumn("step", F.sum("_new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max(F.struct("ok", "at", "call", "tool", "latency")).alias("s")
    return islands.groupBy("run", "step").agg(best, F.count("*").alias("tries")).select("run", "step", "s.tool", "s.ok", "s.latency", "s.at", "tries")


def followed_by(stepped: DataFrame) -> DataFrame:
    """run, source, target, ok, latency for each step that another one follows."""
    line = Window.partitionBy("run").orderBy("step")
    return stepped.withColumn("source", F.lag("tool").over(line)).where("source is not null").select("run", "source", F.col("tool").alias("target"), "ok", "latency")


def feeds(calls: DataFrame) -> DataFrame:
    """source, target, field, n: values that a successful call gave out and a later call of the run took in.

    calls: run, at, call, tool, ok, outputs and inputs (arrays of (field, value)). An equi-join on (run, value); of a value that
    several earlier calls gave, each giving tool counts once for a taking call.
    """
    out = calls.where("ok").select("run", F.col("at").alias("out_at"), F.col("tool").alias("source"), F.explode("outputs").alias("o")).select("run", "out_at", "source", F.col("o.value").alias("value"))
    took = calls.select("run", "at", "call", F.col("tool").alias("target"), F.explode("inputs").alias("i")).select("run", "at", "call", "target", F.col("i.field").alias("field"), F.col("i.value").alias("value"))
    met = took.join(out, ["run", "value"]).where("out_at < at").select("run", "call", "source", "target", "field").distinct()
    return met.groupBy("source", "target", "field").agg(F.count("*").alias("n"))


def edge_support(edges: DataFrame) -> DataFrame:
    """source, target, support, successes, failures, success_rate, median_latency (of the successes)."""
    ok = F.col("ok")
    grouped = edges.groupBy("source", "target").agg(F.countDistinct("run").alias("support"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), F.round(F.median(F.when(ok, F.col("latency"))), 6).alias("median_latency"))
    return grouped.withColumn("success_rate", F.round(F.col("successes") / (F.col("successes") + F.col("failures")), 6))


def best_sequence(stepped: DataFrame, by: str, coverage: float = MIN_PATH_COVERAGE) -> DataFrame:
    """by, path, support: the longest prefix of tools that enough runs follow, or else the best supported one.

    stepped: by, run, step, tool. A run gives each of its prefixes, so it costs the square of its steps, of which runs have few.
    """
    line = Window.partitionBy(by, "run").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = stepped.withColumn("path", F.array_join(F.collect_list("tool").over(line), ">")).withColumn("size", F.count("*").over(line))
    runs = stepped.groupBy(by).agg(F.countDistinct("run").alias("runs"))
    counted = prefixes.groupBy(by, "path", "size").agg(F.count("*").alias("support")).join(runs, by)
    enough = F.col("support") >= F.greatest(F.lit(2), F.ceil(coverage * F.col("runs")))
    order = Window.partitionBy(by).orderBy(F.desc(enough), F.desc(F.when(enough, F.col("size")).otherwise(F.col("support"))), F.desc(F.when(enough, F.col("support")).otherwise(F.col("size"))), F.asc("path"))
    return counted.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(by, "path", "size", "support")


def run_outcome(calls: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """run, n, succeeded: the label; else false where a call failed; else unknown. labels: run, success, source, teaches."""
    clean = calls.groupBy("run").agg(F.count("*").alias("n"), F.bool_and("ok").alias("clean"))
    if labels is None:
        return clean.select("run", "n", F.when(~F.col("clean"), False).alias("succeeded"))
    both = clean.join(labels, "run", "left")
    by_system = (F.col("source") == "system") & ~F.col("success") & F.col("clean")
    told = F.when(F.col("success").isNull(), F.when(~F.col("clean"), False)).when(~F.col("teaches") | by_system, F.lit(None).cast("boolean")).otherwise(F.col("success"))
    return both.select("run", "n", told.alias("succeeded"))


def tool_stats(calls: DataFrame, by: list[str]) -> DataFrame:
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.count_if("ok").alias("successes"), F.round(F.sum("latency"), 4).alias("latency_sum"), F.max("at").alias("last_used"))


def approval_patterns(votes: DataFrame, by: list[str], least: int) -> DataFrame:
    """by.., support, approved, reviewers, suggestion. votes: by.., approved, reviewer, reversible."""
    grouped = votes.groupBy(*by).agg(F.count("*").alias("support"), F.count_if("approved").alias("approved"), F.countDistinct(F.coalesce("reviewer", F.lit(""))).alias("reviewers"), F.bool_and("reversible").alias("reversible"))
    rate = F.col("approved") / F.col("support")
    said = F.when(~F.col("reversible") | (F.col("support") < 5), "ask").when((rate >= 0.95) & (F.col("reviewers") >= 2), "auto").when(rate <= 0.5, "always_ask").otherwise("ask")
    return grouped.where(F.col("support") >= least).select(*by, "support", "approved", "reviewers", said.alias("suggestion"))


def rank_procedures(found: DataFrame, by: str, alike: Column) -> DataFrame:
    """found with position: those alike in words by .6 or more first, then by meaning; ties by rate, support and id."""
    tier = F.when(alike >= 0.6, 0).otherwise(1)
    order = Window.partitionBy(by).orderBy(tier, F.desc("score"), F.desc("rate"), F.desc("support"), F.asc("id"))
    return found.withColumn("position", F.row_number().over(order))
