"""Learned procedures: mined plans, bindings of arguments, status, hints for the next step, tool search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import scores as s
from sedge.operators import mining, retrieval


def mine(calls: DataFrame, outcomes: DataFrame) -> DataFrame:
    """pattern, path, size, support, runs, rate, last_used: the sequence that a pattern's successful runs share.

    calls: pattern and those of mining.steps(); outcomes: run, succeeded. All runs that follow the sequence count towards its rate.
    """
    stepped = mining.steps(calls).join(calls.select("run", "pattern").distinct(), "run").join(outcomes.select("run", "succeeded"), "run")
    best = mining.best_sequence(stepped.where("succeeded"), "pattern")
    line = Window.partitionBy("pattern", "run").orderBy("step")
    paths = stepped.withColumn("so_far", F.array_join(F.collect_list("tool").over(line.rowsBetween(Window.unboundedPreceding, 0)), ">"))
    follows = best.select("pattern", "path", "size").join(paths, "pattern").where("so_far = path")
    told = follows.groupBy("pattern", "path", "size").agg(F.count_if("succeeded").alias("support"), F.count_if(F.col("succeeded").isNotNull()).alias("runs"), F.max("at").alias("last_used"))
    return told.withColumn("rate", F.round(F.col("support") / F.col("runs"), 4))


def bindings(plan_steps: DataFrame, calls: DataFrame, field_values: DataFrame) -> DataFrame:
    """pattern, step, argument, source_step, source_field, constant: where each argument of a plan's step came from in most runs.

    plan_steps: pattern, step, tool. calls: pattern, run, step, tool, inputs (array of (field, value)). field_values: run, step,
    field, value of what earlier steps gave out. An argument of one value in all runs is a constant.
    """
    args = plan_steps.join(calls, ["pattern", "step", "tool"]).select("pattern", "run", "step", F.explode("inputs").alias("i")).select("pattern", "run", "step", F.col("i.field").alias("argument"), F.col("i.value").alias("value"))
    n = args.groupBy("pattern", "step", "argument").agg(F.countDistinct("run").alias("runs"), F.countDistinct("value").alias("kinds"), F.min("value").alias("only"))
    given = field_values.select("run", F.col("step").alias("source_step"), F.col("field").alias("source_field"), "value")
    met = args.join(given, ["run", "value"]).where("source_step < step").groupBy("pattern", "step", "argument", "source_step", "source_field").agg(F.countDistinct("run").alias("hits"))
    order = Window.partitionBy("pattern", "step", "argument").orderBy(F.desc("hits"), F.desc("source_step"), "source_field")
    best = met.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    both = n.join(best, ["pattern", "step", "argument"], "left")
    bound = F.col("hits") * 2 > F.col("runs")
    return both.select("pattern", "step", "argument", F.when(bound, F.col("source_step")).alias("source_step"), F.when(bound, F.col("source_field")).alias("source_field"), F.when(~F.coalesce(bound, F.lit(False)) & (F.col("kinds") == 1) & (F.col("runs") > 1), F.col("only")).alias("constant"))


def with_status(mined: DataFrame, rejected: DataFrame, now: Column) -> DataFrame:
    """mined with its status; a rejected plan stays rejected as long as its sequence is the same. rejected: pattern, path."""
    known = rejected.select("pattern", "path").distinct().withColumn("no", F.lit(True))
    idle = F.datediff(now, F.col("last_used"))
    return mined.join(known, ["pattern", "path"], "left").withColumn("status", s.procedure_status(F.col("support"), F.col("rate"), idle, F.coalesce("no", F.lit(False)))).drop("no")


def next_step(plans: DataFrame, done: DataFrame) -> DataFrame:
    """run, pattern, next_tool, position: the first step of a plan that a run's successful calls, matched in order, haven't reached.

    done: run, pattern, tools (array of the tools that worked, in order).
    """
    both = done.join(plans.select("pattern", F.split("path", ">").alias("plan")), "pattern")
    reached = F.aggregate("tools", F.lit(0), lambda at, tool: F.when(F.get("plan", at) == tool, at + 1).otherwise(at))
    return both.withColumn("position", reached).select("run", "pattern", F.get("plan", F.col("position")).alias("next_tool"), "position")


def filled(arguments: DataFrame, *sources: DataFrame) -> DataFrame:
    """run, argument, value, source: each argument from the first source that has one. arguments: run, argument; sources: run, argument, value."""
    out = arguments
    for k, source in enumerate(sources):
        one = source.groupBy("run", "argument").agg(F.min("value").alias(f"v{k}"))
        out = out.join(one, ["run", "argument"], "left")
    names = [f"v{k}" for k in range(len(sources))]
    which = F.coalesce(*(F.when(F.col(n).isNotNull(), F.lit(k)) for k, n in enumerate(names)))
    return out.select("run", "argument", F.coalesce(*names).alias("value"), which.alias("source"))


def tool_search(tasks: DataFrame, tools: DataFrame, limit: int = 10) -> DataFrame:
    """query, id, score, relevance, rank of tools by the words of their names and texts, two arms of equal weight."""
    items = tasks.select("item_id", "text")
    lexical = retrieval.bm25(items, tools, 50, doc_id="tool_id")
    shared = retrieval.shared_words(items, tools, 50, doc_id="tool_id")
    ranked = retrieval.fuse([(lexical, 1.0, "bm25"), (shared, 1.0, "words")], k=1, limit=limit)
    return ranked.withColumn("relevance", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query")), 6))
