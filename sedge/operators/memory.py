"""Memories: consolidation of new statements with held ones, admission, commands, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.functions import scores as s
from sedge.functions import text as t
from sedge.operators import dedup
from sedge.operators.graph import shared_table

# Fixed values.
SINGLE_VALUED = (
    "name timezone time_zone role title team email location birthday manager company employer city country language pronouns phone department working_hours handle username works_at lives_in favourite"
).split()
SINGLE_VALUED_PREFIX = "favourite_"
LEXICAL, OVERLAP = 0.92, 0.3
LIFETIMES = {"preference": "long_term", "fact": "long_term", "instruction": "short_term", "task": "short_term", "episodic": "long_term", "working": "ephemeral"}
# Ends of fixed values.


def single_valued(predicate: Column) -> Column:
    """A new value of this predicate replaces the one before."""
    return F.coalesce(predicate.isin(SINGLE_VALUED) | predicate.startswith(SINGLE_VALUED_PREFIX), F.lit(False))


def clean_object(value: Column) -> Column:
    return t.normalize(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?i)^\s*(?:the|a|an|my)\s+", ""))


def features(statements: DataFrame) -> DataFrame:
    """What `consolidate` compares of statements, in place of subject, object and content: slot, value, hash, marks (figures and negation), w (words)."""
    content = F.col("content")
    marks = F.concat(F.array_join(F.array_sort(t.figures(content)), "\n"), F.when(t.has_negation(content), "\nnot").otherwise(""))
    made = {"slot": F.lower(F.trim("subject")), "value": clean_object(F.col("object")), "hash": t.normalized_hash(content), "marks": marks, "w": F.array_join(F.array_sort(t.tokens(content)), " ")}
    return statements.withColumns(made).drop("subject", "object", "content")


def consolidate(new: DataFrame, held: DataFrame) -> DataFrame:
    """id, decision, target, score, reason for each new statement against the current ones of its scope.

    Both: id, scope, owner, subject, predicate, object, content (or what `features` makes of them); new also negates (whether it
    says that it replaces something), held also shared (others may read it). Pairs meet on equal content, on one value of one slot,
    on the slot alone where a new value replaces the one before or the statement says so, or on words alike enough to be the same
    statement, so neither a scope nor a slot of many values is joined with itself. The first rung that holds decides; the writer's
    own statements go first. Texts are read once and don't go into joins; words are compared for statements that no rung before decides.
    """
    read = lambda df, name: df if "hash" in df.columns else shared_table(features(df), name)
    a, b = read(new, "new"), read(held, "held")
    words = F.split("w", " ")
    order = dedup.commonness(a, "id", words)
    slot, valued, h_valued = ["scope", "slot", "predicate"], F.col("value") != "", F.col("h_value") != ""
    foreign = (F.col("owner") != F.col("h_owner")).cast("int").alias("foreign")
    step = lambda n, decision, score, reason: F.struct(F.lit(n).alias("rung"), F.lit(decision).alias("decision"), F.round(score, 4).alias("score"), F.lit(reason).alias("reason"))
    rows = lambda df, own: df.select("id", "target", foreign, own.alias("own")).where("own is not null")
    told = lambda *columns: b.select(F.col("id").alias("target"), F.col("owner").alias("h_owner"), *columns)

    identical = rows(a.select("id", "owner", "scope", "hash").join(told("scope", "hash"), ["scope", "hash"]), step(1, "REINFORCE", F.lit(1.0), "identical"))
    same_value = rows(a.where(valued).select("id", "owner", *slot, "value").join(told(*slot, "value"), [*slot, "value"]), step(2, "REINFORCE", F.lit(0.98), "same value"))
    replacing = a.where((single_valued(F.col("predicate")) & valued) | F.col("negates")).select("id", "owner", *slot, "value", "negates").join(told(*slot, F.col("value").alias("h_value"), "shared"), slot)
    new_value = valued & h_valued & single_valued(F.col("predicate"))
    another = F.col("h_owner").isNotNull() & (F.col("owner") != F.col("h_owner")) & F.col("shared") & ~F.col("negates")
    by_slot = rows(replacing, F.when(new_value & another, step(3, "CONTRADICT", F.lit(0.9), "another's value")).when(new_value, step(3, "SUPERSEDE", F.lit(0.95), "new value")))
    said = replacing.where(F.col("negates") & ~F.coalesce(new_value, F.lit(False))).select("id", "owner", "target", "h_owner").join(a.select("id", "w"), "id").join(b.select(F.col("id").alias("target"), F.col("w").alias("h_w")), "target")
    share = F.when((F.col("w") != "") & (F.col("h_w") != ""), t.jaccard(words, F.split("h_w", " "))).otherwise(0.0)
    in_words = rows(said.withColumn("share", share), F.when(F.col("share") >= OVERLAP, step(4, "SUPERSEDE", 0.8 + F.col("share") / 5, "replaced in words")))
    sooner = identical.union(same_value).union(by_slot).union(in_words)

    open_sets = dedup.word_sets(a, "id", order, words, "scope").join(sooner.select("id"), "id", "left_anti")
    near = dedup.alike(open_sets, dedup.word_sets(b, "id", order, words, "scope"), LEXICAL).select(F.col("a").alias("id"), F.col("b").alias("target"), (F.col("shared") / F.col("total")).alias("share"))
    near = near.join(a.select("id", "owner", "marks"), "id").join(told(F.col("marks").alias("h_marks")), "target").where((F.col("share") >= LEXICAL) & (F.col("marks") == F.col("h_marks")))
    by_words = rows(near, F.when(F.col("share") == 1.0, step(5, "REINFORCE", F.col("share"), "same words")).otherwise(step(5, "MERGE", F.col("share"), "nearly the same words")))

    first = F.min(F.struct(F.col("own.rung").alias("rung"), "foreign", (-F.col("own.score")).alias("less"), "target", "own")).alias("first")
    out = a.select("id").join(sooner.union(by_words).groupBy("id").agg(first), "id", "left").select("id", "first.own", "first.target")
    return out.select("id", F.coalesce("own.decision", F.lit("CREATE")).alias("decision"), "target", F.coalesce("own.score", F.lit(0.0)).alias("score"), F.coalesce("own.reason", F.lit("new")).alias("reason"))


def applied(new: DataFrame, held: DataFrame, decided: DataFrame) -> DataFrame:
    """held and new after the decisions: id, content, status, reinforcement, replaced_by, contradicts.

    Reinforced ones count up and what they restate is not kept; superseded ones are closed and point to the statement that
    replaced them (the newest by since, if several did); contradictions keep both.
    """
    told = decided.where("target is not null").join(new.select("id", "since"), "id")
    hits = told.groupBy("target").agg(
        F.count_if(F.col("decision").isin("REINFORCE", "MERGE")).alias("more"),
        F.max(F.when(F.col("decision") == "SUPERSEDE", F.struct("since", "id"))).alias("by"),
        F.array_sort(F.collect_list(F.when(F.col("decision") == "CONTRADICT", F.col("id")))).alias("contradicts"),
    )
    old = held.join(hits, held.id == hits.target, "left").select(held.id, "content", F.when(F.col("by").isNotNull(), "SUPERSEDED").otherwise("CURRENT").alias("status"), (F.coalesce("reinforcement", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("reinforcement"), F.col("by.id").alias("replaced_by"), F.coalesce("contradicts", F.array().cast("array<string>")).alias("contradicts"))
    kept = new.join(decided.where("decision in ('CREATE', 'SUPERSEDE', 'CONTRADICT')").select("id", "decision", "target"), "id")
    fresh = kept.select("id", "content", F.lit("CURRENT").alias("status"), F.lit(0).cast("long").alias("reinforcement"), F.lit(None).cast("string").alias("replaced_by"), F.when(F.col("decision") == "CONTRADICT", F.array("target")).otherwise(F.array().cast("array<string>")).alias("contradicts"))
    return old.union(fresh)


def admit(candidates: DataFrame) -> DataFrame:
    """candidates with worthiness, score and verdict. candidates: kind, lifetime, decision, confidence, importance, age_days, hinted, transient, generic."""
    worth = s.worthiness(F.col("kind"), F.col("confidence"), F.col("hinted"), F.col("transient"), F.col("generic"))
    score = s.admission_score(worth, F.col("decision"), F.col("confidence"), s.utility(F.col("lifetime"), F.col("importance"), F.col("age_days")))
    return candidates.withColumn("worthiness", worth).withColumn("score", score).withColumn("verdict", s.admission_verdict(worth, F.col("decision"), F.col("confidence"), score))


def sweep(memories: DataFrame, now: Column, threshold: float = 0.05, idle: float = 30.0, half_life: float = 30.0) -> DataFrame:
    """memories with forgetting score and the status after a sweep: those long idle and under the threshold are archived; lasting ones stay."""
    days = F.timestamp_diff("MICROSECOND", F.greatest("updated_at", F.coalesce("accessed_at", "updated_at"), "created_at"), now) / 86400e6
    score = s.forgetting_score(F.col("importance"), days, F.col("accesses") + F.col("reinforcement"), half_life)
    goes = (F.col("status") == "CURRENT") & ~F.col("lasting") & (days >= idle) & (score < threshold)
    return memories.withColumn("forgetting", score).withColumn("status", F.when(goes, "ARCHIVED").otherwise(F.col("status")))


def source_audience(sources: DataFrame) -> DataFrame:
    """derived, keys: who may read what derives from several sources: those who may read every one of them."""
    n = sources.groupBy("derived").agg(F.countDistinct("source").alias("n"))
    per = sources.select("derived", "source", F.explode("keys").alias("key")).distinct().groupBy("derived", "key").agg(F.count("*").alias("k"))
    kept = per.join(n, "derived").where("k = n").groupBy("derived").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    return n.select("derived").join(kept, "derived", "left").select("derived", F.coalesce("keys", F.array().cast("array<string>")).alias("keys"))


def corroborated(deferred: DataFrame) -> DataFrame:
    """Deferred statements that were said again in their scope, at the time when they were: scope, hash, id of the first, admitted_at.

    deferred: id, scope, content, at.
    """
    line = Window.partitionBy("scope", "hash").orderBy("at", "id")
    rows = deferred.withColumn("hash", t.normalized_hash(F.col("content"))).withColumn("n", F.row_number().over(line)).withColumn("first", F.first("id").over(line))
    return rows.where("n = 2").select("scope", "hash", F.col("first").alias("id"), F.col("at").alias("admitted_at"))


def built(candidates: DataFrame, now: Column, ttl_days: dict[str, int]) -> DataFrame:
    """candidates as memory rows: an id that a rerun gives again, content hash, lifetime by kind, and when it expires."""
    life = F.create_map(*(F.lit(x) for kv in LIFETIMES.items() for x in kv))
    days = F.create_map(*(F.lit(x) for kv in ttl_days.items() for x in kv))
    lifetime = F.coalesce(F.try_element_at(life, F.col("kind")), F.lit("long_term"))
    key = F.concat(F.lit("mem_"), F.sha2(F.concat_ws("\u0001", "scope", "subject", "predicate", t.normalize(F.col("content"))), 256))
    rows = candidates.withColumn("memory_id", key).withColumn("hash", t.normalized_hash(F.col("content"))).withColumn("lifetime", lifetime)
    return rows.withColumn("expires_at", now + F.make_dt_interval(F.try_element_at(days, F.col("lifetime"))))
