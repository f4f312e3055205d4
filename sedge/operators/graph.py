"""Property graphs of entities and dated relations: neighbourhoods, profiles, closures, chains, names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What makes two relations one assertion.
IDENTITY = ["subject", "predicate", "object", "valid_from", "valid_to"]


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """df written to the folder that all executors share (checkpoint() where that is a directory), to cut its lineage."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    import tempfile

    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedge-"))  # tests only: no shared folder is named
    return df.checkpoint()


def best_assertions(relations: DataFrame) -> DataFrame:
    """One relation of each assertion: the surest, then the one of most mentions, the newest, the least id."""
    order = Window.partitionBy(*IDENTITY).orderBy(F.desc("confidence"), F.desc("mentions"), F.desc("observed_at"), F.asc("id"))
    return relations.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def both_ends(relations: DataFrame) -> DataFrame:
    """Each relation seen from either end, as (here, there): two equi-joins instead of one with OR."""
    return relations.select(F.col("subject").alias("here"), F.col("object").alias("there"), F.lit(0).alias("side"), "*").union(relations.select(F.col("object"), F.col("subject"), F.lit(1), "*"))


def neighbourhood(seeds: DataFrame, relations: DataFrame, hops: int, visible: Column | None = None, max_visited: int | None = None) -> DataFrame:
    """id, hop of the relations within so many hops of the seeds (entity); an assertion counts at the first hop that meets it.

    With max_visited, a hop takes on the first so many new entities by order of the relations that meet them.
    """
    edges = best_assertions(relations if visible is None else relations.where(visible))
    ends = both_ends(edges)
    visited = seeds.select("entity").distinct()
    frontier, found = visited, None
    for hop in range(1, hops + 1):
        met = ends.join(frontier, F.col("here") == F.col("entity"), "left_semi")
        new = met.select("id", "there", "side", "confidence", "mentions", "observed_at")
        if found is not None:
            new = new.join(found.select("id"), "id", "left_anti")
        new = shared_table(new, "hop")
        step = new.select("id").distinct().withColumn("hop", F.lit(hop))
        found = step if found is None else found.union(step)
        reached = new.groupBy(F.col("there").alias("entity")).agg(F.min(F.struct(-F.col("confidence"), -F.col("mentions"), "id", "side")).alias("first"))
        reached = reached.join(visited, "entity", "left_anti")
        if max_visited:
            reached = reached.orderBy("first", "entity").limit(max_visited)
        frontier = shared_table(reached.select("entity"), "frontier")
        visited = visited.union(frontier)
    return found


def profile(relations: DataFrame, now: Column, current: int = 50, past: int = 20) -> DataFrame:
    """entity, predicate, object, state: each entity's current value of every predicate, and what held before, newest first."""
    held = (F.col("valid_to").isNull()) | (F.col("valid_to") > now)
    line = Window.partitionBy("subject", "predicate", "held").orderBy(F.desc("observed_at"), F.desc("confidence"), F.asc("id"))
    ranked = relations.withColumn("held", held).withColumn("n", F.row_number().over(line))
    state = F.when(F.col("held") & (F.col("n") == 1), "current").otherwise("history")
    told = ranked.withColumn("state", state)
    place = F.row_number().over(Window.partitionBy("subject", "state").orderBy(F.desc("observed_at"), F.asc("id")))
    return told.withColumn("place", place).where(F.col("place") <= F.when(F.col("state") == "current", current).otherwise(past)).select(F.col("subject").alias("entity"), "predicate", "object", "state", "place", "id")


def search_names(entities: DataFrame, prefix: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """Entities whose name begins so, most mentioned first."""
    found = entities.where(F.lower("name").startswith(prefix.lower()))
    return (found if kind is None else found.where(F.col("kind") == kind)).orderBy(F.desc("mentions"), F.asc("name"), F.asc("entity")).limit(limit)


def query_names(queries: DataFrame, entities: DataFrame, most: int = 36) -> DataFrame:
    """query, entity: entities whose canonical name or alias is a run of three, two or one words of the query."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("([\\p{L}\\p{N}]+)"), 1)
    grams = F.concat(*(F.when(F.size("w") >= n, _grams(n)).otherwise(F.array().cast("array<string>")) for n in (3, 2, 1)))
    terms = queries.select("query", words.alias("w")).select("query", F.explode(F.slice(F.array_distinct(grams), 1, most)).alias("name"))
    names = entities.select("entity", F.explode(F.array_distinct(F.concat(F.array(F.lower("name")), F.transform("aliases", F.lower)))).alias("name"))
    return terms.join(names, "name").groupBy("query", "entity").agg(F.max(F.length("name")).alias("size"))


def _grams(n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size("w") - (n - 1)), lambda i: F.array_join(F.slice("w", i, n), " "))


def closure(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node: everything that derives from the start nodes, cycles or not. edges: source, derived. Rounds end when one adds nothing."""
    seen = start.select("node").distinct()
    frontier = seen
    while True:
        step = edges.join(frontier, F.col("source") == F.col("node"), "left_semi").select(F.col("derived").alias("node")).distinct()
        frontier = shared_table(step.join(seen, "node", "left_anti"), "closure")
        if frontier.isEmpty():
            return seen
        seen = shared_table(seen.union(frontier), "seen")


def prune_chains(rows: DataFrame, keep: int) -> DataFrame:
    """rows (id, replaced_by) that lie more than `keep` replacements behind the head of their chain, with the head and depth.

    Pointers are doubled: after k rounds each row knows its 2**k-th successor, so a chain of n takes log2(n) rounds.
    """
    now = rows.select("id", F.coalesce("replaced_by", "id").alias("to"), F.when(F.col("replaced_by").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    while True:
        nxt = now.alias("a").join(now.alias("b"), F.col("a.to") == F.col("b.id"), "left").select("a.id", F.coalesce("b.to", "a.to").alias("to"), (F.col("a.depth") + F.when(F.col("a.to") != F.col("a.id"), F.coalesce("b.depth", F.lit(0))).otherwise(0)).alias("depth"))
        nxt = shared_table(nxt, "chain")
        moved = nxt.join(now.withColumnRenamed("to", "old"), "id").where("to <> old").isEmpty()
        now = nxt
        if moved:
            return now.where(F.col("depth") > keep).select("id", F.col("to").alias("head"), "depth")


def candidate_pairs(rows: DataFrame, block: list[str], linked: DataFrame, most: int) -> DataFrame:
    """a, b: neighbours in their block's order of time, up to `most` apart, that aren't linked yet.

    Pairs of a block stay within a window of its order, so a block of n rows gives most * n pairs, not n squared.
    """
    line = Window.partitionBy(*block).orderBy("at", "id")
    near = rows.select("id", *(F.lead("id", k).over(line).alias(f"n{k}") for k in range(1, most + 1)))
    pairs = near.select("id", F.explode(F.array(*(f"n{k}" for k in range(1, most + 1)))).alias("b")).where("b is not null").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    return pairs.join(linked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
