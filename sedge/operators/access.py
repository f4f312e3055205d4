"""Who may read what: audience keys, reader keys, the row predicate, store filters, relation tuples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.operators.graph import shared_table


def audience_keys(visibility: Column, tenant: Column, user: Column, agent: Column, thread: Column, run: Column, parent_run: Column, workspace: Column, groups: Column) -> Column:
    """Keys that an object carries by its visibility; its owner's key is always among them."""
    key = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c))
    own = (
        F.when(visibility == "tenant", F.array(key("tenant", tenant)))
        .when(visibility == "workspace", F.array(key("workspace", workspace)))
        .when(visibility == "group", F.transform(groups, lambda g: F.concat(F.lit("group:"), g)))
        .when(visibility == "user", F.array(key("user", user)))
        .when(visibility == "agent", F.array(key("agent", agent)))
        .when(visibility == "thread", F.array(key("thread", thread)))
        .when(visibility == "run", F.array(key("run", run), key("runup", parent_run)))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.array_distinct(F.array_compact(F.concat(own, F.array(key("user", user)))))


def reader_keys(tenant: Column, user: Column, agent: Column, run: Column, granted_threads: Column, threads: Column, granted_workspaces: Column, workspaces: Column, groups: Column) -> Column:
    """Keys that a reader holds; a thread or workspace counts only if it is both granted and in use."""
    named = lambda name, c: F.transform(c, lambda x: F.concat(F.lit(f"{name}:"), x))
    single = F.array(*(F.when(c.isNotNull(), F.concat(F.lit(f"{n}:"), c)) for n, c in (("tenant", tenant), ("user", user), ("agent", agent), ("run", run), ("runup", run))))
    return F.array_distinct(F.array_compact(F.concat(single, named("thread", F.array_intersect(granted_threads, threads)), named("workspace", F.array_intersect(granted_workspaces, workspaces)), named("group", groups))))


def readable(tenant: Column, keys: Column, reader_tenant: Column, held: Column) -> Column:
    """The row predicate: one tenant, and a key in common."""
    return (tenant == reader_tenant) & F.arrays_overlap(keys, held)


def store_filter(must: dict | None = None, must_any: dict | None = None, must_not: dict | None = None, should_any: dict | None = None, within: dict | None = None) -> Column:
    """A conjunction: equal fields; fields (or arrays) with one of some values; none of some; an OR group; closed ranges, without which a row is out."""
    out = F.lit(True)
    for name, value in (must or {}).items():
        out &= F.coalesce(F.col(name) == F.lit(value), F.lit(False))
    for name, values in (must_any or {}).items():
        out &= F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    for name, values in (must_not or {}).items():
        out &= ~F.coalesce(F.col(name).isin(list(values)), F.lit(False))
    if should_any:
        one = F.lit(False)
        for name, values in should_any.items():
            one |= F.coalesce(F.col(name).isin(list(values)), F.lit(False))
        out &= one
    for name, (low, high) in (within or {}).items():
        if low is not None:
            out &= F.coalesce(F.col(name) >= F.lit(low), F.lit(False))
        if high is not None:
            out &= F.coalesce(F.col(name) <= F.lit(high), F.lit(False))
    return out


def asserted(derived: Column, category: Column, provider: Column) -> Column:
    """Said by somebody: neither derived, nor unverified, nor a model's."""
    return ~F.coalesce(derived, F.lit(False)) & ~category.eqNullSafe(F.lit("unverified")) & ~provider.eqNullSafe(F.lit("llm"))


def grants(tuples: DataFrame) -> DataFrame:
    """object, relation, subject: what relation tuples grant, through groups of groups too; cycles end.

    tuples: object, relation, subject, and subject_relation where the subject is a set (all that hold that relation on it).
    """
    direct = tuples.where("subject_relation is null").select("object", "relation", "subject").distinct()
    sets = tuples.where("subject_relation is not null").select("object", "relation", F.col("subject").alias("via"), "subject_relation")
    seen, frontier = direct, direct
    while True:
        step = sets.alias("s").join(frontier.alias("f"), (F.col("s.via") == F.col("f.object")) & (F.col("s.subject_relation") == F.col("f.relation"))).select("s.object", "s.relation", "f.subject").distinct()
        frontier = shared_table(step.join(seen, ["object", "relation", "subject"], "left_anti"), "grants")
        if frontier.isEmpty():
            return seen
        seen = shared_table(seen.union(frontier), "granted")
