"""Read-path queries on the driver's tables: ranks, floors, exact hits, chains, companions, folds, retention, grants."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sedge.operators import serving
from sedge.plans.sql import frame

def _day():
    return F.to_date("ts")


def _ranked(events):
    """Each user's events of a day in order of ids, as one query's list."""
    line = F.row_number().over(Window.partitionBy("user_id", _day()).orderBy("event_id"))
    return events.select(F.concat_ws(":", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("query"), F.col("event_id").alias("id"), line.alias("rank"), "event_type", "user_id", "ts")


_RANKED = "r AS (SELECT user_id || ':' || strftime(ts, '%Y-%m-%d') AS query, event_id AS id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS rank, event_type, user_id, ts FROM events)"


def _current(events):
    return serving.current_first(_ranked(events).withColumn("earlier_value", F.col("id") % 3 == 0)).select("query", "id", "rank")


def _standing(events):
    ranked = _ranked(events).withColumn("score", (F.col("id") % 8).cast("double"))
    factor = F.when(F.col("event_type") == "error", 0.25).when(F.col("event_type") == "view", 0.5).otherwise(1.0)
    return serving.by_standing(ranked, factor).select("query", "id", "rank")


def _floor(events):
    rows = _ranked(events).select("query", "id", "rank", F.when(F.col("event_type") == "view", "chunk").otherwise("memory").alias("kind"), F.when(F.col("id") % 9 != 0, (F.col("id") % 16) / 32.0).alias("similarity"), (F.col("id") % 13 == 0).alias("companion"), (F.col("id") % 17 == 0).alias("exact"))
    return serving.above_floor(rows)


def _exact(documents, benchmark):
    name = lambda kind, c: F.concat(F.lit(f"{kind}_"), F.lpad(F.col(c).cast("string"), 6, "0"))
    asked = documents.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), F.concat(F.lit("what of "), name("doc", "doc_id"), F.lit(" and "), name("mem", "doc_id"), F.lit("? and doc_1")).alias("text"))
    return serving.exact_hits(asked, documents.select(name("doc", "doc_id").alias("id"), F.lit("document").alias("kind")), benchmark.select(name("mem", "item_id").alias("id"), F.lit("memory").alias("kind")))


def _selected(events):
    rows = events.select("event_id", F.when(F.col("event_id") % 5 != 0, F.concat(F.lit("d"), (F.col("event_id") % 4).cast("string"))).alias("document"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("observed_at"))
    return serving.selected(rows, ["d1", "d2"], ["click", "view"], ("2024-01-05", "2024-01-20")).select("event_id", "document", "kind")


def _followed(events):
    ranked = _ranked(events).where("rank <= 3").select("query", "id", "rank")
    replaced = events.where("event_id % 4 = 1").select(F.col("event_id").alias("id"), (F.col("event_id") + 3).alias("by"))
    return serving.followed(ranked, replaced, 4)


def _companions(lineitem):
    line = lineitem.select((F.col("l_orderkey") % 50).alias("query"), F.col("l_partkey").alias("id"))
    kind = F.element_at(F.array(F.lit("DEFINED_BY"), F.lit("NEXT"), F.lit("FOOTNOTE")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    edges = lineitem.select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + 1).alias("dst"), kind.alias("kind"))
    below = lineitem.select(F.col("l_suppkey").alias("node"), F.col("l_suppkey").alias("part")).distinct().union(lineitem.select("l_suppkey", "l_partkey"))
    return serving.missing_companions(line, edges, below)


def _folded(events):
    command = F.element_at(F.array(*(F.lit(x) for x in ("remember", "correct", "retract", "restore", "forget"))), (F.col("event_id") % 23 % 5 + 1).cast("int"))
    return serving.folded(events.select(F.col("user_id").alias("id"), F.col("event_id").alias("n"), command.alias("command"), F.concat_ws(" ", "event_type", "event_id").alias("content")))


def _retained(events):
    policies = events.groupBy(F.col("user_id").alias("tenant"), F.col("event_type").alias("kind")).agg((F.count("*") % 30).alias("days")).where("kind <> 'signup'")
    rows = events.select("event_id", F.col("user_id").alias("tenant"), F.col("event_type").alias("kind"), _day().alias("at"))
    return serving.retained(rows, policies, F.lit("2024-02-01").cast("date")).select("event_id", "tenant", "kind")


def _recent(events):
    rows = events.select("user_id", "event_id", F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("ts").alias("at"), F.md5(F.concat_ws(":", F.col("event_type"), (F.col("event_id") % 40).cast("string"))).alias("hash"))
    wanted = events.select("user_id", F.md5(F.concat(F.lit("click:"), (F.col("user_id") % 40).cast("string"))).alias("hash")).distinct()
    return serving.recent_or_exact(rows, "user_id", {"click": 3, "error": 2}, wanted)


def _reflection(events):
    keys = F.array(F.concat(F.lit("user:"), (F.col("user_id") % 3).cast("string")), F.lit("team:a"))
    return serving.reflection_groups(events.select((F.col("user_id") % 2).alias("tenant"), F.col("user_id").alias("owner"), F.col("event_type").alias("scope"), keys.alias("keys"), F.col("event_id").alias("id"), _day().alias("at")))


def _scopes(events):
    kind = F.element_at(F.array(F.lit("thread"), F.lit("workspace"), F.lit("group"), F.lit("other")), (F.col("event_id") % 4 + 1).cast("int"))
    return serving.scope_keys(events.select(F.col("user_id").alias("subject"), F.concat_ws(":", kind, (F.col("event_id") % 10).cast("string")).alias("object")))


def _entities(part, lineitem):
    names = part.select(F.col("p_partkey").alias("entity"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("name"), (F.col("p_partkey") % 2 == 0).alias("is_id"))
    calls = lineitem.select(F.col("l_returnflag").alias("tool"), F.array(F.struct(F.lit("p").alias("key"), F.concat(F.lit(" PART "), F.col("l_partkey").cast("string")).alias("value"))).alias("inputs"))
    return serving.tool_entities(calls, names)


def _summaries(orders):
    rows = orders.select(F.concat(F.lit("customer "), F.col("o_custkey").cast("string")).alias("subject"), F.lit("has_ordered").alias("predicate"), F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("object"), (F.col("o_orderkey") % 5 / 5.0).alias("confidence"))
    return serving.entity_summaries(rows, 4).select("entity", "summary")


def _people(events):
    return serving.people(events.select(F.col("user_id").alias("person"), (F.col("event_id") % 4).alias("proofs")), 10)


PLANS = {
    "current_first": frame("events", _current, f"WITH {_RANKED} SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY (id % 3 = 0)::INT, rank) AS rank FROM r"),
    "by_standing": frame("events", _standing, f"WITH {_RANKED} SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY (id % 8) * CASE event_type WHEN 'error' THEN 0.25 WHEN 'view' THEN 0.5 ELSE 1.0 END DESC, rank) AS rank FROM r"),
    "above_floor": frame(
        "events",
        _floor,
        f"""WITH {_RANKED}, i AS (SELECT query, id, rank, CASE WHEN event_type = 'view' THEN 'chunk' ELSE 'memory' END AS kind, CASE WHEN id % 9 <> 0 THEN (id % 16) / 32.0 END AS sim, id % 13 = 0 AS c, id % 17 = 0 AS e FROM r),
        m AS (SELECT *, sim IS NOT NULL AND sim < 0.2 AND NOT c AND NOT e AS under, coalesce(max(CASE WHEN kind = 'memory' THEN sim END) OVER (PARTITION BY query), 0) AS best FROM i),
        n AS (SELECT *, row_number() OVER (PARTITION BY query, under, kind ORDER BY rank) AS n FROM m)
        SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY under::INT, rank) AS rank, under FROM n WHERE NOT under OR (kind = 'memory' AND best >= 0.4 AND n <= 5)""",
    ),
    "exact_hits": frame("documents benchmark", _exact, "WITH q AS (SELECT doc_id AS query, lpad(doc_id::VARCHAR, 6, '0') AS k FROM documents WHERE doc_id % 20 = 0) SELECT query, 'doc_' || k AS id, 'document' AS kind, 1.0::DOUBLE AS score FROM q UNION ALL SELECT query, 'mem_' || k, 'memory', 1.0 FROM q WHERE query IN (SELECT item_id FROM benchmark)"),
    "selected_candidates": frame("events", _selected, "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN 'd' || (event_id % 4) END AS document, event_type AS kind FROM events WHERE (event_id % 5 = 0 OR event_id % 4 IN (1, 2)) AND event_type IN ('click', 'view') AND event_id % 7 <> 0 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"),
    "followed_chain": frame(
        "events",
        _followed,
        f"""WITH RECURSIVE {_RANKED}, p AS (SELECT event_id AS id, event_id + 3 AS by_ FROM events WHERE event_id % 4 = 1), c AS (SELECT query, id AS at_, rank, 0 AS hop FROM r WHERE rank <= 3 UNION ALL SELECT query, by_, rank, hop + 1 FROM c JOIN p ON at_ = p.id WHERE hop < 4),
        f AS (SELECT query, at_ AS id, min((rank, -hop)) AS k FROM c GROUP BY 1, 2) SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY k, id) AS rank FROM f""",
    ),
    "missing_companions": frame(
        "lineitem",
        _companions,
        """WITH p AS (SELECT DISTINCT l_orderkey % 50 AS query, l_partkey AS id FROM lineitem), e AS (SELECT DISTINCT l_partkey AS src, l_suppkey + 1 AS dst FROM lineitem WHERE l_suppkey % 3 <> 1), b AS (SELECT l_suppkey AS node, l_suppkey AS part FROM lineitem UNION SELECT l_suppkey, l_partkey FROM lineitem)
        SELECT DISTINCT query, id AS seed, dst AS needs FROM p JOIN e ON id = src WHERE NOT EXISTS (SELECT 1 FROM b JOIN p AS o ON o.id = b.part WHERE b.node = e.dst AND o.query = p.query)""",
    ),
    "folded_commands": frame(
        "events",
        _folded,
        """WITH c AS (SELECT user_id AS id, event_id AS n, ['remember', 'correct', 'retract', 'restore', 'forget'][event_id % 23 % 5 + 1] AS command, event_type || ' ' || event_id AS content FROM events),
        f AS (SELECT id, arg_max(content, n) FILTER (command IN ('remember', 'correct')) AS content, arg_max(command, n) FILTER (command <> 'correct') AS last, bool_or(command = 'forget') AS gone FROM c GROUP BY id)
        SELECT id, CASE WHEN NOT gone THEN content END AS content, CASE WHEN gone THEN 'FORGOTTEN' WHEN last = 'retract' THEN 'RETRACTED' ELSE 'CURRENT' END AS status FROM f""",
    ),
    "retained_rows": frame("events", _retained, "WITH p AS (SELECT user_id AS tenant, event_type AS kind, count(*) % 30 AS days FROM events WHERE event_type <> 'signup' GROUP BY 1, 2) SELECT event_id, user_id AS tenant, event_type AS kind FROM events LEFT JOIN p ON tenant = user_id AND kind = event_type WHERE days IS NULL OR DATE '2024-02-01' - ts::DATE <= days"),
    "recent_or_exact": frame(
        "events",
        _recent,
        """WITH n AS (SELECT user_id, event_id AS id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events)
        SELECT user_id, id FROM n WHERE n <= CASE event_type WHEN 'click' THEN 3 WHEN 'error' THEN 2 ELSE 0 END UNION SELECT user_id, event_id FROM events WHERE event_type = 'click' AND event_id % 40 = user_id % 40""",
    ),
    "reflection_groups": frame("events", _reflection, "SELECT user_id % 2 AS tenant, user_id AS owner, event_type AS scope, 'team:a,user:' || (user_id % 3) AS audience, count(*) AS n, min(event_id) AS first, max(ts::DATE) AS newest FROM events GROUP BY 1, 2, 3, 4"),
    "scope_keys": frame("events", _scopes, "SELECT user_id AS subject, coalesce(list_sort(list_distinct(list((event_id % 10)::VARCHAR) FILTER (event_id % 4 = 0))), []) AS threads, coalesce(list_sort(list_distinct(list((event_id % 10)::VARCHAR) FILTER (event_id % 4 = 1))), []) AS workspaces, coalesce(list_sort(list_distinct(list((event_id % 10)::VARCHAR) FILTER (event_id % 4 = 2))), []) AS groups FROM events GROUP BY 1"),
    "tool_entities": frame("part lineitem", _entities, "SELECT l_returnflag AS tool, l_partkey AS entity, CASE WHEN l_partkey % 2 = 0 THEN 'identified_by' ELSE 'used_entity' END AS kind, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part) GROUP BY 1, 2, 3"),
    "entity_summaries": frame(
        "orders",
        _summaries,
        """WITH r AS (SELECT o_custkey, 'order ' || o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, 'order ' || o_orderkey) AS n FROM orders)
        SELECT 'customer ' || o_custkey AS entity, 'customer ' || o_custkey || ': ' || string_agg('has ordered ' || o, '; ' ORDER BY n) AS summary FROM r WHERE n <= 4 GROUP BY o_custkey""",
    ),
    "people": frame("events", _people, "SELECT user_id AS person, sum(event_id % 4)::BIGINT AS proofs FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
}
