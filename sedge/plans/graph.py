"""Graph, access and feedback queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.operators import access, feedback, graph
from sedge.plans.sql import frame, plan

_REL = """rel AS (SELECT 'c' || c_custkey AS subject, 'in' AS predicate, 'n' || c_nationkey AS object, 1.0::DOUBLE AS confidence, 1 AS mentions, 'a' || c_custkey AS id FROM customer
UNION ALL SELECT 's' || s_suppkey, 'in', 'n' || s_nationkey, 0.9, 1, 'b' || s_suppkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'part_of', 'r' || n_regionkey, 1.0, 2, 'd' || n_nationkey FROM nation)"""


def relations(customer, supplier, nation):
    """customers and suppliers in nations, nations in regions, as a property graph."""
    day = F.lit("2024-01-01").cast("date")
    none = F.lit(None).cast("date")

    def edges(df, a, ida, predicate, b, idb, conf, mentions, tag):
        return df.select(F.concat(F.lit(a), F.col(ida).cast("string")).alias("subject"), F.lit(predicate).alias("predicate"), F.concat(F.lit(b), F.col(idb).cast("string")).alias("object"), day.alias("valid_from"), none.alias("valid_to"), F.lit(conf).alias("confidence"), F.lit(mentions).alias("mentions"), day.alias("observed_at"), F.concat(F.lit(tag), F.col(ida).cast("string")).alias("id"))

    return edges(customer, "c", "c_custkey", "in", "n", "c_nationkey", 1.0, 1, "a").union(edges(supplier, "s", "s_suppkey", "in", "n", "s_nationkey", 0.9, 1, "b")).union(edges(nation, "n", "n_nationkey", "part_of", "r", "n_regionkey", 1.0, 2, "d"))


def _khop(customer, supplier, nation):
    seeds = customer.sparkSession.createDataFrame([("r0",)], "entity string")
    return graph.neighbourhood(seeds, relations(customer, supplier, nation), 2)


def _profile(orders):
    rel = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.col("o_orderpriority").alias("predicate"), F.col("o_orderstatus").alias("object"), F.col("o_orderdate").alias("observed_at"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("valid_to"), F.lit(1.0).alias("confidence"), F.col("o_orderkey").alias("id"))
    return graph.profile(rel, F.lit("2100-01-01").cast("timestamp_ntz"))


def _chain(events):
    from sedge.plans.events import versions

    v = versions(events).select(F.col("event_id").alias("id"), "replaced_by")
    return graph.prune_chains(v, 3)


def _lineage(events):
    from sedge.plans.events import versions

    v = versions(events)
    edges = v.where("replaced_by is not null").select(F.col("event_id").alias("source"), F.col("replaced_by").alias("derived"))
    return graph.closure(edges, v.where("replaces is null and event_type = 'signup'").select(F.col("event_id").alias("node"))).withColumnRenamed("node", "event_id")


def _votes(labels, documents):
    both = labels.join(documents.select("doc_id", "source", "lang", "n_chars"), "doc_id")
    return feedback.votes_by_target(both, "source", F.col("toxic") == 0, F.coalesce("lang", F.lit("")), "n_chars")


def _one_vote(events):
    votes = events.where("event_type in ('view', 'purchase')").select(F.col("user_id").alias("voter"), (F.col("event_id") % 3).alias("target"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("event_type").alias("thumb"))
    return feedback.counted_votes(votes).select("id", "voter", "target", "state", "replaced_by")


def _labels(events):
    rows = events.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run"), F.element_at(F.array(*(F.lit(x) for x in ("system", "agent", "user"))), (F.col("event_id") % 3 + 1).cast("int")).alias("source"), F.col("ts").alias("at"), F.col("event_id").alias("id"), (F.col("event_type") != "error").alias("success"))
    return feedback.run_labels(rows, {"system": 0, "agent": 1, "user": 2})


def _visible(documents):
    keys = access.audience_keys(F.when(F.col("doc_id") % 3 == 0, "tenant").when(F.col("doc_id") % 3 == 1, "group").otherwise("user"), F.lit("t1"), F.col("source"), *(F.lit(None).cast("string"),) * 4, F.lit(None).cast("string"), F.array("lang"))
    held = access.reader_keys(F.lit("t1"), F.lit("src3"), *(F.lit(None).cast("string"),) * 2, *(F.array().cast("array<string>"),) * 4, F.array(F.lit("de")))
    return documents.where(access.readable(F.lit("t1"), keys, F.lit("t1"), held) & ((F.col("doc_id") % 3 != 0) | (F.col("doc_id") % 2 == 0))).select("doc_id", "lang", "source")


PLANS = {
    "khop_neighbourhood": frame("customer supplier nation", _khop, f"WITH {_REL}, h1 AS (SELECT id, CASE WHEN subject = 'r0' THEN object ELSE subject END AS there FROM rel WHERE subject = 'r0' OR object = 'r0'), h2 AS (SELECT id FROM rel JOIN h1 ON subject = there OR object = there EXCEPT SELECT id FROM h1) SELECT DISTINCT id, 1 AS hop FROM h1 UNION ALL SELECT id, 2 FROM (SELECT rel.id FROM rel WHERE (subject IN (SELECT there FROM h1) OR object IN (SELECT there FROM h1)) AND id NOT IN (SELECT id FROM h1))"),
    "entity_profile": frame(
        "orders",
        _profile,
        """WITH r AS (SELECT 'c' || o_custkey AS entity, o_orderpriority AS predicate, o_orderstatus AS object, o_orderdate AS ob, o_orderkey AS id, o_orderstatus <> 'F' AS held FROM orders),
        n AS (SELECT *, row_number() OVER (PARTITION BY entity, predicate, held ORDER BY ob DESC, id) AS n FROM r), s AS (SELECT *, CASE WHEN held AND n = 1 THEN 'current' ELSE 'history' END AS state FROM n),
        p AS (SELECT *, row_number() OVER (PARTITION BY entity, state ORDER BY ob DESC, id) AS place FROM s) SELECT entity, predicate, object, state, place, id FROM p WHERE place <= CASE WHEN state = 'current' THEN 50 ELSE 20 END""",
    ),
    "supersede_prune": frame(
        "events",
        _chain,
        """WITH heads AS (SELECT * FROM (SELECT user_id, event_type, event_id, ts, floor(value / 10) AS v, lag(floor(value / 10)) OVER w AS b, lag(event_id) OVER w IS NULL AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE f OR b IS DISTINCT FROM v),
        d AS (SELECT event_id AS id, last_value(event_id) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head, count(*) OVER (PARTITION BY user_id, event_type) - row_number() OVER w AS depth FROM heads WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT id, head, depth FROM d WHERE depth > 3""",
    ),
    "lineage_closure": frame("events", _lineage, "WITH h AS (SELECT * FROM (SELECT event_id, event_type, floor(value / 10) AS v, lag(floor(value / 10)) OVER w AS b, lag(event_id) OVER w IS NULL AS f FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE f OR b IS DISTINCT FROM v) SELECT event_id FROM h WHERE event_type = 'signup'"),
    "votes_by_target": frame("labels documents", _votes, "SELECT source, count(*) AS n, count(*) FILTER (toxic = 0) AS counted, count(DISTINCT lang) AS voters, max(n_chars) AS last FROM labels JOIN documents USING (doc_id) GROUP BY 1"),
    "review_counts": frame("labels documents", lambda la, d: feedback.review_counts(la.join(d, "doc_id").withColumn("state", F.concat(F.lit("q"), F.col("quality").cast("string"))), "lang", "state", ["q0", "q1"]), "SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM labels JOIN documents USING (doc_id) GROUP BY 1"),
    "one_vote": frame(
        "events",
        _one_vote,
        """WITH v AS (SELECT user_id AS voter, event_id % 3 AS target, ts, event_id AS id, event_type AS thumb FROM events WHERE event_type IN ('view', 'purchase')),
        n AS (SELECT *, coalesce(lag(thumb) OVER w <> thumb, true) AS new FROM v WINDOW w AS (PARTITION BY voter, target ORDER BY ts, id)), r AS (SELECT *, sum(new::INT) OVER (PARTITION BY voter, target ORDER BY ts, id) AS run FROM n)
        SELECT id, voter, target, CASE WHEN NOT new THEN 'dismissed' WHEN run = max(run) OVER (PARTITION BY voter, target) THEN 'current' ELSE 'replaced' END AS state, CASE WHEN NOT new THEN first_value(id) OVER (PARTITION BY voter, target, run ORDER BY ts, id) END AS replaced_by FROM r""",
    ),
    "run_labels": frame("events", _labels, "WITH l AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run, ['system', 'agent', 'user'][event_id % 3 + 1] AS source, event_id % 3 AS r, ts, event_id, event_type <> 'error' AS success FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY r DESC, ts DESC, event_id DESC) AS n FROM l) SELECT run, success, source FROM o WHERE n = 1"),
    "visibility_semi_join": frame("documents", _visible, "SELECT doc_id, lang, source FROM documents WHERE (doc_id % 3 = 0 AND doc_id % 2 = 0) OR (doc_id % 3 <> 0 AND (source = 'src3' OR (doc_id % 3 = 1 AND lang = 'de')))"),
    "store_filter": frame("documents", lambda d: d.where(access.store_filter(must={"lang": "en"}, must_not={"source": ["src1", "src2"]}, should_any={"source": ["src3", "src4"], "n_chars": [100]}, within={"n_chars": (100, 5000)})).select("doc_id"), "SELECT doc_id FROM documents WHERE lang = 'en' AND source NOT IN ('src1', 'src2') AND (source IN ('src3', 'src4') OR n_chars = 100) AND n_chars BETWEEN 100 AND 5000"),
    "candidate_pairs": frame(
        "events",
        lambda e: graph.candidate_pairs(e.select(F.col("event_id").alias("id"), "user_id", "event_type", F.col("ts").alias("at")), ["user_id", "event_type"], e.sparkSession.createDataFrame([], "a long, b long"), 2),
        "WITH l AS (SELECT event_id, unnest([lead(event_id) OVER w, lead(event_id, 2) OVER w]) AS o FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) SELECT least(event_id, o) AS a, greatest(event_id, o) AS b FROM l WHERE o IS NOT NULL",
    ),
    "contributors": plan("events", "SELECT event_type, count(DISTINCT coalesce(user_id, -1)) AS users, CASE WHEN count(DISTINCT user_id) = 1 THEN min(user_id) END AS sole FROM events GROUP BY 1"),
}
