"""Memory, procedure and feature queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import nested, vectors
from sedge.operators import context, extraction, graph, memory, procedures, statements
from sedge.plans.events import _STEPS, calls
from sedge.plans.retrieval import _BM25, _SHARED
from sedge.plans.sql import frame


def _facts(turns):
    rows = turns.withColumn("said", F.concat(F.element_at(F.array(*(F.lit(x) for x in ("My city is ", "I prefer ", "We decided to keep ", ""))), (F.col("turn") % 4 + 1).cast("int")), F.lit("Q"), "turn", F.when(F.col("turn") % 4 == 3, "").otherwise("")))
    found = extraction.facts(rows, "conv_id", F.concat(F.lit("user:"), "role"), F.col("said"))
    return found.groupBy("conv_id", "category", "predicate").agg(F.count("*").alias("n"))


def _consolidated(documents):
    base = documents.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("scope"), F.col("source").alias("owner"), F.col("source").alias("subject"), F.lit("text").alias("predicate"), F.lit("").alias("object"), F.col("text").alias("content"))
    read = graph.shared_table(memory.features(base.withColumn("text", F.sha2("content", 256))), "statements")
    least = read.groupBy("scope", "text").agg(F.min(F.col("id").cast("long")).cast("string").alias("id")).select("id")
    held = read.join(least, "id").drop("text").withColumn("shared", F.lit(False))
    return memory.consolidate(read.drop("text").withColumn("negates", F.lit(False)), held).groupBy("decision").agg(F.count("*").alias("n"))


def _slots(events):
    """Events as statements: a user's type of event is a slot, its first event the one that is held."""
    predicate = F.when(F.col("event_type") == "view", "city").when(F.col("event_type") == "error", "role").otherwise(F.col("event_type"))
    key = F.col("event_id")
    said = events.select(key.cast("string").alias("id"), F.col("user_id").cast("string").alias("scope"), (key % 2).cast("string").alias("owner"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("subject"), predicate.alias("predicate"), F.floor(F.col("value") / 25).cast("string").alias("object"), F.concat(F.lit("event e"), key.cast("string")).alias("content"), (key % 3 == 0).alias("shared"), (key % 5 == 0).alias("negates"))
    first = said.groupBy("scope", "predicate").agg(F.min(F.struct(F.col("id").cast("long").alias("n"), "id")).alias("first")).select("first.id")
    return memory.consolidate(said.drop("shared"), said.drop("negates").join(first, "id", "left_semi"))


def _procedures(events):
    rows = calls(events).withColumn("pattern", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    outcome = rows.groupBy("run").agg(F.bool_and("ok").alias("succeeded"))
    none = events.sparkSession.createDataFrame([], "pattern string, path string")
    return procedures.with_status(procedures.mine(rows, outcome), none, F.lit("2024-02-15").cast("date")).select("pattern", "path", "support", "runs", "rate", "status")


def _beliefs(events):
    sources = events.select(F.concat_ws(":", "user_id", "event_type").alias("belief"), F.col("event_id").alias("id"))
    memories = events.select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 7 == 0, "SUPERSEDED").when(F.col("event_id") % 11 == 0, "FORGOTTEN").otherwise("CURRENT").alias("status"))
    return statements.belief_state(sources.select("belief").distinct(), sources, memories)


def _plan(events):
    side = lambda odd: events.where(F.col("event_id") % 2 == odd).groupBy(F.col("user_id").alias("person"), F.col("event_type").alias("key")).agg((F.count("*") % 3).cast("string").alias("text"))
    return statements.belief_plan(side(0), side(1)).select("person", "key", "action")


def _chats(turns):
    person = F.col("conv_id") % 5
    said = turns.select(person.alias("person"), F.col("conv_id").alias("thread"), F.col("turn").alias("at"), "role", "text")
    asked = turns.where("turn = 0").select(F.col("conv_id").alias("query"), person.alias("person"), "text")
    return statements.earlier_chats(said, asked)


def _subjects(part):
    named = part.select("p_partkey", F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("a"), F.concat(F.lit("the part #"), (F.col("p_partkey") + F.col("p_partkey") % 3).cast("string")).alias("b"))
    return named.groupBy((F.col("p_partkey") % 3).alias("shift"), statements.same_subject(F.col("a"), F.col("b")).alias("verdict")).agg(F.count("*").alias("n"))


PLANS = {
    "belief_state": frame("events", _beliefs, "WITH s AS (SELECT user_id || ':' || event_type AS belief, CASE WHEN event_id % 7 = 0 THEN 'S' WHEN event_id % 11 = 0 THEN 'F' ELSE 'C' END AS st FROM events) SELECT belief, CASE WHEN count(*) FILTER (st <> 'F') = 0 THEN 'deleted' WHEN count(*) FILTER (st = 'C') < count(*) THEN 'stale' ELSE 'current' END AS state FROM s GROUP BY 1"),
    "belief_plan": frame("events", _plan, "WITH a AS (SELECT user_id AS person, event_type AS key, count(*) % 3 AS t FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT user_id AS person, event_type AS key, count(*) % 3 AS t FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) SELECT person, key, CASE WHEN a.t IS NULL THEN 'add' WHEN b.t IS NULL THEN 'retire' WHEN a.t = b.t THEN 'keep' ELSE 'update' END AS action FROM a FULL JOIN b USING (person, key)"),
    "earlier_chats": frame(
        "conversations",
        _chats,
        r"""WITH w AS (SELECT conv_id % 5 AS person, conv_id, turn, role, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), lambda x: length(x) > 1))) AS word FROM conversations), n AS (SELECT conv_id % 5 AS person, count(*)::DOUBLE AS n FROM conversations GROUP BY 1),
        df AS (SELECT person, word, ln(1 + (n + 1) / (1 + count(*)::DOUBLE)) AS w FROM w JOIN n USING (person) GROUP BY person, word, n), q AS (SELECT conv_id AS query, person, word FROM w WHERE turn = 0),
        h AS (SELECT query, conv_id AS thread, turn AS at_, round(sum(df.w), 6) AS weight FROM q JOIN w ON q.person = w.person AND q.word = w.word JOIN df ON df.person = w.person AND df.word = w.word WHERE role = 'assistant' GROUP BY 1, 2, 3)
        SELECT query, thread, at_ AS "at", weight FROM (SELECT *, max(weight) OVER (PARTITION BY query) AS b FROM h) WHERE weight >= 0.5 * b""",
    ),
    "replay_layers": frame("conversations", lambda c: statements.replay_layers(c, 1, 2).groupBy("conv_id", "layer").agg(F.count("*").alias("n")), "WITH u AS (SELECT conv_id, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM conversations), b AS (SELECT conv_id, max(unit) OVER (PARTITION BY conv_id) - unit AS back FROM u) SELECT conv_id, CASE WHEN back < 1 THEN 'whole' WHEN back < 3 THEN 'text' ELSE 'steps' END AS layer, count(*) AS n FROM b GROUP BY 1, 2"),
    "subject_pairs": frame("part", _subjects, "SELECT p_partkey % 3 AS shift, CASE WHEN p_partkey % 3 = 0 THEN 'SAME' ELSE 'DIFFERENT' END AS verdict, count(*) AS n FROM part GROUP BY 1, 2"),
    "query_periods": frame("events", lambda e: statements.periods(e.select("event_id", F.concat(F.lit("what of "), F.date_format("ts", "MMMM yyyy")).alias("q")), "event_id", "q", F.col("event_id").cast("timestamp").cast("date")).groupBy("first", "last").agg(F.count("*").alias("n")), "SELECT strftime(date_trunc('month', ts), '%Y-%m-%d') AS first, strftime(last_day(ts), '%Y-%m-%d') AS last, count(*) AS n FROM events GROUP BY 1, 2"),
    "turn_facts": frame(
        "conversations",
        _facts,
        """SELECT conv_id, category, predicate, count(*) AS n FROM (SELECT conv_id, 'verbatim_turn' AS category, 'said' AS predicate FROM conversations
        UNION ALL SELECT conv_id, ['attribute', 'preference', 'decision'][turn % 4 + 1], ['city', 'prefers', 'decided'][turn % 4 + 1] FROM conversations WHERE turn % 4 < 3) GROUP BY 1, 2, 3""",
    ),
    # Each text is held by the first document of its language that has it, so all but nulls are identical to a held one.
    "consolidation": frame("documents", _consolidated, "SELECT CASE WHEN text IS NULL OR lang IS NULL THEN 'CREATE' ELSE 'REINFORCE' END AS decision, count(*) AS n FROM documents GROUP BY 1"),
    "slot_consolidation": frame(
        "events",
        _slots,
        """WITH n AS (SELECT event_id AS id, user_id, CASE event_type WHEN 'view' THEN 'city' WHEN 'error' THEN 'role' ELSE event_type END AS p, floor(value / 25) AS v, event_id % 2 AS o, event_id % 3 = 0 AS shared, event_id % 5 = 0 AS neg FROM events),
        h AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY user_id, p ORDER BY id) = 1),
        x AS (SELECT n.id, h.id AS t, CASE WHEN n.id = h.id THEN 1 WHEN n.v = h.v THEN 2 WHEN n.p IN ('city', 'role') AND n.o <> h.o AND h.shared AND NOT n.neg THEN 3 WHEN n.p IN ('city', 'role') THEN 4 WHEN n.neg THEN 5 ELSE 6 END AS k FROM n JOIN h USING (user_id, p))
        SELECT id::VARCHAR AS id, ['REINFORCE', 'REINFORCE', 'CONTRADICT', 'SUPERSEDE', 'SUPERSEDE', 'CREATE'][k] AS decision, CASE WHEN k < 6 THEN t::VARCHAR END AS target, [1.0, 0.98, 0.9, 0.95, 0.8667, 0.0][k]::DOUBLE AS score, ['identical', 'same value', 'another''s value', 'new value', 'replaced in words', 'new'][k] AS reason FROM x""",
    ),
    "procedures_mined": frame(
        "events",
        _procedures,
        f"""WITH {_STEPS}, o AS (SELECT run, bool_and(ok) AS good FROM calls GROUP BY 1),
        s AS (SELECT 'user ' || user_id AS pattern, run, good, "at", string_agg(tool, '>') OVER w AS path, count(*) OVER w AS size FROM steps JOIN o USING (run) WINDOW w AS (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING)),
        c AS (SELECT pattern, path, size, count(*) AS support, any_value(runs) AS runs FROM s JOIN (SELECT pattern, count(DISTINCT run) AS runs FROM s WHERE good GROUP BY 1) USING (pattern) WHERE good GROUP BY 1, 2, 3),
        e AS (SELECT *, support >= greatest(2, ceil(0.5 * runs)) AS enough FROM c),
        b AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY enough DESC, CASE WHEN enough THEN size ELSE support END DESC, CASE WHEN enough THEN support ELSE size END DESC, path) = 1),
        m AS (SELECT pattern, path, count(*) FILTER (good) AS support, count(*) AS runs, max("at") AS last FROM b JOIN s USING (pattern, path) GROUP BY 1, 2), r AS (SELECT *, round(support / runs, 4) AS rate, DATE '2024-02-15' - last::DATE AS idle FROM m)
        SELECT pattern, path, support, runs, rate, CASE WHEN rate < 0.5 OR idle > 60 THEN 'retired' WHEN support >= 2 AND rate >= 0.6 THEN 'active' ELSE 'candidate' END AS status FROM r""",
    ),
    "tool_search": frame(
        "benchmark",
        lambda b: procedures.tool_search(b, b.select(F.col("item_id").alias("tool_id"), "text")),
        f"""WITH documents AS (SELECT item_id AS doc_id, text FROM benchmark), {_BM25}, {_SHARED}, arms AS (SELECT query, id, 1.0::DOUBLE / (1 + rank) AS part, 'bm25' AS r FROM bmr WHERE rank <= 50 UNION ALL SELECT query, id, 1.0::DOUBLE / (1 + rank), 'words' FROM shr WHERE rank <= 50),
        f AS (SELECT query, id, round(sum(part), 9) AS score, string_agg(r, '+' ORDER BY r) AS retrievers FROM arms GROUP BY query, id),
        g AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM f) SELECT *, round(score / max(score) OVER (PARTITION BY query), 6) AS relevance FROM g WHERE rank <= 10""",
    ),
    "json_leaves": frame("events", lambda e: nested.flattened(e, "event_id", "props").groupBy("field").agg(F.count("*").alias("n"), F.countDistinct("form").alias("forms")), "SELECT 'k' AS field, count(*) AS n, count(DISTINCT CASE WHEN length(json_extract_string(props, '$.k')) >= 3 THEN json_extract_string(props, '$.k') END) AS forms FROM events"),
    "hash_embeddings": frame("benchmark", lambda b: vectors.embedded(b, "item_id", "text").select("item_id", F.round(F.aggregate(F.transform("vector", lambda x: x * x), F.lit(0.0), lambda a, x: a + x), 6).alias("norm")), "SELECT item_id, CAST(1.0 AS DOUBLE) AS norm FROM benchmark"),
    "script_tokens": frame("benchmark", lambda b: vectors.any_script(b, "item_id", "text").groupBy("item_id").agg(F.sum("n").alias("n"))),
    "index_texts": frame("events", lambda e: e.select("event_id", extraction.index_text(F.col("ts"), F.concat(F.lit("user:"), F.col("user_id").cast("string")), F.lit("EPISODIC"), F.col("event_type")).alias("text")), "SELECT event_id, '[' || strftime(ts, '%Y-%m-%d') || '] ' || user_id || ': episodic: ' || event_type AS text FROM events"),
    "conflict_pairs": frame("events", lambda e: nested.conflict_pairs(e.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("t")).select(F.get("t", F.lit(0)).alias("x"), F.col("t")), "x", "t"), "WITH t AS (SELECT list_sort(list_distinct(list(event_type))) AS t FROM events GROUP BY user_id) SELECT DISTINCT least(t[1], y) AS a, greatest(t[1], y) AS b FROM (SELECT t, unnest(t) AS y FROM t) WHERE t[1] <> y"),
    "person_pages": frame(
        "events",
        lambda e: context.person_page(e.select(F.col("user_id").alias("person"), F.col("event_type").alias("facet"), F.concat_ws(" ", "event_type", "event_id").alias("text"), F.to_date("ts").alias("since"), F.when(F.col("event_id") % 2 == 0, F.to_date("ts")).alias("until")).where("facet <> 'view'"), ["signup", "purchase", "error"]).select("person", F.sha2("page", 256).alias("hash")),
        """WITH b AS (SELECT user_id, event_type AS facet, event_type || ' ' || event_id AS text, ts::DATE AS since, CASE WHEN event_id % 2 = 0 THEN ts::DATE END AS until FROM events WHERE event_type <> 'view'),
        n AS (SELECT *, row_number() OVER (PARTITION BY user_id, facet, until IS NOT NULL ORDER BY since DESC, text) AS n FROM b)
        SELECT user_id AS person, sha256(string_agg(text || coalesce(' (until ' || strftime(until, '%Y-%m-%d') || ')', ''), chr(10) ORDER BY CASE facet WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 WHEN 'error' THEN 3 ELSE 4 END, until IS NOT NULL, since, text)) AS hash FROM n WHERE until IS NULL OR n <= 3 GROUP BY 1""",
    ),
}
