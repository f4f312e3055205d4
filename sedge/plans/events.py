"""Conversation, time and process-mining queries on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sedge.functions import scores as s
from sedge.operators import conversation, mining, retrieval, temporal
from sedge.plans.sql import frame, plan

_EST = r"""CAST(greatest(1, CASE WHEN strlen(text) = length(text) THEN length(text) // 4 + (length(text) - length(replace(text, chr(10), ''))) ELSE
 (length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) + 4 * (length(text) - length(replace(text, chr(10), ''))) + 4 * (strlen(text) - length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')))) // 4 END) AS BIGINT)"""
_CALLS = '''calls AS (SELECT user_id || '/' || strftime(ts, '%Y-%m-%d') AS run, ts AS "at", event_id AS call, event_type AS tool, event_type <> 'error' AS ok, value AS latency, user_id FROM events)'''
_STEPS = f"""{_CALLS}, n AS (SELECT *, CASE WHEN lag(tool) OVER w = tool THEN 0 ELSE 1 END AS new FROM calls WINDOW w AS (PARTITION BY run ORDER BY "at", call)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY run ORDER BY "at", call) AS step FROM n), best AS (SELECT *, row_number() OVER (PARTITION BY run, step ORDER BY ok DESC, "at" DESC, call DESC) AS b, count(*) OVER (PARTITION BY run, step) AS tries FROM isl),
steps AS (SELECT run, step::BIGINT AS step, tool, ok, latency, "at", tries, user_id FROM best WHERE b = 1)"""
_EDGES = f"{_STEPS}, edges AS (SELECT * FROM (SELECT run, lag(tool) OVER (PARTITION BY run ORDER BY step) AS source, tool AS target, ok, latency FROM steps) WHERE source IS NOT NULL)"
_SLOT = """heads AS (SELECT * FROM (SELECT *, lag(v) OVER w AS before, lag(event_id) OVER w IS NULL AS head FROM (SELECT user_id, event_type, event_id, ts, CAST(floor(value / 10) AS BIGINT) AS v FROM events) WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE head OR before IS DISTINCT FROM v),
versions AS (SELECT user_id, event_type, event_id, ts, v, lead(ts) OVER w AS valid_to, lead(event_id) OVER w AS replaced_by, lag(event_id) OVER w AS replaces FROM heads WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))"""


def calls(events):
    """events as tool calls: a user's day is a run, the type a tool, an error a failure."""
    return events.select(F.concat_ws("/", "user_id", F.date_format("ts", "yyyy-MM-dd")).alias("run"), F.col("ts").alias("at"), F.col("event_id").alias("call"), F.col("event_type").alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency"), "user_id")


def versions(events):
    facts = events.select("user_id", "event_type", "event_id", "ts", F.floor(F.col("value") / 10).alias("v"))
    return temporal.supersede(facts, ["user_id", "event_type"], "ts", "event_id", "v")


def _snapshot(events):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    held = versions(events).where(temporal.graph_as_of(F.col("ts"), F.col("valid_to"), at))
    return held.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("ts").alias("newest"))


def _known(events):
    at = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    own = versions(events).where(temporal.known_at(F.col("ts"), F.col("valid_to"), at) & temporal.index_as_of(F.col("ts"), F.col("valid_to"), at))
    return own.select("user_id", "event_type", "event_id", "v")


def _forgetting(events):
    used = events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"), F.avg("value").alias("mean"))
    idle = F.timestamp_diff("MICROSECOND", F.col("last"), F.lit("2024-03-01").cast("timestamp_ntz")) / 86400e6
    return used.select("user_id", "event_type", s.forgetting_score(F.least(F.lit(1.0), F.col("mean") / 100), idle, F.col("n") % 7).alias("score"))


def _standing(events):
    k = events.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.least(F.lit(1.0), F.avg("value") / 100), 6).alias("c"))
    return k.select("user_id", F.round(s.standing_factor(F.col("c"), F.col("n").cast("int")), 6).alias("factor"))


def _admission(events):
    kinds = ["policy", "task", "conversation", "working", "tool"]
    types = ["click", "purchase", "error", "signup", "view"]
    pick = lambda xs: F.try_element_at(F.create_map(*(F.lit(v) for kv in zip(types, xs) for v in kv)), F.col("event_type"))
    kind, life, decision = pick(kinds), pick(["long_term", "short_term", "long_term", "ephemeral", "short_term"]), pick(["create", "merge", "supersede", "create", "reinforce"])
    conf = F.round(F.least(F.lit(1.0), F.col("value") / 100), 4)
    age = F.datediff(F.lit("2024-06-01").cast("date"), F.col("ts").cast("date"))
    w = s.worthiness(kind, conf, F.col("user_id") % 5 == 0, F.col("event_id") % 7 == 0, F.col("event_id") % 11 == 0)
    u = s.utility(life, conf, age)
    score = s.admission_score(w, decision, conf, u)
    return events.select("event_type", s.admission_verdict(w, decision, conf, score).alias("verdict"), score.alias("score")).groupBy("event_type", "verdict").agg(F.count("*").alias("n"), F.round(F.sum("score"), 3).alias("total"))


def _fold(events):
    step = F.when(F.col("event_type") == "purchase", 0.1).when(F.col("event_type") == "error", -0.05).otherwise(0.05)
    rows = events.where("event_type in ('purchase', 'error')").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", step.alias("d")))), lambda x: x["d"]).alias("steps"))
    return rows.select("user_id", F.round(s.confidence_after(F.lit(0.5), F.col("steps")), 6).alias("confidence"), F.size("steps").alias("n"))


def _fiscal(orders):
    cal = temporal.fiscal_years(orders.sparkSession, 1990, 2030)
    return temporal.fiscal_position(orders.select(F.col("o_orderdate").cast("date").alias("day")), F.col("day"), cal).groupBy("fiscal_year", "period", "quarter").agg(F.count("*").alias("n"), F.min("fiscal_week").alias("week"))


def _relative(orders):
    phrase = F.element_at(F.array(*(F.lit(p) for p in ("yesterday", "last week", "last weekend", "last month", "next month", "last year", "last friday", "next monday"))), (F.col("o_orderkey") % 8 + 1).cast("int"))
    rows = orders.select("o_orderkey", temporal.relative_days(phrase, F.col("o_orderdate").cast("date")).alias("d"))
    return rows.select("o_orderkey", F.col("d.first").alias("a"), F.col("d.last").alias("b"))


_EVENT = lambda fn: lambda e: fn(mining.steps(calls(e)))

PLANS = {
    "message_sequence": frame("conversations", lambda c: conversation.with_sequence(c, "conv_id", "turn").groupBy("conv_id").agg(F.max("sequence").alias("last"), F.sum("sequence").alias("total")), "WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) SELECT conv_id, max(n) AS last, sum(n)::BIGINT AS total FROM s GROUP BY 1"),
    "thread_window_n_turns": frame("conversations", lambda c: conversation.newest_turns(c, 2).select("conv_id", "turn", "role"), "WITH u AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations WHERE role = 'user'), s AS (SELECT conv_id, turn AS start FROM u WHERE n = 2) SELECT c.conv_id, turn, role FROM conversations c LEFT JOIN s USING (conv_id) WHERE turn >= coalesce(start, 0)"),
    "window_budget": frame("conversations", lambda c: conversation.budget_window(c, 300).select("conv_id", "turn", "used"), f"WITH m AS (SELECT conv_id, turn, sum({_EST} + 4) OVER w AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) SELECT conv_id, turn, used::BIGINT AS used FROM m WHERE used <= 300 OR n = 1"),
    "turn_units": frame("conversations", lambda c: conversation.turn_units(c).groupBy("conv_id", "unit").agg(F.count("*").alias("n"), F.min("turn").alias("first")), "WITH u AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS unit FROM conversations) SELECT conv_id, unit::BIGINT AS unit, count(*) AS n, min(turn) AS first FROM u GROUP BY 1, 2"),
    "preceding_message": frame("events", lambda e: conversation.preceding(e, "user_id", "ts", "event_id", "2 HOURS").select("event_id", "before"), "SELECT event_id, CASE WHEN lag(ts) OVER w >= ts - INTERVAL 2 HOURS THEN lag(event_id) OVER w END AS before FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"),
    "rolling_digest": frame(
        "conversations",
        lambda c: conversation.rolling_digest(c, every=4, keep=400).select("conv_id", "version", "lines", F.sha2("digest", 256).alias("hash")),
        r"""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role || ': ' || CASE WHEN length(f) > 160 THEN f[:160] || '…' ELSE f END AS line FROM (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM conversations)),
        v AS (SELECT conv_id, unnest(range(1, max(n) // 4 + 1))::INT AS version FROM l GROUP BY conv_id), sp AS (SELECT conv_id, version, n, line, sum(length(line) + 1) OVER (PARTITION BY conv_id, version ORDER BY n DESC) AS chars FROM l JOIN v USING (conv_id) WHERE n <= version * 4)
        SELECT conv_id, version, count(*) AS lines, sha256(string_agg(line, chr(10) ORDER BY n)) AS hash FROM sp WHERE chars <= 401 GROUP BY 1, 2""",
    ),
    "archive_segments": frame(
        "conversations",
        lambda c: conversation.encode_segments(conversation.plan_segments(c, 200, 3)).select("conv_id", "segment", "n", "first", "last", "sha256"),
        """WITH RECURSIVE m AS (SELECT *, strlen(text) + 256 AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
        f AS (SELECT conv_id, k, 0::BIGINT AS segment, size AS used, 1 AS n FROM m WHERE k = 1 UNION ALL
        SELECT m.conv_id, m.k, f.segment + x.cut::INT, CASE WHEN x.cut THEN m.size ELSE f.used + m.size END, CASE WHEN x.cut THEN 1 ELSE f.n + 1 END FROM f JOIN m ON m.conv_id = f.conv_id AND m.k = f.k + 1, LATERAL (SELECT f.used + m.size > 1000 OR f.n >= 3 AS cut) x)
        SELECT conv_id, segment, count(*) AS n, min(turn) AS first, max(turn) AS last, sha256(string_agg('{"conv_id": ' || conv_id || ', "role": ' || to_json(role)::VARCHAR || ', "text": ' || to_json(text)::VARCHAR || ', "turn": ' || turn || '}' || chr(10), '' ORDER BY turn)) AS sha256
        FROM f JOIN m USING (conv_id, k) GROUP BY 1, 2""",
    ),
    "slot_scd2": frame("events", versions, f"WITH {_SLOT} SELECT * FROM versions"),
    "as_of_snapshot": frame("events", _snapshot, f"WITH {_SLOT} SELECT event_type, count(*) AS n, sum(v)::BIGINT AS total, max(ts) AS newest FROM versions WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-15 12:00:00') GROUP BY 1"),
    "known_at_snapshot": frame("events", _known, f"WITH {_SLOT} SELECT user_id, event_type, event_id, v FROM versions WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' AND (valid_to IS NULL OR valid_to >= TIMESTAMP '2024-01-15 12:00:00')"),
    "latest_per_slot": frame("events", lambda e: retrieval.latest_per_slot(e, ["user_id", "event_type"], "ts", "event_id", F.floor(F.col("value") / 10)).groupBy("event_type", "earlier_value").agg(F.count("*").alias("n"), F.max("replaced_by").alias("by")), "WITH n AS (SELECT *, first_value(event_id) OVER w AS nid, first_value(floor(value / 10)) OVER w AS nv FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC)) SELECT event_type, floor(value / 10) IS DISTINCT FROM nv AS earlier_value, count(*) AS n, max(CASE WHEN floor(value / 10) IS DISTINCT FROM nv THEN nid END) AS by FROM n GROUP BY 1, 2"),
    "forgetting_scores": frame("events", _forgetting, "SELECT user_id, event_type, round(greatest(least(1.0, avg(value) / 100), 0) * pow(0.5, greatest((epoch_us(TIMESTAMP '2024-03-01') - epoch_us(max(ts))) / 86400e6, 0) / 30.0) * (1 - pow(0.5, count(*) % 7)), 6) AS score FROM events GROUP BY 1, 2"),
    "standing_factor": frame("events", _standing, "SELECT user_id, round(1 + greatest(-0.15, least(0.15, 0.3 * (CASE WHEN c = 0 THEN 0.5 ELSE c END - 0.5) + 0.03 * log2(greatest(1, n)))), 6) AS factor FROM (SELECT user_id, count(*) AS n, round(least(1.0, avg(value) / 100), 6) AS c FROM events GROUP BY 1)"),
    "admission_gate": frame(
        "events",
        _admission,
        """WITH k(event_type, prior, life, dec, nov) AS (VALUES ('click', 0.85, 1.0, 'create', 1.0), ('purchase', 0.6, 0.65, 'merge', 0.5), ('error', 0.3, 1.0, 'supersede', 0.9), ('signup', 0.2, 0.2, 'create', 1.0), ('view', 0.35, 0.65, 'reinforce', 0.25)),
        a AS (SELECT *, round(least(1.0, value / 100), 4)::DOUBLE AS conf, date_diff('day', ts::DATE, DATE '2024-06-01') AS age FROM events JOIN k USING (event_type)),
        b AS (SELECT *, round(least(1.0::DOUBLE, CASE WHEN user_id % 5 = 0 THEN greatest(0.6::DOUBLE * prior + 0.4::DOUBLE * conf, 0.8) ELSE 0.6::DOUBLE * prior + 0.4::DOUBLE * conf END * CASE WHEN event_id % 7 = 0 THEN 0.4::DOUBLE ELSE 1 END * CASE WHEN event_id % 11 = 0 THEN 0.5::DOUBLE ELSE 1 END), 4) AS w,
        round(least(1.0::DOUBLE, life::DOUBLE * greatest(conf, 0.05) * greatest(0.5, 1 - 0.5::DOUBLE * greatest(age, 0) / 365.0)), 4) AS u FROM a),
        c AS (SELECT *, round(0.4::DOUBLE * w + 0.2::DOUBLE * nov + 0.2::DOUBLE * conf + 0.2::DOUBLE * u, 4) AS score FROM b)
        SELECT event_type, CASE WHEN w < 0.35 THEN 'REJECT' WHEN conf < 0.3 THEN 'REJECT' WHEN dec IN ('merge', 'reinforce') THEN 'ADMIT' WHEN score < 0.32 THEN 'REJECT' WHEN score < 0.4 THEN 'DEFER' ELSE 'ADMIT' END AS verdict, count(*) AS n, round(sum(score), 3) AS total FROM c GROUP BY 1, 2""",
    ),
    "confidence_fold": frame(
        "events",
        _fold,
        """WITH s AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 0.1 ELSE -0.05 END::DOUBLE ORDER BY ts, event_id) AS d FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
        SELECT user_id, round(list_reduce(list_concat([0.5::DOUBLE], d), lambda c, x: least(1.0, greatest(0.05, c + x))), 6) AS confidence, len(d)::INT AS n FROM s""",
    ),
    "fiscal_periods": frame(
        "orders",
        _fiscal,
        """WITH y AS (SELECT y, make_date(y::INT + 1, 1, 31) AS e FROM range(1989, 2031) t(y)), ends AS (SELECT y, e + ((9 - isodow(e)) % 7 - 3)::INT AS e FROM y), years AS (SELECT y, lag(e) OVER (ORDER BY y) + 1 AS a, e AS b FROM ends),
        w AS (SELECT y, (o_orderdate::DATE - a) // 7 AS w FROM orders LEFT JOIN years ON o_orderdate::DATE BETWEEN a AND b),
        q AS (SELECT y, w, least(w // 13, 3) AS q FROM w), p AS (SELECT y, w, q, q * 3 + CASE WHEN w - q * 13 < 4 THEN 1 WHEN w - q * 13 < 9 THEN 2 ELSE 3 END AS p FROM q)
        SELECT y::INT AS fiscal_year, p::INT AS period, (q + 1)::INT AS quarter, count(*) AS n, min(w + 1)::INT AS week FROM p GROUP BY y, p, q""",
    ),
    "relative_dates": frame(
        "orders",
        _relative,
        """SELECT o_orderkey, CAST(CASE k WHEN 0 THEN d - 1 WHEN 1 THEN m - 7 WHEN 2 THEN m - 2 WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 MONTH WHEN 4 THEN date_trunc('month', d) + INTERVAL 1 MONTH WHEN 5 THEN date_trunc('year', d) - INTERVAL 1 YEAR WHEN 6 THEN d - ((isodow(d) - 5 + 6) % 7 + 1)::INT ELSE d + ((1 - isodow(d) + 6) % 7 + 1)::INT END AS DATE) AS a,
        CAST(CASE k WHEN 0 THEN d - 1 WHEN 1 THEN m - 1 WHEN 2 THEN m - 1 WHEN 3 THEN date_trunc('month', d) - INTERVAL 1 DAY WHEN 4 THEN date_trunc('month', d) + INTERVAL 2 MONTH - INTERVAL 1 DAY WHEN 5 THEN date_trunc('year', d) - INTERVAL 1 DAY WHEN 6 THEN d - ((isodow(d) - 5 + 6) % 7 + 1)::INT ELSE d + ((1 - isodow(d) + 6) % 7 + 1)::INT END AS DATE) AS b
        FROM (SELECT o_orderkey, o_orderkey % 8 AS k, o_orderdate::DATE AS d, date_trunc('week', o_orderdate)::DATE AS m FROM orders)""",
    ),
    "retry_islands": frame("events", lambda e: mining.steps(calls(e)).select("run", "step", "tool", "ok", "latency", "tries"), f"WITH {_STEPS} SELECT run, step, tool, ok, latency, tries FROM steps"),
    "followed_by_edges": frame("events", _EVENT(lambda st: mining.followed_by(st).groupBy("source", "target").agg(F.count("*").alias("n"))), f"WITH {_EDGES} SELECT source, target, count(*) AS n FROM edges GROUP BY 1, 2"),
    "edge_support": frame("events", _EVENT(lambda st: mining.edge_support(mining.followed_by(st))), f"WITH {_EDGES} SELECT source, target, count(DISTINCT run) AS support, count(*) FILTER (ok) AS successes, count(*) FILTER (NOT ok) AS failures, round(median(latency) FILTER (ok), 6) AS median_latency, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS success_rate FROM edges GROUP BY 1, 2"),
    "best_sequence": frame(
        "events",
        lambda e: mining.best_sequence(mining.steps(calls(e)).withColumn("user", F.substring_index("run", "/", 1)), "user"),
        f"""WITH {_STEPS}, pre AS (SELECT user_id::VARCHAR AS "user", run, string_agg(tool, '>') OVER w AS path, count(*) OVER w AS size FROM steps WINDOW w AS (PARTITION BY run ORDER BY step)), rn AS (SELECT "user", count(DISTINCT run) AS runs FROM pre GROUP BY 1),
        c AS (SELECT "user", path, size, count(*) AS support, runs FROM pre JOIN rn USING ("user") GROUP BY ALL), d AS (SELECT *, support >= greatest(2, ceil(0.5 * runs)) AS e FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY e DESC, CASE WHEN e THEN size ELSE support END DESC, CASE WHEN e THEN support ELSE size END DESC, path) AS n FROM d) SELECT "user", path, size, support FROM r WHERE n = 1""",
    ),
    "run_outcome": frame("events", lambda e: mining.run_outcome(calls(e)), f"WITH {_CALLS} SELECT run, count(*) AS n, CASE WHEN NOT bool_and(ok) THEN false END AS succeeded FROM calls GROUP BY 1"),
    "tool_stats": frame("events", lambda e: mining.tool_stats(calls(e), ["user_id", "tool"]), f"WITH {_CALLS} SELECT user_id, tool, count(*) AS calls, count(*) FILTER (ok) AS successes, round(sum(latency), 4) AS latency_sum, max(\"at\") AS last_used FROM calls GROUP BY 1, 2"),
    "approval_patterns": frame(
        "events",
        lambda e: mining.approval_patterns(e.select(F.col("event_type").alias("tool"), (F.col("event_id") % 10).alias("shape"), (F.col("value") > 20).alias("approved"), F.col("user_id").cast("string").alias("reviewer"), (F.col("event_type") != "purchase").alias("reversible")), ["tool", "shape"], 3),
        "WITH v AS (SELECT event_type AS tool, event_id % 10 AS shape, value > 20 AS approved, user_id, event_type <> 'purchase' AS rev FROM events), g AS (SELECT tool, shape, count(*) AS support, count(*) FILTER (approved) AS approved, count(DISTINCT user_id) AS reviewers, bool_and(rev) AS rev FROM v GROUP BY 1, 2) SELECT tool, shape, support, approved, reviewers, CASE WHEN NOT rev OR support < 5 THEN 'ask' WHEN approved / support::DOUBLE >= 0.95 AND reviewers >= 2 THEN 'auto' WHEN approved / support::DOUBLE <= 0.5 THEN 'always_ask' ELSE 'ask' END AS suggestion FROM g WHERE support >= 3",
    ),
    "feeds_edges": frame(
        "events",
        lambda e: mining.feeds(calls(e).join(e.select(F.col("event_id").alias("call"), F.get_json_object("props", "$.k").alias("k")), "call").withColumn("outputs", F.array(F.struct(F.lit("k").alias("field"), F.col("k").alias("value")))).withColumn("inputs", F.col("outputs"))),
        f"WITH {_CALLS}, k AS (SELECT calls.*, json_extract_string(props, '$.k') AS k FROM calls JOIN events ON event_id = call), m AS (SELECT DISTINCT b.run, b.call, a.tool AS source, b.tool AS target FROM k a JOIN k b ON a.run = b.run AND a.k = b.k AND a.\"at\" < b.\"at\" WHERE a.ok) SELECT source, target, 'k' AS field, count(*) AS n FROM m GROUP BY 1, 2",
    ),
    "usage_daily": plan("events", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2"),
    "rate_windows": plan("events", "SELECT user_id, date_trunc('MINUTE', ts) AS minute, count(*) AS n, count(*) > 2 AS over_limit FROM events GROUP BY 1, 2"),
}
