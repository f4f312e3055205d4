import hashlib
import json
from datetime import date, datetime

import pytest
import zstandard
from pyspark.sql import functions as F

from sedge.functions import nested, vectors
from sedge.operators import context, extraction, memory, procedures
from sedge.sources import files


def test_json_leaves(spark):
    assert nested.leaves({"a": {"b": [1, True, None, {"c": " Xyz "}]}, "d": 2.50}) == [("a.b[0]", 1), ("a.b[3].c", " Xyz "), ("d", 2.5)]
    assert [nested.comparable(x) for x in (" Xyz ", 1234.50, 7, "ab", True and "TRUE")] == ["xyz", "1234.5", None, None, "true"]
    deep = {"k": 1}
    for _ in range(9):
        deep = {"x": deep}
    assert nested.leaves(deep) == [] and len(nested.leaves({str(k): k for k in range(500)})) == nested.MAX_FIELDS
    rows = spark.createDataFrame([("r", '{"a": [10, "foo"]}'), ("s", "not json"), ("t", None)], "id string, raw string")
    assert sorted(map(tuple, nested.flattened(rows, "id", "raw").collect())) == [("r", "a[0]", "10", None), ("r", "a[1]", "foo", "foo")]
    assert nested.arg_shape('{"b": 1, "a": "x", "c": [], "d": {}, "e": true, "f": null}') == "a:str,b:num,c:list,d:obj,e:bool,f:null" and nested.arg_shape("x") == ""
    pairs = spark.createDataFrame([(1, [2, 3]), (2, [1])], "id int, c array<int>")
    assert sorted(map(tuple, nested.conflict_pairs(pairs, "id", "c").collect())) == [(1, 2), (1, 3)]
    assert spark.range(1).select(nested.when_shape(F.lit('a:"x'))).first()[0] == 'shape == "a:\\"x"'


def test_tokens_of_any_script_and_hashed_vectors(spark):
    assert vectors.script_tokens("Don't, 日本語 été É") == ["don't", "日", "本", "語", "日本", "本語", "été", "é"]
    v = vectors.hash_vector("red blue")
    want = {}
    for f in ("red", "blue", "red_blue"):
        h = int(hashlib.blake2b(f.encode(), digest_size=8).hexdigest(), 16)
        want[h % 256] = want.get(h % 256, 0) + (1 if h >> 63 else -1)
    assert {i: round(x * 3**0.5, 6) for i, x in enumerate(v) if x} == {i: float(x) for i, x in want.items()}
    assert vectors.embedded(spark.createDataFrame([(1, None), (2, "a b")], "id long, t string"), "id", "t").count() == 2


TURNS = [
    ("My timezone is CET.", ("attribute", "timezone", "cet")),
    ("My favourite food is the Thai curry!", ("preference", "favourite_food", "thai curry")),
    ("I work at Acme Steel.", ("attribute", "works_at", "acme steel")),
    ("I've just moved to Austin last month.", ("attribute", "lives_in", "austin")),
    ("I care about low stock.", ("preference", "cares_about", "low stock")),
    ("Please never call before nine.", ("instruction", "instruction", "never call before nine")),
    ("We decided to ship on Monday", ("decision", "decided", "ship on monday")),
    ("Decision: go", ("decision", "decided", "go")),
    ("I'm a staff engineer", ("attribute", "role", "staff engineer")),
    ("I need to file the report by Friday", ("preference", "prefers", "to file the report by friday")),
    ("I'd rather source eggs locally", ("preference", "prefers", "source eggs locally")),
    ("I can't stand delays.", ("preference", "dislikes", "delays")),
    ("I never use taxis", ("preference", "avoids", "taxis")),
    ("I'm a nurse in Boston.", ("attribute", "role", "nurse at boston")),
    ("I've moved to the marketing team", None),
    ("Mir ist eine kurze Lieferzeit besonders wichtig", ("preference", "cares_about", "eine kurze lieferzeit")),
    ("Permanently prefer weekly summaries", ("preference", "cares_about", "weekly summaries")),
    ("To reset it, run the tool twice", ("procedure", "procedure", "")),
    ("It has failed.", None),
    ("the thing is odd", None),
    ("the lift failed", ("event", "event", "")),
    ("The lock code for the hazardous materials cage in Warehouse 3 is 8492", ("fact", "is", "8492")),
    ("The kids and I went to the beach and it was great", None),
    ("What do I like?", None),
    ("The moon is far.", ("fact", "is", "far")),
]


def test_rules_read_sentences(spark):
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(TURNS)], "id int, text string")
    out = extraction.facts(rows, "id", F.lit("u"), F.col("text")).collect()
    got = {r.id: (r.category, r.predicate, r.object) for r in out if r.category != "verbatim_turn"}
    assert got == {i: f for i, (_, f) in enumerate(TURNS) if f}
    assert sum(r.category == "verbatim_turn" for r in out) == len(TURNS)


def test_clauses_and_subjects(spark):
    rows = spark.createDataFrame([(1, "My name is Ann and my timezone is CET."), (2, "We have two vans. The Van is red."), (3, None), (4, " ")], "id int, text string")
    out = extraction.facts(rows, "id", F.lit("user:a"), F.col("text")).where("category <> 'verbatim_turn'").collect()
    assert sorted((r.id, r.sentence, r.subject, r.predicate, r.object) for r in out) == [(1, 0, "user:a", "name", "ann"), (1, 1, "user:a", "timezone", "cet"), (2, 0, "user:a", "have", "two vans"), (2, 1, "van", "is", "red")]


def test_statement_kinds(spark):
    cases = [("Never use the lift if it smokes.", "CONDITIONAL_RULE"), ("Always lock the door.", "RULE"), ("Actually, it is Tuesday.", "CORRECTION"), ("The shop opened in May.", "LIFECYCLE"), ("The line is currently down.", "STATUS"), ("Is it?", None), ("Thanks!", None), ("Please list them", None), ("Water is wet.", "FACT")]
    rows = spark.createDataFrame([(x,) for x, _ in cases], "x string").select(extraction.statement_kind(F.col("x")).alias("k")).collect()
    assert [r.k for r in rows] == [k for _, k in cases]
    assert spark.range(1).select(extraction.turn_kind(F.array(F.lit("FACT"), F.lit("RULE")))).first()[0] == "RULE"


def test_index_texts(spark):
    at = F.lit("2024-05-08 10:00:00").cast("timestamp")
    own = extraction.index_text(at, F.lit("user:ann"), F.lit("USER"), F.lit("I moved"))
    got = spark.range(1).select(own.alias("a"), extraction.index_text(at, F.lit("thr_1"), F.lit("USER"), F.lit("x"), F.lit("y")).alias("b"), extraction.context_text(own, F.lit("agent:bo"), F.lit("Where to?")).alias("c")).first()
    assert tuple(got) == ("[2024-05-08] ann: user: I moved", "[2024-05-08] user: x\ny", "bo: Where to?\n[2024-05-08] ann: user: I moved")


def test_values_tables_terms(spark):
    assert extraction.values_of("EUR 1.5 million is 12% of $20 and 3 GBP") == [("money", 1.5e6, "EUR", 0), ("percent", 12.0, None, 19), ("money", 20.0, "USD", 26), ("money", 3.0, "GBP", 34)]
    table = spark.createDataFrame([(1, 0, "table", "| m | 2023 | 2024 |\n|---|---|---|\n| EBITDA | 5 | |\n| Cash | 1 | 2 |")], "doc_id long, ordinal int, kind string, text string")
    assert sorted((r.metric, r.period, r.value) for r in extraction.table_facts(table).collect()) == [("Cash", "2023", "1"), ("Cash", "2024", "2"), ("EBITDA", "2023", "5")]
    rows = spark.createDataFrame([(1, "Net debt means all loans.\nSee Section 2.1, table 4 and note[^a]. The European Central Bank (ECB) said so.")], "id int, t string")
    assert {r.term for r in extraction.definitions(rows, "id", "t").collect()} >= {"Net debt", "ECB"}
    assert {(r.kind, r.number) for r in extraction.references(rows, "id", "t").collect()} == {("section", "2.1"), ("table", "4"), ("footnote", "a")}


def test_procedures(spark):
    calls = []
    for k, (run, tools) in enumerate([("r1", "abc"), ("r2", "abc"), ("r3", "abd"), ("r4", "ab")]):
        calls += [(run, j, 10 * k + j, x, True, 1.0, "p") for j, x in enumerate(tools)]
    df = spark.createDataFrame(calls, "run string, at int, call int, tool string, ok boolean, latency double, pattern string").withColumn("at", F.to_date(F.concat(F.lit("2024-01-0"), (F.col("at") + 1).cast("string"))))
    outcome = spark.createDataFrame([("r1", True), ("r2", True), ("r3", True), ("r4", False)], "run string, succeeded boolean")
    plan = procedures.mine(df, outcome)
    row = plan.first()
    assert (row.path, row.support, row.runs, row.rate) == ("a>b>c", 2, 2, 1.0)
    status = lambda rejected, day: procedures.with_status(plan, spark.createDataFrame(rejected, "pattern string, path string"), F.lit(day).cast("date")).first().status
    assert [status([], "2024-01-10"), status([], "2024-06-01"), status([("p", "a>b>c")], "2024-01-10")] == ["active", "retired", "rejected"]
    done = spark.createDataFrame([("x", "p", ["a", "z", "b"]), ("y", "p", ["a", "b", "c"])], "run string, pattern string, tools array<string>")
    assert {r.run: r.next_tool for r in procedures.next_step(plan, done).collect()} == {"x": "c", "y": None}
    args = spark.createDataFrame([("x", "id"), ("x", "unit"), ("x", "who")], "run string, argument string")
    first, second = (spark.createDataFrame(d, "run string, argument string, value string") for d in ([("x", "id", "7")], [("x", "id", "8"), ("x", "unit", "kg")]))
    assert {r.argument: (r.value, r.source) for r in procedures.filled(args, first, second).collect()} == {"id": ("7", 0), "unit": ("kg", 1), "who": (None, None)}


def test_bindings(spark):
    steps = spark.createDataFrame([("p", 2, "b")], "pattern string, step int, tool string")
    field = "array<struct<field:string,value:string>>"
    calls = spark.createDataFrame([("p", r, 2, "b", [("id", v), ("unit", "kg")]) for r, v in (("r1", "x1"), ("r2", "x2"))], f"pattern string, run string, step int, tool string, inputs {field}")
    given = spark.createDataFrame([("r1", 1, "out.id", "x1"), ("r2", 1, "out.id", "x2")], "run string, step int, field string, value string")
    got = {r.argument: (r.source_step, r.source_field, r.constant) for r in procedures.bindings(steps, calls, given).collect()}
    assert got == {"id": (1, "out.id", None), "unit": (None, None, "kg")}


def test_tool_search(spark):
    tools = spark.createDataFrame([(1, "create invoice for a customer"), (2, "delete invoice"), (3, "weather report")], "tool_id int, text string")
    tasks = spark.createDataFrame([(1, "please create an invoice")], "item_id int, text string")
    got = procedures.tool_search(tasks, tools).orderBy("rank").collect()
    assert [r.id for r in got] == [1, 2] and got[0].relevance == 1.0


def test_pages_and_windows(spark):
    day = lambda s: date.fromisoformat(s) if s else None
    beliefs = [("p", "work", "at Acme", day("2023-01-01"), None), ("p", "home", "in Rome", day("2022-01-01"), None), ("p", "home", "in Oslo", day("2020-01-01"), day("2022-01-01"))]
    page = context.person_page(spark.createDataFrame(beliefs, "person string, facet string, text string, since date, until date"), ["home", "work"]).first().page
    assert page == "in Rome\nin Oslo (until 2022-01-01)\nat Acme"
    pins = spark.createDataFrame([(1, "tools", 30), (1, "profile", 15), (1, "people", 10)], "query int, section string, tokens int")
    assert {r.section for r in context.pinned(pins, 100).collect()} == {"profile", "tools"}
    items = context.handles(spark.createDataFrame([("q", datetime(2024, 1, 2), "b"), ("q", datetime(2024, 1, 1), "a")], "query string, at timestamp, text string"), "query", "m", F.col("text"))
    assert context.timeline(items, "query").first().lines == "[m1] 2024-01-01: a\n[m2] 2024-01-02: b"
    status = lambda *x: spark.range(1).select(context.evidence_status(*(F.lit(v) for v in x))).first()[0]
    assert [status(True, False, True, True, False, True, False), status(True, False, False, True, False, True, False), status(True, False, True, True, True, True, False), status(False, True, True, True, False, True, False)] == ["COMPLETE", "INSUFFICIENT", "INCOMPLETE", "INSUFFICIENT"]


def test_cache_is_guarded_by_figures(spark):
    asked = spark.createDataFrame([(1, "cost of 3 bolts"), (2, "cost of 4 bolts")], "query int, text string").select("query", context.guarded_signature(F.col("text"), F.lit("s")).alias("signature"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    kept = asked.where("query = 1").select("signature", F.lit("b1").alias("bundle"), "vector", F.lit(1).alias("revision"), F.lit(1).alias("current"))
    assert [(r["query"], r.bundle) for r in context.cached(asked, kept).collect()] == [(1, "b1")]


def test_memory_state(spark):
    src = spark.createDataFrame([("d", 1, ["a", "b"]), ("d", 2, ["b", "c"]), ("e", 1, ["a"]), ("e", 3, ["c"])], "derived string, source int, keys array<string>")
    assert {r.derived: list(r["keys"]) for r in memory.source_audience(src).collect()} == {"d": ["b"], "e": []}
    t0, now = datetime(2024, 1, 1), F.lit("2024-06-01").cast("timestamp")
    rows = spark.createDataFrame([(1, t0, None, t0, 0.3, 1, 0, "CURRENT", False), (2, t0, None, t0, 0.3, 1, 0, "CURRENT", True), (3, t0, datetime(2024, 5, 30), t0, 0.9, 3, 0, "CURRENT", False)], "id int, updated_at timestamp, accessed_at timestamp, created_at timestamp, importance double, accesses int, reinforcement int, status string, lasting boolean")
    assert {r.id: r.status for r in memory.sweep(rows, now).collect()} == {1: "ARCHIVED", 2: "CURRENT", 3: "CURRENT"}


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_bytes("# A\x00b é".encode())
    (tmp_path / "in/b.pdf").write_bytes(b"%PDF")
    good, refused = files.text_files(spark, str(tmp_path / "in"))
    assert [(r.media, r.text) for r in good.collect()] == [("text/markdown", "# Ab é")] and refused.count() == 1
    (tmp_path / "log").mkdir()
    (tmp_path / "log/m.jsonl").write_text("\n".join(json.dumps({"thread": "t", "role": "user", "text": x, "at": f"2024-01-01T00:00:0{k}", "source": "s", "message_id": m}) for k, (x, m) in enumerate([("a", "1"), ("a again", "1"), ("b", "2")])))
    assert sorted(r.text for r in files.message_log(spark, str(tmp_path / "log")).collect()) == ["a", "b"]
    held = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 1)], "id int, v string, version int")
    changes = spark.createDataFrame([(1, "A", 2, False), (2, "b", 2, True), (4, "d", 1, False), (3, "old", 0, False)], "id int, v string, version int, deleted boolean")
    assert sorted((r.id, r.v) for r in files.upserted(held, changes, ["id"], "version").collect()) == [(1, "A"), (3, "c"), (4, "d")]
    index = spark.createDataFrame([("d1", "c1"), ("d1", "c2"), ("d2", "c3")], "doc string, chunk string")
    assert {r.chunk for r in files.purge(index, spark.createDataFrame([("d1", "c2"), ("d1", "c9")], "doc string, chunk string"), "doc", "chunk").collect()} == {"c2", "c3"}
    raw = b'{"x": 1}\n'
    listed = spark.createDataFrame([("s1", hashlib.sha256(raw).hexdigest()), ("s2", "x"), ("s3", "y")], "seg string, sha256 string")
    stored = spark.createDataFrame([("s1", raw), ("s2", raw), ("s4", raw)], "seg string, raw binary")
    assert {r.seg: r.state for r in files.reconcile(listed, stored, ["seg"]).collect()} == {"s2": "differs", "s3": "missing", "s4": "not_listed"}
    assert zstandard.decompress(zstandard.compress(raw)) == raw


def test_standing_rules(spark):
    rules = spark.createDataFrame([(1, "u", "Never ship bolts on Friday", False), (2, "u", "Be brief", True), (3, "u", "Paint is toxic", False), (4, "v", "Be loud", True)], "rule int, person string, text string, always boolean")
    tasks = spark.createDataFrame([(7, "u", "ship the bolts")], "task int, person string, text string")
    assert {r.rule for r in context.standing(rules, tasks).collect()} == {1, 2}


def test_applied_decisions(spark):
    new = spark.createDataFrame([("n1", "x", 5), ("n2", "y", 6), ("n3", "z", 7)], "id string, content string, since int")
    held = spark.createDataFrame([("h1", "a", 0), ("h2", "b", 1)], "id string, content string, reinforcement long")
    told = spark.createDataFrame([("n1", "REINFORCE", "h2"), ("n2", "SUPERSEDE", "h1"), ("n3", "CREATE", None)], "id string, decision string, target string")
    got = {r.id: (r.status, r.reinforcement, r.replaced_by) for r in memory.applied(new, held, told).collect()}
    assert got == {"h1": ("SUPERSEDED", 0, "n2"), "h2": ("CURRENT", 2, None), "n2": ("CURRENT", 0, None), "n3": ("CURRENT", 0, None)}


def test_confidence_is_clamped_at_each_step(spark):
    from sedge.functions import scores as s

    got = spark.range(1).select(s.confidence_after(F.lit(0.95), F.array(F.lit(0.1), F.lit(0.1), F.lit(-0.05)))).first()[0]
    assert got == pytest.approx(0.95)


def test_definitions_and_short_forms(spark):
    rows = spark.createDataFrame([(1, "The European Central Bank (ECB) met the board (new)."), (2, '"Free cash" denotes money.'), (3, "nothing means much"), (4, None), (5, "Gross Margin (GM) and Net (XYZ)")], "id int, t string")
    got = sorted((r.id, r.term) for r in extraction.definitions(rows, "id", "t").collect())
    assert got == [(1, "ECB"), (1, "European Central Bank"), (2, "Free cash"), (5, "GM"), (5, "Gross Margin"), (5, "XYZ")]


def test_summaries_take_the_sentences_that_others_share_words_with(spark):
    from sedge.operators import documents

    text = "Rivers carry water down the mountain. Water in rivers feeds the valley fields. Nobody mentioned bicycles yesterday evening. Mountain rivers flood the valley."
    df = spark.createDataFrame([(1, text), (2, None), (3, "Short.")], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in documents.summaries(df, sentences=2).collect()}
    assert got[2] == got[3] == "" and "bicycles" not in got[1] and got[1].endswith("Mountain rivers flood the valley.")


def test_routes_of_tickets_and_threads(spark):
    from sedge.operators import evidence

    asked = ["what of AB-123", "scroll back a bit", "remind me what it was", "i usually walk", "the high-level view", "list all of them", "hello"]
    df = spark.createDataFrame(list(enumerate(asked)), "n int, q string")
    got = [r.k for r in df.select("n", evidence.route(F.col("q")).alias("k")).orderBy("n").collect()]
    assert got == ["EXACT_IDENTIFIER", "CONVERSATION_HISTORY", "CONVERSATION_HISTORY", "USER_MEMORY", "GLOBAL_SUMMARY", "DOCUMENT_MULTI_HOP", "GENERAL_SEMANTIC"]
