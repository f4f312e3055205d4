from datetime import date, datetime

from pyspark.sql import functions as F

from sedge.operators import dedup, documents, serving


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_final_scores(spark):
    arms = spark.createDataFrame([(1, "bm25", "a", 1), (1, "bm25", "b", 2), (1, "colbert", "b", 1), (1, "dense", "c", 3)], "query int, arm string, id string, rank int")
    facts = spark.createDataFrame([(1, "a", "s1", False, True, True), (1, "b", "s2", False, False, False), (1, "c", "s2", True, False, False)], "query int, id string, session string, speaks boolean, timed boolean, dated boolean")
    got = {r.id: (r.score, r["rank"]) for r in serving.memory_scores(arms, facts).collect()}
    a, b, c = 1 / 11, 1 / 12 + 6 / 11, 1 / 13
    want = {"a": a + 0.3 * a + 4 / 11, "b": b + 0.3 * b, "c": c + 0.3 * b + 1 / 11}
    assert {k: round(v, 9) for k, v in want.items()} == {k: v for k, (v, _) in got.items()}
    assert [k for k, _ in sorted(got.items(), key=lambda x: x[1][1])] == ["b", "a", "c"]


def test_floor(spark):
    items = [("q", f"m{k}", k, "memory", 0.1, False, False) for k in range(1, 8)] + [("q", "top", 8, "memory", 0.5, False, False), ("q", "doc", 9, "chunk", 0.1, False, False), ("q", "comp", 10, "chunk", 0.1, True, False), ("r", "x", 1, "memory", 0.1, False, False), ("r", "y", 2, "memory", 0.3, False, False)]
    df = spark.createDataFrame(items, "query string, id string, rank int, kind string, similarity double, companion boolean, exact boolean")
    got = rows(serving.above_floor(df), "query", "rank", "id")
    assert [x[2] for x in got if x[0] == "q"] == ["top", "comp", "m1", "m2", "m3", "m4", "m5"] and [x[2] for x in got if x[0] == "r"] == ["y"]


def test_expansion_and_companions(spark):
    seeds = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query int, id string, rank int")
    edges = spark.createDataFrame([("a", "n", "NEXT"), ("b", "d", "DEFINED_BY"), ("a", "b", "NEXT"), ("a", "twin", "FOOTNOTE"), ("b", "p", "PARENT")], "src string, dst string, kind string")
    texts = spark.createDataFrame([("a", "1"), ("b", "2"), ("n", "3"), ("d", "4"), ("twin", "1"), ("p", "5")], "id string, hash string")
    assert rows(serving.expanded(seeds, edges, texts, 2), "place", "id", "edge") == [(1, "d", "DEFINED_BY"), (2, "p", "PARENT")]
    below = spark.createDataFrame([("d", "d"), ("d", "d1"), ("twin", "twin")], "node string, part string")
    assert rows(serving.missing_companions(seeds, edges, below), "seed", "needs") == [("a", "twin"), ("b", "d")]
    more = seeds.union(spark.createDataFrame([(1, "d1", 3)], "query int, id string, rank int"))
    assert rows(serving.missing_companions(more, edges, below), "needs") == [("twin",)]


def test_chains_and_bridges(spark):
    ranked = spark.createDataFrame([(1, "old", 1), (1, "x", 2)], "query int, id string, rank int")
    chain = spark.createDataFrame([("old", "mid"), ("mid", "new")], "id string, by string")
    assert [r[1] for r in rows(serving.followed(ranked, chain), "rank", "id")] == ["new", "mid", "old", "x"]
    texts = spark.createDataFrame([("old", "Ann works for Acme Steel"), ("x", "rain again")], "id string, text string")
    asked = spark.createDataFrame([(1, "who is ann's boss, ann")], "query int, text string")
    assert rows(serving.bridges(ranked, texts, asked), "bridge", "text") == [("old", "acme steel works")]


def test_gaps_and_overlap(spark):
    cell = lambda c: spark.range(1).select(c).first()[0]
    assert cell(serving.unanswered(F.lit("What is the phone number for WO-7?"), F.lit("WO-9 is near"))) == ["phone", "code #wo7"]
    assert cell(serving.unanswered(F.lit("What is the email?"), F.lit("a@b.org"))) == []
    assert cell(serving.expand_glossary(F.lit("PO and eta?"))) == "PO (purchase order) and eta (estimated time of arrival)?"
    asked = spark.createDataFrame([(1, "pumps?"), (2, "of the"), (3, "cars")], "query int, text string")
    seen = spark.createDataFrame([(1, "a pump broke"), (2, "x"), (3, "boats")], "query int, text string")
    # "pumps" is cut to its stem, "pump" is one
    assert rows(serving.grounded_in(asked, seen), "query", "overlaps") == [(1, True), (2, False), (3, False)]


def test_passages_and_sections(spark):
    texts = spark.createDataFrame([(1, "Alpha one here. Beta two here. Gamma three here. Delta four here.")], "id int, text string")
    weights = spark.createDataFrame([(1, "gamma", 2.0), (1, "alpha", 1.0)], "id int, word string, weight double")
    assert serving.passages(texts, weights, 46).first().passage == "Alpha one here. … Gamma three here."
    doc = spark.createDataFrame([(1, "# A\nx\n## B\ny\n### C\nz\n## D\nw")], "doc_id long, text string")
    got = {r.section: r.text for r in serving.section_texts(documents.hierarchy(documents.blocks(doc))).collect()}
    assert got == {0: "x\ny\nz\nw", 2: "y\nz", 4: "z", 6: "w"}


def test_small_folds(spark):
    log = [("m", 1, "remember", "a"), ("m", 2, "correct", "b"), ("m", 3, "retract", None), ("m", 4, "restore", None), ("n", 1, "remember", "x"), ("n", 2, "retract", None), ("o", 1, "remember", "s"), ("o", 2, "forget", None)]
    assert rows(serving.folded(spark.createDataFrame(log, "id string, n int, command string, content string")), "id", "status") == [("m", "CURRENT"), ("n", "RETRACTED"), ("o", "FORGOTTEN")]
    rel = spark.createDataFrame([("Acme", "based_in", "Rome", 0.9), ("Acme", "makes", "steel", 0.8)], "subject string, predicate string, object string, confidence double")
    assert serving.entity_summaries(rel).first().summary == "Acme: based in Rome; makes steel"
    assert rows(serving.forbidden(spark.createDataFrame([("send_mail",), ("read",)], "tool string"), spark.createDataFrame([(1, "Never use send_mail at night"), (2, "Use read")], "rule int, text string")), "tool", "rule") == [("send_mail", 1)]
    kept = serving.retained(spark.createDataFrame([("t", "a", date(2024, 1, 1)), ("t", "b", date(2024, 1, 1)), ("t", "a", date(2024, 2, 1))], "tenant string, kind string, at date"), spark.createDataFrame([("t", "a", 30)], "tenant string, kind string, days int"), F.lit("2024-02-20").cast("date"))
    assert rows(kept, "kind", "at") == [("a", date(2024, 2, 1)), ("b", date(2024, 1, 1))]
    recent = serving.recent_or_exact(spark.createDataFrame([("u", k, "m", datetime(2024, 1, k), str(k)) for k in range(1, 6)], "user string, id int, kind string, at timestamp, hash string"), "user", {"m": 2}, spark.createDataFrame([("u", "1")], "user string, hash string"))
    assert rows(recent, "id") == [(1,), (4,), (5,)]
    granted = spark.createDataFrame([("u", "thread:t1"), ("u", "group:g"), ("u", "thread:t0")], "subject string, object string")
    assert tuple(serving.scope_keys(granted).first()) == ("u", ["t0", "t1"], [], ["g"])
    hits = serving.exact_hits(spark.createDataFrame([(1, "open mem_ab12 and doc_zz99")], "query int, text string"), spark.createDataFrame([("mem_ab12", "memory")], "id string, kind string"))
    assert rows(hits, "id", "score") == [("mem_ab12", 1.0)]
    names = spark.createDataFrame([("e", "Acme", False), ("e", "A-1", True)], "entity string, name string, is_id boolean")
    calls = spark.createDataFrame([("t", [("x", "acme"), ("y", "a-1")])], "tool string, inputs array<struct<field:string,value:string>>")
    assert rows(serving.tool_entities(calls, names), "kind") == [("identified_by",), ("used_entity",)]


def test_orders(spark):
    ranked = spark.createDataFrame([(1, "a", 1, 1.0, True), (1, "b", 2, 0.9, False), (1, "c", 3, 0.9, False)], "query int, id string, rank int, score double, earlier_value boolean")
    assert [r[1] for r in rows(serving.current_first(ranked), "rank", "id")] == ["b", "c", "a"]
    assert [r[1] for r in rows(serving.by_standing(ranked, F.when(F.col("id") == "c", 1.15).otherwise(1.0)), "rank", "id")] == ["c", "a", "b"]


def test_said_again_and_built(spark):
    from sedge.operators import feedback, memory

    said = spark.createDataFrame([("a", "s", "The gate is red.", 1), ("b", "s", "the gate is  red", 5), ("c", "s", "the gate is red", 9), ("d", "z", "The gate is red", 2)], "id string, scope string, content string, at int")
    assert rows(memory.corroborated(said), "id", "admitted_at") == [("a", 5)]
    new = spark.createDataFrame([("s", "u", "likes", "Tea", "preference"), ("s", "u", "does", "x", "task")], "scope string, subject string, predicate string, content string, kind string")
    out = memory.built(new, F.lit("2024-01-01 00:00:00").cast("timestamp"), {"short_term": 7}).collect()
    assert [(r.lifetime, r.expires_at) for r in out] == [("long_term", None), ("short_term", datetime(2024, 1, 8))] and all(r.memory_id.startswith("mem_") for r in out)
    words = lambda s: F.array(*(F.lit(w) for w in s.split()))
    got = spark.range(1).select(feedback.bleu1(words("a b b"), words("a b")).alias("x"), feedback.bleu1(words("a"), words("a b")).alias("y")).first()
    assert (round(got.x, 6), round(got.y, 6)) == (0.666667, 0.367879)
    votes = spark.createDataFrame([("m", 2, 1, False), ("m", 1, 2, True)], "memory string, at int, id int, up boolean")
    assert feedback.answer_step(votes).first().steps == [0.05, -0.05]


def test_cosine_top_leaves_out_rows_without_a_vector(spark):
    from sedge.operators import retrieval

    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.9, 0.1]), (None, [1.0, 0.0]), (4, [None, 1.0]), (5, []), (6, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query, r.id) for r in retrieval.cosine_top(df, df, k=1).collect()]
    assert sorted(got)[:2] == [(1, 3), (3, 1)] and {q for q, _ in got} == {1, 3, 6}


def test_likeness_within_a_column(spark):
    rows = spark.createDataFrame([(1, "x", "red green blue"), (2, "y", "green blue red"), (3, "x", "blue red green"), (4, None, "red green blue")], "id int, scope string, text string")
    found = lambda **k: {(r.a, r.b) for r in dedup.likeness_pairs(rows, rows, 0.8, "id", "id", **k).where("a < b").collect()}
    assert found() == {(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)}
    assert found(within="scope") == {(1, 3)}
