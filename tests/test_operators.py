from datetime import date

import pytest
from pyspark.sql import functions as F

from sedge.functions import scores as s
from sedge.functions import text as t
from sedge.operators import access, conversation, dedup, documents, evidence, feedback, graph, memory, mining, retrieval, temporal


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "text,want",
    [("  My timezone  is CET. ", "my timezone is cet"), ("A\nB!!", "a b"), ("", "")],
)
def test_normal_form(spark, text, want):
    assert one(spark, t.normalize(F.col("a")), a=text) == want


def test_text_functions(spark):
    assert one(spark, t.figures(F.col("a")), a="ship 1,200 of WO-K3 and 3.5") == ["1200", "3", "3.5", "#wok3"]
    assert one(spark, t.has_negation(F.col("a")), a="I don't") and not one(spark, t.has_negation(F.col("a")), a="knot")
    assert one(spark, t.sentences(F.col("a")), a="One. Two!\n- three\n12") == ["One.", "Two!", "three"]
    assert one(spark, t.strip_turn_prefix(F.col("a")), a="[8 May, 2023] Ada L: I moved to Paris: it was great.") == "I moved to Paris: it was great."
    assert one(spark, t.strip_turn_prefix(F.col("a")), a="Decision: ship it") == "Decision: ship it"
    assert one(spark, t.detect_script(F.col("a")), a="привет ok") == "cyrillic" and one(spark, t.detect_script(F.col("a")), a="12") == "none"
    assert [one(spark, t.latin_language(F.col("a")), a=x) for x in ("where is the dog", "wo ist der Hund", "¿dónde está el perro?", "naïve", "12")] == ["en", "de", "es", "und", "und"]
    assert one(spark, t.task_pattern(F.col("a")), a="Send INV-2201 for EUR 700 to a@b.org by 2024-01-02, 3 copies") == "send {id} for {money} to {email} by {date}, {num} copies"
    assert [one(spark, t.estimate_tokens(F.col("a")), a=x) for x in ("", "abcd" * 3, "a\nb\n", "日本")] == [1, 3, 3, 6]


def test_entailment_by_words(spark):
    nli = lambda p, c: one(spark, s.lexical_nli(F.col("p"), F.col("c")), p=p, c=c)
    same = nli("Revenue increased to EUR 98 million in 2024", "Revenue increased to EUR 98 million")
    assert same.entailment == 0.95 and same.contradiction == 0.0
    for claim in ("Revenue decreased to EUR 98 million in 2024", "Revenue increased to EUR 150 million in 2024", "Revenue did not increase to EUR 98 million in 2024"):
        assert nli("Revenue increased to EUR 98 million in 2024", claim).contradiction >= 0.7, claim
    assert nli("x", "the of").neutral == 1.0


def test_consolidation_ladder(spark):
    cols = "id string, scope string, owner string, subject string, predicate string, object string, content string"
    held = [
        ("m1", "s", "u", "user", "timezone", "CET", "My timezone is CET", False),
        ("m2", "s", "u", "user", "likes", "tea", "I like green tea in the morning", False),
        ("m3", "s", "v", "Acme", "location", "Berlin", "Acme is located in Berlin", True),
        ("m4", "s", "u", "pump", "note", "7", "The pump in hall seven needs a new filter every four weeks by plan", False),
        ("m5", "z", "u", "user", "timezone", "PST", "My timezone is PST", False),
    ]
    new = [
        ("a", "s", "u", "user", "x", "", "my timezone is CET.", False),
        ("b", "s", "u", "user", "timezone", "GMT", "I now use GMT", False),
        ("c", "s", "u", "user", "likes", "the tea", "Tea is what I like", False),
        ("d", "s", "u", "user", "likes", "coffee", "I like coffee", False),
        ("e", "s", "u", "Acme", "location", "Munich", "Acme sits in Munich", False),
        ("f", "s", "u", "pump", "remark", "", "The pump in hall seven needs a new filter every four weeks by the plan", False),
        ("g", "s", "u", "user", "likes", "black tea", "I no longer like green tea in the morning", True),
        ("h", "z", "u", "user", "timezone", "PST", "Pacific time", False),
        ("i", "q", "u", "user", "timezone", "CET", "My timezone is CET", False),
    ]
    out = memory.consolidate(spark.createDataFrame(new, cols + ", negates boolean"), spark.createDataFrame(held, cols + ", shared boolean"))
    assert {r.id: (r.decision, r.target) for r in out.collect()} == {
        "a": ("REINFORCE", "m1"), "b": ("SUPERSEDE", "m1"), "c": ("REINFORCE", "m2"), "d": ("CREATE", None), "e": ("CONTRADICT", "m3"), "f": ("REINFORCE", "m4"), "g": ("SUPERSEDE", "m2"), "h": ("REINFORCE", "m5"), "i": ("CREATE", None),
    }


def test_versions_do_not_depend_on_arrival(spark):
    rows = [(1, "a", 10, "x"), (2, "a", 30, "y"), (3, "a", 20, "x"), (4, "a", 40, "z"), (5, "b", 5, "q")]
    want = None
    for order in (rows, rows[::-1]):
        got = sorted((r.id, r.valid_to, r.replaces, r.replaced_by) for r in temporal.supersede(spark.createDataFrame(order, "id int, slot string, since int, value string"), ["slot"], "since", "id", "value").collect())
        assert want in (None, got)
        want = got
    assert want == [(1, 30, None, 2), (2, 40, 1, 4), (4, None, 2, None), (5, None, None, None)]


def test_fiscal_years(spark):
    cal = temporal.fiscal_years(spark, 2022, 2025).collect()
    year = [r for r in cal if r.fiscal_year == 2023]
    assert (year[0].starts, year[-1].ends, sum(r.weeks for r in year)) == (date(2023, 1, 29), date(2024, 2, 3), 53)
    assert [r.weeks for r in cal if r.fiscal_year == 2024] == [4, 5, 4] * 4
    days = spark.createDataFrame([(date(2024, 2, 3),), (date(2024, 2, 4),)], "day date")
    got = temporal.fiscal_position(days, F.col("day"), temporal.fiscal_years(spark, 2022, 2025)).orderBy("day").collect()
    assert [(r.fiscal_year, r.fiscal_week, r.period, r.quarter) for r in got] == [(2023, 53, 12, 4), (2024, 1, 1, 1)]


def test_dates_in_words(spark):
    parse = lambda x: one(spark, temporal.parse_date(F.col("a")), a=x)
    assert [parse(x) for x in ("on 2024-02-29.", "May 8, 2023", "in June 2021", "2023-02-30", "none")] == [date(2024, 2, 29), date(2023, 5, 8), date(2021, 6, 1), None, None]
    days = lambda x: one(spark, temporal.relative_days(F.col("a"), F.lit("2024-03-01").cast("date")), a=x)
    assert tuple(days("last week")) == (date(2024, 2, 19), date(2024, 2, 25)) and tuple(days("last friday")) == (date(2024, 2, 23),) * 2 and days("soon") is None
    assert one(spark, temporal.valid_from_cue(F.col("a")), a="I live here since May 2020, gladly") == "May 2020"


MARK = """# Report
<!-- page: 2 -->
Intro text.

## One
- a
- b

Table 1: Sales
| x | y |
| 1 | 2 |

### Deep
```py
code
```
[^1]: A note
    that goes on
## Two
End.
# Next
Tail."""


def test_blocks_and_tree(spark):
    df = spark.createDataFrame([(1, MARK), (2, None), (3, "")], "doc_id long, text string")
    rows = documents.hierarchy(documents.blocks(df)).orderBy("ordinal").collect()
    assert [(r.kind, r.text, r.parent, r.path, r.page) for r in rows] == [
        ("heading", "Report", None, "Report", None),
        ("paragraph", "Intro text.", 0, "Report", 2),
        ("heading", "One", 0, "Report > One", 2),
        ("list", "- a\n- b", 2, "Report > One", 2),
        ("table", "| x | y |\n| 1 | 2 |", 2, "Report > One", 2),
        ("heading", "Deep", 2, "Report > One > Deep", 2),
        ("code", "code", 5, "Report > One > Deep", 2),
        ("footnote", "A note that goes on", 5, "Report > One > Deep", 2),
        ("heading", "Two", 0, "Report > Two", 2),
        ("paragraph", "End.", 8, "Report > Two", 2),
        ("heading", "Next", None, "Next", 2),
        ("paragraph", "Tail.", 10, "Next", 2),
    ]
    assert rows[4].label == "Table 1: Sales"
    edges = {(r.src, r.dst, r.kind) for r in documents.context_edges(documents.hierarchy(documents.blocks(df))).collect()}
    assert {(0, 1, "CHILD"), (1, 0, "PARENT"), (1, 2, "NEXT"), (2, 1, "PREVIOUS"), (0, 10, "NEXT")} <= edges
    spans = {r.section: (r.first_page, r.last_page, r.nodes) for r in documents.page_spans(documents.hierarchy(documents.blocks(df))).collect()}
    assert spans[0][2] == 10 and spans[2][2] == 6


def test_markdown_of_html():
    page = "<style>p{}</style><h2>T &amp; U</h2><p>a <b>b</b><ul><li>x</li></ul><table><tr><th>k</th><td>v w</td></tr></table><pre>p  q</pre><script>no</script>"
    assert [b[1:3] for b in documents.blocks_of(documents.markdown_of(page))] == [("heading", "T & U"), ("paragraph", "a b"), ("list", "- x"), ("table", "| k | v w |"), ("code", "p  q")]


def test_chunks_are_slices_that_fit():
    text = "\n".join(" ".join(f"word{k}{j}." for j in range(60)) for k in range(30)) + "\n" + "x" * 5000
    spans = documents.chunk_spans(text)
    assert all(documents._estimate(text[a:b]) <= documents.MAX_TOKENS for a, b in spans)
    covered = bytearray(len(text))
    for a, b in spans:
        covered[a:b] = b"\1" * (b - a)
    assert all(covered)
    table = "| a | b |\n" + "\n".join(f"| {k} | {'y' * 40} |" for k in range(100))
    assert all(c.startswith("| a | b |\n") for c in documents.chunk_texts("table", table))


def test_claims_and_verdicts(spark):
    answer = "Revenue rose to EUR 98 million [c1]. Is that so? Costs fell in 2024 (source: c2 p. 3). The pump is blue."
    said = evidence.claims_of(answer)
    assert [(x, c) for _, x, c in said] == [("Revenue rose to EUR 98 million", ["c1"]), ("Costs fell in 2024", ["c2 p. 3"]), ("The pump is blue", [])]
    claimed = evidence.claims(spark.createDataFrame([(1, "Revenue rose to EUR 98 million [c1]. Revenue rose to EUR 150 million. The moon is green cheese. The plant opened in Berlin in 2020.")], "answer long, text string"))
    held = spark.createDataFrame([(1, "c1", 0, "Revenue rose to EUR 98 million", "chunk"), (1, "c2", 1, "The plant opened in Berlin in 2020", "chunk")], "answer long, item string, position int, text string, kind string")
    got = {r.claim: (r.verdict, r.item) for r in evidence.verdicts(claimed, held).collect()}
    assert got[0] == ("supported", "c1") and got[1] == ("contradicted", "c1") and got[2][0] == "unsupported" and got[3] == ("supported", "c2")
    rate = evidence.report(evidence.verdicts(claimed, held), ["answer"]).first()
    assert rate.hallucination_rate == 0.5


def test_packing_passes_over_what_does_not_fit(spark):
    rows = [("q", 1, 1, "a", 50, 1), ("q", 2, 2, "a", 60, 2), ("q", 3, 3, "b", 30, 3), ("q", 4, 4, "b", 10, 3), ("q", 5, 5, "c", 10, 5)]
    got = [(r.id, r.used) for r in evidence.packed(spark.createDataFrame(rows, "query string, id long, rank int, section string, tokens long, seed long"), 100, {"c": 5}).orderBy("id").collect()]
    assert got == [(1, 50), (3, 90), (4, 90)]


def test_graph(spark):
    rel = [("a", "knows", "b", 0.9, 1, "1"), ("a", "knows", "b", 0.8, 1, "2"), ("b", "knows", "c", 0.9, 1, "3"), ("c", "knows", "a", 0.9, 1, "4"), ("d", "knows", "c", 0.9, 1, "5"), ("d", "knows", "e", 0.9, 1, "6")]
    df = spark.createDataFrame(rel, "subject string, predicate string, object string, confidence double, mentions int, id string").withColumn("valid_from", F.lit(None).cast("date")).withColumn("valid_to", F.lit(None).cast("date")).withColumn("observed_at", F.lit("2024-01-01").cast("date"))
    seeds = spark.createDataFrame([("a",)], "entity string")
    assert sorted((r.id, r.hop) for r in graph.neighbourhood(seeds, df, 2).collect()) == [("1", 1), ("3", 2), ("4", 1), ("5", 2)]
    names = spark.createDataFrame([("e1", "Acme Steel", ["acme"]), ("e2", "Steel", [])], "entity string, name string, aliases array<string>")
    asked = spark.createDataFrame([(1, "What does Acme Steel sell?"), (2, "acme?")], "query int, text string")
    assert sorted((r.query, r.entity) for r in graph.query_names(asked, names).collect()) == [(1, "e1"), (1, "e2"), (2, "e1")]
    cycle = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "source int, derived int")
    assert sorted(r.node for r in graph.closure(cycle, spark.createDataFrame([(1,)], "node int")).collect()) == [1, 2, 3]


def test_access(spark):
    tuples = [("doc", "viewer", "team", "member"), ("team", "member", "org", "member"), ("org", "member", "team", "member"), ("org", "member", "ann", None), ("doc", "viewer", "bob", None)]
    got = access.grants(spark.createDataFrame(tuples, "object string, relation string, subject string, subject_relation string"))
    assert {r.subject for r in got.where("object = 'doc'").collect()} == {"ann", "bob"}
    keys = lambda v: one(spark, access.audience_keys(F.lit(v), F.lit("t"), F.lit("u"), F.lit("a"), F.lit("th"), F.lit("r"), F.lit("p"), F.lit("w"), F.array(F.lit("g"))), z=1)
    assert keys("run") == ["run:r", "runup:p", "user:u"] and keys("tenant") == ["tenant:t", "user:u"] and keys("private") == ["user:u"]


def test_votes(spark):
    rows = [("v", 1, 1, 1, "up"), ("v", 1, 2, 2, "up"), ("v", 1, 3, 3, "down"), ("v", 1, 4, 4, "up"), ("w", 1, 1, 5, "down")]
    got = {r.id: (r.state, r.replaced_by) for r in feedback.counted_votes(spark.createDataFrame(rows, "voter string, target int, at int, id int, thumb string")).collect()}
    assert got == {1: ("replaced", None), 2: ("dismissed", 1), 3: ("replaced", None), 4: ("current", None), 5: ("current", None)}
    f1 = one(spark, feedback.token_f1(F.array(F.lit("a"), F.lit("b"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))), z=1)
    assert f1 == pytest.approx(0.4)


def test_mining(spark):
    calls = [("r", 1, 1, "a", False, 5.0), ("r", 2, 2, "a", True, 6.0), ("r", 3, 3, "a", False, 7.0), ("r", 4, 4, "b", True, 1.0), ("s", 1, 5, "a", True, 1.0), ("s", 2, 6, "b", False, 2.0), ("t", 1, 7, "a", True, 1.0), ("t", 2, 8, "c", True, 3.0)]
    df = spark.createDataFrame(calls, "run string, at int, call int, tool string, ok boolean, latency double")
    st = mining.steps(df)
    assert sorted((r.run, r.step, r.tool, r.ok, r.latency, r.tries) for r in st.collect())[:2] == [("r", 1, "a", True, 6.0, 3), ("r", 2, "b", True, 1.0, 1)]
    best = mining.best_sequence(st.withColumn("task", F.lit("x")), "task").first()
    assert (best.path, best.support) == ("a>b", 2)
    assert {r.run: r.succeeded for r in mining.run_outcome(df).collect()} == {"r": False, "s": False, "t": None}


def test_late_interaction_and_gains(spark):
    q = spark.createDataFrame([(1, [[1.0, 0.0], [0.0, 1.0]])], "query int, vectors array<array<double>>")
    d = spark.createDataFrame([(7, [[0.5, 0.5], [1.0, 0.0]]), (8, [[0.0, 0.2]])], "id int, vectors array<array<double>>")
    pairs = spark.createDataFrame([(1, 7), (1, 8)], "query int, id int")
    assert {r.id: r.score for r in retrieval.max_sim(q, d, pairs).collect()} == {7: 1.5, 8: 0.2}
    ranked = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query int, id string, rank int")
    rel = spark.createDataFrame([(1, "y", 1.0), (1, "z", 1.0), (2, "q", 1.0)], "query int, id string, gain double")
    got = {r["query"]: (r.ndcg, r.recall) for r in retrieval.ndcg(ranked, rel).collect()}
    assert got[1] == (pytest.approx(0.386853, abs=1e-6), 0.5) and got[2] == (0.0, 0.0)


def test_containment_is_lossless(spark):
    whole = "the quick brown fox jumps over the lazy dog and the-very-long-hyphenated-word-of-all-time ends"
    parts = ["quick brown fox jumps over the lazy", "ick brown fox jumps over the la", "very-long-hyphenated-word-of-all", "e very-long", "dog and the-very-long-hyphen", "not in there at all, to be sure"]
    got = {r.id for r in dedup.contained(spark.createDataFrame(list(enumerate(parts)), "id int, text string"), spark.createDataFrame([(1, whole), (2, "x")], "id int, text string"), "id", "id").collect()}
    assert got == {k for k, p in enumerate(parts) if len(p) >= 25 and p in whole}


def test_windows(spark):
    rows = [(1, k, "user" if k % 3 == 0 else "assistant", "x" * 40) for k in range(9)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in conversation.newest_turns(df, 2).collect()) == [3, 4, 5, 6, 7, 8]
    assert sorted(r.turn for r in conversation.newest_turns(df, 9).collect()) == list(range(9))
    assert sorted(r.turn for r in conversation.budget_window(df, 30).collect()) == [7, 8]
    assert sorted(r.turn for r in conversation.budget_window(df, 1).collect()) == [8]
