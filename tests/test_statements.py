import pytest
from pyspark.sql import functions as F

from sedge.operators import statements as st


@pytest.mark.parametrize(
    "a,b,want",
    [
        ("Forklift 4", "forklift #4", "SAME"),
        ("Forklift 4", "Forklift 3", "DIFFERENT"),
        ("Acme Ltd", "Acme GmbH", "DIFFERENT"),
        ("Acme Logistics Ltd", "acme logistics", "SAME"),
        ("the pumps", "pump", "SAME"),
        ("Acme Logistics", "Acme", "POSSIBLE"),
        ("European Central Bank", "ECB", "POSSIBLE"),
        ("warehouse", "warehause", "POSSIBLE"),
        ("bolt", "nut", "DIFFERENT"),
    ],
)
def test_subjects(spark, a, b, want):
    assert spark.range(1).select(st.same_subject(F.lit(a), F.lit(b))).first()[0] == want


def test_replacement(spark):
    rows = [
        (1, "u", 1, "The gate code for Depot Nord is 4821 today"),
        (2, "u", 2, "The gate code for Depot Nord is 9000 today"),
        (3, "u", 3, "Lunch at Depot Nord was good"),
        (4, "v", 4, "The gate code for Depot Nord is 1111 today"),
    ]
    got = {r.id: (r.by, r.grade) for r in st.replaced(spark.createDataFrame(rows, "id int, person string, at int, text string")).collect()}
    assert got == {1: (2, "EARLIER")}


def test_rules_and_slots(spark):
    rules = [(1, "u", 1, "Orders are prefixed with WO-E3"), (2, "u", 2, "Orders are prefixed with WO-K3"), (3, "u", 2, "Invoices go out on Monday"), (4, "v", 9, "Orders are prefixed with WO-Z9")]
    df = spark.createDataFrame(rules, "id int, person string, at int, text string")
    assert {r.id: r.earlier_value for r in st.restated(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    asked = spark.createDataFrame([(1, "u", "What are orders prefixed with?")], "query int, person string, text string")
    assert {r.id: r.earlier_value for r in st.answers_slot(asked, df).collect()} == {2: False, 1: True}


def test_periods(spark):
    assert st.periods_of("What happened in March 2023, in May and summer 2022?", 2024, 6) == [("2023-03-01", "2023-03-31"), ("--05", "--05"), ("2022-06-01", "2022-08-31")]
    assert st.periods_of("May I ask about 2020 and last month?", 2024, 1) == [("2020-01-01", "2020-12-31"), ("2023-12-01", "2023-12-31")]
    rows = st.periods(spark.createDataFrame([(1, "last year")], "q long, text string"), "q", "text", F.lit("2024-06-01").cast("date")).collect()
    assert [tuple(r)[1:] for r in rows] == [("2023-01-01", "2023-12-31")]


def test_beliefs(spark):
    held, new = (spark.createDataFrame(d, "person string, key string, text string") for d in ([("p", "a", "Likes tea."), ("p", "b", "Lives in Rome"), ("p", "c", "Old")], [("p", "a", "likes  tea"), ("p", "b", "Lives in Oslo"), ("p", "d", "New")]))
    assert {r.key: r.action for r in st.belief_plan(held, new).collect()} == {"a": "keep", "b": "update", "c": "retire", "d": "add"}
    beliefs = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "belief string")
    sources = spark.createDataFrame([("x", 1), ("y", 1), ("y", 2), ("z", 9)], "belief string, id int")
    memories = spark.createDataFrame([(1, "CURRENT"), (2, "SUPERSEDED")], "id int, status string")
    assert {r.belief: r.state for r in st.belief_state(beliefs, sources, memories).collect()} == {"x": "current", "y": "stale", "z": "deleted", "w": "deleted"}


def test_checks_and_facts(spark):
    ok = lambda a, b: spark.range(1).select(st.grounded(F.lit(a), F.lit(b))).first()[0]
    assert ok("The depot in Rome has 4 gates", "there are 4 gates at the Rome depot") and not ok("It has 5 gates", "it has 4 gates") and not ok("It is not open", "it is open")
    rows = spark.createDataFrame([(1, "Acme Steel acquired Beta Works in 2021. Revenue rose to EUR 98 million. Growth was driven by new shops. Acme Steel was founded in 1950.")], "doc_id int, text string")
    got = {(r.subject, r.predicate, r.object, r.period) for r in st.document_facts(rows, "doc_id", "text").collect()}
    assert got == {("Acme Steel", "acquired", "Beta Works", "2021"), ("Revenue", "has_value", "EUR 98 million", None), ("Growth", "driven_by", "new shops", None), ("Acme Steel", "founded_in", "1950", "1950")}


def test_layers_and_earlier_chats(spark):
    df = spark.createDataFrame([(1, k, "user" if k % 2 == 0 else "assistant", f"m{k}") for k in range(8)], "conv_id int, turn int, role string, text string")
    assert [r.layer for r in st.replay_layers(df, 1, 2).orderBy("turn").collect()] == ["steps"] * 2 + ["text"] * 4 + ["whole"] * 2
    said = spark.createDataFrame([("t1", 1, "assistant", "The torque of the bolt is 40", "u"), ("t2", 2, "assistant", "Hello there", "u"), ("t3", 3, "user", "torque of the bolt", "u"), ("t4", 4, "assistant", "torque bolt", "v")], "thread string, at int, role string, text string, person string")
    asked = spark.createDataFrame([(1, "u", "what torque has the bolt")], "query int, person string, text string")
    assert [r.thread for r in st.earlier_chats(said, asked).collect()] == ["t1"]
