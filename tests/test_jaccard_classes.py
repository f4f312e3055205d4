from itertools import combinations

from sedge.functions import text as t
from sedge.plans import registry, retrieval

TEXTS = [
    "Red green blue cyan black.", "black, cyan blue green red", "the red red green blue cyan black", "red green blue cyan black white",
    "white black cyan blue; green red", "something else entirely", None, "", "the of", "...",
]


def test_classes_and_pairs_give_every_pair_of_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    sets = {r[0]: set(r[1] or ()) for r in docs.select("doc_id", t.tokens(docs.text)).collect()}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b]}
    want = {p: x for p, x in want.items() if x >= 0.8}
    kept = {r.id: r.kept for r in retrieval._word_sets(docs).collect()}
    between = {(r.a, r.b): r.jaccard for r in retrieval._alike(docs).collect()}
    got = {(a, b): 1.0 if kept[a] == kept[b] else between.get(tuple(sorted((kept[a], kept[b])))) for a, b in combinations(sorted(kept), 2)}
    assert {p: x for p, x in got.items() if x} == want
    assert len(kept) == len(TEXTS) and len({p for p, x in want.items() if x == 1.0}) == 4


def test_registered(spark):
    assert "jaccard_classes" in registry.queries() and "jaccard_classes" in registry.oracle_sql()
