import random
from itertools import combinations

import pytest
from shuffled import written

from sedge.functions import text as t
from sedge.operators import dedup
from sedge.plans import registry

WORDS = [f"w{k}" for k in range(400)]


def texts(rng, n, size):
    """Texts of common and rare words, each a second time with some of its words replaced."""
    out = []
    for k in range(n):
        base = rng.choices(WORDS, [1 / (1 + j) for j in range(len(WORDS))], k=size()) + [f"own{k}x{j}" for j in range(rng.randrange(4))]
        out.append(base)
        out.append([f"new{k}x{j}" if rng.random() < 0.12 else w for j, w in enumerate(base)])
    return [" ".join(x) for x in out]


def brute(rows, least):
    return {(i, j): round(len(x & y) / len(x | y), 6) for (i, p, x), (j, q, y) in combinations(rows, 2) if x and y and p is not None and p == q and round(len(x & y) / len(x | y), 6) >= least}


@pytest.mark.parametrize("least", [0.8, 0.92, 0.5])
def test_likeness_pairs_equal_brute_force(spark, least):
    rng = random.Random(7)
    said = texts(rng, 60, lambda: rng.choice([1, 2, 3, 5, 9, 20, 60])) + ["", None, "the of", "a1 b2 c3 d4 e5", "a1 b2 c3 d4 e5"]
    rows = spark.createDataFrame([(k, rng.choice(["x", "x", "y", None]), s) for k, s in enumerate(said)], "id int, scope string, text string")
    sets = [(r.id, r.scope, set(r.w or ())) for r in rows.select("id", "scope", t.tokens(rows.text).alias("w")).orderBy("id").collect()]
    found = lambda **k: {(r.a, r.b): r.jaccard for r in dedup.likeness_pairs(rows, rows, least, "id", "id", **k).where("a < b").collect()}
    assert found() == brute([(i, "", w) for i, _, w in sets], least) and found()
    assert found(within="scope") == brute(sets, least)
    other = rows.where("id % 3 > 0")
    got = {(r.a, r.b) for r in dedup.likeness_pairs(rows, other, least, "id", "id").where("a < b").collect()}
    assert got == {p for p in brute([(i, "", w) for i, _, w in sets], least) if p[1] % 3}


def test_words_do_not_go_to_every_pair_that_shares_one(spark):
    folder = "/root/testdata/sf0.01"
    got, size = written(spark, lambda: registry.queries()["jaccard_pairs"](spark, folder).collect())
    assert len(got) == 66 and size < 5_000_000
