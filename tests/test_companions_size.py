import random

from shuffled import written

from sedge.operators import serving


def brute(packed, edges, below):
    """Rows as the SQL has them: a null never equals anything."""
    have = {(n, q) for n, p in below for q, i in packed if None not in (n, p, q) and p == i}
    return {(q, i, dst) for q, i in packed for src, dst, kind in edges if i is not None and src == i and kind in serving.REQUIRED and (dst, q) not in have}


def inputs(spark, packed, edges, below):
    return spark.createDataFrame(packed, "query long, id long"), spark.createDataFrame(edges, "src long, dst long, kind string"), spark.createDataFrame(below, "node long, part long")


def test_many_questions_nulls_and_repeats(spark, monkeypatch):
    rng = random.Random(5)
    maybe = lambda n: None if rng.random() < 0.04 else rng.randrange(n)
    packed = [(maybe(300), maybe(40)) for _ in range(1500)]
    edges = [(maybe(40), maybe(60), rng.choice([*serving.REQUIRED, "NEXT", None])) for _ in range(300)]
    below = [(maybe(60), maybe(40)) for _ in range(90)]
    want = brute(packed, edges, below)
    assert len(want) > 1000 and any(q is None for q, _, _ in want) and any(d is None for _, _, d in want)
    for group in (4096, 100, 7):
        monkeypatch.setattr(serving, "QUERY_GROUP", group)
        got = [tuple(r) for r in serving.missing_companions(*inputs(spark, packed + packed[:50], edges + edges[:50], below + below[:9])).select("query", "seed", "needs").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_questions_do_not_multiply_rows(spark):
    """60 questions of 100 rows each, 20 edges a row, 50 rows below a node: 120,000 needs, and 50 times as many rows below them."""
    rng = random.Random(6)
    packed = [(q, i) for q in range(60) for i in rng.sample(range(200), 100)]
    edges = [(i, 1000 + rng.randrange(40), "FOOTNOTE") for i in range(200) for _ in range(20)]
    below = [(1000 + n, i) for n in range(39) for i in rng.sample(range(200), 50)]
    got, size = written(spark, lambda: serving.missing_companions(*inputs(spark, packed, edges, below)).collect())
    assert {(r.query, r.seed, r.needs) for r in got} == brute(packed, edges, below)
    assert size < 400_000
