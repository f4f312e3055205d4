import inspect
import math

import pytest
import test_lm
from test_lm import SCHEMA, brute, corpus, crc

from sedge.llm import lm, queries

WEIGHTS = {0: [0.2, 0.8, 0, 0], 64: [0.1, 0.3, 0.6, 0], 70: [0.1, 0.2, 0.7, 0], 129: [0.1, 0.1, 0.2, 0.6]}


@pytest.mark.parametrize("bucket, like", [(0, 0), (64, 64), (73, 70), (66, 64), (67, 64), (68, 70), (137, 129), (128, 129), (193, 129)])
def test_unlearnt_bucket_is_like_the_nearest(bucket, like):
    assert lm.weights_of(bucket, WEIGHTS, [9.0]) == WEIGHTS[like]


def test_orders_without_a_learnt_bucket():
    assert lm.weights_of(130, {0: [1], 65: [2]}, [9]) == [2]
    assert lm.weights_of(130, {0: [1]}, [9]) == [1]
    assert lm.weights_of(130, {}, [9]) == [9]


def test_hottest_context_keeps_its_order(spark):
    """Under all training counts the context of a passes a power of two that the main counts, on which weights are learnt, do not reach."""
    main = [i for i in range(400) if crc(i) not in (0, lm.HELD)][:60]
    held = [i for i in range(400) if crc(i) == lm.HELD][:10]
    test = [i for i in range(400) if crc(i) == 0][:5]
    rows = [(i, "a b", "f", 3) for i in main + held + test]
    got = {r.doc_id: r.score for r in lm.score(spark.createDataFrame(rows, SCHEMA), order=2, nearest=True).collect()}
    assert int(math.log2(len(main))) < int(math.log2(len(main + held)))
    assert got[test[0]] > max(x[6] for x in brute(rows, 2) if x[0] in test) + 0.5


def like_nearest(b, weights, fallback):
    for k in range(b // 64, 0, -1):
        for away in range(64):
            for near in (b % 64 - away, b % 64 + away):
                if 0 <= near < 64 and 64 * k + near in weights:
                    return weights[64 * k + near]
    return weights.get(0, fallback)


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_brute_force_with_nearest_buckets(spark, order):
    source, old = inspect.getsource(brute), "weights.get(b, fallback)"
    assert source.count(old) == 1
    names = {**vars(test_lm), "like_nearest": like_nearest}
    exec(source.replace(old, "like_nearest(b, weights, fallback)"), names)
    rows, key = corpus(), lambda r: (r[0] or -1, r[2])
    got = sorted(map(tuple, lm.score(spark.createDataFrame(rows, SCHEMA), order=order, nearest=True).collect()), key=key)
    want = sorted(names["brute"](rows, order), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)
    if order == 2:  # a bucket of this corpus is not learnt
        assert want != sorted(brute(rows, order), key=key)


def test_the_query_takes_nearest_buckets(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(lm, "score", lambda docs, **more: seen.update(more) or docs)
    queries.QUERIES["op1_lm_scoring"](spark, "/root/testdata/sf0.001")
    assert seen == {"nearest": True}
