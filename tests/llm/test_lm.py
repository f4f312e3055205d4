import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sedge.llm import lm

SCHEMA = "doc_id long, text string, fold string, block int"


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) + ["</s>"]


def crc(i):
    return zlib.crc32(b"" if i is None else str(i).encode()) % 10


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    vocab = ["W%d" % i for i in range(40)] + ["ÉT", "Été"]
    after = {w: rng.choices(vocab, k=4) for w in vocab}
    out = []
    for i in range(n):
        w, words = rng.choice(vocab), []
        for _ in range(rng.randint(0, 40)):
            words.append(w)
            w = rng.choice(after[w]) if w in after and rng.random() < 0.8 else rng.choice(vocab + ["new%d" % rng.randint(0, 500)])
        out.append((i, rng.choice([" ", "\n "]).join(words), "f", 3))
    return out + [(1000, None, "f", 3), (1001, "", "f", 3), (None, "w1 w2", "f", 3), (5, out[5][1], "f", 3)]


def brute(rows, order):
    """Counts by dictionaries, weights by the same rounds on the held-out tokens."""

    def count(docs):
        c = [Counter() for _ in range(order)]
        for t in docs:
            s = ["</s>", *tokens(t)]
            for j in range(1, len(s)):
                for k in range(1, order + 1):
                    if j - k + 1 >= 0:
                        c[k - 1][tuple(s[j - k + 1 : j + 1])] += 1
        return c

    def estimates(c, t):
        n, v = sum(c[0].values()), len(c[0])
        s, out = ["</s>", *tokens(t)], []
        for j in range(1, len(s)):
            e, b = [1 / (v + 1), c[0][(s[j],)] / max(1, n)], 0
            for k in range(2, order + 1):
                ctx = tuple(s[j - k + 1 : j]) if j - k + 1 >= 0 else None
                seen = c[k - 2][ctx] if ctx else 0
                e.append(c[k - 1][(*ctx, s[j])] / seen if seen else 0.0)
                if seen:
                    b = 64 * (k - 1) + int(math.log2(seen))
            out.append((b, e))
        return out

    main = count([t for i, t, *_ in rows if crc(i) not in (0, lm.HELD)])
    held = [x for i, t, *_ in rows if crc(i) == lm.HELD for x in estimates(main, t)]
    weights = {}
    for b in {b for b, _ in held}:
        longest = max(1, b // 64 + 1)
        weights[b] = [0.1] + [0.9 / longest] * longest + [0.0] * (order - longest)
    last = None
    for _ in range(lm.ROUNDS):
        sums, n, gain = {b: [0.0] * (order + 1) for b in weights}, Counter(), 0.0
        for b, e in held:
            mixed = sum(w * x for w, x in zip(weights[b], e))
            gain += math.log10(mixed)
            n[b] += 1
            for k in range(order + 1):
                sums[b][k] += weights[b][k] * e[k] / mixed
        for b in weights:
            shares = [max(x / n[b], 1e-6 if k == 0 else 0) for k, x in enumerate(sums[b])]
            weights[b] = [x / sum(shares) for x in shares]
        if last is not None and gain / len(held) - last < lm.GAIN:
            break
        last = gain / len(held)
    full = count([t for i, t, *_ in rows if crc(i) != 0])
    n, v = sum(full[0].values()), len(full[0])
    fallback = weights.get(0) or [0.1, 0.9] + [0.0] * (order - 1)
    out = []
    for i, t, *_ in rows:
        c1 = [full[0][(w,)] for w in tokens(t)]
        model = sum(math.log10(sum(w * x for w, x in zip(weights.get(b, fallback), e))) for b, e in estimates(full, t))
        out.append((i, crc(i) == 0, len(c1), sum(c > 0 for c in c1), n, sum(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) for c in c1), model))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_brute_force(spark, order):
    rows = corpus()
    got = sorted(map(tuple, lm.score(spark.createDataFrame(rows, SCHEMA).repartition(6), order=order).collect()), key=lambda r: (r[0] or -1, r[2]))
    want = sorted(brute(rows, order), key=lambda r: (r[0] or -1, r[2]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-6, abs=1e-6)
    held = [g for g in got if g[1]]
    assert sum(g[6] for g in held) > sum(g[5] for g in held)


def test_blobs_come_back():
    draw = np.random.default_rng(1)
    columns = [draw.integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2) + np.uint64(1), np.arange(50, dtype=np.uint64), np.zeros(50, np.uint64)]
    assert all((a == b).all() for a, b in zip(columns, lm.unpack(lm.pack(*columns), 3)))
    assert [len(x) for x in lm.unpack(lm.pack(*[c[:0] for c in columns]), 3)] == [0, 0, 0]


def test_a_block_has_every_gram_once():
    block = lm.Block(pa.array(["A b a", "", "b A"]), 3)
    assert [len(h) for h in block.hashes] == [3, 6, 4]
    assert block.counts(0, np.array([True, True, True])).sum() == 8
    assert block.counts(2, np.array([True, False, False])).sum() == 3


def test_no_rows_and_no_training(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = [(None, "a b", "", 0)]
    got = lm.score(spark.createDataFrame(alone, SCHEMA)).collect()[0]
    assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens, got.base_score) == (True, 3, 0, 0, 0.0)
    assert math.isfinite(got.score)
