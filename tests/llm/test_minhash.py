import hashlib
import random
import re
import struct

import pytest
import xxhash

from sedge.llm import minhash as m

SCHEMA = "doc_id long, text string, range int, key string"


def longs(*xs):
    h = 42
    for x in xs:
        h = xxhash.xxh64_intdigest(struct.pack("<Q", x & (1 << 64) - 1), h)
    return h


def brute(text):
    """Packed bins of a text as hex."""
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    if not words:
        return ""
    found = [longs(*words[i : i + 5]) for i in range(max(1, len(words) - 4))]
    bins = [None] * 256  # in signed order of the high byte
    for h in found:
        j = (h >> 56) ^ 128
        bins[j] = h if bins[j] is None else min(bins[j], h)
    ints = lambda j, t: xxhash.xxh64_intdigest(struct.pack("<I", t), xxhash.xxh64_intdigest(struct.pack("<I", j), 42))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    out = []
    for j in range(256):
        if bins[j] is not None:
            out.append(bins[j])
            continue
        tried = (bins[signed(ints(j, t)) % 256] for t in range(8))
        out.append(next((x for x in tried if x is not None), None) or min((signed(ints(j, i)), x) for i, x in enumerate(bins) if x is not None)[1])
    return "".join(f"{x & 255:02x}" for x in out)


def near(a, b):
    if not a or not b:
        return float(a == b)
    same = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, 512, 2))
    return max(0.0, (same / 256 - 1 / 256) / (1 - 1 / 256))


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t, *_) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), brute(t), brute(edited), near(brute(t), brute(edited)), near(brute(t), brute(after))))
    return out


def texts(n=80):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abçd🙂") for _ in range(rng.randint(1, 4)))
    out = [None, "", " \n", "one", "one two three four", "a b c d e", "a b c d e f"]
    return out + [rng.choice([" ", "\n "]).join(word() for _ in range(rng.choice([8, 60, 300, 2500]))) for _ in range(n)]


def rows_of(df):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2])
    return sorted(map(tuple, df.collect()), key=key)


def test_documents_match_brute_force(spark):
    rows = [(7 * (i * 37 % 87) - 100, t, 3, "k") for i, t in enumerate(texts())]
    rng = random.Random(1)
    shuffled = rng.sample(rows, len(rows))
    got = rows_of(m.digests(spark.createDataFrame(shuffled, SCHEMA).repartition(5)))
    want = sorted(expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:])


def test_repeated_null_and_single_rows(spark):
    rows = [(None, "b c", 0, ""), (None, "a", 0, ""), (4, "same text here", 0, ""), (4, "same text here", 0, ""), (4, "other", 0, ""), (9, None, 0, "")]
    got = rows_of(m.digests(spark.createDataFrame(rows, SCHEMA)))
    assert [g[:5] for g in got] == [w[:5] for w in sorted(expected(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[2]))]
    one = m.digests(spark.createDataFrame([(1, "a b c d e f g", 0, "")], SCHEMA)).collect()[0]
    assert (one.near_next, one.edited_sha256) == (1.0, hashlib.sha256(b"a b c da b c ").hexdigest())
    assert m.digests(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimates_follow_true_likeness(spark):
    rng = random.Random(8)
    rows, true = [], {}
    for k in range(60):
        base = [str(rng.random()) for _ in range(400)]
        other = base[: rng.randint(0, 400)]
        other += [str(rng.random()) for _ in range(400 - len(other))]
        a, b = ({tuple(x[i : i + 5]) for i in range(396)} for x in (base, other))
        true[2 * k] = len(a & b) / len(a | b)
        rows += [(2 * k, " ".join(base), 0, ""), (2 * k + 1, " ".join(other), 0, "")]
    got = {r.doc_id: r.near_next for r in m.digests(spark.createDataFrame(rows, SCHEMA)).collect()}
    errors = [got[i] - t for i, t in true.items()]
    assert max(map(abs, errors)) < 0.15 and abs(sum(errors)) / len(errors) < 0.02


def test_no_python_in_the_plan(spark):
    plan = m.digests(spark.createDataFrame([(1, "a", 0, "")], SCHEMA).coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
