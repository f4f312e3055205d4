import random
import re

import numpy as np

from sedge.llm import decontaminate as d

DOCS = "doc_id long, text string, item long, words string"
ITEMS = "item_id long, text string, doc_id long"


def words(t):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in t or ""))


def brute_tiles(item, text, shortest):
    """The classic loop: find the longest matches of unmarked words, mark them, go on."""
    a, b, tiles = [True] * len(item), [True] * len(text), []
    shortest = max(1, min(shortest, len(item)))
    while True:
        best, found = 0, []
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and a[i + k] and b[j + k]:
                    k += 1
                if k > best:
                    best, found = k, []
                if k == best and k:
                    found.append((i, j))
        if best < shortest:
            return tiles
        for i, j in found:
            if all(a[i : i + best]) and all(b[j : j + best]):
                a[i : i + best] = b[j : j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiles_match_the_classic_loop():
    rng = random.Random(1)
    for _ in range(300):
        item, text = ([rng.randrange(5) for _ in range(rng.randint(0, 20))] for _ in range(2))
        got = d.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
        assert got == brute_tiles(item, text, 3)


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abçdE") for _ in range(3))
    items = [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(25)] + ["", None, "...", "just two"]
    docs = [None, "", "--", "nothing of it here", "some JUST; two, more"]
    for _ in range(60):
        a, b = (rng.choice([i for i in items if i and len(i.split()) > 12]).split() for _ in range(2))
        cut = rng.randint(0, len(a))
        parts = [a[cut:], [word() for _ in range(rng.randint(0, 40))], a[: rng.randint(0, cut)], b[: rng.randint(0, 9)]]
        rng.shuffle(parts)
        docs.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.1 else w for p in parts for w in p))
    return docs, items


def test_documents_match_brute_force(spark):
    docs, items = corpus()
    got = {r.doc_id: (r.contaminated, round(r.coverage, 9), list(r.items)) for r in d.decontaminate(spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(docs)], DOCS), spark.createDataFrame([(i, t, 3) for i, t in enumerate(items)], ITEMS)).collect()}
    for i, t in enumerate(docs):
        shares = {}
        for k, q in enumerate(items):
            a, b = words(q), words(t)
            n = min(d.SEED, len(a))
            if a and {tuple(a[x : x + n]) for x in range(len(a) - n + 1)} & {tuple(b[x : x + n]) for x in range(len(b) - n + 1)}:
                shares[k] = sum(x[2] for x in brute_tiles(a, b, d.SEED)) / len(a)
        most = max(shares.values(), default=0.0)
        assert got[i] == (most >= d.THRESHOLD, round(most, 9), sorted(k for k, s in shares.items() if s >= d.THRESHOLD)), i
    assert any(c for c, _, _ in got.values()) and not all(c for c, _, _ in got.values())


def test_rows(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, 0, ""), (1, text, 0, ""), (None, text, 0, ""), (2, "other", 0, "")], DOCS)
    items = spark.createDataFrame([(9, text, 0), (9, "five six seven eight", 0), (None, text, 0), (8, "five six seven eight nine ten", 0)], ITEMS)
    got = sorted((r.doc_id or 0, r.contaminated, r.coverage, list(r.items)) for r in d.decontaminate(docs, items).collect())
    assert got == [(0, True, 1.0, [8, 9]), (1, True, 1.0, [8, 9]), (1, True, 1.0, [8, 9]), (2, False, 0.0, [])]
    assert [r.contaminated for r in d.decontaminate(docs, items.limit(0)).collect()] == [False] * 4
    assert d.decontaminate(docs.limit(0), items).count() == 0


def test_least_loses_no_contaminated_document(spark):
    docs, items = corpus()
    docs += ["aaa bbb ccc ddd " * 9] * 30  # makes some seeds frequent
    items += ["aaa bbb ccc ddd aaa bbb ccc ddd one two three four five six", "x1 x2 x3 aaa bbb ccc ddd x4 x5 x6"]
    a, b = spark.createDataFrame([(i, t, 7, "x") for i, t in enumerate(docs)], DOCS), spark.createDataFrame([(i, t, 3) for i, t in enumerate(items)], ITEMS)
    whole = {r.doc_id: (r.contaminated, r.coverage if r.contaminated else 0.0, list(r.items)) for r in d.decontaminate(a, b).collect()}
    found = {r.doc_id: (r.contaminated, r.coverage, list(r.items)) for r in d.decontaminate(a, b, least=d.THRESHOLD).collect()}
    assert found == whole and any(c for c, _, _ in whole.values())
