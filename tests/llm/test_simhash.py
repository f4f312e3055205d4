import random
import re

import pytest
import xxhash

from sedge.llm import simhash
from sedge.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, fp long, cell string"


def brute(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        found = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in found]
        out.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    return out


def classes(ids, fps, most):
    up = list(range(len(ids)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                up[find(i)] = find(j)
    return [min(ids[k] for k in range(len(ids)) if find(k) == find(i)) for i in range(len(ids))]


def test_documents_match_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abçdÉEx") for _ in range(rng.randint(1, 4)))
    texts = [None, "", " \n\t", "One", "one", "a b c", "A  b\x0bc d"]
    for _ in range(40):
        base = [word() for _ in range(rng.randint(1, 300))]
        for _ in range(rng.randint(1, 3)):
            copy = list(base)
            if rng.random() < 0.7:
                copy[rng.randrange(len(copy))] = word()
            texts.append(rng.choice([" ", "\n", "  "]).join(copy))
    rows = [(100 - i, t, None, 1, "x") for i, t in enumerate(texts)]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps, ids = brute(texts), [r[0] for r in rows]
    comp = classes(ids, fps, 4)
    assert got == {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, comp)}


def test_grid_finds_every_link_in_crowded_cells(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    fps = {rng.getrandbits(64) for _ in range(30)}
    for f in list(fps):
        for _ in range(20):
            g = f
            for _ in range(rng.randint(0, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f, i) for i, f in enumerate(signed)], "fp long, rep long")
    scratch = Scratch(spark, "t")
    found = {r.node: r.component for r in simhash.components(simhash.links(nodes, scratch), scratch).collect()}
    want = classes(list(range(len(fps))), fps, 4)
    assert [found.get(i, i) for i in range(len(fps))] == want


def test_one_large_block_keeps_classes():
    import numpy as np

    rng = np.random.default_rng(1)
    fp = np.repeat(rng.integers(0, 1 << 63, 20, dtype=np.uint64), 40) ^ (np.uint64(1) << rng.integers(0, 64, 800, dtype=np.uint64))
    block, edges = simhash._Block(4), []
    for s in range(0, 800, 100):
        edges += block.add(np.repeat([0, 1], [50, 50]) if s == 0 else np.ones(100), fp[s : s + 100], np.arange(s, s + 100))
    up = {i: i for i in range(800)}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        assert bin(int(fp[a] ^ fp[b])).count("1") <= 8
        up[find(a)] = find(b)
    for v in range(50, 800):
        near = [m for m in range(50) if bin(int(fp[v] ^ fp[m])).count("1") <= 4]
        assert all(find(v) == find(m) for m in near)


def test_rows_repeated_null_and_none(spark):
    rows = [(1, "same words in two rows", "en", 0, ""), (1, "same words in two rows", "en", 0, ""), (None, "same words in two rows", "en", 0, ""), (0, "quite another text with its own words", None, 0, "")]
    got = sorted((r.doc_id or -1, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect() if r.doc_id != 0)
    assert got == [(-1, None), (1, 1), (1, 1)]
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_too_many_bits_are_refused(spark):
    nodes = spark.createDataFrame([(1, 1)], "fp long, rep long")
    with pytest.raises(ValueError):
        simhash.links(nodes, Scratch(spark, "t"), most=5)


def test_an_unrelated_text_under_the_same_id_stays(spark):
    a, b, x = ("".join(f"{k}{i} " for i in range(60)) for k in "abx")
    rows = [(5, a, "en", 1, ""), (5, b, "de", 2, ""), (6, x, "fr", 3, ""), (6, x, "fr", 3, ""), (7, a, "en", 4, ""), (None, a, None, 5, ""), (None, None, None, 6, "")]
    kept = simhash.representatives(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.lang or "") for r in kept) == sorted([(0, "", ""), (0, a, ""), (5, a, "en"), (5, b, "de"), (6, x, "fr")])
