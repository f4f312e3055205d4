import random
from collections import Counter

import pytest

from sedge.llm import repeats, suffix_dedup
from sedge.llm.common import Scratch

SCHEMA = "doc_id long, text string, start int, rank string"


def brute(texts, window):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + window] for r in raw for i in range(len(r) - window + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - window + 1):
            if seen[r[i : i + window]] > 1:
                gone[i : i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, bytes(b for b, g in zip(r, gone) if not g)))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    line = lambda k: "".join(rng.choice("abé \n") for _ in range(k))
    shared = [line(rng.randint(20, 90)) for _ in range(6)]
    texts = [None, "", "a", "x" * 200, "xy" * 60, "xy" * 90]
    for _ in range(n):
        parts = [line(rng.randint(0, 50)) if rng.random() < 0.6 else rng.choice(shared)[rng.randint(0, 9) :] for _ in range(rng.randint(1, 5))]
        texts.append("".join(parts))
    texts += [rng.choice(texts) for _ in range(8)]
    return texts


@pytest.mark.parametrize("seed,group,part", [(1, 4096, 1 << 18), (2, 3, 5)])
def test_removal_matches_brute_force(spark, monkeypatch, seed, group, part):
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    monkeypatch.setattr(suffix_dedup, "PART", part)
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = corpus(seed)
    rows = [(i, t, 5, "r") for i, t in enumerate(texts)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(7), window=24).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out}
    assert got == dict(enumerate(brute(texts, 24)))


def test_ranks_double_until_the_reach_and_tell_cores_apart(spark, monkeypatch):
    """Equal ranks are equal cores, over all anchors, and some needed several doublings."""
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    window = 40
    core = window - 7 + 1
    texts = [t or "" for t in corpus(3, 40)] + ["z" * 120, "q" * 90 + "z" * 60]
    rows = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    scratch = Scratch(spark, "test")
    keyed = repeats.keyed(rows, scratch)
    anchors = suffix_dedup.positions(keyed, window).where("n > 0").collect()
    assert max(r.reach for r in anchors) >= 8
    cores = {}
    for r in anchors:
        cores.setdefault(texts[r.id].encode()[r.place : r.place + core], set()).add((r.id, r.start))
    want = sorted(sorted(x) for x in cores.values() if len(x) > 1)
    found = {}
    for r in suffix_dedup.equal_cores(keyed, window, scratch, 5).collect():
        found.setdefault(r["rank"], set()).add((r.id, r.start))
    assert sorted(sorted(x) for x in found.values()) == want


def test_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    rng = random.Random(9)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(3))
    rows = [(1, a, 0, ""), (1, a, 0, ""), (None, b, 0, ""), (2, c + b[:40], 0, ""), (2, c[:10], 0, ""), (None, None, 0, "")]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=24).collect()
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_removed) for r in out)
    assert got == [(-1, 0, 0), (-1, 60, 40), (1, 60, 60), (1, 60, 60), (2, 10, 0), (2, 100, 40)]


def test_no_rows(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most,written", [(100_000, 0), (1, 1)])
def test_ranks_are_written_again_only_without_a_broadcast(spark, monkeypatch, most, written):
    """Each table that is written costs disk, and its files a process each on executors without Hadoop's native library."""
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    monkeypatch.setattr(suffix_dedup, "FIXES", most)
    names, table = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a: names.append(name) or table(self, df, name, *a))
    texts = corpus(4, 30)
    rows = [(i, t, 5, "r") for i, t in enumerate(texts)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=24).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == dict(enumerate(brute(texts, 24)))
    pairs = [x for x in names if x.endswith("-pairs")]
    assert len(pairs) > 2 and len([x for x in names if "ranks" in x]) == written * len(pairs)


def test_each_doubling_writes_one_table_and_few_columns(spark, monkeypatch):
    """What a step looks up comes by one join, cores are sorted once, and a row takes no pair and no salt along that it doesn't need."""
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    tables, table = {}, Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name, *a: tables.setdefault(name, df.columns) and table(self, df, name, *a))
    texts = corpus(5, 30)
    rows = [(i, t, 5, "r") for i, t in enumerate(texts)]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA), window=24).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in out} == dict(enumerate(brute(texts, 24)))
    steps = sorted(int(x[4:]) for x in tables if x.startswith("step"))
    assert len(steps) > 1 and steps == [1 << k for k in range(len(steps))]
    own = {x for x in tables if x.startswith("step") or x.endswith("-pairs")} | {"positions", "contexts"}
    assert own == {"positions", "contexts", *(f"step{h}" for h in steps), *(f"h{h}-pairs" for h in steps)}
    assert not [x for x in tables if x.startswith(("ready", "on")) and x[-1].isdigit()]
    assert set(tables["positions"]) == {"id", "place", "on", "pack", "name", "tail", "ctx"}


@pytest.mark.parametrize("once", [False, True])
def test_keys_tell_cores_apart(spark, monkeypatch, once):
    monkeypatch.setattr(suffix_dedup, "WIDTH", 7)
    monkeypatch.setattr(suffix_dedup, "GRAM", 3)
    window = 40
    texts = [t or "" for t in corpus(6, 30)] + ["z" * 120, "q" * 90 + "z" * 60]
    rows = spark.createDataFrame([(i, t, 0, "") for i, t in enumerate(texts)], SCHEMA)
    scratch = Scratch(spark, "test")
    keyed = repeats.keyed(rows, scratch)
    cores = lambda r: texts[r.id].encode()[r.place : r.place + window - 7 + 1]
    want, found = {}, {}
    for r in suffix_dedup.positions(keyed, window).where("n > 0").collect():
        want.setdefault(cores(r), set()).add((r.id, r.start))
    for r in suffix_dedup.unpacked(suffix_dedup.named_cores(keyed, window, scratch, 5, once), "key", "id", "place", "start").collect():
        found.setdefault(r.key, set()).add((cores(r), r.id, r.start))
    assert all(len({core for core, _, _ in x}) == 1 for x in found.values())
    assert {frozenset(x) for x in want.values() if len(x) > 1} == {frozenset(x[1:] for x in y) for y in found.values() if len(y) > 1}


def test_windows_too_long_for_a_pack_are_refused(spark):
    with pytest.raises(ValueError):
        suffix_dedup.positions(spark.createDataFrame([], "id long, salt long, text string"), 1 << 23)
