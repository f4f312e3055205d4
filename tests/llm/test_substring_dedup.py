import random
import re

import pytest

from sedge.llm import repeats, substring_dedup
from sedge.llm.common import Scratch

SCHEMA = "doc_id long, text string, key int, spans string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """rows: (id, text) in order of ids."""
    seen, out = set(), {}
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone[k : k + window] = [True] * window
            seen.add(w)
        out[i] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def corpus(seed, n=80):
    rng = random.Random(seed)
    vocab = ["a", "b", "Über", "c,", "D", "d"]
    line = lambda k: [rng.choice(vocab) for _ in range(k)]
    shared = [line(rng.randint(6, 40)) for _ in range(6)]
    texts = [None, "", " \n ", "a", " ".join("a" * 60), " ".join("ab" * 30)]
    for _ in range(n):
        parts = [line(rng.randint(0, 20)) if rng.random() < 0.5 else rng.choice(shared)[rng.randint(0, 4) :] for _ in range(rng.randint(1, 5))]
        texts.append(rng.choice([" ", "\n", "\t "]).join(sum(parts, [])))
    return texts + [rng.choice(texts) for _ in range(10)]


@pytest.mark.parametrize("seed,batches,group", [(1, 1, 4096), (2, 4, 3), (3, 3, 4096)])
def test_removal_matches_brute_force(spark, monkeypatch, seed, batches, group):
    monkeypatch.setattr(substring_dedup, "WIDTH", 5)
    monkeypatch.setattr(substring_dedup, "GRAM", 3)
    monkeypatch.setattr(repeats, "GROUP", group)
    rows = list(enumerate(corpus(seed)))
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], SCHEMA).repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.remove_repeats(df, window=8, batches=batches).collect()}
    assert got == brute(rows, 8)


def test_repeated_and_null_ids_and_no_rows(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(str(rng.random()) for _ in range(30)) for _ in range(3))
    rows = [(1, a, 0, ""), (1, a, 0, ""), (5, a, 0, ""), (None, b, 0, ""), (2, b + " " + c, 0, ""), (2, "else", 0, ""), (None, None, 0, "")]
    out = substring_dedup.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in out)
    assert got == [(-1, 0, 0), (-1, 30, 0), (1, 30, 0), (1, 30, 0), (2, 1, 0), (2, 60, 30), (5, 30, 30)]
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_an_index_lasts_over_sessions(spark, tmp_path):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["a", "bé", "c,", "dd"]) for _ in range(n))
    shared = [line(14) for _ in range(4)]
    rows = [(i, " ".join([line(rng.randint(0, 9)), rng.choice(shared), line(rng.randint(0, 30))])) for i in range(60)]
    folder, window = f"file://{tmp_path}/index", 8
    want = brute(rows, window)
    done = 0
    for part in (rows[:20], rows[20:35], rows[35:50], rows[50:]):
        session = spark.newSession()  # views and settings are its own
        scratch = Scratch(session, "test")
        docs, history = (session.createDataFrame(x, "doc_id long, text string") for x in (part, rows[:done]))
        index = substring_dedup.FingerprintIndex.open(session, scratch, folder) if done else substring_dedup.FingerprintIndex(session, scratch, 3, folder)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substring_dedup.clean_batch(index, docs, history, window).collect()}
        assert got == {i: want[i] for i, _ in part}
        index.save()
        index.close()
        done += len(part)
    assert len(substring_dedup.FingerprintIndex.open(spark, Scratch(spark, "test"), folder).runs) == 1  # 4 batches, compacted


def test_merge_joins_use_the_order_of_runs(spark, tmp_path):
    """Two runs are joined without an exchange or a sort."""
    index = substring_dedup.FingerprintIndex(spark, Scratch(spark, "test"), 3)
    docs = repeats.keyed(spark.createDataFrame([(i, f"w{i % 5} " * 40) for i in range(50)], "doc_id long, text string"), index.scratch)
    found = repeats.windows(docs, "word", 8, 3, 6, (), substring_dedup._first_of_slice, substring_dedup._SCHEMA)
    run = found.repartition(3, "key").sortWithinPartitions("key", "ctx", "id", "salt", "start").mapInArrow(substring_dedup._sorted_marks, substring_dedup._SCHEMA)
    a, b = index._write(run), index._write(run)
    with substring_dedup._bucket_joins(spark):
        joined = index._firsts(a).join(index._firsts(b).select("key", "ctx").hint("merge"), ["key", "ctx"], "left_semi")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    spark.sql(f"DROP TABLE {a}")
    spark.sql(f"DROP TABLE {b}")
