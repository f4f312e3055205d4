import base64
import random
import re
import struct

import public_tokenizers as P
import tiktoken

import corpus_pipeline as c
from sedge.llm import langid
from brute_force import components, removed_words, simhashes

SOUNDS = {"aa": ["ba", "do", "mi", "le", "th"], "bb": ["sch", "ung", "ein", "ß", "ke"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, items string"


def corpus():
    rng = random.Random(11)

    def prose(lang, n):
        return [("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(2, 5)))) for _ in range(n)]

    items = [(k, " ".join(prose("aa", 30))) for k in range(4)]
    passage, texts = prose("bb", 60), []
    for k in range(80):
        lang = rng.choice(["aa", "bb"])
        words = prose(lang, rng.randint(30, 200))
        if k % 10 == 3:
            words[10:10] = passage
        if k % 10 == 5:
            words[5:5] = items[k % 4][1].split()
        texts.append((" ".join(words), lang))
    texts += [(texts[3][0], "bb"), (texts[7][0] + " " + texts[7][0].split()[0], "aa"), (" ".join(passage), "bb"), ("123 456 !!", "aa"), (None, None), ("", "aa")]
    docs = [(i, t, lang, "s", len(t or ""), "r", "i") for i, (t, lang) in enumerate(texts)]
    return docs, items


def expected(spark, docs, items):
    """Each stage again, on rows; the network is the stage's own, as it learns from the same rows."""
    df = spark.createDataFrame(docs, SCHEMA)
    told = {r.doc_id: r for r in langid.predict(df, langid.learn(df)).collect()}
    docs = [d for d in docs if told[d[0]].lang_pred != "und" and told[d[0]].score >= c.LANGUAGE_SCORE]
    comp = components([d[0] for d in docs], simhashes([d[1] for d in docs]), 4)
    docs = [d for d, k in zip(docs, comp) if d[0] == k]
    out = []
    cut = removed_words([(d[0], d[1]) for d in docs], 20)
    words = lambda t: re.findall("[0-9a-z\x80-\U0010ffff]+", t.lower())
    for d in docs:
        n, gone, kept = cut[d[0]]
        if gone == n:
            continue
        text = d[1] if not gone else kept
        if not any(" ".join(words(t)) in " ".join(words(text)) for _, t in items):
            out.append((d[0], text))
    return out


def test_pipeline_matches_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = expected(spark, docs, items)
    got = {r.doc_id: bytes(r.ids) for r in c.run(spark, str(tmp_path)).collect()}
    assert got == {i: struct.pack(f"<{len(x)}I", *x) for i, t in want for x in [enc.encode_ordinary(t)]}
    assert 60 <= len(got) < 80


def test_stages_keep_columns_and_take_odd_rows(spark, tmp_path):
    spark.createDataFrame([(0, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(1, "bado mile thba dole mido", "aa", None, None, None, "x"), (1, "bado mile thba dole mido", "aa", None, None, None, "x"), (None, "schung einke schke", None, None, None, None, None), (2, None, None, None, None, None, None)]
    for data in (rows, []):
        df = spark.createDataFrame(data, SCHEMA)
        for k, (name, stage) in enumerate(c.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.columns == df.columns if k < 4 else out.columns[0] == "doc_id"
            found = out.collect()
            assert bool(found) == bool(data), name
            assert name != "near_duplicates" or not data or sorted((r.doc_id or 0) for r in found) == [0, 1, 2]
