import random

import public_tokenizers as P
import sentencepiece

from sedge.llm import token_counts

PATH = P.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_tokens string, known int"
ODD = [None, "", " ", "  ", "\n", "a\n b", "▁", "x▁y ", "🙂🙂 \n\n  z", "<s> </s><unk> <0x41>", "\t\t a", "é́", "  lead", "trail  ", "a\x00b", "A" * 5000, "of the " * 700]


def test_counts_equal_the_library(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice([" ", "  ", "\n", "▁", "the", "été", "日本", "🙂", "x1", ".", "<s>"]) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 1000) for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(map(tuple, token_counts.token_counts(df, PATH, limit=1000).collect())) == want


def test_small_blocks_change_nothing(spark):
    rng = random.Random(5)
    texts = ODD + [" ".join(rng.choice(["one", "two", "a\x00b", "\x00\x02", "été"]) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.n_tokens) for r in token_counts.token_counts(df, PATH, block=200).collect())
    assert got == [(i, len(model.encode(t or ""))) for i, t in enumerate(texts)]


def test_each_distinct_pre_token_is_counted_once(spark, tmp_path):
    """The library is asked for every distinct pre-token of all blocks, and for none twice."""
    df = spark.createDataFrame([(i, f"same words {i % 7} again", "", 0) for i in range(80)], SCHEMA).repartition(4)
    asked = tmp_path / "asked"
    asked.mkdir()

    class Told(token_counts.PieceCounter):
        def count(self, found):
            (asked / f"{hash(tuple(found))}-{id(found)}").write_text("\0".join(found))
            return super().count(found)

    out = token_counts.token_counts(df, PATH, block=300, make=Told).collect()
    assert len(out) == 80
    seen = [t for f in asked.iterdir() for t in f.read_text().split("\0")]
    assert sorted(seen) == sorted({t for i in range(7) for t in token_counts.pre_tokens(f"same words {i} again")})


def test_packing():
    parts = ["a\x00b", "\x00", "\x00\x01", "\x00\x02", "x", "été"]
    assert token_counts.unpack(token_counts.pack(parts)) == parts


def test_repeated_and_null_ids_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b", "", 0), (1, "a b", "", 0), (1, "a b", "", 0)], SCHEMA)
    assert [r.n_tokens for r in token_counts.token_counts(df, PATH).collect()] == [2, 2, 2]
    assert token_counts.token_counts(df.limit(0), PATH).count() == 0
