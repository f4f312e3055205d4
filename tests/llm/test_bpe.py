import base64
import hashlib
import random
import struct

import public_tokenizers as P
import regex
import tiktoken

from sedge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
SCHEMA = "doc_id long, text string, ids string, n_tokens int"


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t\n ", "don't", "we'll", "été", "word", "12", "345", "!!", "日本語", "🙂", " ", "x" * 40, "<|endoftext|>", "   \n   "]
    return [None, "", " ", "a"] + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 400))) for _ in range(60)] + ["y" * 3000 + " z", " " * 2000 + "q", "ab " * 1000]


def test_chunks_are_stitched_as_the_whole_is_read():
    use = bpe.coder(PATH, P.PATTERN)
    for t in texts():
        for chunk, overlap in ((8, 4), (50, 16), (100, 100)):
            assert use.pieces(t or "", chunk, overlap) == regex.findall(P.PATTERN, t or "")


def test_no_text_is_read_whole():
    """Pre-tokens of texts longer than a chunk come from its chunks alone."""
    use, real, seen = bpe.Coder(PATH, P.PATTERN), regex.compile(P.PATTERN), []

    class Told:
        def findall(self, text):
            seen.append(len(text))
            return real.findall(text)

    use.find = Told()
    text = "some ordinary words of a text, 12 and more.\n" * 200
    assert use.pieces(text) == real.findall(text)
    assert max(seen) <= bpe.CHUNK + bpe.OVERLAP < len(text) and len(seen) > 10


def test_query_digests_equal_the_library(spark):
    enc = library()
    want = {}
    rows = []
    for i, t in enumerate(texts()):
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
        rows.append((i, t, "clash", 7))
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN).collect()}
    assert got == want


def test_long_texts_are_dealt_to_tasks(spark):
    enc = library()
    rows = [(i, t, "", 0) for i, t in enumerate(texts())] + [(None, "null id " * 50, "", 0), (5, "again and again " * 30, "", 0)]
    out = bpe.encode(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN, chunk=30, overlap=12, spread=40).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, bytes(r.ids)) for r in out)
    want = sorted((r[0] if r[0] is not None else -1, struct.pack(f"<{len(x)}I", *x)) for r in rows for x in [enc.encode_ordinary(r[1] or "")])
    assert got == want


def test_round_trip_deals_long_texts_too(spark):
    enc = library()
    rows = [(i, t, "", 0) for i, t in enumerate(texts())]
    out = bpe.round_trip(spark.createDataFrame(rows, SCHEMA), PATH, P.PATTERN, chunk=30, overlap=12, spread=40).collect()
    want = [(r[0], enc.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in rows]
    assert sorted((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out) == [(i, struct.pack(f"<{len(x)}I", *x), raw) for i, x, raw in want]


def test_no_rows(spark):
    assert bpe.digests(spark.createDataFrame([], SCHEMA), PATH, P.PATTERN).count() == 0
