import random
import zlib

import numpy as np
import pytest

from sedge.llm import langid

SCHEMA = "doc_id long, text string, lang string, score int, held_out string"
SOUNDS = {"aa": ["ba", "do", "mi", "le", "th"], "bb": ["sch", "ung", "ein", "ß", "ke"], "cc": ["ñi", "os", "ción", "ra", "el"]}


def texts(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SOUNDS))
        out.append((i, " ".join("".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(3, 60))), lang, 0, "x"))
    return out


def test_gradients_match_differences():
    net = langid.Network(["a", "b", "c"], hidden=3, seed=1)
    net.w = {k: w.astype(np.float64) for k, w in net.w.items()}
    draw = np.random.default_rng(2)
    codes, want = draw.integers(97, 101, (5, 4)), draw.integers(0, 3, 4)
    _, g = net.gradients(codes, want)
    for name, w in net.w.items():
        for _ in range(6):
            at = tuple(draw.integers(0, s) for s in w.shape)
            if name in ("xf", "xb"):
                at = (at[0], int(codes[0, 0]))
            old = w[at]
            w[at] = old + 1e-3
            up = net.gradients(codes, want)[0]
            w[at] = old - 1e-3
            down = net.gradients(codes, want)[0]
            w[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-3, abs=3e-4)


def test_held_out_accuracy_and_folds(spark):
    rows = texts(600)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2) for r in rows)
    assert sum(got[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)
    assert all(0 <= g.score <= 1 for g in got.values())


def test_labels_of_held_out_rows_and_other_columns_are_not_used(spark):
    rows = texts(200)
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang, 5, "y") for i, t, lang, _, _ in rows]
    a, b = (sorted(map(tuple, langid.identify(spark.createDataFrame(x, SCHEMA)).collect())) for x in (rows, swapped))
    assert a == b


def plain_logs(net, raw):
    """Log probabilities at each byte, one byte after the other."""
    k = net.hidden

    def read(codes, x, u):
        h, out = np.zeros(k), []
        for c in codes:
            a, b = x[:, c].astype(float), u.astype(float) @ h
            z, r = np.clip(a[:k] + b[:k], 0, 1), np.clip(a[k : 2 * k] + b[k : 2 * k], 0, 1)
            new = np.clip(a[2 * k :] + r * b[2 * k :], -1, 1)
            h = new + z * (h - new)
            out.append(h)
        return out

    forward, backward = read(raw, net.w["xf"], net.w["uf"]), read(raw[::-1], net.w["xb"], net.w["ub"])[::-1]
    s = np.array([net.w["out"] @ np.concatenate(p) + net.w["bias"] for p in zip(forward, backward)]).reshape(len(raw), len(net.languages))
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True)) if len(raw) else np.zeros((0, len(net.languages)))


def trained():
    net = langid.Network(["aa", "bb"], hidden=4, seed=3)
    rows = [t for t in texts(80) if t[2] in ("aa", "bb")]
    raw = [np.frombuffer((t[1] * 4).encode()[:96].ljust(96), np.uint8) for t in rows]
    net.train(np.array(raw), np.array([int(t[2] == "bb") for t in rows]), epochs=4, batch=16)
    return net


def test_every_byte_is_labelled_with_states_that_go_on_over_words_and_windows(monkeypatch):
    net = trained()
    parts = [b"ba do mi sch ung", b"", b"two" * 30, b"\xff\n\x00", ("scheinung bado " * 12).encode()]
    raw, bounds = np.frombuffer(b"".join(parts), np.uint8), np.append(0, np.cumsum([len(p) for p in parts]))
    together = net.pooled(raw, bounds)
    monkeypatch.setattr(langid, "TOGETHER", 2)
    assert net.pooled(raw, bounds) == pytest.approx(together, abs=1e-5)
    for k, p in enumerate(parts):
        logs = plain_logs(net, np.frombuffer(p, np.uint8)).sum(axis=0) / max(1, len(p)) * np.sqrt(max(1, len(p.split())))
        want = np.exp(logs - logs.max())
        assert together[k] == pytest.approx(want / want.sum(), abs=1e-4)


def test_windows_label_each_byte_once_and_see_their_margins():
    bounds = np.array([0, 0, 5, 100, 103, 260])
    for core, margin, together in ((10, 4, 3), (64, 16, 100), (7, 0, 2)):
        seen = np.zeros(260, int)
        for begin, sizes, first, last, owner in langid.windows_of(bounds, core, margin, together):
            assert (np.diff(sizes) <= 0).all()
            for b, n, f, e, o in zip(begin, sizes, first, last, owner):
                seen[b + f : b + e] += 1
                assert bounds[o] <= b and b + n <= bounds[o + 1]
                assert f == min(margin, b + f - bounds[o]) and n - e == min(margin, bounds[o + 1] - b - e)
        assert (seen == 1).all()


def test_a_short_margin_is_nearly_the_whole_text(monkeypatch):
    net = trained()
    monkeypatch.setattr(langid, "CORE", 64)
    raw = ("scheinung kesch ßung " * 40).encode()
    got = net.pooled(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    logs = plain_logs(net, np.frombuffer(raw, np.uint8)).sum(axis=0) / len(raw) * np.sqrt(len(raw.split()))
    want = np.exp(logs - logs.max())
    assert got[0] == pytest.approx(want / want.sum(), abs=0.02)


def test_rare_languages_are_in_the_sample(spark):
    rows = [(i, "x", "common", 0, "") for i in range(3000)] + [(5000 + i, "y", "rare", 0, "") for i in range(4)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("xxhash64(7, doc_id) as h", "lang", "text")
    found = langid.sample_of(df, 20)
    assert [sum(lang == k for lang, _ in found) for k in ("common", "rare")] == [20, 4]
    assert found == langid.sample_of(df.repartition(5), 20)


def test_rows_without_text_or_labels(spark):
    rows = texts(100) + [(1000, None, "aa", 0, ""), (1001, "", "aa", 0, ""), (1002, "12 ... !?", "aa", 0, ""), (None, "bado mile", None, 0, ""), (3, "bado mile", None, 0, "")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[None][0] in SOUNDS
    bare = spark.createDataFrame([(1, "some text", None, 0, "")], SCHEMA)
    assert [tuple(r) for r in langid.identify(bare).collect()] == [(1, False, "und", 0.0)]
    assert langid.identify(spark.createDataFrame([], SCHEMA)).count() == 0
