"""Language identification by a bidirectional gated recurrent network over bytes.

Method. Two gated recurrent layers read a text's bytes from both ends; at every byte their states give a distribution over
the languages. A document's probabilities pool those of all its bytes: the mean of their logarithms, times the square root
of the number of words (neighbouring bytes are far from independent), normalised. A text is read in windows of CORE bytes; a
window's layers also read the MARGIN bytes on either side, whose labels they leave to the windows there, so that states
go on over words, lines and the windows' ends. Windows of a slice are read together, the longer ones first.

The network is trained here in NumPy, by backpropagation through time with Adam, on the whole texts of a bounded
sample of labelled rows: of each language ROWS, in order of a hash of the row, and of LANGUAGES languages at most, the
most frequent ones. It sees bytes only. Gates and states are cut off straight lines (between 0 and 1, -1 and 1) instead of curves.

Rows. A null text, or one without a letter, gets `und` and score 0. Of equal probabilities the language that comes first in
the alphabet is taken. With no labelled row to learn from all rows do. A null id is not held out. Repeated rows each get a row. A
very long text is read window by window. Columns that the input has besides are left out. No rows in, no rows out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import find_words, rest_of, slices, whole_rows

#: The bound of the training sample: rows of each language, and languages.
ROWS, LANGUAGES = 150, 256
#: One training window in so many is also shown in capitals.
SHOUTED = 6
#: Bytes of a window that get labels, and bytes read before and after them.
CORE, MARGIN = 480, 16
#: Units of a layer; passes over the sample; bytes of a training window, and windows of a step.
HIDDEN, EPOCHS, TRAINED, BATCH = 5, 3, 96, 192
#: Windows that are read together at most, and bytes of text of a slice.
TOGETHER, SLICE = 2048, 1 << 21
UNKNOWN = "und"


class Network:
    """Weights: for each direction, by byte (x: 3H by 256) and state (u: 3H by H); and out (languages by 2H), bias.

    Rows of x and u are those of the gate that keeps the state, the gate that shows it to the candidate, the candidate.
    """

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = 0):
        draw = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        f = lambda scale, *shape: (draw.standard_normal(shape) * scale).astype(np.float32)
        self.w = {}
        for side in "fb":
            x = f(0.3, 3 * hidden, 256)
            x[: 2 * hidden] += 0.5  # gates begin half open
            self.w |= {"x" + side: x, "u" + side: f(0.3 / np.sqrt(hidden), 3 * hidden, hidden)}
        self.w |= {"out": f(1 / np.sqrt(2 * hidden), len(languages), 2 * hidden), "bias": np.zeros(len(languages), np.float32)}

    def _read(self, codes: np.ndarray, x: np.ndarray, u: np.ndarray, keep: list) -> np.ndarray:
        """States (L by H by n) after each byte of codes (L by n); keep gets what the way back needs."""
        length, n = codes.shape
        k = self.hidden
        h, states = np.zeros((k, n), x.dtype), np.empty((length, k, n), x.dtype)
        for t in range(length):
            a, b = x[:, codes[t]], u @ h
            gates = np.clip(a[: 2 * k] + b[: 2 * k], 0, 1)
            z, r = gates[:k], gates[k:]
            new = np.clip(a[2 * k :] + r * b[2 * k :], -1, 1)
            keep.append((h, z, r, new, b[2 * k :]))
            h = new + z * (h - new)
            states[t] = h
        return states

    def gradients(self, codes: np.ndarray, want: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all bytes of codes (L by n), and its derivatives, by backpropagation through time."""
        kept = ([], [])
        forward = self._read(codes, self.w["xf"], self.w["uf"], kept[0])
        backward = self._read(codes[::-1], self.w["xb"], self.w["ub"], kept[1])[::-1]
        states = np.concatenate([forward, backward], axis=1)
        length, _, n = states.shape
        k, many = self.hidden, len(self.languages)
        scores = self.w["out"] @ states + self.w["bias"][:, None]
        scores -= scores.max(axis=1, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(axis=1, keepdims=True)
        at = np.arange(n)
        loss = -np.log(p[:, want, at] + 1e-12).mean()
        p[:, want, at] -= 1
        p /= n * length
        g = {name: np.zeros_like(w) for name, w in self.w.items()}
        flat = p.transpose(1, 0, 2).reshape(many, -1)
        g["out"] += flat @ states.transpose(1, 0, 2).reshape(2 * k, -1).T
        g["bias"] += flat.sum(axis=1)
        down = self.w["out"].T @ p
        for side, steps, seen, into in (("f", kept[0], codes, down[:, :k]), ("b", kept[1], codes[::-1], down[::-1, k:])):
            u, later, da = self.w["u" + side], np.zeros((k, n), p.dtype), np.empty((length, 3 * k, n), p.dtype)
            for t in range(length - 1, -1, -1):
                h, z, r, new, inner = steps[t]
                d = into[t] + later
                dnew = d * (1 - z) * (np.abs(new) < 1)
                dz, dr = d * (h - new) * ((z > 0) & (z < 1)), dnew * inner * ((r > 0) & (r < 1))
                db = np.concatenate([dz, dr, dnew * r])
                g["u" + side] += db @ h.T
                da[t, : 2 * k], da[t, 2 * k :] = db[: 2 * k], dnew
                later = d * z + u.T @ db
            byte = seen.ravel()
            order = np.argsort(byte, kind="stable")
            lead = np.flatnonzero(np.diff(byte[order], prepend=-1))
            g["x" + side][:, byte[order][lead]] += np.add.reduceat(da.transpose(1, 0, 2).reshape(3 * k, -1)[:, order], lead, axis=1)
        return float(loss), g

    def train(self, windows: np.ndarray, want: np.ndarray, epochs: int = EPOCHS, batch: int = BATCH, rate: float = 0.02, seed: int = 0) -> None:
        """Adam over batches of windows (n by L bytes), in an order drawn anew each time."""
        draw = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(w) for k, w in self.w.items()}, {k: np.zeros_like(w) for k, w in self.w.items()}, 0
        parts = -(-len(windows) // batch)
        for _ in range(epochs):
            for rows in np.array_split(draw.permutation(len(windows)), parts):
                _, g = self.gradients(np.ascontiguousarray(windows[rows].T).astype(np.intp), want[rows])
                step += 1
                now = rate * (1 - 0.9 * step / (epochs * parts))
                norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
                for k, w in self.w.items():
                    d = g[k] * min(1.0, 1.0 / (norm + 1e-9))
                    m[k] += 0.1 * (d - m[k])
                    v[k] += 0.01 * (d * d - v[k])
                    w -= (now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def label(self, codes: np.ndarray, sizes: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Sums of the languages' log probabilities at the bytes from first to last of each window (languages by n).

        codes: L by n; sizes: the windows' bytes, the longest first. A window takes no part in steps beyond its end.
        """
        k, (length, n) = self.hidden, codes.shape
        w, out, bias = self.w, self.w["out"], self.w["bias"][:, None]
        here = np.searchsorted(-sizes, -np.arange(1, length + 1), "right")  # windows that have a byte t
        a, b, g, new = (np.empty((rows, n), np.float32) for rows in (3 * k, 3 * k, 2 * k, k))
        states, sums = np.empty((length, k, n), np.float32), np.zeros((len(self.languages), n), np.float32)

        def step(h, codes_t, side, m):
            a_, b_, g_, new_ = a[:, :m], b[:, :m], g[:, :m], new[:, :m]
            np.take(w["x" + side], codes_t[:m], axis=1, out=a_, mode="clip")
            np.matmul(w["u" + side], h, out=b_)
            np.add(a_[: 2 * k], b_[: 2 * k], out=g_)
            np.clip(g_, 0, 1, out=g_)
            np.multiply(g_[k:], b_[2 * k :], out=new_)
            np.add(new_, a_[2 * k :], out=new_)
            np.clip(new_, -1, 1, out=new_)
            h -= new_
            h *= g_[:k]
            h += new_

        h = np.zeros((k, n), np.float32)
        for t in range(length):
            m = int(here[t])
            step(h[:, :m], codes[t], "f", m)
            states[t, :, :m] = h[:, :m]
        h[:] = 0
        small = np.abs(out).sum(axis=1).max() + np.abs(bias).max() < 60  # states are at most 1, so no exponential overflows
        for t in range(length - 1, -1, -1):
            m = int(here[t])
            step(h[:, :m], codes[t], "b", m)
            s = out[:, :k] @ states[t, :, :m]
            s += out[:, k:] @ h[:, :m]
            s += bias
            if not small:
                s -= s.max(axis=0)
            s -= np.log(np.exp(s).sum(axis=0))
            if t < MARGIN or t >= CORE:
                s *= (first[:m] <= t) & (t < last[:m])
            sums[:, :m] += s
        return sums

    def pooled(self, raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Probabilities of the languages for each row of a slice of bytes."""
        rows, sums = len(bounds) - 1, np.zeros((len(bounds) - 1, len(self.languages)))
        views = np.lib.stride_tricks.sliding_window_view(np.append(raw, np.zeros(CORE + 2 * MARGIN, np.uint8)), CORE + 2 * MARGIN)
        for part in windows_of(bounds):
            begin, sizes, first, last, owner = part
            codes = np.ascontiguousarray(views[begin, : int(sizes[0])].T).astype(np.intp)
            np.add.at(sums, owner, self.label(codes, sizes, first, last).T.astype(np.float64))
        words = find_words(raw, bounds)[2]
        logs = sums / np.maximum(np.diff(bounds), 1)[:, None] * np.sqrt(np.maximum(words, 1))[:, None]
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def windows_of(bounds: np.ndarray, core: int | None = None, margin: int | None = None, together: int | None = None):
    """Windows of the rows of a slice, some at a time, the longer first: begin, size, where labels begin and end in it, row."""
    core, margin, together = core or CORE, MARGIN if margin is None else margin, together or TOGETHER
    sizes = np.diff(bounds)
    many = -(-sizes // core)
    owner = np.repeat(np.arange(len(sizes)), many)
    low = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * core
    high = np.minimum(low + core, sizes[owner])
    begin, end = np.maximum(low - margin, 0), np.minimum(high + margin, sizes[owner])
    order = np.argsort(begin - end, kind="stable")
    for s in range(0, len(order), together):
        o = order[s : s + together]
        yield bounds[:-1][owner[o]] + begin[o], (end - begin)[o], (low - begin)[o], (high - begin)[o], owner[o]


def fold(id_col: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % parts


def sample_of(rows: DataFrame, each: int = ROWS, languages: int = LANGUAGES) -> list[tuple[str, str]]:
    """(lang, text) of `each` rows of each language, in order of h. rows: h (a hash over all 64 bits), lang, text.

    A bound on the hash, broadcast for the `languages` at most, leaves about three times as many of each language, so no text
    but theirs is shuffled and the sort that follows is as small as the sample.
    """
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()
    if not counts:
        return []
    share = lambda n: min(1.0, (3 * each + 50) / n)
    bounds = rows.sparkSession.createDataFrame([(r.lang, -(1 << 63) + min((1 << 64) - 1, int(share(r["count"]) * (1 << 64)))) for r in counts], "of string, most long")
    near = rows.join(F.broadcast(bounds), F.col("lang") == F.col("of")).where(F.col("h") <= F.col("most")).select("h", "lang", "text")
    line = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    return [(r.lang, r.text) for r in near.withColumn("at", line).where(F.col("at") <= each).orderBy("h", "lang", "text").select("lang", "text").collect()]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: Column | None = None, each: int = ROWS) -> Network | None:
    """A network from a bounded sample of the labelled rows that are not held out; None if there are none."""
    held_out = fold(F.col(id_col), 4) == 2 if held_out is None else held_out
    rows = docs.where(~held_out & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sample = sample_of(rows.select(F.xxhash64(F.lit(7), F.col(id_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")), each)
    languages = sorted({lang for lang, _ in sample})
    windows, want, rest = [], [], {}
    for lang, text in sample:
        raw = np.frombuffer(text.encode(), np.uint8)
        y, cut = languages.index(lang), len(raw) // TRAINED * TRAINED
        windows.append(raw[:cut].reshape(-1, TRAINED))
        want.append(np.full(cut // TRAINED, y))
        shout = np.frombuffer(text.upper().encode(), np.uint8)
        shout = shout[: len(shout) // TRAINED * TRAINED].reshape(-1, TRAINED)[::SHOUTED]
        windows.append(shout)
        want.append(np.full(len(shout), y))
        rest.setdefault(y, []).append(raw[cut:])
    for y, parts in rest.items():  # what is left of each text, end to end; the last window begins earlier or is filled with spaces
        raw = np.concatenate([x for part in parts for x in (part, np.array([0x20], np.uint8))])
        if short := -len(raw) % TRAINED:
            raw = np.append(raw, np.full(short, 0x20, np.uint8))
        windows.append(raw.reshape(-1, TRAINED))
        want.append(np.full(len(raw) // TRAINED, y))
    if not windows:
        return None
    net = Network(languages)
    net.train(np.concatenate(windows), np.concatenate(want))
    return net


def _run(net: Network, text: int, letters: int, keep: list[int], names: list[str]):
    """For batches with the text and whether it has letters: the columns of keep, the language and its probability."""

    def run(batches):
        of = np.array([*net.languages, UNKNOWN], object)
        for part, raw, bounds in slices(batches, names[text], SLICE):
            p = net.pooled(raw, bounds)
            best, has = p.argmax(axis=1), part.column(letters).to_numpy(zero_copy_only=False)
            score = np.where(has, p[np.arange(len(p)), best], 0.0)
            found = pa.array(of[np.where(has, best, len(net.languages))].tolist(), pa.string())
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), found, pa.array(score)], [*(names[k] for k in keep), "lang_pred", "score"])

    return run


def has_letters(text: Column) -> Column:
    return F.coalesce(text.cast("string").rlike("\\p{L}"), F.lit(False))


def accepted(docs: DataFrame, net: Network | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose language is told with at least this probability."""
    if net is None:
        return docs.limit(0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), has_letters(F.col(text_col)).alias("letters"), rest_of(docs, text_col).alias("rest"))
    schema = T.StructType([rows.schema["text"], rows.schema["rest"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = rows.mapInArrow(_run(net, 0, 1, [0, 2], rows.columns), schema)
    return whole_rows(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs.columns, text_col, F.col("text"))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, lang_pred, score: the language with the largest pooled probability, and that probability."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), has_letters(F.col(text_col)).alias("letters"))
    if net is None:
        return rows.select(F.col("id").alias(id_col), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    return rows.mapInArrow(_run(net, 1, 2, [0], rows.columns), "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id_col, held_out, lang_pred, score, learnt from the rows whose fold() of 4 is not 2."""
    net = learn(docs, id_col, text_col, lang_col)
    found = predict(docs, net, id_col, text_col)
    return found.select(id_col, (fold(F.col(id_col), 4) == 2).alias("held_out"), "lang_pred", "score")
