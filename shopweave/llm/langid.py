"""Language identification by a small convolutional network over bytes.

Bytes are folded to classes (letters by themselves in lower case, every other
ASCII byte one class), embedded, and convolved with filters two, three and four
bytes wide; each filter keeps its maximum over the window, and a softmax over
the learned languages follows. The network is trained in numpy with Adam on
labelled windows.

Training uses a bounded sample: ``rows_per_language`` documents of each of the
``max_languages`` most frequent languages, taken by a hash of ``doc_id``, and
``WINDOWS_PER_ROW`` windows spread over each. Prediction covers every byte of every
text: windows of ``WINDOW`` bytes, each beginning where the last one's final three
bytes do, so no filter position is missed. A text's probabilities are its windows'
means, weighted by their lengths.

A null text, or one without a letter, is ``und`` with score 0, and so is every
text when there is no labelled row to learn from. Null ``doc_id`` rows are neither
held out nor learned from. Ties go to the label that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopweave.llm.common import pieces, to_bytes

WINDOW = 128
WIDTHS = (2, 3, 4)
STEP = WINDOW - max(WIDTHS) + 1
FILTERS = 16
EMBEDDING = 8
ROWS_PER_LANGUAGE = 400
MAX_LANGUAGES = 256
WINDOWS_PER_ROW = 4
EPOCHS = 14
BATCH = 64
HELD_OUT_MOD = 5
UNKNOWN = "und"
SPREAD = 1 << 30  # of the sampling hash

#: Class of each byte: 0 pads, 1 is any ASCII byte that is no letter, 2 to 27 are letters, then bytes from 0x80 on.
CLASS = np.ones(256, np.int64)
CLASS[65:91] = CLASS[97:123] = np.arange(2, 28)
CLASS[128:] = np.arange(28, 156)
CLASSES = 156


def held_out(doc_id: Column, mod: int = HELD_OUT_MOD) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == 0, F.lit(False))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(byte classes of each window, its text's position, its length); an empty text has none."""
    flat = np.append(CLASS[np.frombuffer(b"".join(texts), np.uint8)], np.zeros(WINDOW, np.int64))
    sizes = np.array([len(t) for t in texts], np.int64)
    count = np.where(sizes > 0, np.maximum(1, -(-(sizes - WINDOW) // STEP) + 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    first = np.repeat(np.cumsum(sizes) - sizes, count) + nth * STEP
    length = np.minimum(WINDOW, sizes[owner] - nth * STEP)
    grid = flat[first[:, None] + np.arange(WINDOW)]
    grid[np.arange(WINDOW) >= length[:, None]] = 0
    return grid, owner, length


class Network:
    def __init__(self, labels: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.p = {"embed": rng.normal(0, 0.5, (CLASSES, EMBEDDING)), "out": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))), "bias": np.zeros(len(labels))}
        for w in WIDTHS:
            self.p[f"w{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBEDDING), (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, n = self.p, len(x)
        embedded = p["embed"][x]
        hidden, traces = [], []
        for w in WIDTHS:
            spans = sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(n, x.shape[1] - w + 1, w * EMBEDDING)
            conv = spans @ p[f"w{w}"]
            at = conv.argmax(1)
            hidden.append(np.maximum(np.take_along_axis(conv, at[:, None], 1)[:, 0] + p[f"b{w}"], 0))
            traces.append((spans, at))
        h = np.concatenate(hidden, 1)
        d = softmax(h @ p["out"] + p["bias"])
        d[np.arange(n), y] -= 1
        d /= n
        g = {"out": h.T @ d, "bias": d.sum(0), "embed": np.zeros_like(p["embed"])}
        back = (d @ p["out"].T) * (h > 0)
        for k, w in enumerate(WIDTHS):
            spans, at = traces[k]
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            seen = spans[np.arange(n)[:, None], at]  # n, filters, w * embedding
            g[f"w{w}"], g[f"b{w}"] = np.einsum("nfk,nf->kf", seen, part), part.sum(0)
            weights = p[f"w{w}"].T.reshape(FILTERS, w, EMBEDDING)
            classes = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
            np.add.at(g["embed"], classes, part[:, :, None, None] * weights)
        return g

    def train(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam; each epoch cuts half of the windows to a random length, so short texts are learned too."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            cut = np.where(rng.random(len(x)) < 0.5, rng.integers(6, WINDOW + 1, len(x)), length)
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                rows = order[k : k + BATCH]
                batch = np.where(np.arange(WINDOW) < cut[rows][:, None], x[rows], 0)
                step += 1
                for name, g in self.gradients(batch, y[rows]).items():
                    m[name] += 0.1 * (g - m[name])
                    s[name] += 0.001 * (g * g - s[name])
                    self.p[name] -= 0.004 * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> Tables:
        return Tables(self)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Tables:
    """The trained network for prediction: each filter position as a table by byte class, two positions as one by pair."""

    def __init__(self, network: Network):
        p = network.p
        self.labels, self.out, self.bias = network.labels, p["out"], p["bias"]
        one = {w: [p["embed"] @ p[f"w{w}"][k * EMBEDDING : (k + 1) * EMBEDDING] for k in range(w)] for w in WIDTHS}
        pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS).astype(np.float32)
        self.parts = {w: [(k, pair(one[w][k], one[w][k + 1])) for k in range(0, w - 1, 2)] for w in WIDTHS}
        self.rest = {w: (w - 1, one[w][-1]) if w % 2 else None for w in WIDTHS}
        self.b = {w: p[f"b{w}"] for w in WIDTHS}

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.labels)), np.float32)
        for k in range(0, len(x), 64):
            y = x[k : k + 64]
            pairs = y[:, :-1] * CLASSES + y[:, 1:]
            hidden = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                (at, table), *more = self.parts[w]
                conv = np.take(table, pairs[:, at : at + n], 0)
                for at, table in more:
                    conv += np.take(table, pairs[:, at : at + n], 0)
                if self.rest[w]:
                    at, table = self.rest[w]
                    conv += np.take(table, y[:, at : at + n], 0)
                hidden.append(np.maximum(conv.max(1) + self.b[w], 0))
            out[k : k + 64] = softmax(np.concatenate(hidden, 1) @ self.out + self.bias)
        return out

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        labels, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if self.labels:
            x, owner, length = windows(texts)
            mass = self.probabilities(x) * length[:, None]
            sums = np.stack([np.bincount(owner, mass[:, k], len(texts)) for k in range(len(self.labels))], 1)
            share = sums / np.maximum(sums.sum(1, keepdims=True), 1e-30)
            best = share.argmax(1)
            for i, t in enumerate(texts):
                if has_letter(t):
                    labels[i], scores[i] = self.labels[best[i]], float(min(1.0, share[i, best[i]]))
        return labels, scores


def has_letter(text: bytes) -> bool:
    return bool(re.search(rb"[A-Za-z]", text)) or not text.isascii() and any(map(str.isalpha, text.decode()))


def training_windows(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of the bounded sample with their lengths and labels, collected: at most
    2 * rows_per_language * max_languages * WINDOWS_PER_ROW windows."""
    learn = docs.filter("doc_id is not null and lang is not null").filter(~held_out(F.col("doc_id")))
    counts = learn.groupBy(F.col("lang").alias("label")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(max_languages).collect()
    if not counts:
        return np.empty((0, WINDOW), np.int64), np.empty(0, np.int64), []
    rates = docs.sparkSession.createDataFrame([(r["label"], min(SPREAD, rows_per_language * SPREAD // r["n"] + 1)) for r in counts], "label string, below long")
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit("lang")), F.lit(SPREAD))
    chosen = learn.select(F.col("lang").alias("label"), F.col("text").cast("string").alias("text"), drawn.alias("draw")).join(F.broadcast(rates), "label").filter("draw < below and text is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            label, draw, found = [], [], []
            names, draws = batch.column("label").to_pylist(), batch.column("draw").to_pylist()
            for i, t in enumerate(to_bytes(batch.column("text"))):
                spread = sorted({k * max(0, len(t) - WINDOW) // max(1, WINDOWS_PER_ROW - 1) for k in range(WINDOWS_PER_ROW)})
                for at in spread if has_letter(t) else ():
                    label.append(names[i])
                    draw.append(draws[i])
                    found.append(t[at : at + WINDOW])
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(draw, pa.int64()), pa.array(found, pa.binary())], ["label", "draw", "bytes"])

    most = 2 * rows_per_language * len(counts) * WINDOWS_PER_ROW
    rows = chosen.select("label", "draw", "text").mapInArrow(cut, "label string, draw long, bytes binary").orderBy("draw", "label", "bytes").limit(most).collect()
    grid = np.zeros((len(rows), WINDOW), np.int64)
    for i, r in enumerate(rows):
        grid[i, : len(r["bytes"])] = CLASS[np.frombuffer(bytes(r["bytes"]), np.uint8)]
    return grid, np.array([len(r["bytes"]) for r in rows], np.int64), [r["label"] for r in rows]


def train(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> Tables:
    x, length, names = training_windows(docs, rows_per_language, max_languages)
    network = Network(sorted(set(names)))
    if names:
        network.train(x, length, np.searchsorted(np.array(network.labels, object), np.array(names, object)))
    return network.tables()


def predictor(docs: DataFrame, tables: Tables):
    """A pandas-free column function: struct(lang_pred, score) of a text column."""
    shipped = docs.sparkSession.sparkContext.broadcast(vars(tables))

    @F.arrow_udf("struct<lang_pred string, score double>")
    def predict(texts: pa.Array) -> pa.Array:
        model = Tables.__new__(Tables)
        vars(model).update(shipped.value)
        labels, scores, held, start = [], [], 0, 0
        every = to_bytes(texts)
        for i, t in enumerate([*every, None]):
            if t is None or held + len(t) > 2 << 20 and i > start:
                got = model.predict(every[start:i])
                labels, scores, held, start = labels + got[0], scores + got[1], 0, i
            held += len(t or b"")
        return pa.StructArray.from_arrays([pa.array(labels, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict


def identify(docs: DataFrame, **sample: int) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per row of ``docs``."""
    predict = predictor(docs, train(docs, **sample))
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text").cast("string")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score")


def keep_identified(docs: DataFrame, min_score: float = 0.4, **sample: int) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``, with all their columns."""
    predict = predictor(docs, train(docs, **sample))
    marked = docs.withColumn("__lang", predict(F.col("text").cast("string")))
    return marked.filter((F.col("__lang.lang_pred") != UNKNOWN) & (F.col("__lang.score") >= min_score)).select(*[F.col(f"`{c}`") for c in docs.columns])
