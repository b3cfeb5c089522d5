"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in a
window goes through a softmax. Training is plain numpy: a filter is a table of responses by byte and place,
so that a convolution is a sum of table rows and its gradient touches just the bytes at the maximum. For
prediction, tables of 16-bit integers cover one or two bytes a step, and every window of a text is read.

Fitting reads about `per_language` documents of each language, drawn by a hash of their id, at most
`max_documents` in all, and WINDOWS_A_TEXT windows of each. Rows without a language are left out.
Defined cases: `und` with score 0 for a null text, one without a letter, or where there is nothing to learn
from; repeated rows are predicted each; texts shorter than a window are padded with zero bytes.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import held_out, map_blocks, table, written

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
PAD = max(WIDTHS)
WINDOWS_A_TEXT = 4
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def prepared(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # by width: (width, 256, FILTERS)
    bias: list[np.ndarray]
    dense: np.ndarray
    out_bias: np.ndarray


def _forward(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Pooled responses, where they are, and probabilities; x: windows with PAD more bytes."""
    pooled, places = [], []
    for t, b in zip(net.tables, net.bias, strict=True):
        r = t[0][x[:, :WINDOW]]
        for k in range(1, len(t)):
            r = r + t[k][x[:, k : WINDOW + k]]
        at = r.argmax(1)
        places.append(at)
        pooled.append(np.take_along_axis(r, at[:, None, :], 1)[:, 0, :] + b)
    h = np.maximum(np.concatenate(pooled, 1), 0)
    z = h @ net.dense + net.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    return h, places, z / z.sum(1, keepdims=True)


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, by the tables, their biases, the dense layer and its bias."""
    batch = len(x)
    h, places, p = _forward(net, x)
    d = p.copy()
    d[np.arange(batch), y] -= 1
    d /= batch
    back = (d @ net.dense.T) * (h > 0)
    grads: list[np.ndarray] = []
    rows = np.arange(batch)[:, None]
    for j, t in enumerate(net.tables):
        g = np.zeros_like(t)
        own = back[:, j * FILTERS : (j + 1) * FILTERS]
        for k in range(len(t)):
            np.add.at(g[k], (x[rows, places[j] + k], np.arange(FILTERS)[None, :]), own)
        grads.append(g)
    grads += [back[:, j * FILTERS : (j + 1) * FILTERS].sum(0) for j in range(len(WIDTHS))]
    return [*grads, h.T @ d, d.sum(0)]


def train(windows: np.ndarray, target: np.ndarray, languages: list[str], steps: int = 900, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on cross-entropy; a third of the windows of a batch is cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    n = len(languages)
    net = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), n)).astype(np.float32),
        np.zeros(n, np.float32),
    )
    weights = [*net.tables, *net.bias, net.dense, net.out_bias]
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    by_language = [np.flatnonzero(target == k) for k in range(n)]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(by_language[k]) for k in rng.integers(0, n, batch)])
        x, y = windows[pick].copy(), target[pick]
        for i in np.flatnonzero(rng.random(batch) < 0.33):
            x[i, rng.integers(16, WINDOW) :] = 0
        grads = gradients(net, x, y)
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, a, b in zip(weights, grads, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            w -= slow * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


class Predictor:
    """The network with its tables as 16-bit integers, single bytes and byte pairs."""

    def __init__(self, net: Network):
        self.net = net
        self.scale = 8000 / max(1e-6, max(float(np.abs(t).max()) * len(t) for t in net.tables))
        single = [np.rint(t * self.scale).astype(np.int16) for t in net.tables]
        pair = lambda t, k: (t[k][:, None, :] + t[k + 1][None, :, :]).reshape(1 << 16, FILTERS)
        self.steps = [[(k, pair(t, k) if k + 1 < len(t) else t[k]) for k in range(0, len(t), 2)] for t in single]

    def windows(self, data: np.ndarray) -> np.ndarray:
        """Probabilities of each WINDOW of data, which has PAD more bytes than whole windows."""
        n = (len(data) - PAD) // WINDOW
        out = np.empty((n, len(self.net.languages)), np.float32)
        pairs = data[:-1].astype(np.uint16) << 8 | data[1:]
        for a in range(0, n, 128):
            b = min(n, a + 128)
            low, high = a * WINDOW, b * WINDOW
            pooled = []
            for steps, bias in zip(self.steps, self.net.bias, strict=True):
                r = None
                for k, t in steps:
                    x = t.take((pairs if len(t) > 256 else data)[low + k : high + k], 0)
                    r = x if r is None else np.add(r, x, out=r)
                pooled.append(r.reshape(b - a, WINDOW, FILTERS).max(1) / self.scale + bias)
            z = np.maximum(np.concatenate(pooled, 1), 0) @ self.net.dense + self.net.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[a:b] = z / z.sum(1, keepdims=True)
        return out

    def texts(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        held = [(i, prepared(x)) for i, x in enumerate(texts) if x and has_letter(x)]
        if not held or not self.net.languages:
            return out
        counts = [-(-(len(x) + PAD) // WINDOW) for _, x in held]
        data = b"".join(x.ljust(n * WINDOW, b"\0") for (_, x), n in zip(held, counts, strict=True)) + bytes(PAD)
        p = self.windows(np.frombuffer(data, np.uint8))
        first = np.concatenate([[0], np.cumsum(counts)])
        weight = np.full(len(p), float(WINDOW))
        for (_, x), end in zip(held, first[1:], strict=True):
            weight[end - 1] = max(1, len(x) % WINDOW)
        mean = np.add.reduceat(p * weight[:, None], first[:-1], 0) / np.add.reduceat(weight, first[:-1])[:, None]
        best = mean.argmax(1)
        for (i, _), k, row in zip(held, best.tolist(), mean.tolist(), strict=True):
            out[i] = (self.net.languages[k], min(1.0, row[k]))
        return out


def fit(docs: DataFrame, per_language: int = 600, max_documents: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network:
    """The network from labelled documents; at most max_documents * WINDOWS_A_TEXT windows reach the driver."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    counts = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")))  # one row a language
    share = F.pmod("h", F.lit(1 << 20)) * F.col("n") < float(per_language << 20)  # about per_language of each, by hash
    ids = labelled.join(counts, "lang").where(share).orderBy("h", "doc_id").limit(max_documents)
    sample = rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id")  # at most max_documents ids

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            langs, found = [], []
            for doc_id, text, lang in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if not text or lang is None or not has_letter(text):
                    continue
                data = prepared(text)
                spread = max(1, len(data) - WINDOW + 1)
                for k in range(min(WINDOWS_A_TEXT, -(-len(data) // WINDOW))):
                    at = zlib.crc32(f"{doc_id}:{k}".encode()) % spread
                    found.append(data[at : at + WINDOW])
                    langs.append(lang)
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary())], names=["lang", "data"])

        return work

    got = sorted((r["lang"], bytes(r["data"])) for r in map_blocks(sample, make, "lang string, data binary").collect())
    languages = sorted({lang for lang, _ in got})
    if len(languages) < 2:
        return Network(languages, [np.zeros((w, 256, FILTERS), np.float32) for w in WIDTHS], [np.zeros(FILTERS, np.float32)] * len(WIDTHS), np.zeros((FILTERS * len(WIDTHS), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    x = np.frombuffer(b"".join(d.ljust(WINDOW + PAD, b"\0") for _, d in got), np.uint8).reshape(-1, WINDOW + PAD)
    return train(x, np.array([languages.index(lang) for lang, _ in got]), languages)


def identify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """lang_pred and score of every whole text."""

    def make():
        model = Predictor(net)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = model.texts(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return work

    return map_blocks(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, net).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
