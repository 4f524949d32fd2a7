"""Language ID by a byte convolutional network over fixed-length windows."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, held_out, map_bytes, slices, whole_texts

WINDOW = 192  # bytes
EMBED = 6  # numbers for each byte
WIDTHS, FILTERS = (2, 3, 4), 16  # filter widths, filters of each
SAMPLE = 1500  # documents to learn from, of each language, about
PER_DOC = 2  # windows of each, evenly spread
UNKNOWN = "und"


def windows_of(text: bytes, length: int = WINDOW) -> np.ndarray:
    """All of a text's bytes as rows of ``length``, the last filled with zeros."""
    n = max(1, -(-len(text) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, length)


def has_letter(text: bytes) -> bool:
    return any(c.isalpha() for c in text.decode("utf-8", "ignore"))


@dataclass
class ByteNet:
    """Byte embedding, filters of several widths with a rectifier, their maxima over the window, and softmax."""

    classes: list[str]
    embed: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)  # (width * EMBED, FILTERS) each
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None

    def merged(self) -> np.ndarray:
        """All filters as columns over the widest span, zero where a filter is narrower."""
        span = max(WIDTHS) * self.embed.shape[1]
        return np.concatenate([np.pad(f, ((0, span - len(f)), (0, 0))) for f in self.filters], axis=1)

    def responses(self, windows: np.ndarray, matrix: np.ndarray) -> np.ndarray:
        """(windows, positions, filters): one matrix product over all spans."""
        n, length = windows.shape
        widest, e = max(WIDTHS), self.embed.shape[1]
        x = np.zeros((n, length + widest - 1, e), self.embed.dtype)
        x[:, :length] = self.embed[windows]
        s = x.strides
        spans = np.lib.stride_tricks.as_strided(x, (n, length, widest * e), (s[0], s[1], s[2]), writeable=False)
        return spans.reshape(n * length, -1) @ matrix

    def probabilities(self, windows: np.ndarray, batch: int = 64) -> np.ndarray:
        matrix = self.merged()
        out = np.empty((len(windows), len(self.classes)), np.float32)
        for s in range(0, len(windows), batch):
            w = windows[s : s + batch]
            top = np.maximum(self.responses(w, matrix).reshape(len(w), w.shape[1], -1).max(1) + self.bias, 0)
            z = top @ self.out + self.out_bias
            z = np.exp(z - z.max(1, keepdims=True))
            out[s : s + batch] = z / z.sum(1, keepdims=True)
        return out


def fit_bytenet(windows: np.ndarray, labels: list[str], epochs: int = 12, seed: int = 7) -> ByteNet:
    """Train by Adam; the gradient of a maximum goes to the position that holds it."""
    classes = sorted(set(labels))
    rng = np.random.default_rng(seed)
    net = ByteNet(classes, (rng.standard_normal((256, EMBED)) * 0.5).astype(np.float32))
    net.embed[0] = 0
    net.filters = [(rng.standard_normal((w * EMBED, FILTERS)) / np.sqrt(w * EMBED)).astype(np.float32) for w in WIDTHS]
    total, c = len(WIDTHS) * FILTERS, len(classes)
    net.bias = np.zeros(total, np.float32)
    net.out, net.out_bias = (rng.standard_normal((total, c)) * 0.1).astype(np.float32), np.zeros(c, np.float32)
    if c < 2:
        return net
    y = np.array([classes.index(x) for x in labels])
    weight = (len(y) / c / np.bincount(y, minlength=c))[y]
    params = [net.embed, *net.filters, net.bias, net.out, net.out_bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.005 * (1 - epoch / epochs) + 2e-4
        order = rng.permutation(len(y))
        for s in range(0, len(y), 64):
            at = order[s : s + 64]
            grads = gradients(net, windows[at], y[at], weight[at])
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            net.embed[0] = 0
    return net


def gradients(net: ByteNet, w: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean weighted cross-entropy of windows and half of ``decay`` times the squared output weights, by embedding, filters, bias, output and its bias."""
    n, length = w.shape
    widest = max(WIDTHS)
    r = net.responses(w, net.merged()).reshape(n, length, -1)
    where = r.argmax(1)
    raw = np.take_along_axis(r, where[:, None], 1)[:, 0] + net.bias
    top = np.maximum(raw, 0)
    z = top @ net.out + net.out_bias
    z = np.exp(z - z.max(1, keepdims=True))
    dz = z / z.sum(1, keepdims=True)
    dz[np.arange(n), y] -= 1
    dz = (dz * weight[:, None] / n).astype(net.embed.dtype)
    draw = (dz @ net.out.T) * (raw > 0)
    grads = [np.zeros_like(net.embed)]
    wide = np.concatenate([w, np.zeros((n, widest - 1), np.uint8)], axis=1)
    for k, width in enumerate(WIDTHS):
        part = slice(k * FILTERS, (k + 1) * FILTERS)
        bytes_at = wide[np.arange(n)[:, None, None], where[:, part, None] + np.arange(width)]  # (n, filters, width)
        seen = net.embed[bytes_at].reshape(n, FILTERS, -1)
        grads.append(np.einsum("nfi,nf->if", seen, draw[:, part]))
        back = (draw[:, part, None] * net.filters[k].T[None]).reshape(n, FILTERS, width, EMBED)
        np.add.at(grads[0], bytes_at.reshape(-1), back.reshape(-1, EMBED))
    return grads + [draw.sum(0), top.T @ dz + decay * net.out, dz.sum(0)]


def fit_language(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most: int = SAMPLE) -> ByteNet:
    """Learn from windows spread over the texts of a bounded sample of about ``most`` documents of each language."""
    texts = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").cast("binary").alias("text")).where("lang is not null and text is not null")
    shares = {r["lang"]: most / r["n"] for r in texts.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not shares:
        return ByteNet([], np.zeros((256, EMBED), np.float32))
    share = F.coalesce(F.create_map(*(F.lit(x) for kv in shares.items() for x in kv))[F.col("lang")], F.lit(0.0))
    picked = texts.where(F.abs(F.xxhash64("doc_id") % 1_000_000) < share * 1_000_000)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows = []
                for doc, lang, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    if has_letter(text):
                        w = windows_of(text)
                        rows += [(doc, lang, w[i].tobytes()) for i in sorted({len(w) * k // PER_DOC for k in range(PER_DOC)})]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64(), pa.string(), pa.binary()])], names=["doc_id", "lang", "window"])

    rows = picked.mapInArrow(run, "doc_id long, lang string, window binary").toPandas().sort_values(["doc_id", "window"])
    if not len(rows):
        return ByteNet([], np.zeros((256, EMBED), np.float32))
    return fit_bytenet(np.stack([np.frombuffer(b, np.uint8) for b in rows.window]), rows.lang.tolist())


def predict_language(df: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row: the mean of its windows' probabilities, each weighted by its bytes.

    A null text, one without a letter, or any text when nothing was learned is ``und`` with score 0.
    """
    shipped = df.sparkSession.sparkContext.broadcast(net)

    def make():
        model = shipped.value

        def predict(ids, texts):
            ok = [bool(model.classes) and has_letter(t) for t in texts]
            parts = [windows_of(t) for t, k in zip(texts, ok, strict=True) if k]
            names, scores, at = [UNKNOWN] * len(texts), [0.0] * len(texts), 0
            if parts:
                p = model.probabilities(np.concatenate(parts))
                filled = iter(parts)
                for k in (k for k in range(len(texts)) if ok[k]):
                    n = len(next(filled))
                    weight = np.full(n, WINDOW, np.float64)
                    weight[-1] = len(texts[k]) - (n - 1) * WINDOW
                    mean = weight @ p[at : at + n] / weight.sum()
                    at += n
                    names[k], scores[k] = model.classes[int(mean.argmax())], float(min(1.0, mean.max()))
            return [ids, names, scores]

        return predict

    return map_bytes(whole_texts(df, id_col, text_col), make, "doc_id long, lang_pred string, score double", [pa.int64(), pa.string(), pa.float64()])


def op4_language(spark, sf_dir):
    docs = documents(spark, sf_dir)
    net = fit_language(docs.where(~held_out("doc_id", 4, 2)))
    return predict_language(docs, net).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language": op4_language}
ORACLES: dict[str, str] = {}
