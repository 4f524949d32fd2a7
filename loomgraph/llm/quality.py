"""Quality classifier: random-indexing word vectors pooled per document, and a two-layer network with calibrated probabilities."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import documents, held_out, map_bytes, slices, whole_texts

#: Runs of letters (all bytes beyond ASCII count as such), of digits, and of other signs.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")
ROWS, DIMS = 1 << 14, 32  # word vectors (words share them by hash) and their length
LONG = 1 << 20  # bytes of a text whose words are read one by one
REACH = 2  # words on either side that count as context
SAMPLE = 20_000  # labelled documents to learn from, about; more are thinned by a hash of their id
HIDDEN = 24
THRESHOLD = 0.3


def token_ids(text: bytes, rows: int = ROWS) -> np.ndarray:
    """Each word's row. A long text's words are not held as a list, which takes many times its bytes."""
    words = TOKEN.findall(text) if len(text) <= LONG else (m.group() for m in TOKEN.finditer(text))
    return np.fromiter(map(zlib.crc32, words), np.uint32) & np.uint32(rows - 1)


def index_positions(rows: int = ROWS, dims: int = DIMS) -> np.ndarray:
    """For each word row its sparse index vector: the place of its one and of its minus one."""
    rng = np.random.default_rng(5)
    plus = rng.integers(0, dims, rows)
    return np.stack([plus, (plus + rng.integers(1, dims, rows)) % dims])


def context_sums(texts: list[bytes], places: np.ndarray, out: np.ndarray, reach: int = REACH) -> None:
    """Add to each word's row the index vectors of the words around it; words of one text only."""
    dims = out.shape[1]
    for text in texts:
        ids = token_ids(text, len(out)).astype(np.int64)
        for d in range(1, min(reach, len(ids) - 1) + 1):
            for word, around in ((ids[d:], ids[:-d]), (ids[:-d], ids[d:])):
                base = word * dims
                np.add.at(out.reshape(-1), base + places[0][around], 1)
                np.add.at(out.reshape(-1), base + places[1][around], -1)


def word_vectors(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = ROWS, dims: int = DIMS) -> np.ndarray:
    """Random indexing over all texts, (rows, dims): each task sums what its texts give, and Spark sums the tasks' tables by word row.

    The table's size is fixed, however many texts there are.
    """
    names = [f"c{k}" for k in range(dims)]

    def run(batches):
        places, sums = index_positions(rows, dims), np.zeros((rows, dims), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                context_sums(part.column("text").to_pylist(), places, sums)
        for start in range(0, rows, 2048):
            some = sums[start : start + 2048]
            at = np.nonzero(some.any(1))[0]
            yield pa.RecordBatch.from_arrays([pa.array(at + start, pa.int32()), *(pa.array(some[at, k]) for k in range(dims))], names=["row", *names])

    texts = whole_texts(df, id_col, text_col).select(F.col("text").cast("binary").alias("text"))
    sums = texts.mapInArrow(run, "row int, " + ", ".join(f"{n} long" for n in names)).groupBy("row").agg(*(F.sum(n).alias(n) for n in names))
    found = sums.toPandas()
    out = np.zeros((rows, dims))
    if len(found):
        out[found["row"].to_numpy()] = found[names].to_numpy()
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.maximum(norm, 1e-9)).astype(np.float32)


def inputs(dims: int = DIMS) -> int:
    return 3 * dims + 2


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Each text's words' vectors pooled: mean, spread, mean product of neighbours (large where words repeat), that product's sum, and the mean's length; zeros of a text without words."""
    dims = vectors.shape[1]
    out = np.zeros((len(texts), inputs(dims)), np.float32)
    for k, text in enumerate(texts):
        ids = token_ids(text, len(vectors))
        if len(ids):
            rows, times = np.unique(ids, return_counts=True)
            v, w = vectors[rows], (times / len(ids)).astype(np.float32)
            mean = w @ v
            pairs = np.zeros(dims, np.float64)
            for s in range(0, len(ids) - 1, 8192):
                part = vectors[ids[s : s + 8193]]
                pairs += np.einsum("ij,ij->j", part[:-1], part[1:])
            pairs /= max(1, len(ids) - 1)
            out[k] = np.concatenate([mean, np.sqrt(np.maximum(w @ (v * v) - mean * mean, 0)), pairs, [pairs.sum(), np.sqrt(mean @ mean)]])
    return out


@dataclass
class Network:
    """Two layers over standardised inputs; the logit is divided by a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def fit_network(x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, epochs: int = 60, seed: int = 3) -> Network:
    """Fit by Adam on four fifths of the rows, then the temperature on the rest by likelihood over a grid.

    With one label only, every score is that label's share (smoothed); with no rows it is one half.
    """
    n, d = x.shape
    rng = np.random.default_rng(seed)
    share = (y.sum() + 0.5) / (n + 1)
    flat = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(share / (1 - share))))
    if len(np.unique(y)) < 2:
        return flat
    order = rng.permutation(n)
    fit, rest = (order[n // 5 :], order[: n // 5]) if n >= 50 else (order, order)
    net = Network(x[fit].mean(0), x[fit].std(0) + 1e-3, rng.standard_normal((d, hidden)) / np.sqrt(d), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), flat.b2)
    z = (x[fit] - net.mean) / net.scale
    t = y[fit].astype(float)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 1e-4
        at = rng.permutation(len(z))
        for s in range(0, len(z), 128):
            zb, tb = z[at[s : s + 128]], t[at[s : s + 128]]
            grads = gradients(params, zb, tb)
            step += 1
            for p, g, a, b in zip(params, grads, m, v, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    logit, truth = net.logits(x[rest]), y[rest]
    grid = np.geomspace(0.5, 8, 41)
    loss = [np.logaddexp(0, np.where(truth == 1, -logit, logit) / k).mean() for k in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def gradients(params: list[np.ndarray], z: np.ndarray, t: np.ndarray, decay: float = 1e-4) -> list[np.ndarray]:
    """Of the mean cross-entropy and half of ``decay`` times the squared weights, by the weights and biases of both layers."""
    w1, b1, w2, b2 = params
    h = np.tanh(z @ w1 + b1)
    err = (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30))) - t) / len(t)
    back = np.outer(err, w2) * (1 - h * h)
    return [z.T @ back + decay * w1, back.sum(0), h.T @ err + decay * w2, np.array([err.sum()])]


def labelled_sample(labels: DataFrame, label_col: str, id_col: str = "doc_id", most: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of about ``most`` rows at most: those whose hashed id falls below a share, the same for all."""
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    share = most / max(1, rows.count())
    return rows if share >= 1 else rows.where(F.abs(F.xxhash64("doc_id") % 1_000_000) < int(share * 1_000_000))


def fit_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all texts, and a network learned from ``labels`` (a bounded sample of about ``most`` rows, so it is small enough to broadcast)."""
    vectors = word_vectors(df, id_col, text_col)
    shipped = df.sparkSession.sparkContext.broadcast(vectors)
    sample = F.broadcast(labelled_sample(labels, label_col, most=most))
    picked = whole_texts(df, id_col, text_col).join(sample, "doc_id").select("doc_id", "label", F.col("text").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                x = pooled(part.column("text").to_pylist(), shipped.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label").cast(pa.int32()), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "label", "x"])

    rows = picked.mapInArrow(run, "doc_id long, label int, x binary").toPandas().sort_values(["doc_id", "x"])
    x = np.stack([np.frombuffer(b, np.float32) for b in rows.x]) if len(rows) else np.zeros((0, inputs(vectors.shape[1])), np.float32)
    return vectors, fit_network(x.astype(np.float64), rows.label.to_numpy())


def score_quality(df: DataFrame, vectors: np.ndarray, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) for each row; a null or empty text has the score of no words."""
    shipped = df.sparkSession.sparkContext.broadcast((vectors, network))

    def make():
        v, net = shipped.value
        return lambda ids, texts: [ids, net.scores(pooled(texts, v))]

    return map_bytes(whole_texts(df, id_col, text_col), make, "doc_id long, score double", [pa.int64(), pa.float64()])


def keep_quality(df: DataFrame, vectors: np.ndarray, network: Network, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows, with all their columns, whose score is ``threshold`` or more; rows are judged where they lie, without a shuffle."""
    shipped = df.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        v, net = shipped.value
        for batch in batches:
            for part in slices(batch, text_col):
                texts = [(t or "").encode() for t in part.column(text_col).to_pylist()]
                yield part.filter(pa.array(net.scores(pooled(texts, v)) >= threshold))

    return df.mapInArrow(run, df.schema)


def training_labels(labels: DataFrame) -> DataFrame:
    return labels.where(~held_out("doc_id", 5, 0))


def op3_quality(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    vectors, network = fit_quality(docs, training_labels(labels))
    scored = score_quality(docs, vectors, network)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_quality": op3_quality}
ORACLES: dict[str, str] = {}
