"""Quality classifier: a convolutional network over bytes, trained and applied with numpy.

A text's bytes are cut into overlapping chunks that cover all of it.  In a chunk, learned filters over eight embedded
bytes are taken every four bytes and max-pooled; the pooled values are averaged over the chunks and go through a hidden
layer, with the logarithm of the mean number of places in a chunk, into one probability.  Scoring reads every byte; only training uses a sample: at most ``MAX_TRAIN`` labelled
documents (the first ones by a hash of their id), ``TRAIN_CHUNKS`` chunks of each, drawn by hash in the tasks.

Defined results: a null or empty text is one chunk of padding, and has that chunk's score.  Without any labelled
document, or with one class only, the network keeps its first weights and a bias that follows the labels, so scores stay
between 0 and 1.  Repeated rows get the same score.  An empty table gives an empty result.  Other columns are not read,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import slices

CHUNK, STEP = 512, 448
#: Bytes from one place of the filters to the next; a filter spans two such steps.
STRIDE = 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Bounds of the training sample.
MAX_TRAIN, TRAIN_CHUNKS = 8000, 6
TRAIN_STEPS, BATCH, RATE, DECAY = 600, 96, 4e-3, 1e-3
#: Share of a batch's documents of which only a short piece is shown, of SHORT places at most.
CROP, SHORT = 0.3, 24
ACCEPT = 0.7

Weights = dict[str, np.ndarray]


def chunks(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of the chunks, places of each that the filters may take, number of chunks of each text)."""
    raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    counts = np.array([max(1, -(-(len(r) - (CHUNK - STEP)) // STEP)) for r in raw], dtype=np.int64)
    out, places, k = np.zeros((int(counts.sum()), CHUNK), np.uint8), np.empty(int(counts.sum()), np.int64), 0
    for r, n in zip(raw, counts.tolist(), strict=True):
        data = np.frombuffer(r, np.uint8)
        for i in range(n):
            part = data[i * STEP : i * STEP + CHUNK]
            out[k, : len(part)] = part
            places[k] = min(max(1, -(-len(part) // STRIDE) - 1), CHUNK // STRIDE - 1)
            k += 1
    return out, places, counts


def new_weights(seed: int = 7) -> Weights:
    rng = np.random.default_rng(seed)
    f = STRIDE * EMBED
    normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    return {
        "embed": normal(256, EMBED, scale=0.5), "left": normal(f, FILTERS, scale=f**-0.5), "right": normal(f, FILTERS, scale=f**-0.5),
        "bias": np.zeros(FILTERS, np.float32), "w1": normal(FILTERS + 1, HIDDEN, scale=FILTERS**-0.5), "b1": np.zeros(HIDDEN, np.float32),
        "w2": normal(HIDDEN, scale=HIDDEN**-0.5), "b2": np.zeros(1, np.float32),
    }


def pooled(w: Weights, data: np.ndarray, places: np.ndarray, train: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(max-pooled filters of each chunk, the place of each maximum, the embedded steps)."""
    n, steps = len(data), CHUNK // STRIDE
    x = w["embed"][data].reshape(n * steps, STRIDE * EMBED)
    left, right = (x @ w["left"]).reshape(n, steps, FILTERS), (x @ w["right"]).reshape(n, steps, FILTERS)
    z = left[:, :-1] + right[:, 1:]
    for i in np.flatnonzero(places < steps - 1):
        z[i, places[i] :] = -np.inf
    best = z.argmax(axis=1) if train else None
    top = z.max(axis=1) + w["bias"]
    return np.maximum(top, 0), best, x


def head(w: Weights, mean: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, probability) from the mean of the pooled filters and the mean number of places."""
    mean = np.hstack([mean, np.log2(places)[:, None] / 7]).astype(np.float32)
    h = np.maximum(mean @ w["w1"] + w["b1"], 0)
    return h, 1 / (1 + np.exp(-np.clip(h @ w["w2"] + w["b2"], -30, 30)))


def gradients(w: Weights, data: np.ndarray, places: np.ndarray, owner: np.ndarray, labels: np.ndarray) -> tuple[float, Weights]:
    """The mean log loss of texts, and its gradient by each weight; ``owner`` says which text each chunk is of."""
    size = len(labels)
    n = np.bincount(owner, minlength=size)[:, None].astype(np.float32)
    p, best, x = pooled(w, data, places, train=True)
    mean = np.zeros((size, FILTERS), np.float32)
    np.add.at(mean, owner, p)
    mean /= n
    length = np.bincount(owner, places, size) / n[:, 0]
    h, y = head(w, mean, length)
    g: Weights = {}
    dy = ((y - labels) / size).astype(np.float32)
    g["w2"], g["b2"] = h.T @ dy, np.array([dy.sum()], np.float32)
    dh = np.outer(dy, w["w2"]) * (h > 0)
    full = np.hstack([mean, (np.log2(length)[:, None] / 7).astype(np.float32)])
    g["w1"], g["b1"] = full.T @ dh, dh.sum(axis=0)
    dp = ((dh @ w["w1"][:FILTERS].T) / n)[owner] * (p > 0)
    g["bias"] = dp.sum(axis=0)
    # Only the place of each maximum gets a gradient.
    at = (np.arange(len(data)) * (CHUNK // STRIDE))[:, None] + best
    dx = np.zeros_like(x)
    for side, place in (("left", at), ("right", at + 1)):
        g[side] = np.einsum("cfe,cf->ef", x[place], dp)
        np.add.at(dx, place, dp[:, :, None] * w[side].T[None])
    g["embed"] = np.zeros_like(w["embed"])
    used = np.flatnonzero(dx.any(axis=1))
    np.add.at(g["embed"], data.reshape(-1, STRIDE)[used], dx[used].reshape(-1, STRIDE, EMBED))
    # In the logit, which doesn't saturate.
    z = np.clip(h @ w["w2"] + w["b2"], -30, 30)
    return float(np.mean(np.logaddexp(0, z) - labels * z)), g


def fit(texts: list[list[bytes]], labels: np.ndarray) -> Weights:
    """Weights from texts, each given as its chunks, by Adam on the log loss."""
    w, rng = new_weights(), np.random.default_rng(11)
    share = (labels.sum() + 1) / (len(labels) + 2)
    w["b2"][0] = np.log(share / (1 - share))
    if len(labels) == 0 or labels.min() == labels.max():
        return w
    m, v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))
    data = np.zeros((sum(map(len, texts)), CHUNK), np.uint8)
    flat = [c for t in texts for c in t]
    for i, c in enumerate(flat):
        data[i, : len(c)] = np.frombuffer(c, np.uint8)
    places = np.array([min(max(1, -(-len(c) // STRIDE) - 1), CHUNK // STRIDE - 1) for c in flat])
    counts = np.array([len(t) for t in texts])
    first = np.cumsum(counts) - counts
    for t in range(1, TRAIN_STEPS + 1):
        pick = rng.integers(0, len(texts), BATCH)
        rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in pick])
        owner = np.repeat(np.arange(BATCH), counts[pick])
        d = data[rows]
        seen = places[rows]
        # Short pieces of longer documents teach that a short document isn't a poor one.
        cropped = np.flatnonzero(rng.random(BATCH) < CROP)
        one = np.cumsum(counts[pick])[cropped] - rng.integers(1, counts[pick][cropped] + 1)
        alone = np.ones(len(rows), bool)
        alone[np.isin(owner, cropped)] = False
        alone[one] = True
        seen[one] = np.minimum(seen[one], rng.integers(1, SHORT + 1, len(one)))
        d, owner, seen = d[alone], owner[alone], seen[alone]
        _, g = gradients(w, d, seen, owner, labels[pick])
        rate = RATE * min(1.0, 2 * (1 - t / (TRAIN_STEPS + 1)))
        for k, grad in g.items():
            m[k] = 0.9 * m[k] + 0.1 * grad
            v[k] = 0.999 * v[k] + 0.001 * grad**2
            w[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8) + rate * DECAY * w[k]).astype(np.float32)
    return w


def fold_free(id_col: Column) -> Column:
    """True for the ids that training may use: those whose crc32 of the id as text isn't 2 modulo 4."""
    return F.crc32(id_col.cast("string").cast("binary")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Weights:
    """Weights from the labelled documents that ``fold_free`` allows."""
    marks = labels.where(F.col(label_col).isin(0, 1) & fold_free(F.col(id_col)))
    marks = marks.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    marks = marks.orderBy(F.xxhash64("id"), "id", "y").limit(MAX_TRAIN)
    part, n = F.col("part"), F.greatest(F.lit(1), F.ceil((F.length("raw") - (CHUNK - STEP)) / STEP)).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.encode(F.coalesce(text_col, F.lit("")), "UTF-8").alias("raw"))
    # MAX_TRAIN rows at most are broadcast, and as many times TRAIN_CHUNKS chunks come back: an id counts once, with the
    # first of its texts and labels by hash.
    rows = rows.join(F.broadcast(marks), "id").withColumn("n", n)
    order = F.sort_array(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.xxhash64("id", k).alias("h"), k.alias("k"))))
    rows = rows.withColumn("part", F.transform(F.slice(order, 1, TRAIN_CHUNKS), lambda x: x["k"]))
    picked = F.transform(part, lambda k: F.substring(F.col("raw"), k * STEP + 1, F.lit(CHUNK)))
    one = F.min(F.struct(F.xxhash64("raw").alias("h"), "y", picked.alias("chunks"))).alias("one")
    got = rows.groupBy("id").agg(one).select("id", "one.y", "one.chunks").orderBy("id").toArrow()
    texts = [[bytes(c) for c in x] for x in got["chunks"].to_pylist()]
    return fit(texts, np.array(got["y"].to_pylist(), dtype=np.float32))


def score_texts(w: Weights, texts: list[str | None]) -> np.ndarray:
    data, places, counts = chunks(texts)
    sums = np.zeros((len(texts), FILTERS), np.float64)
    owner = np.repeat(np.arange(len(texts)), counts)
    for lo in range(0, len(data), 1000):
        p, _, _ = pooled(w, data[lo : lo + 1000], places[lo : lo + 1000])
        np.add.at(sums, owner[lo : lo + 1000], p)
    return head(w, (sums / counts[:, None]).astype(np.float32), np.bincount(owner, places, len(texts)) / counts)[1].astype(np.float64)


def score(docs: DataFrame, w: Weights, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.columns[1], 4_000_000):
                yield pa.record_batch([batch.columns[0].slice(lo, hi - lo), pa.array(score_texts(w, texts))], names=["id", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, w: Weights, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores ``ACCEPT`` or more, with all their columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.concatenate([np.empty(0), *[score_texts(w, texts) for _, _, texts in slices(batch.columns[at], 4_000_000)]]) >= ACCEPT
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
