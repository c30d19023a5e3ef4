"""A quality classifier on random-indexing word vectors.

Each word has a sparse random index vector, which follows from a hash of it. A word's vector is the sum of the index
vectors of its neighbours over a bounded sample of texts, normalised, and its own; a word that the sample doesn't have twice
gets the company of words of its shape that the sample has once. A document's words are pooled to the mean and the
deviation of their vectors and the length of the mean; a network of two layers, in numpy, gives a logit, and a
temperature found on rows that it isn't trained on makes it a probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_crc32, pick, small_batches

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
DIMENSIONS, NONZERO, WINDOW = 48, 6, 2
#: Texts for word vectors and their bytes, and labelled rows for the network, each at most about.
VECTOR_TEXTS, VECTOR_BYTES, LABELLED = 2500, 1 << 24, 12_000
HIDDEN, EPOCHS, BATCH, RATE = 24, 40, 128, 0.01
PREDICTED_FROM = 0.7

#: Shapes of words: for those that the sample doesn't have.
SHAPES = RARE, UPPER, SIGNS, DIGITS = range(4)


def shape(word: str) -> int:
    if word[0].isdigit():
        return DIGITS
    if not word[0].isalpha():
        return SIGNS
    return UPPER if len(word) > 1 and word.isupper() else RARE


def index_vectors(words: list[str]) -> np.ndarray:
    """NONZERO places of each vector are 1 or -1, by the bytes of the word's hash; a place that comes twice adds up."""
    hashes = np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words], dtype=np.uint64)
    out = np.zeros((len(words), DIMENSIONS), dtype=np.float32)
    every = np.arange(len(words))
    for k in range(NONZERO):
        part = (hashes >> np.uint64(10 * k)) & np.uint64(1023)
        out[every, (part >> np.uint64(1)) % np.uint64(DIMENSIONS)] += 1.0 - 2.0 * (part & np.uint64(1))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def word_vectors(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words that the texts have twice or more, their vectors, and the company of words of each shape that they have once."""
    cut = [TOKEN.findall(t or "") for t in texts]
    counts: dict[str, int] = {}
    for ws in cut:
        for w in ws:
            counts[w] = counts.get(w, 0) + 1
    words = sorted(counts)
    at = {w: i for i, w in enumerate(words)}
    own = index_vectors(words)
    context = np.zeros_like(own)
    for ws in cut:
        ids = np.array([at[w] for w in ws], dtype=np.int64)
        if len(ids) < 2:
            continue
        padded = np.concatenate([np.zeros((WINDOW, DIMENSIONS), np.float32), own[ids], np.zeros((WINDOW, DIMENSIONS), np.float32)])
        near = sum(padded[WINDOW + k : WINDOW + k + len(ids)] for k in range(-WINDOW, WINDOW + 1) if k)
        order = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.diff(ids[order], prepend=-1))
        context[ids[order][heads]] += np.add.reduceat(near[order], heads, axis=0)
    company = np.zeros((len(SHAPES), DIMENSIONS), dtype=np.float32)
    once = [i for i, w in enumerate(words) if counts[w] == 1]
    np.add.at(company, [shape(words[i]) for i in once], context[once])
    # A word is its company and, by less, itself; words of one kind of text end up near each other.
    more = [i for i, w in enumerate(words) if counts[w] > 1]
    return [words[i] for i in more], (_unit(context[more]) + 0.5 * _unit(own[more])).astype(np.float32), _unit(company).astype(np.float32)


@dataclass
class Vectors:
    words: list[str]
    vectors: np.ndarray
    company: np.ndarray

    def __post_init__(self) -> None:
        self.at = {w: i for i, w in enumerate(self.words)}

    def of_others(self, words: list[str]) -> np.ndarray:
        return self.company[[shape(w) for w in words]] + 0.5 * _unit(index_vectors(words))

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """For each text mean, deviation, length of the mean, and the logarithm of the number of words; all 0 without a word."""
        out, base, get = np.zeros((len(texts), 2 * DIMENSIONS + 2), dtype=np.float32), len(self.words), self.at.get
        others: dict[str, int] = {}
        cut = []
        for text in texts:
            words = TOKEN.findall(text) if text else []
            cut.append(np.fromiter((i if (i := get(w)) is not None else base + others.setdefault(w, len(others)) for w in words), np.int64, len(words)))
        extra = self.of_others(list(others)) if others else self.company[:0]
        for k, ids in enumerate(cut):
            if not len(ids):
                continue
            which, n = np.unique(ids, return_counts=True)
            known = int(np.searchsorted(which, base))
            x = np.concatenate([self.vectors[which[:known]], extra[which[known:] - base]])
            weight = (n / len(ids)).astype(np.float32)
            mean = weight @ x
            deviation = np.sqrt(np.maximum(weight @ (x * x) - mean * mean, 0))
            out[k] = np.concatenate([mean, deviation, [np.linalg.norm(mean), np.log1p(len(ids)) / 10]])
        return out


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.centre) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, seed: int = 1) -> Network:
    """Trained with Adam on four fifths of the rows; the temperature has the least log loss on the rest."""
    draw = np.random.default_rng(seed)
    x, y = x.astype(np.float64), y.astype(np.float64)
    rest = np.arange(len(x)) % 5 == 4
    own = ~rest
    centre, scale = x[own].mean(axis=0), x[own].std(axis=0) + 1e-3
    z = (x - centre) / scale
    params = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 0.3, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    at, step = np.flatnonzero(own), 0
    for epoch in range(EPOCHS):
        draw.shuffle(at)
        rate = RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(at), BATCH):
            a, t = z[at[i : i + BATCH]], y[at[i : i + BATCH]]
            h = np.tanh(a @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60))) - t) / len(t)
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [a.T @ back + 1e-4 * params[0], back.sum(axis=0), h.T @ error + 1e-4 * params[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                params[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, params[0], params[1], params[2], float(params[3][0]))
    if rest.any():
        logits = net.logits(x[rest])
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(y[rest] > 0.5, 1, -1) * logits / t)))
        net.temperature = min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)
    return net


@dataclass
class Model:
    vectors: Vectors
    network: Network | None
    constant: float  # the score if there is nothing to learn


def _pooled_rows(rows: DataFrame, sent) -> DataFrame:
    kinds = pa.schema([("quality", pa.int32()), ("x", pa.list_(pa.float32()))])

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(list(sent.value.pooled(batch.column("text").to_pylist())), kinds.types[1])], schema=kinds)

    return rows.select("quality", "text").mapInArrow(pool, "quality int, x array<float>")


def train(docs: DataFrame, labels: DataFrame, held_out=None, labelled: int = LABELLED, texts: int = VECTOR_TEXTS) -> Model:
    """A model from labels (doc_id, quality 0 or 1) of documents that aren't held out.

    About `labelled` rows at most, and `texts` texts of VECTOR_BYTES together of those, drawn by hashes of doc_id and
    text; so what comes to the driver and what is broadcast is bounded. Ids with both labels, null ids and null labels
    are left out; of ids that documents repeat, all rows may be drawn.
    With labels of one kind only, or none, every score is their mean (none: 0.5).
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    if held_out is not None:
        own = own.where(~held_out)
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other")
    n = own.count()
    draw = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_000))
    drawn = own.where(draw < F.lit(int(1_000_000 * min(1.0, labelled / max(n, 1)))))
    # Bounded by `labelled`: ids and labels of the sample are broadcast, so that no text is shuffled.
    rows = pick(docs, "doc_id", "text").join(F.broadcast(drawn.withColumnRenamed("doc_id", "d")), F.col("doc_id") == F.col("d"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    again = F.pmod(F.xxhash64(F.lit(10), "doc_id", "text", F.spark_partition_id()), F.lit(1_000_000))
    rows = rows.where(again < F.lit(int(1_000_000 * min(1.0, labelled / max(found["n"], 1)))))
    part = int(1_000_000 * min(1.0, texts / max(found["n"], 1), VECTOR_BYTES / max(found["bytes"], 1)))
    sample = sorted(r["text"] for r in rows.where((again < part) & F.col("text").isNotNull()).select("text").toLocalIterator())
    vectors = Vectors(*word_vectors(sample))
    sent = spark.sparkContext.broadcast(vectors)
    got = _pooled_rows(rows, sent).toArrow()
    y = got.column("quality").to_numpy()
    if len(set(y.tolist())) < 2:
        return Model(vectors, None, float(y.mean()) if len(y) else 0.5)
    x = np.array(got.column("x").to_pylist(), dtype=np.float32)
    order = np.lexsort((*x.T, y))  # not the order in which tasks ended
    return Model(vectors, train_network(x[order], y[order]), 0.5)


def score(docs: DataFrame, model: Model, predicted_from: float = PREDICTED_FROM) -> DataFrame:
    """doc_id, score, predicted of every row. Null texts are scored as empty ones. Repeated rows come out alike.

    An empty table gives no rows. Other columns of docs don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # the sample's words x DIMENSIONS numbers and a small network
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            if own.network is None:
                scores = np.full(batch.num_rows, own.constant)
            else:
                scores = own.network.scores(own.vectors.pooled(batch.column("text").to_pylist()).astype(np.float64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array((scores >= predicted_from).astype(np.int32))], schema=out)

    return pick(docs, "doc_id", "text").mapInArrow(predict, "doc_id bigint, score double, predicted int")


def held_out():
    return id_crc32(F.col("doc_id")) % 4 == 2
