"""Quality scores: random-indexing word vectors, pooled, and a small calibrated network.

1. Every token (run of letters, digits or marks; capitals make another token)
   hashes to one of ``BUCKETS``; each bucket has a fixed sparse random index
   vector. One pass over the whole corpus adds, for every token, the index
   vectors of its neighbours to its bucket: the context vectors. Tasks add up
   their part first; what meets afterwards is one row per bucket and task.
2. A document is the weighted mean of its tokens' unit vectors, the mean of the
   products of adjacent ones (repetition shows there) and its log length.
3. A two-layer network is fitted in numpy on the driver, on at most
   ``TRAIN_ROWS`` labelled rows (a documented bound, drawn by hash of the id);
   a fifth of them is set aside to choose the temperature of the probabilities.

The table of vectors has a fixed size (BUCKETS x DIMS), so what is collected and
broadcast does not grow with the corpus.

Defined cases: null text scores as an empty one (all-zero pool). Without labels, or with labels of
one class, the score is the smoothed share of that class for every text. Several labels for
one id count as the smallest; null labels are left out. Repeated rows get equal
scores. An empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_checked, stored, text_of
from .words import byte_chunks, lower_ascii, segment_hashes

BUCKETS = 1 << 13
DIMS = 32
NONZERO = 4
WINDOW = 2
TRAIN_ROWS = 20_000
HIDDEN = 32
THRESHOLD = 0.7
#: Text bytes whose token vectors a worker holds at once (about 20 times as much memory).
RUN_BYTES = 1 << 18

_KIND = np.full(256, 3, np.uint8)  # marks
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_KIND[128:] = 1


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(columns, signs) of the ``NONZERO`` entries of every bucket's index vector."""
    rng = np.random.default_rng(seed)
    columns = rng.permuted(np.tile(np.arange(DIMS), (BUCKETS, 1)), axis=1)[:, :NONZERO]
    signs = np.tile(np.array([1, -1] * (NONZERO // 2)), (BUCKETS, 1))
    return columns.astype(np.int64), signs.astype(np.float64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every token, first token of every text and the total)."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    kind = _KIND[data]
    edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
    starts = np.concatenate([[0], edge])
    ends = np.concatenate([edge, [len(data)]])
    real = kind[starts] != 0
    starts, ends = starts[real], ends[real]
    hashes = segment_hashes(lower_ascii(data), starts, ends)
    upper = (data >= 65) & (data <= 90)
    shout = upper[starts] & upper[ends - 1] & (ends - starts > 1)
    hashes = np.where(shout, ~hashes, hashes)
    begins = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    return (hashes % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, begins)


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMS)
    count = np.zeros(BUCKETS)
    for batch in batches:
        for _, run in byte_chunks(batch["text"], RUN_BYTES):
            ids, first = tokens(run)
            text_no = np.repeat(np.arange(len(run)), np.diff(first))
            count += np.bincount(ids, minlength=BUCKETS)
            for step in range(1, WINDOW + 1):
                near = text_no[step:] == text_no[:-step]
                left, right = ids[:-step][near], ids[step:][near]
                for here, there in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        total += np.bincount(
                            here * DIMS + columns[there, k], weights=signs[there, k], minlength=BUCKETS * DIMS
                        )
    seen = np.flatnonzero(count)
    frame = pd.DataFrame(total.reshape(BUCKETS, DIMS)[seen].astype(np.int64), columns=[f"c{i}" for i in range(DIMS)])
    frame.insert(0, "n", count[seen].astype(np.int64))
    frame.insert(0, "bucket", seen.astype(np.int32))
    yield frame


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Weighted unit context vectors of all buckets, from every text of ``docs``."""
    names = ["n", *[f"c{i}" for i in range(DIMS)]]
    parts = docs.select(text_of("text").alias("text")).mapInPandas(
        _contexts, "bucket int, " + ", ".join(f"{c} long" for c in names)
    )
    rows = parts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in names]).toPandas()  # BUCKETS rows at most
    vectors = np.zeros((BUCKETS, DIMS))
    count = np.zeros(BUCKETS)
    if len(rows):
        at = rows["bucket"].to_numpy()
        vectors[at] = rows[names[1:]].to_numpy()
        count[at] = rows["n"].to_numpy()
    share = count / max(1.0, count.sum())
    vectors -= share[:, None] * vectors.sum(axis=0)  # what every token has in common says nothing
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    return (vectors * (1e-3 / (1e-3 + share))[:, None] ** 0.5).astype(np.float32)


def pool(vectors: np.ndarray, texts: Iterator[str | None]) -> np.ndarray:
    """One row per text: mean vector, mean product of adjacent vectors, log length."""
    out = []
    for _, run in byte_chunks(texts, RUN_BYTES):
        ids, first = tokens(run)
        n = np.diff(first)
        pooled = np.zeros((len(run), 2 * DIMS + 1), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            own = vectors[ids]
            pooled[full, :DIMS] = np.add.reduceat(own, first[full], axis=0) / n[full, None]
            product = own.copy()
            product[:-1] *= own[1:]
            product[first[full] + n[full] - 1] = 0  # the last token has no next one
            pooled[full, DIMS:-1] = np.add.reduceat(product, first[full], axis=0) / np.maximum(1, n[full, None] - 1)
            pooled[full, -1] = np.log1p(n[full])
        out.append(pooled)
    return np.concatenate(out) if out else np.zeros((0, 2 * DIMS + 1), np.float32)


@dataclass
class Network:
    """Standardised inputs, one tanh layer, one logistic output, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 3, epochs: int = 40) -> Network:
    """Adam on cross-entropy; every fifth row only chooses the temperature."""
    width = x.shape[1]
    if len(y) < 10 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1),
                       float(np.log(share / (1 - share))))
    aside = np.arange(len(y)) % 5 == 4
    rng = np.random.default_rng(seed)
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, width ** -0.5, (width, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, HIDDEN ** -0.5, HIDDEN), 0.0)
    z, target = ((x - net.mean) / net.scale)[~aside], y[~aside]
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (net.w1, net.b1, net.w2, np.zeros(1))]
    bias, step = np.zeros(1), 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        order = rng.permutation(len(target))
        for a in range(0, len(order), 128):
            rows = order[a:a + 128]
            hidden = np.tanh(z[rows] @ net.w1 + net.b1)
            miss = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + bias, -60, 60))) - target[rows]) / len(rows)
            back = np.outer(miss, net.w2) * (1 - hidden ** 2)
            step += 1
            grads = (z[rows].T @ back + 1e-4 * net.w1, back.sum(0), hidden.T @ miss + 1e-4 * net.w2, miss.sum(keepdims=True))
            for p, g, m in zip((net.w1, net.b1, net.w2, bias), grads, moments):
                m[0] += 0.1 * (g - m[0])
                m[1] += 0.001 * (g * g - m[1])
                p -= rate * (m[0] / (1 - 0.9 ** step)) / (np.sqrt(m[1] / (1 - 0.999 ** step)) + 1e-8)
    net.b2 = float(bias[0])
    logits, truth = net.logits(x[aside]), y[aside]

    def loss(t: float) -> float:
        return float(np.mean(np.logaddexp(0, logits / t) - truth * logits / t))

    net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss)) if len(truth) else 1.0
    return net


class QualityModel:
    """Vectors and network; ``score`` adds a probability to any documents."""

    def __init__(self, spark, vectors: np.ndarray, network: Network):
        self.shared = spark.sparkContext.broadcast((vectors, network))  # about 1 MB, by BUCKETS and DIMS

    def score(self, text: Column) -> Column:
        shared = self.shared

        @F.pandas_udf("double")
        def scores(texts: pd.Series) -> pd.Series:
            vectors, network = shared.value
            return pd.Series(network.probabilities(pool(vectors, texts)).astype(float))

        return scores.asNondeterministic()(text_of(text))


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Vectors from all of ``docs``; the network from labelled rows that are not held out."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("_y"))
    chosen = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows).select(
        F.col("doc_id").alias("_id"), "_y"
    ), "train")
    shared = spark.sparkContext.broadcast(vectors)

    @F.pandas_udf("array<float>")
    def features(texts: pd.Series) -> pd.Series:
        return pd.Series(list(pool(shared.value, texts)))

    texts = docs.select(F.col("doc_id").alias("_doc"), text_of("text").alias("text"))
    rows = join_checked(texts, chosen, F.col("_doc") == F.col("_id"), "inner")
    sample = rows.select("_doc", "_y", features("text").alias("x")).toPandas().drop_duplicates("_doc")
    sample = sample.iloc[np.argsort(pd.util.hash_array(sample["_doc"].to_numpy(np.int64)), kind="stable")]
    x = np.stack(sample["x"].tolist()).astype(float) if len(sample) else np.zeros((0, 2 * DIMS + 1))
    return QualityModel(spark, vectors, fit_network(x, sample["_y"].to_numpy(float)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    model = fit(docs, labels)
    rows = docs.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"),
                       model.score(F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose predicted label is 1, columns unchanged."""
    names = docs.columns
    spare = next(f"_score{i}" for i in range(len(names) + 1) if f"_score{i}" not in names)
    model = fit(docs, labels)
    return docs.withColumn(spare, model.score(docs["text"])).where(F.col(spare) >= THRESHOLD).select(*names)
