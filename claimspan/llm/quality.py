"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network with calibrated probabilities.

Words are runs without white space. Each has a bucket, by a hash of its letters and digits in lower case, and a shape, by its case, its last
character, whether it lacks letters and whether it repeats the word before it. Buckets and shapes are the vocabulary. Every bucket has a fixed
random index vector with NONZERO entries of 1 or -1 in DIM; the vector of a bucket or shape is the sum of the index vectors of the words within WINDOW
words of it, over all documents, scaled to unit length. A document is the mean vector of its words' buckets, the mean vector of its shapes, and
the logarithm of its length.

The network (one hidden layer of HIDDEN rectified units, numpy, full-batch Adam) is fitted on at most MAX_TRAIN training
documents of each label (by hash of doc_id); a fifth of them stays out of the fit and sets the temperature by which scores are calibrated.

The vocabulary, and so what is broadcast or sent to the driver, has a fixed size. Word vectors cover all documents.

Defined cases: null or empty text is the zero vector, scored like any other; without labels of both kinds every score is the share of
label 1 (0.5 without labels); repeated rows score equally; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from . import words as W
from .common import materialise
from .toxicity import held_out, labelled, sampled

BUCKETS = 1 << 13
SHAPES = 1 << 9
SIZE = BUCKETS + SHAPES
DIM = 48
NONZERO = 4
WINDOW = 2
HIDDEN = 32
MAX_TRAIN = 10_000
STEPS = 400
RATE = 0.01
DECAY = 1e-4
SEED = 8
CHUNK = 1 << 20
THRESHOLD = 0.5
FEATURES = 2 * DIM + 1

#: What a byte is to the hash of a word: letters, digits and bytes of other scripts count, other signs don't.
_SOLID = np.zeros(256, bool)
_SOLID[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: The class of a word's last byte.
_LAST = np.zeros(256, np.int64)
for _k, _c in enumerate((b"a-z", b".", b",;:", b"!?", b"|", b"#", b"$", b"%", b"&*", b"0-9", b")]}>\"'")):
    for _b in range(_c[0], _c[2] + 1) if len(_c) == 3 and _c[1:2] == b"-" else _c:
        _LAST[_b] = _k + 1
_LAST[65:91] = 1
_LAST[128:] = 1

_rng = np.random.default_rng(SEED)
#: The index vectors: places and signs.
PLACE = np.argsort(_rng.random((BUCKETS, DIM)), axis=1)[:, :NONZERO]
SIGN = _rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def tokens(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and shape (from BUCKETS on) of every word."""
    n = len(w.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = lambda mask: np.add.reduceat(mask[w.start[0] :], w.start - w.start[0], dtype=np.int64)
    upper = total((w.buf >= 65) & (w.buf <= 90))
    lower = total(((w.buf >= 97) & (w.buf <= 122)) | (w.buf >= 128))
    letters = upper + lower
    case = np.where(letters == 0, 0, np.where(upper == 0, 1, np.where(lower == 0, 2 + (letters > 1), 4 + (upper > 1))))
    again = np.append(False, (w.hash[1:] == w.hash[:-1]) & (letters[1:] > 0))
    signs = np.minimum(w.end - w.start - letters, 3)
    shape = ((case * 12 + _LAST[w.buf[w.end - 1]]) * 2 + again) * 4 + signs
    return (w.hash % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape % SHAPES


def _chunks(column: pa.Array) -> Iterator[tuple[int, W.Words]]:
    return W.chunks(column, W.FOLD, size=CHUNK, solid=_SOLID)


def context_sums(texts: DataFrame) -> np.ndarray:
    """The sums of neighbours' index vectors for the whole vocabulary, over all documents: (SIZE, DIM)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(SIZE * DIM)
        for batch in batches:
            for _, w in _chunks(batch.column("text")):
                bucket, shape = tokens(w)
                doc = w.doc_of_word()
                for gap in range(1, WINDOW + 1):
                    at = np.flatnonzero(doc[gap:] == doc[:-gap]) if len(doc) > gap else np.zeros(0, np.int64)
                    for word, near in ((at, at + gap), (at + gap, at)):
                        place, sign = PLACE[bucket[near]], SIGN[bucket[near]]
                        for own in (bucket[word], shape[word]):
                            for k in range(NONZERO):
                                out += np.bincount(own * DIM + place[:, k], sign[:, k], SIZE * DIM)
        yield from vectors.emit(out, TaskContext.get().partitionId())

    return vectors.total(texts.select("text").mapInArrow(run, vectors.SCHEMA), SIZE * DIM).reshape(SIZE, DIM)


def word_vectors(texts: DataFrame) -> np.ndarray:
    sums = context_sums(texts)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return (sums / np.maximum(length, 1e-9)).astype(np.float32)


def pooled(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """The features of each text: (rows, FEATURES)."""
    out = np.zeros((len(column), FEATURES), np.float32)
    for base, w in _chunks(column):
        bucket, shape = tokens(w)
        n = np.diff(w.offset)
        some = np.flatnonzero(n)
        if len(some):
            # A document's sums run over its own words alone, so equal texts have equal features.
            for k, ids in enumerate((bucket, shape)):
                sums = np.add.reduceat(table[ids], w.offset[:-1][some], axis=0)
                out[base + some, k * DIM : (k + 1) * DIM] = sums / n[some][:, None]
            out[base + some, -1] = np.log1p(n[some]) / 10
    return out


class Network:
    """Two layers: rectified units and a logistic output."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-3
        x = (x - self.mean) / self.spread
        check = rng.random(len(x)) < 0.2
        if not (len(set(y[check])) == 2 and len(set(y[~check])) == 2):
            check = np.zeros(len(x), bool)
        xt, yt = x[~check], y[~check]
        self.p = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p]
        self.temperature = 1.0
        for step in range(1, STEPS + 1):
            z = xt @ self.p[0] + self.p[1]
            h = np.maximum(z, 0)
            d = (self._sigmoid(h @ self.p[2] + self.p[3]) - yt) / len(yt)
            dh = np.outer(d, self.p[2]) * (z > 0)
            grads = [xt.T @ dh + DECAY * self.p[0], dh.sum(0), h.T @ d + DECAY * self.p[2], np.array([d.sum()])]
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.p[i] = self.p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if check.any():
            logit, truth = self.logit(x[check], True), y[check]
            loss = lambda t: float(-np.log(np.maximum(np.where(truth == 1, self._sigmoid(logit / t), 1 - self._sigmoid(logit / t)), 1e-9)).mean())
            self.temperature = float(min(2.0 ** np.arange(-2, 5, 0.25), key=loss))

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))

    def logit(self, x: np.ndarray, scaled: bool = False) -> np.ndarray:
        if not scaled:
            x = (x - self.mean) / self.spread
        return np.maximum(x @ self.p[0] + self.p[1], 0) @ self.p[2] + self.p[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1, row by row alike whatever the batch."""
        return self._sigmoid(self.logit(x.astype(np.float64)) / self.temperature).round(9)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    table = spark.sparkContext.broadcast(word_vectors(texts))

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pooled(batch.column("text"), table.value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    made = materialise(texts.mapInArrow(pool, f"doc_id {dict(texts.dtypes)['doc_id']}, x binary"), "quality-vectors")
    train = sampled(made.withColumnRenamed("x", "text"), labelled(docs, labels, "quality"), "quality", MAX_TRAIN, MAX_TRAIN)
    rows = train.select("doc_id", "quality", "text").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    y = rows["quality"].to_numpy().astype(float)
    net = None
    if len(set(y)) == 2:
        net = Network(np.stack([np.frombuffer(b.as_buffer(), np.float32) for b in rows["text"]]).astype(np.float64), y)
    share = float(y.mean()) if len(y) else 0.5
    net_b = spark.sparkContext.broadcast(net)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([np.frombuffer(b.as_buffer(), np.float32) for b in batch.column("x")]) if len(batch) else np.zeros((0, FEATURES), np.float32)
            p = net_b.value.predict(x) if net_b.value else np.full(len(x), share)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p, pa.float64())], names=["doc_id", "score"])

    out = made.mapInArrow(score, f"doc_id {dict(texts.dtypes)['doc_id']}, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
