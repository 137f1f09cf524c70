"""Quality classifier: random-indexing word vectors pooled per document, then a small calibrated network."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import staged
from tessella.llm.wordhash import slices, tokens

#: Words are hashed to so many rows of the context matrix, of so many columns: 1 MB in all, for any corpus.
WORDS, DIM = 1 << 13, 32
#: Entries of a word's index vector that are not 0, and how far the context reaches to either side.
ENTRIES, REACH = 4, 2
#: Labelled documents that the network is fitted on, at most: those whose id hashes lowest.
SAMPLE = 20_000
HIDDEN, EPOCHS, SEED = 32, 300, 11
_CHUNK = 1 << 15

_rng = np.random.default_rng(4099)
_PLACE = np.stack([_rng.permutation(DIM)[:ENTRIES] for _ in range(WORDS)])
_SIGN = _rng.choice([-1.0, 1.0], (WORDS, ENTRIES))


def index_vectors() -> np.ndarray:
    """The sparse random vector of each word."""
    out = np.zeros((WORDS, DIM))
    np.put_along_axis(out, _PLACE, _SIGN, 1)
    return out


def _texts(column: pa.Array) -> list[bytes]:
    return [(x or "").encode("utf-8", "surrogatepass") for x in column.to_pylist()]


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, n = tokens(texts)
    return (h >> np.uint64(64 - 13)).astype(np.int64), n


def _contexts(batches):
    """This task's part of the context matrix, in chunks, with the words' counts in the last column."""
    total = np.zeros(WORDS * (DIM + 1))
    for whole in batches:
        for batch in slices(whole):
            w, n = _words(_texts(batch.column(1)))
            doc = np.repeat(np.arange(len(n)), n)
            total[WORDS * DIM :] += np.bincount(w, minlength=WORDS)
            for d in range(1, REACH + 1):
                near = doc[d:] == doc[:-d]
                a, b = w[:-d][near], w[d:][near]
                for x, y in ((a, b), (b, a)):  # y stands near x
                    for k in range(ENTRIES):
                        total[: WORDS * DIM] += np.bincount(x * DIM + _PLACE[y, k], _SIGN[y, k], WORDS * DIM)
    part = [k for k in range(-(-len(total) // _CHUNK)) if total[k * _CHUNK : (k + 1) * _CHUNK].any()]
    yield pa.record_batch([pa.array(part, pa.int32()), pa.array([total[k * _CHUNK : (k + 1) * _CHUNK].tobytes() for k in part], pa.binary())], names=["chunk", "part"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Random-indexing vectors from the contexts of all words of all texts, weighted down by frequency.

    ``docs`` has the columns id and text. Each word hash has its normalised context vector and its own
    index vector side by side; the last column is the word's weight.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "part": [sum(np.frombuffer(x) for x in pdf["part"]).tobytes()]})

    total = np.zeros(WORDS * (DIM + 1))
    for row in docs.mapInArrow(_contexts, "chunk int, part binary").groupBy("chunk").applyInPandas(add, "chunk int, part binary").collect():  # 2 MB in all
        total[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = np.frombuffer(row.part)
    context, count = total[: WORDS * DIM].reshape(WORDS, DIM), total[WORDS * DIM :]
    context = context / np.maximum(1e-9, np.linalg.norm(context, axis=1, keepdims=True))
    weight = 1e-2 / (1e-2 + count / max(1, count.sum()))
    return np.concatenate((context, index_vectors() / np.sqrt(ENTRIES), weight[:, None]), 1)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """The weighted mean of each text's word vectors, and a last column that is 1 where there are words."""
    w, n = _words(texts)
    doc = np.repeat(np.arange(len(texts)), n)
    weight = vectors[w, -1]
    total = np.maximum(1e-12, np.bincount(doc, weight, len(texts)))
    # A document is its row of word counts times the matrix; counted by distinct word to keep rows few.
    key, count = np.unique(doc * WORDS + w, return_counts=True)
    d, u = key // WORDS, key % WORDS
    out = np.zeros((len(texts), 2 * DIM + 1))
    scaled = count * vectors[u, -1]
    for k in range(2 * DIM):
        out[:, k] = np.bincount(d, scaled * vectors[u, k], len(texts)) / total
    out[:, -1] = n > 0
    return out


class Network:
    """Two layers; the scores' temperature is set on the part of the rows held back from fitting."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(2 * DIM + 1), np.ones(2 * DIM + 1))
        self.p = [rng.standard_normal((x.shape[1] if len(x) else 2 * DIM + 1, HIDDEN)) * 0.1, np.zeros(HIDDEN), rng.standard_normal(HIDDEN) * 0.1, np.zeros(1)]
        self.temperature = 1.0
        if len(set(y)) < 2:  # nothing to tell apart: the score is the share of label 1, smoothed
            share = (y.sum() + 1) / (len(y) + 2)
            self.p[2] *= 0
            self.p[3] += np.log(share / (1 - share))
            return
        held = rng.random(len(y)) < 0.2
        if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
            held[:] = False
        self._fit((x[~held] - self.mean) / self.scale, y[~held])
        own = held if held.any() else ~held
        z, t = self.logits(x[own]), y[own]
        grid = np.exp(np.linspace(-2, 3, 101))
        loss = [np.logaddexp(0, np.where(t == 1, -z, z) / g).mean() for g in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        m, v = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        for step in range(1, EPOCHS + 1):
            h = np.tanh(x @ self.p[0] + self.p[1])
            g = (1 / (1 + np.exp(-(h @ self.p[2] + self.p[3]))) - y) / len(y)
            back = np.outer(g, self.p[2]) * (1 - h * h)
            grads = [x.T @ back + 1e-4 * self.p[0], back.sum(0), h.T @ g + 1e-4 * self.p[2], g.sum(keepdims=True)]
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                self.p[k] = self.p[k] - 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-9)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def is_held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pooled(vectors):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                x = pool(_texts(batch.column(1)), vectors.value)
                yield pa.record_batch([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    return run


def _scored(model):
    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                vectors, net = model.value
                yield pa.record_batch([*batch.columns[:1], *batch.columns[2:], pa.array(net.scores(pool(_texts(batch.column(1)), vectors)))], names=[batch.schema.names[0], *batch.schema.names[2:], "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors of all of ``docs(doc_id, text)``, and the network fitted on labelled rows not held out."""
    spark = docs.sparkSession
    vectors = word_vectors(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("doc_id is not null and quality in (0, 1)").where(~is_held_out("doc_id")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = docs.join(F.broadcast(known), "doc_id").select("doc_id", "text", "quality")  # at most ``sample`` ids
    shared = spark.sparkContext.broadcast(vectors)
    rows = chosen.select(F.struct("doc_id", "quality").alias("at"), "text").mapInArrow(_pooled(shared), "doc_id struct<doc_id:long,quality:int>, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id.doc_id, r.x))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), 2 * DIM + 1)
    return vectors, Network(x, np.array([r.doc_id.quality for r in rows], float))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    ``labels(doc_id, quality)`` are learned from where crc32 of the id as text, mod 4, is not 2; a
    document with both labels counts as 0. The fit takes ``sample`` labelled documents at most; the word
    vectors come from all texts. ``score`` is the calibrated chance of label 1, and ``predicted`` is 1
    from ``threshold`` on. Null and empty texts are scored like a document without words; without
    two labels to tell apart all scores are the smoothed share of label 1. A null id is not held out.
    Repeated ids are scored each; an empty table gives no rows; other columns are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    out = docs.mapInArrow(_scored(model), "doc_id long, score double")
    return out.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that ``quality`` predicts as 1, each judged by its own text, whatever its id."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(own, labels, sample))
    at = docs.columns.index(text_col)

    def run(batches):
        vectors, net = model.value
        for whole in batches:
            for batch in slices(whole, at):
                yield batch.filter(pa.array(net.scores(pool(_texts(batch.column(at)), vectors)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
