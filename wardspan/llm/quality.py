"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are counts of: trigrams of its shape (letters, capitals, digits, white space and each other sign, runs of one
class squeezed), trigrams of its bytes hashed to buckets, and words equal or unlike the word before. Weighted by frequency and
inverse document frequency, each kind of terms scaled to length one, they are projected onto the leading singular vectors of
the labelled sample. All documents' cosines with all labelled vectors are computed exactly, a block of documents at a time; the
``NEIGHBOURS`` nearest vote with their labels, weighted by similarity and by how much rarer their class is in the sample than
in the labels.

The sample is the ``SAMPLE`` labelled rows of either class with the smallest hash of their id, from the rows that aren't held
out; projection and vectors thus have a fixed size (about 2 MB), and that is all that is broadcast. Everything else covers all
documents. Labels, lang, source and doc_id are no inputs of a score.

A null or empty text has no terms; it gets the share of label 1 among the labels, 0.5 at most, so nothing of no content is
predicted good. Without labels of both classes the score of other texts is that share, or 0.5 without labels. Null labels are left out; of labels that repeat an id the smallest counts. A null id is
held out by the hash of the empty text. Equally near neighbours vote in the order of the sample. Texts are read whole; a long
one takes memory of some thirty times its size in its worker. Repeated rows count each. Other columns pass through
:func:`classify`, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, free_name, map_arrow, small_batches, table

#: Labelled rows of each class that are sampled, neighbours that vote, dimensions of the vectors.
SAMPLE, NEIGHBOURS, DIMS = 2000, 25, 48
#: Buckets of shape trigrams and of byte trigrams.
SHAPES, TRIGRAMS = 1024, 1024
TERMS = SHAPES + TRIGRAMS + 2
KINDS = (slice(0, SHAPES), slice(SHAPES, SHAPES + TRIGRAMS), slice(SHAPES + TRIGRAMS, TERMS))
#: Length of each kind of terms in a document's vector.
WEIGHTS = (1.0, 0.4, 1.0)
THRESHOLD = 0.7
#: Similarities are raised to this power before they weigh votes.
SHARPNESS = 8
#: Bytes of texts whose terms are counted at once.
BLOCK_BYTES = 4 << 20


def _classes() -> np.ndarray:
    """Letters and all bytes above ASCII 1, capitals 2, digits 3, white space 4, other signs from 5 on."""
    out = np.zeros(256, np.uint32)
    for b in range(256):
        c = chr(b)
        out[b] = 1 if b > 127 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c in " \t\n\v\f\r" else 5 + b
    return out


CLASSES = _classes()


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
    return (x ^ (x >> np.uint32(13))) % np.uint32(n)


def _count(codes: np.ndarray, rows: np.ndarray, n_rows: int, buckets: int) -> np.ndarray:
    """Of the trigrams of codes that lie within one row."""
    if len(codes) < 3:
        return np.zeros((n_rows, buckets), np.float32)
    tri = (codes[:-2] * np.uint32(263) + codes[1:-1]) * np.uint32(263) + codes[2:]
    own = rows[2:] == rows[:-2]
    at = rows[2:][own] * buckets + _bucket(tri[own], buckets)
    return np.bincount(at, minlength=n_rows * buckets).reshape(n_rows, buckets).astype(np.float32)


def _terms(texts: list[bytes]) -> np.ndarray:
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    rows = np.repeat(np.arange(n, dtype=np.int64), [len(t) for t in texts])
    out = np.zeros((n, TERMS), np.float32)
    out[:, KINDS[1]] = _count(data.astype(np.uint32), rows, n, TRIGRAMS)
    shape = CLASSES[data]
    if len(shape):
        fresh = np.append(True, (shape[1:] != shape[:-1]) | (rows[1:] != rows[:-1]) | (shape[1:] > 4))
        out[:, KINDS[0]] = _count(shape[fresh], rows[fresh], n, SHAPES)
    for i, t in enumerate(texts):
        words = t.split()
        again = sum(map(operator.eq, words, words[1:]))
        out[i, -2:] = again, len(words) - again
    return out


def terms(texts: list[bytes]) -> np.ndarray:
    """Counts of terms, a row per text."""
    out, block, size = [], [], 0
    for t in texts:
        if block and size + len(t) > BLOCK_BYTES:
            out.append(_terms(block))
            block, size = [], 0
        block.append(t)
        size += len(t)
    return np.concatenate([*out, _terms(block)])


class Model:
    def __init__(self, counts: np.ndarray, labels: np.ndarray, share: float):
        """share: of label 1 among all labels that may be learnt from."""
        self.share, self.usable = share, len(set(labels.tolist())) == 2
        if not self.usable:
            return
        self.idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
        x = self.weigh(counts)
        rng = np.random.default_rng(5)
        basis = x.T @ rng.standard_normal((len(x), DIMS + 16)).astype(np.float32)
        for _ in range(4):
            basis, _ = np.linalg.qr(x.T @ (x @ np.linalg.qr(basis)[0]))
        _, _, right = np.linalg.svd(x @ basis, full_matrices=False)
        self.project = (basis @ right[:DIMS].T).astype(np.float32)
        self.vectors = self.unit(x @ self.project).T.copy()
        self.labels = labels.astype(np.float32)
        ones = labels.mean()
        self.votes = np.where(labels == 1, share / ones, (1 - share) / (1 - ones)).astype(np.float32)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts)
        x[:, KINDS[2]] = counts[:, KINDS[2]]
        x *= self.idf
        for kind, weight in zip(KINDS, WEIGHTS, strict=True):
            x[:, kind] *= weight / np.maximum(np.linalg.norm(x[:, kind], axis=1, keepdims=True), 1e-9)
        return x

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not self.usable:
            return np.full(len(counts), self.share)
        out = np.empty(len(counts))
        for i in range(0, len(counts), 512):
            cosines = self.unit(self.weigh(counts[i : i + 512]) @ self.project) @ self.vectors
            k = min(NEIGHBOURS, cosines.shape[1])
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cosines, near, axis=1), 1e-6) ** SHARPNESS * self.votes[near]
            out[i : i + 512] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        out[counts.sum(axis=1) == 0] = min(self.share, 0.5)  # nothing speaks for it
        return np.clip(out, 0.0, 1.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts = terms(b.column("text").to_pylist()) if b.num_rows else np.empty((0, TERMS), np.float32)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array([x.tobytes() for x in counts], pa.binary())], ["doc_id", "label", "counts"])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    for b in batches:
        score = model.value.score(terms(b.column("text").to_pylist())) if b.num_rows else np.empty(0)
        yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(score, pa.float64())], ["_row", "score"])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """docs: doc_id, text; labels: doc_id and the label, 0 or 1."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    n, ones = known.agg(F.count(F.lit(1)), F.sum("label")).first()
    share = ones / n if n else 0.5
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.filter("label = 0").orderBy(*order).limit(sample).unionByName(known.filter("label = 1").orderBy(*order).limit(sample))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary("text")).join(F.broadcast(chosen), "doc_id")  # 2 * sample ids at most
    got = map_arrow(rows, _sampled, "doc_id long, label int, counts binary").groupBy("doc_id").agg(F.min("label").alias("label"), F.min("counts").alias("counts")).orderBy("doc_id").collect()
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in got]) if got else np.empty((0, TERMS), np.float32)
    return Model(counts, np.array([r["label"] for r in got], np.int64), share)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """docs with held_out, score and predicted beside (names that docs has are replaced)."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(train(docs, labels, label, sample))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names], F.lit(1).alias(free_name(names, "_one"))).alias("_row"), binary("text"))
    out = map_arrow(rows, partial(_scored, model=model), f"_row {rows.schema['_row'].dataType.simpleString()}, score double")
    mine = ("held_out", "score", "predicted")
    judged = [held_out(F.col("_row").getField("doc_id")).alias("held_out"), F.col("score"), F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted")]
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names if c.lower() not in mine], *judged)


def query(spark, sf_dir):
    """op6: the score of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
