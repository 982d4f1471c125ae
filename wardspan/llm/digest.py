"""Document fingerprints: quartile bucket digests.

Triplets of bytes (a byte, the third and the seventh after it; zeros follow the text) are hashed to ``BUCKETS`` buckets. A
bucket's count becomes two bits, the quartile it falls in among the text's own buckets, and the length one byte on a scale of
tenths of its logarithm. Two digests' difference is the sum of their buckets' distances (opposite quartiles count double) and
of the lengths' distance beyond one step, bounded by ``MOST``; likeness is 1 less its share of that bound. Equal texts have
equal digests. Triplets that reach over syllables tell texts of one language apart better than neighbouring bytes do.

:func:`with_next` also meets each document with the next by id. Documents are range-partitioned and sorted once; each task
streams its rows with a look-ahead of one, and what crosses from one partition to the next are a last and a first document.

A null text is empty; an empty text's digest is all zero. Invalid UTF-8 counts as replacement characters. Null ids come first;
rows that repeat an id follow each other in the order of their texts. A single document is its own next one. Texts are read
whole; a long one takes memory of some twenty times its size in its worker. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import binary, cut, map_arrow, small_batches, table

BUCKETS = 256
OFFSETS = (3, 7)
#: Differences beyond this are as unlike as can be; unrelated texts of a language differ by about as much.
MOST = BUCKETS * 3 // 2
BLOCK_BYTES = 4 << 20


def _counts(texts: list[bytes]) -> np.ndarray:
    n, pad = len(texts), OFFSETS[1]
    data = np.frombuffer(b"".join([t + bytes(pad) for t in texts]), np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, n)
    last = len(data) - pad
    h = (data[:last] * np.uint32(0x9E3779B1)) ^ (data[OFFSETS[0] : last + OFFSETS[0]] * np.uint32(0x85EBCA77)) ^ (data[pad:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    h &= np.uint32(BUCKETS - 1)
    at = np.repeat(np.arange(n, dtype=np.int64), sizes)
    places = np.arange(len(at), dtype=np.int64) + at * pad
    return np.bincount(at * BUCKETS + h[places], minlength=n * BUCKETS).reshape(n, BUCKETS)


def codes(texts: list[bytes]) -> np.ndarray:
    """A row per text: the length's code, then the buckets' quartiles."""
    out = np.zeros((len(texts), 1 + BUCKETS), np.uint8)
    start = size = 0
    for i, t in enumerate([*texts, None]):
        if i > start and (t is None or size + len(t) > BLOCK_BYTES):
            counts = _counts(texts[start:i])
            cuts = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
            for k in (1, 2, 3):
                out[start:i, 1:] += counts > cuts[:, k * BUCKETS // 4 - 1 : k * BUCKETS // 4]
            start, size = i, 0
        size += len(t or b"")
    lengths = np.array([len(t) for t in texts], np.float64)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(lengths) * 10)).astype(np.uint8)
    return out


def told(code: np.ndarray) -> list[str]:
    """Two hexadecimal digits of length, then two bits a bucket."""
    four = code[:, 1:].reshape(len(code), -1, 4)
    packed = four[:, :, 0] << 6 | four[:, :, 1] << 4 | four[:, :, 2] << 2 | four[:, :, 3]
    return [bytes(row).hex() for row in np.concatenate([code[:, :1], packed], axis=1)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    apart = np.abs(a[:, 1:].astype(np.int16) - b[:, 1:])
    total = apart.sum(axis=1) + 3 * (apart == 3).sum(axis=1)
    total = total + np.maximum(0, np.abs(a[:, 0].astype(np.int64) - b[:, 0]) - 1)
    return 1 - np.minimum(total, MOST) / MOST


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


class _Judge:
    """Results of documents whose next one is known."""

    columns = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")

    def __call__(self, texts: list[str], own: np.ndarray, following: list[str], following_codes: np.ndarray) -> list[pa.Array]:
        made = [edited(t, f).encode() for t, f in zip(texts, following, strict=True)]
        made_codes = codes(made)
        return [pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in made], pa.string()), pa.array(told(own), pa.string()), pa.array(told(made_codes), pa.string()), pa.array(likeness(own, made_codes)), pa.array(likeness(own, following_codes))]


JUDGED = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
DONE, FIRST, LAST = 0, 1, 2


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, judge = TaskContext.get().partitionId(), _Judge()

    def edge(kind: int, doc_id, text: str) -> pa.RecordBatch:
        ends = [pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([doc_id], pa.int64()), pa.array([text.encode()], pa.binary())]
        return pa.RecordBatch.from_arrays([*ends, *[pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]], ["part", "kind", "doc_id", "text", *judge.columns])

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = b.column("doc_id").to_pylist()
        texts = [_text(x) for x in b.column("text").to_pylist()]
        own = codes([t.encode() for t in texts])
        if held is None:
            yield edge(FIRST, ids[0], texts[0])
        else:
            ids, texts, own = [held[0], *ids], [held[1], *texts], np.concatenate([held[2], own])
        held = ids[-1], texts[-1], own[-1:]
        n = len(ids) - 1
        if n:
            same = [pa.array(np.full(n, part, np.int32)), pa.array(np.zeros(n, np.int32)), pa.array(ids[:-1], pa.int64()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*same, *judge(texts[:-1], own[:-1], texts[1:], own[1:])], ["part", "kind", "doc_id", "text", *judge.columns])
    if held is not None:
        yield edge(LAST, held[0], held[1])


def _seams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judge = _Judge()
    for b in batches:
        texts, following = ([_text(x) for x in b.column(c).to_pylist()] for c in ("text", "following"))
        arrays = judge(texts, codes([t.encode() for t in texts]), following, codes([t.encode() for t in following]))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays], ["doc_id", *judge.columns])


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id and: n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), binary("text"))
    order = [F.col("doc_id").asc_nulls_first()]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order, "text")
    found = cut(map_arrow(dealt, _stream, f"part int, kind int, doc_id long, text binary, {JUDGED}"))
    # One number per partition: which one follows; after the last, the first.
    parts = found.filter(F.col("kind") == FIRST).select("part")
    around = Window.orderBy("part")
    wrapped = F.coalesce(F.lead("part").over(around), F.first("part").over(around.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    after = parts.select("part", wrapped.alias("next_part"))
    firsts = found.filter(F.col("kind") == FIRST).select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    lasts = found.filter(F.col("kind") == LAST).select("part", "doc_id", "text").join(after, "part").join(firsts, "next_part")
    seams = map_arrow(lasts.select("doc_id", "text", "following"), _seams, f"doc_id long, {JUDGED}")
    return found.filter(F.col("kind") == DONE).select("doc_id", *_Judge.columns).unionByName(seams)


def _only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(told(codes(b.column("text").to_pylist())), pa.string())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint, without a shuffle."""
    small_batches(docs.sparkSession)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), binary("text")), _only, "doc_id long, fingerprint string")


def query(spark, sf_dir):
    """op9: digests of every document and its edited text, and their likeness to each other and to the next document's."""
    return with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def edited_texts(spark, sf_dir):
    """A side query of op9: the lengths and the edited texts' digests, which SQL can tell too."""
    return query(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


EDITED = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id), first_value(coalesce(text, '')) OVER (ORDER BY doc_id)) AS next FROM documents
)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(left(t, length(t) - length(t) // 4) || left(next, length(t) // 4)) AS edited_sha256 FROM d
"""
