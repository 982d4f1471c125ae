"""Exact line dedup through a sharded minimal perfect hash.

1. Every eligible line (key of ``min_chars`` code points or more) of every document yields two independent 64-bit hashes;
   Spark counts documents and the largest id per pair, combining before the shuffle, so a line found everywhere is no hot key.
2. All distinct pairs are dealt to shards. A shard's minimal perfect hash (levels of bit arrays, a key's place is the rank of its
   bit) indexes compact arrays: the document count, a byte a line, and of the lines whose count is ``min_docs`` or more the
   fingerprint (the second hash) and the id to keep.
3. Documents probe the arrays: a line goes where the count is high enough, the fingerprint is its own and the id isn't the
   document's. A line that isn't in the index hits some place too, where the fingerprint tells it apart.
   An index of up to ``broadcast_bytes`` goes to every executor; a larger one stays in shards, to which hashes of the lines
   (never lines) are sent, and only the pairs to drop come back. A shard that is asked more than ``ASKED`` times is sent to several
   tasks, and probes pass through a task in batches, so neither a frequent line nor a large shard gathers anywhere. Both ways give
   the same rows.

A line's key: white space stripped at both ends, A-Z lower-cased. A repeated key loses its lines in all documents but those
with the largest id holding it. Rows count as documents; rows with that same largest id all keep theirs; a null id is below
all others. A null or empty text is one empty line. A long text is split as a whole, in memory of a few times its size. An empty
table gives an empty result. Other columns pass through, whatever their names; n_lines and n_dropped replace columns so named.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, binary, cut, eq_null_safe, free_name, map_arrow, mixed, small_batches, table

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 65_536
BROADCAST_BYTES = 48 << 20
#: Probes that one task answers for a shard, about.
ASKED = 1 << 20
#: Bits of a level for each key that is still without a place.
GAMMA = 2
NO_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANKS).lower()  # of bytes, lower() changes A-Z alone


def hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh64_intdigest(key, 42), xxhash.xxh64_intdigest(key, 0x5EED)


def eligible(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "replace")) >= min_chars)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view(np.int64)


def _occurrences(batches: Iterator[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        first, second, rows = [], [], []
        for i, text in enumerate(b.column("text").to_pylist()):
            found = {hashes(k) for line in text.split(b"\n") if eligible(k := line_key(line), min_chars)}
            for h in found:
                first.append(h[0])
                second.append(h[1])
            rows += [i] * len(found)
        ids = b.column("doc_id").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(_signed(first)), pa.array(_signed(second)), ids], ["h1", "h2", "doc_id"])


# The minimal perfect hash ---------------------------------------------------------------------------------------------


class PerfectHash:
    """Places 0 to n-1 for n distinct 64-bit keys; any other key gets some place or none."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # each an array of 64-bit words
        self.before, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(counts)]))
            total += int(counts.sum())
        self.n = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, levels = keys.astype(np.uint64), []
        if len(np.unique(left)) != len(left):
            raise ValueError("keys repeat")
        while len(left):
            words = max(1, -(-GAMMA * len(left) // 64))
            at = (mixed(left, len(levels)) % np.uint64(words * 64)).astype(np.int64)
            alone = np.bincount(at, minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(levels)

    def places(self, keys: np.ndarray) -> np.ndarray:
        """-1 where there is none."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(open_):
                break
            at = mixed(keys[open_], level) % np.uint64(len(words) * 64)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            here = words[word] >> bit & np.uint64(1) == 1
            below = words[word[here]] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[open_[here]] = self.before[level][word[here]] + np.bitwise_count(below)
            open_ = open_[~here]
        return out

    def to_bytes(self) -> bytes:
        return b"".join([len(self.levels).to_bytes(4, "little"), *(len(w).to_bytes(4, "little") for w in self.levels), *(w.tobytes() for w in self.levels)])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int.from_bytes(data[:4], "little")
        sizes = np.frombuffer(data, np.uint32, n, 4)
        words = np.frombuffer(data[4 + 4 * n :], np.uint64) if n else np.empty(0, np.uint64)
        return cls(np.split(words, np.cumsum(sizes)[:-1]) if n else [])


class Shard:
    """counts: of every place, up to what tells the frequent ones; fingerprints and ids to keep: of the frequent places, in order."""

    def __init__(self, salt: int, perfect: bytes, fingerprints: bytes, counts: bytes, keep: bytes, min_docs: int):
        self.salt, self.perfect = salt, PerfectHash.from_bytes(perfect)
        self.fingerprints, self.keep = np.frombuffer(fingerprints, np.uint64), np.frombuffer(keep, np.int64)
        self.often = np.frombuffer(counts, _count_type(min_docs)) >= min_docs
        self.rank = np.cumsum(self.often) - 1

    def keepers(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which hash pairs are in enough documents, and for those the id that keeps its lines."""
        at = self.perfect.places(_salted(h1, h2, self.salt))
        known = at >= 0
        known[known] = self.often[at[known]]
        known[known] = self.fingerprints[self.rank[at[known]]] == h2[known]
        return known, self.keep[self.rank[at[known]]]


def _count_type(min_docs: int) -> type:
    return np.uint8 if min_docs <= 255 else np.uint32


def _salted(h1: np.ndarray, h2: np.ndarray, salt: int) -> np.ndarray:
    """Keys of the perfect hash: h1, or a blend with h2 if two of a shard's lines share h1."""
    return h1 if salt == 0 else h1 ^ mixed(h2, salt)


def _shard_of(h1: np.ndarray, n_shards: int) -> np.ndarray:
    return (mixed(h1, 77) % np.uint64(n_shards)).astype(np.int64)


def _with_shard(batches: Iterator[pa.RecordBatch], n_shards: int, parts=None) -> Iterator[pa.RecordBatch]:
    """parts: for shards that are asked much, in how many parts; the id's hash picks one."""
    often = np.array(sorted(parts.value.items()) if parts else [], np.int64).reshape(-1, 2)
    for b in batches:
        shard = _shard_of(b.column("h1").to_numpy(zero_copy_only=False).view(np.uint64), n_shards)
        part = np.zeros(len(shard), np.int64)
        if len(often):
            at = np.minimum(np.searchsorted(often[:, 0], shard), len(often) - 1)
            ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).view(np.uint64)
            part = np.where(often[at, 0] == shard, (mixed(ids, 5) % often[at, 1].astype(np.uint64)).astype(np.int64), 0)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard), pa.array(part)], [*b.schema.names, "shard", "part"])


def _build_shard(t: pa.Table, min_docs: int) -> pa.Table:
    h1, h2 = (t.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
    salt = 0
    while len(np.unique(_salted(h1, h2, salt))) != len(h1):
        salt += 1
    perfect = PerfectHash.build(_salted(h1, h2, salt))
    at = perfect.places(_salted(h1, h2, salt))
    n = t.column("n").to_numpy()
    order = np.empty(len(h1), np.int64)
    order[at] = np.arange(len(h1))  # whose each place is
    kind = _count_type(min_docs)
    counts = np.minimum(n[order], np.iinfo(kind).max).astype(kind)
    often = order[counts >= min_docs]
    prints, keep = h2[often], t.column("keep").fill_null(NO_ID).to_numpy()[often]
    asked = int(n.sum())
    return pa.table({"shard": pa.array([t.column("shard")[0].as_py()], pa.int64()), "asked": pa.array([asked], pa.int64()), "often": pa.array([len(often)], pa.int64()), "index_salt": pa.array([salt], pa.int64()), "perfect": pa.array([perfect.to_bytes()], pa.binary()), "prints": pa.array([prints.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary()), "keep": pa.array([keep.tobytes()], pa.binary())})


SHARDS = "shard long, asked long, often long, index_salt long, perfect binary, prints binary, counts binary, keep binary"


def build_index(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int, int]:
    """The written shards, their number and the bytes of their arrays, about."""
    small_batches(docs.sparkSession)
    seen = map_arrow(docs.select(F.col("doc_id").cast("long"), binary("text")), partial(_occurrences, min_chars=min_chars), "h1 long, h2 long, doc_id long")
    distinct = cut(seen.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keep")))
    n = distinct.count()
    n_shards = max(1, -(-n // shard_keys))
    dealt = map_arrow(distinct.withColumn("doc_id", F.lit(None).cast("long")), partial(_with_shard, n_shards=n_shards), "h1 long, h2 long, n long, keep long, doc_id long, shard long, part long")

    def build(t: pa.Table) -> pa.Table:
        return _build_shard(t, min_docs)

    index = cut(dealt.groupBy("shard").applyInArrow(build, SHARDS))
    (often,) = index.agg(F.sum("often")).first()
    return index, n_shards, n * (1 + np.dtype(_count_type(min_docs)).itemsize) + (often or 0) * 16


# Probing --------------------------------------------------------------------------------------------------------------


def _strip(b: pa.RecordBatch, dropped_of) -> pa.RecordBatch:
    """Rewrite the texts of a batch; dropped_of(h1, h2, row) says which of all its eligible lines go."""
    lines, h1, h2, rows, places = [], [], [], [], []
    for i, text in enumerate(b.column("text").to_pylist()):
        own = text.split(b"\n")
        lines.append(own)
        for k, line in enumerate(own):
            key = line_key(line)
            if eligible(key, dropped_of.min_chars):
                x, y = hashes(key)
                h1.append(x)
                h2.append(y)
                rows.append(i)
                places.append(k)
    gone = dropped_of(np.array(h1, np.uint64), np.array(h2, np.uint64), np.array(rows, np.int64), b)
    n_dropped = np.zeros(len(lines), np.int64)
    for j in np.flatnonzero(gone):
        lines[rows[j]][places[j]] = None
        n_dropped[rows[j]] += 1
    kept = [b"\n".join([x for x in own if x is not None]) if n_dropped[i] else b"\n".join(own) for i, own in enumerate(lines)]
    return pa.RecordBatch.from_arrays([b.column("_row"), pa.array(kept, pa.binary()), pa.array([len(own) for own in lines], pa.int64()), pa.array(n_dropped)], ["_row", "kept", "n_lines", "n_dropped"])


class _Broadcast:
    def __init__(self, shards, min_chars: int, min_docs: int, n_shards: int):
        self.shards, self.min_chars, self.min_docs, self.n_shards, self.open = shards, min_chars, min_docs, n_shards, None

    def __call__(self, h1, h2, rows, b):
        if self.open is None:
            self.open = {x[0]: Shard(*x[1:], self.min_docs) for x in self.shards.value}
        ids = b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
        gone, shard = np.zeros(len(h1), bool), _shard_of(h1, self.n_shards)
        for s in np.unique(shard):
            if s in self.open:
                mine = np.flatnonzero(shard == s)
                known, keep = self.open[s].keepers(h1[mine], h2[mine])
                gone[mine[known]] = keep != ids[rows[mine[known]]]
        return gone

    def run(self, batches):
        for b in batches:
            yield _strip(b, self)


class _Listed:
    """The pairs to drop came back to the document."""

    def __init__(self, min_chars: int):
        self.min_chars = min_chars

    def __call__(self, h1, h2, rows, b):
        gone = [{(x["h1"], x["h2"]) for x in own or ()} for own in b.column("gone").to_pylist()]
        return np.array([(int(x), int(y)) in gone[r] for x, y, r in zip(h1.view(np.int64), h2.view(np.int64), rows, strict=True)], bool)

    def run(self, batches):
        for b in batches:
            yield _strip(b, self)


_ARRAYS = ("index_salt", "perfect", "prints", "counts", "keep")
ASKING = "shard long, part long, probe int, index_salt long, perfect binary, prints binary, counts binary, keep binary, h1 long, h2 long, doc_id long"


def _probe(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows by shard and part, the shard's arrays (probe 0) before its probes (1): the probes whose lines go."""
    now, open_ = None, None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("shard", "part", "probe")])
        starts = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
        for i, j in zip(starts, np.append(starts[1:], b.num_rows), strict=True):
            own = b.slice(i, j - i)
            if keys[2, i] == 0:
                now, open_ = tuple(keys[:2, i]), Shard(*(own.column(c)[0].as_py() for c in _ARRAYS), min_docs)
            elif now == tuple(keys[:2, i]):
                h1, h2 = (own.column(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("h1", "h2"))
                known, keep = open_.keepers(h1, h2)
                ids = own.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False)
                gone = np.flatnonzero(known)[keep != ids[known]]
                yield own.select(["h1", "h2", "doc_id"]).take(pa.array(gone))


def _gone(docs: DataFrame, index: DataFrame, n_shards: int, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, gone): the pairs that each document loses, from shards that stay where they are."""
    spark = docs.sparkSession
    parts = {r["shard"]: -(-r["asked"] // ASKED) for r in index.filter(F.col("asked") > ASKED).select("shard", "asked").collect()}  # one for ASKED lines at most
    seen = map_arrow(docs.select(F.col("doc_id").cast("long"), binary("text")), partial(_occurrences, min_chars=min_chars), "h1 long, h2 long, doc_id long")
    sent = map_arrow(seen, partial(_with_shard, n_shards=n_shards, parts=spark.sparkContext.broadcast(parts)), "h1 long, h2 long, doc_id long, shard long, part long")
    sent = sent.select("shard", "part", F.lit(1).alias("probe"), F.lit(None).cast("long").alias("index_salt"), *[F.lit(None).cast("binary").alias(c) for c in _ARRAYS[1:]], "h1", "h2", "doc_id")
    each = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("asked") / ASKED), F.lit(1)).cast("long") - 1)
    there = index.select("shard", F.explode(each).alias("part"), F.lit(0).alias("probe"), *_ARRAYS, *[F.lit(None).cast("long").alias(c) for c in ("h1", "h2", "doc_id")])
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = there.unionByName(sent).repartition(n, "shard", "part").sortWithinPartitions("shard", "part", "probe")
    pairs = map_arrow(met, partial(_probe, min_docs=min_docs), "h1 long, h2 long, doc_id long")
    return pairs.distinct().groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """docs with rewritten text, and n_lines and n_dropped beside (names that docs has are replaced)."""
    spark = docs.sparkSession
    index, n_shards, size = build_index(docs, min_chars, min_docs, shard_keys)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names if c != "text"], F.lit(1).alias(free_name(names, "_one"))).alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), binary("text"))
    shape = f"_row {rows.schema['_row'].dataType.simpleString()}, kept binary, n_lines long, n_dropped long"
    if size <= broadcast_bytes:
        shards = [tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in index.drop("asked", "often").collect()]
        probe = _Broadcast(spark.sparkContext.broadcast(shards), min_chars, min_docs, n_shards)
    else:
        rows = eq_null_safe(rows, _gone(docs, index, n_shards, min_chars, min_docs), ["doc_id"], "left")
        probe = _Listed(min_chars)
    out = map_arrow(rows, probe.run, shape)
    text = F.col("kept").cast("string").alias("text")
    return out.select(*[text if c == "text" else F.col("_row").getField(c).alias(c) for c in names if c == "text" or c.lower() not in ("n_lines", "n_dropped")], "n_lines", "n_dropped")


def query(spark, sf_dir):
    """op3: lines counted and dropped, and a digest of the text that is left."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line
), frequent AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT keyed.*, (f.k IS NOT NULL AND keyed.doc_id <> f.keep) AS gone FROM keyed LEFT JOIN frequent f ON keyed.k = f.k
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
