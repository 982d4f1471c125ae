"""SimHash near-dedup by a binary trie self-join.

Fingerprints are read as paths of a binary trie. Two nodes of the same depth are walked together; a branch to unlike children
adds a differing bit, and a pair of nodes whose differing bits exceed the budget is pruned with all below it. Where both nodes
hold one fingerprint, the bits that are left are counted at once. To spread the walk over machines, fingerprints are dealt to
groups that agree in some of their bits, each group a trie of its own, and every fingerprint enters several groups:

* :func:`near_duplicates` (64 bits, a budget of two) cuts the bits in three parts. Within the budget one part is alike, so no
  link is lost. A group of more than ``SUBTREE`` fingerprints is entered again by thirds of its other bits, twice at most: then
  19 bits at most are free, so no group has more than 2^19 distinct fingerprints, however alike the texts are.
* :func:`keep_one`, the filter, links texts whose shingles of five words are alike to 0.8 (Jaccard) or more, which is read from
  fingerprints of ``WIDE`` bits: of two texts that are alike to J, a bit differs with chance acos(2J / (1 + J)) / pi. The budget
  is what 0.8 makes of ``WIDE`` bits and one standard deviation more (J is told to 0.035 about). Fingerprints enter so many
  groups, each by other bits, that texts of similarity 0.8 share one with chance ``FOUND``, likelier ones nearly always.

Links found by a task shrink to a spanning forest at once (pairs of nodes that are one component already are pruned too), so
large groups never make all their pairs. The forests meet in an iterative connected-components job.

A null or empty text, or one of blanks only, has fingerprint zero and is linked like any other. Texts of fewer words than a
shingle make one shingle. Long texts are hashed in pieces. Repeated rows count each; a null id never becomes a component's id
unless all its ids are null. Of each component keep_one keeps the smallest id (null is above all others) and, of rows with that
id, the one with the smallest digest of its text; of rows that repeat both, one. An empty table gives an empty result. Other
columns pass through :func:`keep_one` unchanged, whatever they are named.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, cut, free_name, map_arrow, mixed, small_batches, table, whole_groups

WORDS, MAX_BITS, SEED = 3, 2, 42
#: The filter's words a shingle, similarity and bits of a fingerprint.
KEEP_WORDS, SIMILARITY, WIDE = 5, 0.8, 512
#: Chance that two texts of just that similarity meet in a group; unlike fingerprints that meet in a group, about.
FOUND, LOAD = 0.95, 256
#: Fingerprints of one group at most, before it is entered once more by other bits.
SUBTREE = 1 << 16
#: Pairs of nodes that are walked at once; fingerprints whose groups are walked together.
FRONTIER, TOGETHER = 1 << 18, 1 << 17
#: Bytes of a text that are split to words at once.
PIECE = 1 << 20


# Fingerprints ---------------------------------------------------------------------------------------------------------

_TO_ONE_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def _word_lists(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        cut_ = _BLANK.search(text, at + PIECE) if len(text) - at > PIECE else None
        end = cut_.start() if cut_ else len(text)
        own = text[at:end].translate(_TO_ONE_BLANK).lower().split(b" ")
        yield [w for w in own if w] if b"" in own else own
        at = end


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    out, own = [], []
    for more in _word_lists(text):
        own = own[len(own) - words + 1 if len(own) >= words else 0 :] + more  # the last words go on
        if len(own) >= words:
            out.append(np.array([xxhash.xxh64_intdigest(x, SEED) for x in map(b" ".join, zip(*(own[k:] for k in range(words)), strict=False))], np.uint64))
    if not out and own:
        out.append(np.array([xxhash.xxh64_intdigest(b" ".join(own), SEED)], np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _add_up(x: np.ndarray) -> list[np.ndarray]:
    """x: 64 rows of words. How many of each column's words have a bit, as words of binary digits, lowest first."""
    digits = [x]
    while len(digits[0]) > 1:
        half, carry, out = len(digits[0]) // 2, None, []
        for d in digits:
            a, b = d[:half], d[half:]
            odd = a ^ b
            out.append(odd if carry is None else odd ^ carry)
            carry = a & b if carry is None else a & b | odd & carry
        digits = [*out, carry]
    return [d[0] for d in digits]


def fingerprints_of(hashes: list[np.ndarray], bits: int = 64) -> np.ndarray:
    """A row of bits / 64 words per text: a bit is set if over half of the hashes have it. Beyond 64 bits hashes are mixed anew."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    ones = np.zeros((len(hashes), bits), np.int64)
    flat = np.concatenate([np.empty(0, np.uint64), *hashes])
    blocks = -(-sizes // 64)  # a text's hashes are laid out in blocks of 64, filled up with zeros
    first = np.cumsum(blocks) - blocks
    place = np.arange(len(flat)) + np.repeat(64 * first - (np.cumsum(sizes) - sizes), sizes)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    for lo in range(0, len(owner), 2048):
        mine = owner[lo : lo + 2048]
        n = len(mine)
        i, j = np.searchsorted(place, [64 * lo, 64 * (lo + n)])
        at = place[i:j] - 64 * lo
        at = at % 64 * n + at // 64
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        for k in range(bits // 64):
            laid = np.zeros(64 * n, np.uint64)
            laid[at] = mixed(flat[i:j], k) if k else flat[i:j]
            counts = np.zeros((n, 64), np.uint8)
            for d, words in enumerate(_add_up(laid.reshape(64, n))):
                counts += np.unpackbits(words.view(np.uint8).reshape(n, 8), axis=1, bitorder="little") << np.uint8(d)
            ones[mine[starts], 64 * k : 64 * k + 64] += np.add.reduceat(counts, starts, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64).reshape(len(hashes), bits // 64)


def fingerprint(hashes: np.ndarray) -> int:
    return int(fingerprints_of([hashes])[0, 0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, bits: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        found = fingerprints_of([shingle_hashes(x.as_py(), words) for x in b.column("text")], bits)
        fp = pa.array(found[:, 0].view(np.int64)) if bits == 64 else pa.FixedSizeBinaryArray.from_buffers(pa.binary(bits // 8), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), fp], [*(c for c in b.schema.names if c != "text"), "fp"])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), binary("text")), partial(_fingerprints, words=words, bits=64), "doc_id long, fp long")


# The trie -------------------------------------------------------------------------------------------------------------


class Forest:
    """Components of 0 to n-1; link() returns the pairs that joined two of them."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.runs = np.arange(n)  # how often the label changed up to here: equal ends mean one component between them

    def link(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        made, parent = [], {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        apart = self.label[a] != self.label[b]
        a, b = a[apart], b[apart]
        _, first = np.unique(self.label[a] * len(self.label) + self.label[b], return_index=True)
        for x, y in zip(a[first].tolist(), b[first].tolist(), strict=True):
            p, q = root(int(self.label[x])), root(int(self.label[y]))
            if p != q:
                parent[max(p, q)] = min(p, q)
                made.append((x, y))
        if made:
            names = np.arange(len(self.label))
            for x in parent:
                names[x] = root(x)
            self.label = names[self.label]
            self.runs = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])
        return made


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


def trie_self_join(keys: np.ndarray, budget: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links within each group, as pairs of places in keys.

    keys: rows of words, the first on top, distinct and sorted within each group; starts: where groups begin. A node is a range
    of keys, so the trie needs no memory of its own.
    """
    n, words = keys.shape
    if not n:
        return []
    forest = Forest(n)
    inner = np.ones(n, bool)
    inner[starts] = False
    after = np.flatnonzero(inner)
    after = after[_differing(keys[after - 1], keys[after]) <= budget]
    made = forest.link(after - 1, after)  # neighbours in order: a group of near copies is mostly one component already
    ends = np.append(starts[1:], n)
    big = ends - starts > 1
    lo, hi = starts[big], ends[big]
    stack = [(lo, hi, lo, hi, np.zeros(len(lo), np.int16), 64 * words)]
    while stack:
        alo, ahi, blo, bhi, wrong, left = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack.append((alo[half:], ahi[half:], blo[half:], bhi[half:], wrong[half:], left))
            stack.append((alo[:half], ahi[:half], blo[:half], bhi[:half], wrong[:half], left))
            continue
        live = ~((forest.runs[alo] == forest.runs[ahi - 1]) & (forest.runs[blo] == forest.runs[bhi - 1]) & (forest.label[alo] == forest.label[blo]))
        single = live & (ahi - alo == 1) & (bhi - blo == 1)
        if single.any():
            x, y = alo[single], blo[single]
            near = _differing(keys[x], keys[y]) <= budget
            made += forest.link(x[near], y[near])
            live &= ~single
        alo, ahi, blo, bhi, wrong = alo[live], ahi[live], blo[live], bhi[live], wrong[live]
        if not len(alo):
            continue
        word, bit = words - 1 - (left - 1) // 64, np.uint64(1 << (left - 1) % 64)
        amid, bmid = _split(keys[:, word], alo, ahi, bit), _split(keys[:, word], blo, bhi, bit)
        same = alo == blo
        parts = []
        for x0, x1, y0, y1, more, also in (
            (alo, amid, blo, bmid, 0, None),
            (amid, ahi, bmid, bhi, 0, None),
            (alo, amid, bmid, bhi, 1, None),
            (amid, ahi, blo, bmid, 1, ~same),  # a node with itself: its unlike children meet once
        ):
            ok = (x1 > x0) & (y1 > y0) & (wrong + more <= budget)
            ok &= ~((x0 == y0) & (x1 - x0 == 1))  # a key with itself
            if also is not None:
                ok &= also
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], wrong[ok] + np.int16(more)))
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if len(joined[0]):
            order = np.argsort(-joined[4], kind="stable")  # what differs least is walked first
            for part in reversed(np.array_split(order[::-1], max(1, -(-len(order) // FRONTIER)))):
                stack.append((*(x[part] for x in joined), left - 1))
    return made


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the keys with this bit begin, for each range; bits above are alike in a range."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        one = keys[np.minimum(mid, len(keys) - 1)] & bit != 0
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)
    return lo


def _words(column: pa.Array) -> np.ndarray:
    """Fingerprints as rows of words."""
    if pa.types.is_integer(column.type):
        return column.to_numpy().view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), -1)


def _walk(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Rows (at, node, fp), sorted by at, whose groups are whole in a partition."""
    for t in whole_groups(batches, "at", TOGETHER):
        t = t.combine_chunks()
        at, node = t.column("at").to_numpy(), t.column("node").to_numpy()
        same = at[1:] == at[:-1]
        own = np.flatnonzero(np.append(False, same) | np.append(same, False))  # alone in its group: no link
        if not len(own):
            continue
        at, node, keys = at[own], node[own], _words(t.column("fp").chunk(0).take(pa.array(own)))
        order = np.lexsort((*keys.T[::-1], at))
        at, node, keys = at[order], node[order], keys[order]
        links = np.array(trie_self_join(keys, budget, np.flatnonzero(np.append(True, at[1:] != at[:-1]))), np.int64).reshape(-1, 2)
        ends = node[links]
        yield pa.RecordBatch.from_arrays([pa.array(ends.max(axis=1)), pa.array(ends.min(axis=1))], ["a", "b"])


def _walked(entered: DataFrame, budget: int) -> DataFrame:
    n = int(entered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(entered.select("at", "node", "fp").repartition(n, "at").sortWithinPartitions("at"), partial(_walk, budget=budget), "a long, b long")


def _pick(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """The values of some bits, of every key."""
    out = np.zeros(len(keys), np.uint64)
    for i, b in enumerate(bits):
        out |= (keys[:, b // 64] >> np.uint64(b % 64) & np.uint64(1)) << np.uint64(i)
    return out


#: Where the parts of 64 bits begin and end.
PARTS = ((0, 22), (22, 43), (43, 64))


def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """used: the bits in which all of a group are alike."""
    for b in batches:
        keys = b.column("fp").to_numpy().view(np.uint64)
        for i, (lo, hi) in enumerate(PARTS):
            mask = ((1 << hi - lo) - 1) << lo
            at = keys >> np.uint64(lo) & np.uint64((1 << hi - lo) - 1)
            yield pa.RecordBatch.from_arrays([pa.array((at << np.uint64(2) | np.uint64(i)).view(np.int64)), b.column("fp"), b.column("fp"), pa.array(np.full(len(keys), mask, np.uint64).view(np.int64))], ["at", "node", "fp", "used"])


def _enter_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the other bits, one third has no differing bit either."""
    for b in batches:
        keys, at, used = (b.column(c).to_numpy().view(np.uint64) for c in ("fp", "at", "used"))
        for mask in np.unique(used):
            own = np.flatnonzero(used == mask)
            free = [i for i in range(64) if not int(mask) >> i & 1]
            for third in np.array_split(free, 3):
                more = np.uint64(sum(1 << int(i) for i in third))
                name = mixed(mixed(keys[own] & more, 1) ^ at[own] ^ more, 2)
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *(b.column(c).take(pa.array(own)) for c in ("node", "fp")), pa.array((used[own] | more).view(np.int64))], ["at", "node", "fp", "used"])


ENTERED = "at long, node long, fp long, used long"


def links(distinct: DataFrame) -> DataFrame:
    """(a, b), a > b: fingerprints linked within the budget, enough of them to connect what is connected."""
    entered, ready = cut(map_arrow(distinct, _enter, ENTERED)), []
    for _ in range(2):
        large = cut(entered.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SUBTREE).select("at"))
        if large.isEmpty():
            break
        ready.append(entered.join(large, "at", "left_anti"))
        entered = cut(map_arrow(entered.join(large, "at"), _enter_again, ENTERED))
    for more in ready:
        entered = entered.unionByName(more)
    return _walked(entered, MAX_BITS).distinct()


def similar_bits(similarity: float, bits: int) -> tuple[float, int]:
    """The share of bits that differ at this Jaccard similarity, and the budget."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    return p, int(bits * p + math.sqrt(bits * p * (1 - p)))


def turns_for(n: int, p: float) -> tuple[int, int]:
    """Bits that tell groups of n fingerprints apart, and how many times each enters one."""
    bits = max(8, math.ceil(math.log2(max(1, n / LOAD))))
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - (1 - p) ** bits)) if p else 1


def _turn_bits(width: int, bits: int, turns: int, seed: int) -> list[np.ndarray]:
    rng = np.random.default_rng(seed)
    flat = np.concatenate([rng.permutation(width) for _ in range(-(-bits * turns // width))])
    return [flat[i * bits : (i + 1) * bits] for i in range(turns)]


def _enter_wide(batches: Iterator[pa.RecordBatch], turns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Groups of groups where rows have an at already."""
    for b in batches:
        keys = _words(b.column("fp"))
        before = b.column("at").to_numpy().view(np.uint64) if "at" in b.schema.names else np.uint64(0)
        for t, bits in enumerate(turns):
            at = mixed(_pick(keys, bits) ^ before, t + 1)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), b.column("node"), b.column("fp")], ["at", "node", "fp"])


def wide_links(distinct: DataFrame, similarity: float) -> DataFrame:
    """(a, b), a > b: nodes of distinct (node, fp) whose fingerprints are alike enough."""
    p, budget = similar_bits(similarity, WIDE)
    shape = "at long, node long, fp binary"
    entered = map_arrow(distinct, partial(_enter_wide, turns=_turn_bits(WIDE, *turns_for(distinct.count(), p), 7)), shape)
    large = cut(entered.groupBy("at").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > SUBTREE))
    most = large.agg(F.max("n")).first()[0]
    if most is None:
        return _walked(entered, budget).distinct()
    again = map_arrow(entered.join(large.select("at"), "at").select("at", "node", "fp"), partial(_enter_wide, turns=_turn_bits(WIDE, *turns_for(most, p), 8)), shape)
    return _walked(entered.join(large, "at", "left_anti").unionByName(again), budget).distinct()


# Components -----------------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), root the smallest of its component.

    Large and small stars take turns: a node's neighbours move to the smallest of them, first the larger, then the smaller
    ones, until nothing moves; all that is aggregated is a minimum, and the rest are joins, whose hot keys Spark can split.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a")
        now = cut(moved.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a > b").distinct())
        mark = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp, component_id): the smallest id that links of at most two differing bits reach."""
    found = cut(fingerprints(docs, words))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = components(links(distinct.select("fp")))
    known = distinct.join(tree.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = known.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = known.select("fp", "root").join(named, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, words: int = KEEP_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of similar ones, with the columns of docs."""
    small_batches(docs.sparkSession)
    names = docs.columns
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(" "), text).cast("binary"))  # rows alike in it are alike in id and text
    found = cut(map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), binary("text")), partial(_fingerprints, words=words, bits=WIDE), "doc_id long, key string, fp binary"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    distinct = cut(found.groupBy("fp").agg(first).select(F.monotonically_increasing_id().alias("node"), "fp", "first"))
    tree = components(wide_links(distinct.select("node", "fp"), similarity))
    kept = distinct.select("node", "first").join(tree, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    marked = docs.withColumn(free_name(names, "_key"), key)
    mark = marked.columns[-1]
    packed = marked.select(F.struct(*[marked[c] for c in names]).alias("_row"), F.col(mark).alias("_key"))
    left = packed.join(kept.select(F.col("first.key").alias("_key")), "_key", "left_semi")
    one = left.groupBy("_key").agg(F.min_by("_row", F.xxhash64(F.col("_row"))).alias("_row"))  # texts are shuffled once, for join and group
    return one.select(*[F.col("_row").getField(c).alias(c) for c in names])


def query(spark, sf_dir):
    """op1: fingerprint and component of every document."""
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
