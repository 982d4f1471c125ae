"""Approximate nearest neighbours: a graph by NN-descent, searched greedily.

Equal vectors are one node (its id is their smallest), so copies don't crowd the graph; a result's other holders follow from a
list of each node's smallest ids, as many as any result can need. The graph starts from the exact neighbours within the leaves
of a few random-projection trees. The tops of the trees are drawn from a sample that grows with the rows, up to ``DEPTH`` cuts;
a task then cuts the rows of a place below further, by their own medians, down to ``LEAF`` rows. So leaves don't grow with the
rows, and every node is in a leaf of every tree. Then, round by round, each node's neighbours and a sample of the nodes it is a
neighbour of are brought together by joins, with their vectors in a byte a component, and every two of them are proposed to each
other if either came new in the last round and they are nearer than the worst neighbour kept: neighbours of neighbours. Each
node keeps the ``DEGREE`` nearest. Rounds go on until fewer than ``SETTLED`` of the edges are new, ``ROUNDS`` at most.

A query walks the graph: of its best nodes (``BEAM``, more where there are more nodes), those not yet expanded are, all at a time,
until none is left. All queries walk together, by joins alone: nothing that grows with the rows is broadcast or collected. The
walk compares vectors of a byte a component; distances of what it found are then measured exactly, in double precision.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without id, nor vectors of
another length than most have (of equally many, the shorter). Of rows that repeat an id the smallest vector counts. Ties go to the
smaller id. A query gets fewer results only if there are fewer candidates. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, whole_groups

K = 10
DEGREE, TREES = 32, 6
#: Rounds at most, and the share of new edges under which they end.
ROUNDS, SETTLED = 12, 0.02
#: Nodes known from the other end that join a round, and that the search may walk.
BACK, WALK_BACK = 16, 32
#: Rows of a leaf at most; neighbours taken from a leaf; rows that a task cuts to leaves, about; sampled rows for each place at
#: the bottom of the trees' tops, and cuts from there to the root at most.
LEAF, FROM_LEAF, PLACE, SAMPLE, DEPTH = 1024, 20, 8192, 64, 14
#: The search's beam for up to 10,000 nodes, and by how much it grows each time they double.
BEAM, WIDER = 160, 20
#: Rows that a task merges at once.
CHUNK = 1 << 20

EDGES = "u long, c long, d double, fresh int"


# Vectors --------------------------------------------------------------------------------------------------------------


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Doubles as bytes, and a byte per component after a scale for the graph."""
    for b in batches:
        lists = b.column("vector")
        n = b.num_rows
        if not n:
            continue
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(n, -1)
        scale = np.abs(flat).max(axis=1, keepdims=True) / 127
        small = np.rint(flat / scale).astype(np.int8)
        coarse = [s.astype("<f4").tobytes() + q.tobytes() for s, q in zip(scale, small, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array(coarse, pa.binary())], ["node", "exact", "coarse"])


def _coarse(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.empty((0, 1), np.float32)
    data = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return data[:, :4].copy().view("<f4") * data[:, 4:].copy().view(np.int8).astype(np.float32)


def _exact(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """(id, vector) of the rows that take part, one per id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.transform(F.col("vector").cast("array<double>"), lambda x: x + F.lit(0.0)).alias("vector"))  # no -0.0: vectors are matched by their bytes
    rows = rows.filter(F.col("id").isNotNull() & finite & F.exists("vector", lambda x: x != 0))
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return cut(rows.filter(F.size("vector") == (most["size"] if most else 0)).groupBy("id").agg(F.min("vector").alias("vector")))


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, exact, coarse) of the distinct vectors, and (node, id) of the smallest K + 1 ids of each."""
    classes = cut(rows.groupBy("vector").agg(F.min("id").alias("node")))
    nodes = cut(map_arrow(classes.select("node", "vector"), _pack, "node long, exact binary, coarse binary"))
    named = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("nth") <= K + 1)  # few per class pass the shuffle
    return nodes, cut(named.join(classes, "vector").select("node", "id"))


# The graph ------------------------------------------------------------------------------------------------------------


def _best(u: np.ndarray, c: np.ndarray, d: np.ndarray, fresh: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Of each u the k smallest d; of a pair that repeats, the oldest (fresh 0 before 1)."""
    order = np.lexsort((fresh, c, u))
    u, c, d, fresh = u[order], c[order], d[order], fresh[order]
    first = np.append(True, (u[1:] != u[:-1]) | (c[1:] != c[:-1])) if len(u) else np.empty(0, bool)
    u, c, d, fresh = u[first], c[first], d[first], fresh[first]
    order = np.lexsort((c, d, u))
    u, c, d, fresh = u[order], c[order], d[order], fresh[order]
    starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.empty(0, np.int64)
    rank = np.arange(len(u)) - np.repeat(starts, np.diff(np.append(starts, len(u))))
    kept = rank < k
    return u[kept], c[kept], d[kept], fresh[kept]


def _keep_best(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """All rows of a u are in this partition; never more than its k best and a chunk are held."""
    held, size, names = [], 0, ["u", "c", "d", "fresh"]

    def merged():
        return _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)

    for b in batches:
        held.append(tuple(b.column(n).to_numpy(zero_copy_only=False) for n in names))
        size += b.num_rows
        if size > CHUNK:
            held = [merged()]
            size = 0
    if held:
        out = merged()
        for i in range(0, len(out[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], names)


def _fewer(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best of each u, a chunk at a time: a node that is near to very many sends k rows a chunk through the shuffle."""
    names = ["u", "c", "d", "fresh"]
    held, size = [], 0

    def told():
        out = _best(*(np.concatenate(x) for x in zip(*held, strict=True)), k)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    for b in batches:
        held.append(tuple(b.column(n).to_numpy(zero_copy_only=False) for n in names))
        size += b.num_rows
        if size > CHUNK // 4:
            yield told()
            held, size = [], 0
    if held:
        yield told()


def best(edges: DataFrame, k: int) -> DataFrame:
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(map_arrow(edges, partial(_fewer, k=k), EDGES).repartition(n, "u"), partial(_keep_best, k=k), EDGES)


def _halves(x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.float32, np.ndarray]:
    """A direction between two of the rows, the median along it, and which rows are beyond; half of them where that parts none."""
    a, b = rng.choice(len(x), 2, replace=False)
    normal = x[a] - x[b]
    along = x @ normal
    cut_ = np.float32(np.median(along))
    right = along > cut_
    if right.all() or not right.any():
        right = np.arange(len(x)) % 2 == 0
    return normal, cut_, right


class Forest:
    """Tops of random-projection trees: at each inner place a direction and a cut, medians of the sample."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES):
        self.depth = depth
        rng, size = np.random.default_rng(11), 2**depth
        self.normals = np.zeros((trees, size, sample.shape[1]), np.float32)
        self.cuts = np.zeros((trees, size), np.float32)
        for t in range(trees):
            rows = {1: np.arange(len(sample))}
            for at in range(1, size):
                own = rows.pop(at)
                if len(own) > 1:
                    self.normals[t, at], self.cuts[t, at], right = _halves(sample[own], rng)
                else:
                    right = np.zeros(len(own), bool)
                rows[2 * at], rows[2 * at + 1] = own[~right], own[right]

    def places(self, x: np.ndarray, t: int) -> np.ndarray:
        at = np.ones(len(x), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (np.einsum("ij,ij->i", x, self.normals[t][at]) > self.cuts[t][at])
        return at


def _deal(batches: Iterator[pa.RecordBatch], forest) -> Iterator[pa.RecordBatch]:
    f = forest.value
    for b in batches:
        if not b.num_rows:
            continue
        x = _coarse(b.column("coarse"))
        for t in range(len(f.normals)):
            place = t << 40 | f.places(x, t)
            yield pa.RecordBatch.from_arrays([pa.array(place), b.column("node"), b.column("coarse")], ["place", "node", "coarse"])


def _leaves(x: np.ndarray, seed: int, leaf: int) -> Iterator[np.ndarray]:
    """Rows of a place, cut in halves until none has more than a leaf's."""
    rng, todo = np.random.default_rng(seed), [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            yield own
        else:
            right = _halves(x[own], rng)[2]
            todo += [own[right], own[~right]]


def _squares(x: np.ndarray) -> np.ndarray:
    """Squared distances within each group; x: groups, members, components."""
    norms = np.einsum("gij,gij->gi", x, x)
    return np.maximum(norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1)), 0)


def _leaf_neighbours(batches: Iterator[pa.RecordBatch], leaf: int) -> Iterator[pa.RecordBatch]:
    for t in whole_groups(batches, "place"):
        place = t.column("place").to_numpy()
        nodes, vectors = t.column("node").to_numpy(), _coarse(t.column("coarse").combine_chunks())
        starts = np.append(np.flatnonzero(np.append(True, place[1:] != place[:-1])), len(place))
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            for own in _leaves(vectors[lo:hi], int(place[lo]), leaf):
                x, node, k = vectors[lo:hi][own], nodes[lo:hi][own], min(FROM_LEAF, len(own) - 1)
                if k:
                    d = (x**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * x @ x.T
                    np.fill_diagonal(d, np.inf)
                    near = np.argpartition(d, k - 1, axis=1)[:, :k]
                    found = np.maximum(np.take_along_axis(d, near, 1), 0).ravel().astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, k)), pa.array(node[near].ravel()), pa.array(found), pa.array(np.ones(len(found), np.int32))], ["u", "c", "d", "fresh"])


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: mid, member, fresh, worst (the member's), coarse. Every two members of a mid, one of them fresh, if near."""
    most = DEGREE + BACK
    for t in whole_groups(batches, "mid"):
        mid = t.column("mid").to_numpy()
        member, fresh, worst = (t.column(c).to_numpy() for c in ("member", "fresh", "worst"))
        x = _coarse(t.column("coarse").combine_chunks())
        starts = np.append(np.flatnonzero(np.append(True, mid[1:] != mid[:-1])), len(mid))
        sizes = np.minimum(np.diff(starts), most)
        for g in range(0, len(sizes), 500):
            own, size = starts[g : g + 500][: len(sizes) - g], sizes[g : g + 500]
            at = own[:, None] + np.minimum(np.arange(most)[None, :], size[:, None] - 1)
            there = np.arange(most)[None, :] < size[:, None]
            d = _squares(x[at])
            ids, new = member[at], fresh[at] > 0
            ok = (d < worst[at][:, :, None]) & there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
            gi, i, j = np.nonzero(ok)
            best_ = _best(ids[gi, i], ids[gi, j], d[gi, i, j].astype(np.float64), np.ones(len(gi), np.int32), DEGREE)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in best_], ["u", "c", "d", "fresh"])


def back_edges(edges: DataFrame, k: int) -> DataFrame:
    """(u, c, d, fresh): up to k nodes c that have u for a neighbour, the nearest."""
    return best(edges.select(F.col("c").alias("u"), F.col("u").alias("c"), "d", "fresh"), k)


def build_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(u, c, d, fresh): each node's neighbours."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = nodes.count()
    if not n:
        return spark.createDataFrame([], EDGES)
    depth = 0
    while 2**depth * PLACE < n and depth < DEPTH:
        depth += 1
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE << depth).select("coarse").toArrow().column("coarse").combine_chunks()
    forest = spark.sparkContext.broadcast(Forest(_coarse(sample), depth))  # 2^DEPTH places at most
    dealt = map_arrow(nodes.select("node", "coarse"), partial(_deal, forest=forest), "place long, node long, coarse binary")
    edges = cut(best(map_arrow(dealt.repartition(parts, "place").sortWithinPartitions("place"), partial(_leaf_neighbours, leaf=LEAF), EDGES), DEGREE))
    for _ in range(rounds):
        members = edges.select(F.col("u").alias("mid"), F.col("c").alias("member"), "fresh").unionByName(back_edges(edges, BACK).select(F.col("u").alias("mid"), F.col("c").alias("member"), "fresh")).groupBy("mid", "member").agg(F.max("fresh").alias("fresh"))
        worst = edges.groupBy("u").agg(F.when(F.count(F.lit(1)) >= DEGREE, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        known = nodes.select("node", "coarse").join(worst, F.col("node") == F.col("u")).select(F.col("node").alias("member"), "coarse", "worst")
        met = members.join(known, "member").repartition(parts, "mid").sortWithinPartitions("mid").select("mid", "member", "fresh", "worst", "coarse")
        proposed = map_arrow(met, _propose, EDGES)
        edges = cut(best(edges.withColumn("fresh", F.lit(0)).unionByName(proposed), DEGREE))
        new, every = edges.agg(F.sum("fresh"), F.count(F.lit(1))).first()
        if not new or new < SETTLED * every:
            break
    return edges


# The search -----------------------------------------------------------------------------------------------------------

STATE = "q long, node long, d double, open int"


def _advance(batches: Iterator[pa.RecordBatch], beam: int) -> Iterator[pa.RecordBatch]:
    """Rows by q: its vector first (kind 0), its beam so far (1), nodes with vectors to measure (2). The new beam; what is new is open."""
    for t in whole_groups(batches, "q", 20_000):
        q, kind, node, d, state = (t.column(c).to_numpy(zero_copy_only=False) for c in ("q", "kind", "node", "d", "open"))
        own = np.flatnonzero(kind == 0)
        row = np.cumsum(kind == 0) - 1  # whose query each row is of
        vectors = t.column("coarse").combine_chunks()
        mine = _coarse(vectors.take(pa.array(own)))
        new, old = np.flatnonzero(kind == 2), np.flatnonzero(kind == 1)
        found = np.empty(len(new))
        for i in range(0, len(new), 20_000):
            at = new[i : i + 20_000]
            found[i : i + 20_000] = np.sqrt(((_coarse(vectors.take(pa.array(at))) - mine[row[at]]) ** 2).sum(axis=1))
        out = _best(np.concatenate([q[old], q[new]]), np.concatenate([node[old], node[new]]).astype(np.int64), np.concatenate([d[old], found]), np.concatenate([np.zeros(len(old), np.int32), np.ones(len(new), np.int32)]), beam)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["q", "node", "d", "open"])


def _walk(starts: DataFrame, nodes: DataFrame, near: DataFrame, beam: int) -> DataFrame:
    """(q, node): the beam of every query (a node of the graph), itself with it."""
    parts = int(starts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    none = {"long": F.lit(None).cast("long"), "double": F.lit(None).cast("double"), "int": F.lit(0), "binary": F.lit(None).cast("binary")}
    vectors = starts.select(F.col("node").alias("q"), F.lit(0).alias("kind"), none["long"].alias("node"), none["double"].alias("d"), none["int"].alias("open"), "coarse")
    state = cut(starts.select(F.col("node").alias("q"), "node", F.lit(0.0).alias("d"), F.lit(1).alias("open")))
    while True:
        ahead = state.filter("open = 1").select("q", F.col("node").alias("u")).join(near, "u").select("q", F.explode("near").alias("node")).distinct()
        ahead = ahead.join(state.select("q", "node"), ["q", "node"], "left_anti").join(nodes.select("node", "coarse"), "node")
        rows = vectors.unionByName(state.select("q", F.lit(1).alias("kind"), "node", "d", F.lit(0).alias("open"), none["binary"].alias("coarse")))
        rows = rows.unionByName(ahead.select("q", F.lit(2).alias("kind"), "node", none["double"].alias("d"), none["int"].alias("open"), "coarse"))
        state = cut(map_arrow(rows.repartition(parts, "q").sortWithinPartitions("q", "kind"), partial(_advance, beam=beam), STATE))
        if not state.agg(F.sum("open")).first()[0]:
            return state.select("q", "node")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows: q, node, mine, exact."""
    for b in batches:
        if b.num_rows:
            d = np.sqrt(((_exact(b.column("exact")) - _exact(b.column("mine"))) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(d)], ["q", "node", "d"])


def beam_for(n: int) -> int:
    return BEAM + max(0, round(WIDER * np.log2(max(1, n) / 10_000)))


def search(vectors: DataFrame, is_query, k: int = K, beam: int | None = None, rounds: int = ROUNDS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of the rows (id, vector) that the condition on id picks."""
    if k > K:
        raise ValueError(f"at most {K} neighbours")
    rows = usable(vectors)
    nodes, members = nodes_of(rows)
    edges = build_graph(nodes, rounds)
    back = back_edges(edges, WALK_BACK)
    near = cut(edges.select("u", "c").unionByName(back.select("u", "c")).groupBy("u").agg(F.collect_set("c").alias("near")))  # DEGREE + WALK_BACK at most
    packed = map_arrow(rows.filter(is_query(F.col("id"))).select(F.col("id").alias("node"), "vector"), _pack, "node long, exact binary, coarse binary")
    own = cut(packed.select(F.col("node").alias("id"), "exact").join(nodes.select("node", "exact"), "exact").select("id", "node"))
    starts = cut(nodes.join(own.select("node").distinct(), "node"))
    found = _walk(starts.select("node", "coarse"), nodes, near, beam or beam_for(nodes.count()))
    met = found.join(nodes.select("node", "exact"), "node").join(starts.select(F.col("node").alias("q"), F.col("exact").alias("mine")), "q")
    measured = map_arrow(met.select("q", "node", "mine", "exact"), _measure, "q long, node long, d double")
    holders = own.withColumnRenamed("id", "query_id").withColumnRenamed("node", "q").join(measured, "q").join(members, "node").filter("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "id"))
    return holders.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), F.col("d").alias("score"))


def query(spark, sf_dir):
    """op5: the 10 nearest of every row whose id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return search(rows, lambda c: c % 100 == 0)
