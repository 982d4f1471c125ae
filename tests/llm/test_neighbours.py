import math

import numpy as np
import pytest

from wardspan.llm import neighbours

ROWS = "id long, vector array<float>, rank int"


def brute(rows, k=10):
    """Exact results for ids divisible by 100."""
    out = {}
    for q, v, _ in rows:
        if q % 100 == 0:
            d = sorted((math.sqrt(sum((np.float32(a).item() - np.float32(b).item()) ** 2 for a, b in zip(v, w, strict=True))), i) for i, w, _ in rows if i != q)
            out[q] = d[:k]
    return out


def found(spark, rows, **more):
    out = {}
    for r in neighbours.search(spark.createDataFrame(rows, ROWS), lambda c: c % 100 == 0, **more).collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["score"], r["vec_id"])
    return {q: [v[i] for i in range(1, len(v) + 1)] for q, v in out.items()}


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 100)
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 12))
    rows = [(i, [float(np.float32(v)) for v in x[i]], 0) for i in range(1500)]
    want, got = brute(rows), found(spark, rows)
    assert got.keys() == want.keys()
    hits = [len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want]
    assert np.mean(hits) / 10 > 0.95
    for q, own in got.items():
        assert own == sorted(own) and len(own) == 10
        exact = {i: d for d, i in brute([r for r in rows if r[0] == q or r[0] in {i for _, i in own}])[q]}
        assert all(math.isclose(d, exact[i], rel_tol=1e-12) for d, i in own)


def test_copies_ties_and_odd_vectors(spark):
    one, two = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(i, one, 0) for i in range(100, 140)] + [(200, two, 0), (201, [0.0, 0.0, 2.0], 0), (200, two, 0), (300, [9.0, 9.0], 0), (400, None, 0), (500, [0.0, 0.0, 0.0], 0), (600, [1.0, float("nan"), 0.0], 0), (700, [1.0, None, 0.0], 0), (None, one, 0), (800, [float("inf"), 0.0, 0.0], 0)]
    got = found(spark, rows)
    assert got.keys() == {100, 200}
    assert got[100] == [(0.0, i) for i in range(101, 111)]
    assert got[200] == [(math.sqrt(2), i) for i in range(100, 110)]


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few(spark, n):
    rows = [(100 * i, [float(i + 1), 1.0], 0) for i in range(n)]
    got = found(spark, rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == ({} if n < 2 else {0: [100, 200], 100: [0, 200], 200: [100, 0]})


def test_rounds_make_the_graph(spark, monkeypatch):
    """Neighbours of neighbours find what the trees' leaves do not."""
    monkeypatch.setattr(neighbours, "LEAF", 24)
    monkeypatch.setattr(neighbours, "TREES", 1)
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1200, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, x[i].tolist(), 0) for i in range(len(x))], ROWS)
    nodes, _ = neighbours.nodes_of(neighbours.usable(df))
    d = ((x[:, None].astype(float) - x[None].astype(float)) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    true = np.argsort(d, axis=1)[:, :10]

    def recall(rounds):
        near = {}
        for r in neighbours.build_graph(nodes, rounds).collect():
            near.setdefault(r["u"], []).append((r["d"], r["c"]))
        return np.mean([len({c for _, c in sorted(near.get(i, []))[:10]} & set(true[i].tolist())) for i in range(len(x))]) / 10

    assert recall(0) < 0.5 and recall(neighbours.ROUNDS) > 0.9


def test_places_are_cut_to_leaves(spark, monkeypatch):
    """Leaves hold every node of a place once, however many there are, copies of one vector too."""
    x = np.random.default_rng(1).standard_normal((1000, 4)).astype(np.float32)
    for rows in (x, np.ones((1000, 4), np.float32)):
        leaves = list(neighbours._leaves(rows, 3, 60))
        assert sorted(np.concatenate(leaves).tolist()) == list(range(1000)) and max(map(len, leaves)) <= 60
    monkeypatch.setattr(neighbours, "PLACE", 50)
    monkeypatch.setattr(neighbours, "LEAF", 30)
    rows = [(i * 20, [float(v) for v in x[i]], 0) for i in range(400)]
    want, got = brute(rows), found(spark, rows)
    assert np.mean([len({i for _, i in want[q]} & {i for _, i in got[q]}) for q in want]) > 9.5


def test_hubs_are_reduced_before_the_shuffle(spark):
    """A node that all others are near to sends few rows."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(5000, np.int64)), pa.array(np.arange(5000)), pa.array(np.arange(5000, 0, -1).astype(float)), pa.array(np.ones(5000, np.int32))], ["u", "c", "d", "fresh"])
    out = list(neighbours._fewer(iter([batch] * 3), 16))
    assert sum(b.num_rows for b in out) == 16 and out[0].column("c").to_pylist() == list(range(4999, 4983, -1))


def test_negative_zeros(spark):
    rows = [(100, [-0.0, 1.0], 0), (200, [0.0, 1.0], 0), (300, [1.0, -0.0], 0), (1, [2.0, -0.0], 0)]
    got = found(spark, rows)
    assert {q: [i for _, i in v] for q, v in got.items()} == {100: [200, 300, 1], 200: [100, 300, 1], 300: [1, 100, 200]}
