import math

from pyspark.sql import functions as F

from wardspan.llm import mixing

DOCS = "doc_id long, text string, source string, size string"


def brute_targets(sizes):
    """sizes: source -> size; by raising the level step by step."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] for s in capped} | share
        capped |= over
        if len(capped) == len(names):
            return {s: 3.0 * sizes[s] for s in names}


def documents():
    rows = []
    for s, n in (("a", 3), ("b", 40), ("B", 200), ("é", 25), (None, 30), ("zero", 4), ("z", 900)):
        for k in range(n):
            rows.append((len(rows), "word " * (0 if s == "zero" else 1 + k * 7 % 23), s, "x"))
    return rows


def test_targets(spark):
    rows = documents()
    df = spark.createDataFrame(rows, DOCS).select("source", mixing.n_words("text").alias("size"))
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(math.isclose(got[s], want[s], rel_tol=1e-12, abs_tol=1e-9) for s in want)
    assert math.isclose(sum(got.values()), sum(sizes.values()))


def test_plan_and_mix_agree(spark):
    df = spark.createDataFrame(documents(), DOCS)
    plan = {r["doc_id"]: r for r in mixing.mix_plan(df).collect()}
    per = {}
    for i, t, s, _ in documents():
        r = plan[i]
        assert r["size"] == len(t.split()) and 0 <= r["copies"] <= 3 and r["taken"] == r["copies"] * r["size"]
        per.setdefault(s, [0, r["target"]])[0] += r["taken"]
    assert all(abs(took - goal) <= 30 for took, goal in per.values())
    out = mixing.mix(df)
    assert out.columns == df.columns
    counts = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert counts == {i: r["copies"] for i, r in plan.items() if r["copies"]}
    again = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(df.repartition(7)).collect()}
    assert again == {i: r["copies"] for i, r in plan.items()}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a", "x"), (None, " \n", None, "x")], DOCS)
    assert [(r["size"], r["target"], r["taken"]) for r in mixing.mix_plan(blank).collect()] == [(0, 0.0, 0)] * 2
    same = spark.createDataFrame([(1, "a b c", "s", "x")] * 5, DOCS)
    assert mixing.mix_plan(same).agg(F.sum("taken")).first()[0] == 15


def test_query_matches_sql(spark, sf_dir):
    from helpers import same_as_sql

    same_as_sql(mixing.query(spark, sf_dir), mixing.ORACLE, sf_dir)
