import zlib

import numpy as np

from wardspan.llm import quality

DOCS = "doc_id long, text string, score string"
LABELS = "doc_id long, quality int"
rng = np.random.default_rng(1)
SYLLABLES = "ther tion and ing ent ou re st".split()


def clean(n):
    return " ".join("".join(rng.choice(SYLLABLES, 3)) for _ in range(n)).capitalize() + "."


def junk(n):
    kind = rng.integers(0, 4)
    words = clean(n).split()
    return {0: " | ".join(words), 1: " ".join(w.upper() + "!!" for w in words), 2: " ".join(w + "***" for w in words), 3: " ".join(w for w in words[: n // 8] for _ in range(8))}[int(kind)]


def made(n):
    labels = rng.random(n) < 0.8
    return [(i, clean(60) if y else junk(60), "x") for i, y in enumerate(labels)], [(i, int(y)) for i, y in enumerate(labels)]


def test_held_out_accuracy_and_flags(spark):
    docs, labels = made(1200)
    out = quality.classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    assert sorted(out.columns) == ["doc_id", "held_out", "predicted", "score", "text"]
    truth, rows = dict(labels), out.collect()
    assert len(rows) == 1200
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    own = [r for r in rows if r["held_out"]]
    assert len(own) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in own]) > 0.97
    assert min(r["predicted"] for r in own if truth[r["doc_id"]]) == 1  # clean ones stay


def test_held_out_labels_change_nothing(spark):
    docs, labels = made(400)
    df = spark.createDataFrame(docs, DOCS)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.classify(df, spark.createDataFrame(x, LABELS)).collect()) for x in (labels, flipped))
    assert a == b


def test_cosines_are_exact():
    counts = quality.terms([t.encode() for _, t, _ in made(150)[0]])
    labels = np.array([i % 2 for i in range(150)])
    m = quality.Model(counts, labels, 0.5)
    x = m.unit(m.weigh(counts) @ m.project)
    for i in range(0, 150, 29):
        cosine = m.vectors.T @ x[i]
        near = np.argsort(-cosine)[: quality.NEIGHBOURS]
        w = np.maximum(cosine[near], 1e-6) ** quality.SHARPNESS * m.votes[near]
        assert np.isclose(m.score(counts[i : i + 1])[0], (w * labels[near]).sum() / w.sum(), atol=1e-4)


def test_blocks_count_alike(monkeypatch):
    texts = [b"", b"a", b"Ab 1!", "é日x".encode() * 50, b"one one two"] * 3
    whole = quality.terms(texts)
    monkeypatch.setattr(quality, "BLOCK_BYTES", 10)
    assert np.array_equal(quality.terms(texts), whole)
    assert whole[4][-2:].tolist() == [1, 2] and whole[0].sum() == 0


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", None), (3, "word " * 50_000, None), (3, "again", None)], DOCS)
    none = quality.classify(docs, spark.createDataFrame([], LABELS))
    assert [r["score"] for r in none.collect()] == [0.5] * 4
    ones = quality.classify(docs, spark.createDataFrame([(1, 1), (3, 1), (3, None), (9, 7), (None, 1)], LABELS))
    assert {r["score"] for r in ones.collect()} == {1.0}
    assert quality.classify(docs.limit(0), spark.createDataFrame([(1, 1), (3, 0)], LABELS)).count() == 0
