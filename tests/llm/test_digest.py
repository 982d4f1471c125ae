import hashlib

import numpy as np
import pytest

from wardspan.llm import digest

DOCS = "doc_id long, text string, fingerprint string"


def brute_code(data):
    padded = data + bytes(7)
    counts = [0] * digest.BUCKETS
    mask = 0xFFFFFFFF
    for i in range(len(data)):
        h = (padded[i] * 0x9E3779B1 ^ padded[i + 3] * 0x85EBCA77 ^ padded[i + 7] * 0xC2B2AE3D) & mask
        h = (h ^ h >> 15) * 0x2C1B3C6D & mask
        counts[(h ^ h >> 13) % digest.BUCKETS] += 1
    cuts = [sorted(counts)[k * digest.BUCKETS // 4 - 1] for k in (1, 2, 3)]
    return [min(255, int(np.floor(np.log1p(len(data)) * 10))), *(sum(c > q for q in cuts) for c in counts)]


TEXTS = [b"", b"a", "é日".encode(), b"some text that is somewhat longer than the others " * 9, b"\0\0\0"]


def test_codes(monkeypatch):
    want = [brute_code(t) for t in TEXTS]
    assert digest.codes(TEXTS).tolist() == want
    monkeypatch.setattr(digest, "BLOCK_BYTES", 5)
    assert digest.codes(TEXTS).tolist() == want
    said = digest.told(digest.codes(TEXTS))
    assert all(len(s) == 2 + digest.BUCKETS // 2 for s in said) and said[0] == "0" * 130


def test_likeness():
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(5000)]
    text = lambda: " ".join(rng.choice(words, 400)).encode()
    a, b = text(), text()
    c = a[: len(a) * 3 // 4] + b[: len(a) // 4]
    code = digest.codes([a, b, c])
    like = digest.likeness(code[[0, 0, 0]], code)
    assert like[0] == 1 and like[2] > 0.5 and like[2] > like[1] + 0.2 and like[1] >= 0
    assert np.array_equal(digest.likeness(code, code[::-1]), digest.likeness(code[::-1], code))


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_next(spark, partitions):
    rng = np.random.default_rng(2)
    rows = [(int(i) * 3 - 50, "wörd " * int(n), "x") for i, n in zip(rng.permutation(60), rng.integers(0, 90, 60), strict=True)]
    rows += [(500, None, "x"), (None, "first", None), (501, "y" * 150_000, "x"), (7000, "same", "x"), (7000, "same", "x"), (7000, "ever", "x")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in digest.with_next(spark.createDataFrame(rows, DOCS)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    ordered = sorted(((i is not None, i or 0, (t or "").encode()) for i, t, _ in rows))
    want = []
    for k, (there, i, t) in enumerate(ordered):
        own, following = t.decode(), ordered[(k + 1) % len(ordered)][2].decode()
        cut = len(own) // 4
        made = (own[: len(own) - cut] + following[:cut]).encode()
        code = digest.codes([t, made, following.encode()])
        a, b, _ = digest.told(code)
        want.append((there, i, len(own), hashlib.sha256(made).hexdigest(), a, b, digest.likeness(code[:1], code[1:2])[0], digest.likeness(code[:1], code[2:])[0]))
    assert got == sorted(want)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], DOCS)
    assert digest.with_next(empty).count() == 0 and digest.fingerprints(empty).count() == 0
    r = digest.with_next(spark.createDataFrame([(1, "abcdefgh", None)], DOCS)).first()
    assert r["near_next"] == 1 and r["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert digest.fingerprints(spark.createDataFrame([(1, "abcdefgh", None)], DOCS)).first()["fingerprint"] == r["fingerprint"]
