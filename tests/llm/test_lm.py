import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from wardspan.llm import lm

DOCS = "doc_id long, text string, score int"


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def symbols(text):
    return [*b" ".join(t.encode() for t in tokens(text)[:-1]), lm.END]


def brute_ppm(training, text, nodes):
    """Walk the contexts from the longest kept one, symbol by symbol."""
    first, later = defaultdict(Counter), defaultdict(lambda: defaultdict(set))
    for t in training:
        past = [lm.START] * lm.ORDER
        for s in symbols(t):
            for k in range(lm.ORDER + 1):
                context = tuple(past[len(past) - k :]) if k else ()
                first[context][s] += 1
                later[context][s].add(past[-k - 1] if k < lm.ORDER else None)
            past = [*past[1:], s]
    kept = set(sorted(first, key=lambda c: (-sum(first[c].values()), len(c), c))[:nodes]) | {()}
    total = 0.0
    past = [lm.START] * lm.ORDER
    for s in symbols(text):
        k = max(k for k in range(lm.ORDER + 1) if (tuple(past[len(past) - k :]) if k else ()) in kept)
        excluded, p, level = set(), 1.0, 0
        while True:
            context = tuple(past[len(past) - k :]) if k else ()
            counts = {x: n for x, n in first[context].items()} if level == 0 else {x: (len(m) if len(context) < lm.ORDER else first[context][x]) for x, m in later[context].items() if x not in excluded}
            n, d = sum(counts.values()), len(counts)
            if s in counts:
                p *= (counts[s] - lm.DISCOUNT) / n
                break
            if d:
                p *= lm.DISCOUNT * d / n
            excluded |= set(first[context])
            if k == 0:
                p /= lm.SYMBOLS - len(excluded)
                break
            k, level = k - 1, level + 1
        total += math.log10(p)
        past = [*past[1:], s]
    return total


TEXTS = ["The cat sat on the mat and the cat ate", "the dog sat", "a cat", None, "", " \n", "Thé cät  sat\ton", "zzz unseen q", "the cat sat on the mat " * 60, "mat cat"] * 2


@pytest.mark.parametrize("nodes", [100_000, 40])
def test_brute_force(spark, monkeypatch, nodes):
    monkeypatch.setattr(lm, "NODES", nodes)
    monkeypatch.setattr(lm, "COMMON", 3)
    rows = list(enumerate(TEXTS))
    out = {r["doc_id"]: r for r in lm.score(spark.createDataFrame([(*r, 0) for r in rows], DOCS)).collect()}
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(x for t in training for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    for i, t in rows:
        r, own = out[i], tokens(t)
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 5 == 1, len(own), sum(counts[x] > 0 for x in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in own), rel_tol=1e-9)
        assert math.isclose(r["score"], brute_ppm(training, t, nodes), rel_tol=1e-4)
        assert r["score"] < 0


def test_probabilities_add_up(spark):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], DOCS)
    trie = lm.train(df)[1]
    p = 10.0 ** trie.logs.reshape(-1, trie.width).astype(float)
    p[:, trie.symbol[lm.START]] = 0  # never predicted
    assert np.allclose(p[:, :-1].sum(axis=1) + p[:, -1] * (lm.SYMBOLS - (trie.width - 2)), 1, atol=1e-5)


def test_pieces_and_blocks_walk_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], DOCS)
    trie = lm.train(df)[1]
    texts = [lm.words((t or "").encode()) for t in TEXTS]
    whole = trie.score(texts)
    monkeypatch.setattr(lm, "PIECE", 5)
    monkeypatch.setattr(lm, "BLOCK_BYTES", 30)
    assert np.allclose(trie.score(texts), whole, atol=1e-9)


def test_odd_tables(spark):
    assert lm.score(spark.createDataFrame([], DOCS)).count() == 0
    alone = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(alone, "no training at all", 0)], DOCS)).first()
    assert (r["n_known"], r["train_tokens"], r["n_tokens"]) == (0, 0, 5)
    assert math.isclose(r["base_score"], 5 * math.log10(0.5 / 0.5)) and math.isclose(r["score"], -19 * math.log10(lm.SYMBOLS), rel_tol=1e-6)
    out = lm.score(spark.createDataFrame([(None, "x", 0), (5, "x", 0), (5, "x", 0), (6, "y " * 100_000, 0)], DOCS))
    assert out.count() == 4


def test_all_contexts_are_kept(spark):
    """More contexts than a table of 65,536 holds, in many shards."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join("".join(rng.choice(list("abcdefghijklmnopqrst"), 7)) for _ in range(300))) for i in range(30)]
    training = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    seen = {(k, t[at - k : at]) for t in training for at in range(len(t)) for k in range(min(at, lm.ORDER) + 1)}
    assert len(seen) > 65_536
    out = {r["doc_id"]: r["score"] for r in lm.score(spark.createDataFrame([(*r, 0) for r in rows], DOCS)).collect()}
    held = next(i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 1)
    for i in (held, next(i for i, t in rows if t in training)):
        assert math.isclose(out[i], brute_ppm(training, rows[i][1], 10**9), rel_tol=1e-4)


def test_shards_answer_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)], DOCS)
    whole = {r["doc_id"]: r["score"] for r in lm.score(df).collect()}
    monkeypatch.setattr(lm, "SHARD_BYTES", 40)
    assert all(math.isclose(r["score"], whole[r["doc_id"]], rel_tol=1e-6) for r in lm.score(df).collect())
