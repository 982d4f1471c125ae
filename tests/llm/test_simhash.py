import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from wardspan.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(prints))]


@given(st.text(alphabet="aB é\t\n\x0b日x", max_size=80))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(simhash.shingle_hashes(text.encode())) == brute_fingerprint(text)


@pytest.mark.parametrize("seed", range(4))
def test_trie_join_connects_what_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 12, np.uint64)
    keys = np.unique(np.concatenate([base, *(base ^ (np.uint64(1) << rng.integers(0, 64, 12, np.uint64)) for _ in range(12)), *(base ^ (np.uint64(3) << rng.integers(0, 62, 12, np.uint64)) for _ in range(6))]))
    made = simhash.trie_self_join(keys.reshape(-1, 1), 2, np.array([0]))
    assert all((int(keys[a]) ^ int(keys[b])).bit_count() <= 2 for a, b in made)
    want = brute_components([int(k) for k in keys])
    parent = list(range(len(keys)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in made:
        x, y = root(int(a)), root(int(b))
        assert x != y  # a forest
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(keys))] == want


def near_rows():
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(25):
        text = [words[k] for k in rng.integers(0, 400, 300)]
        for c in range(4):
            own = list(text)
            own[int(rng.integers(0, 300))] = f"edit{i}{c}"
            rows.append((len(rows), " ".join(own)))
    return rows + [(100, None), (101, ""), (102, " \n"), (103, "one"), (104, "One"), (105, "one two"), (106, rows[0][1]), (107, "long " * 30_000)]


@pytest.mark.parametrize("subtree", [1 << 16, 2])
def test_components(spark, monkeypatch, subtree):
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    rows = near_rows()
    prints = [brute_fingerprint(t) for _, t in rows]
    roots = brute_components(prints)
    want = {i: (f"{p:016x}", r) for (i, _), p, r in zip(rows, prints, roots, strict=True)}
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: (f"{r['fp'] & (2**64 - 1):016x}", r["component_id"]) for r in out.collect()}
    assert got == want


def brute_wide(text, bits=simhash.WIDE):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))] if words else []
    first = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    fp = 0
    for k in range(bits // 64):
        hashes = [int(h) for h in (simhash.mixed(first, k) if k else first)]
        fp |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << 64 * k
    return fp, set(shingles)


def brute_kept(rows, budget):
    """Ids that stay of rows with distinct ids."""
    prints = [brute_wide(t)[0] for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= budget and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    return {min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root)}


def test_fingerprints_of_many_texts():
    rng = np.random.default_rng(1)
    texts = ["", "one", "a b c d e", *(" ".join(f"w{k}" for k in rng.integers(0, 50, n)) for n in (6, 68, 69, 70, 400, 9000))]
    hashes = [simhash.shingle_hashes(t.encode(), 5) for t in texts]
    found = simhash.fingerprints_of(hashes, simhash.WIDE)
    assert [sum(int(w) << 64 * k for k, w in enumerate(row)) for row in found] == [brute_wide(t)[0] for t in texts]
    assert simhash.fingerprints_of([], simhash.WIDE).shape[0] == 0


def test_long_texts_in_pieces(monkeypatch):
    text = ("one two\tthree  four five six\n" * 50).encode()
    whole = {n: simhash.shingle_hashes(text, n) for n in (3, 5)}
    for piece in (1, 7, 40):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert all((simhash.shingle_hashes(text, n) == whole[n]).all() for n in whole)


@pytest.mark.parametrize("seed", range(3))
def test_wide_trie_join_connects_what_brute_force_does(seed):
    rng = np.random.default_rng(seed)
    keys = rng.integers(0, 1 << 63, (30, 2), np.uint64)
    near = np.repeat(keys, 8, axis=0)
    for row in near:
        for b in rng.integers(0, 128, int(rng.integers(0, 9))):
            row[b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    keys = np.unique(np.concatenate([keys, near]), axis=0)
    ints = [int(a) << 64 | int(b) for a, b in keys]
    made = simhash.trie_self_join(keys, 9, np.array([0]))
    roots = list(range(len(keys)))
    for a, b in made:
        assert (ints[a] ^ ints[b]).bit_count() <= 9 and roots[a] != roots[b]
        roots = [roots[a] if r == roots[b] else r for r in roots]
    for i in range(len(ints)):
        for j in range(i):
            assert roots[i] == roots[j] or (ints[i] ^ ints[j]).bit_count() > 9


@pytest.mark.parametrize("subtree", [1 << 16, 20])
def test_keep_one_of_similar_texts(spark, monkeypatch, subtree):
    """Groups of near copies (0.85 or more alike) leave one; texts that are 0.6 alike or less, and unlike ones, stay."""
    monkeypatch.setattr(simhash, "SUBTREE", subtree)
    rng = np.random.default_rng(5)
    texts = []
    for _ in range(12):
        base = [f"w{k}" for k in rng.integers(0, 3000, 400)]
        texts.append((" ".join(base), True))
        for edits, same in ((1, True), (3, True), (6, True), (40, False)):
            own = list(base)
            for at in rng.choice(400, edits, replace=False):
                own[at] = f"x{rng.integers(0, 10**6)}"
            texts.append((" ".join(own), same))
    rows = [(i, t) for i, (t, _) in enumerate(texts)]
    got = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i for i, (_, same) in enumerate(texts) if i % 5 == 0 or not same} == brute_kept(rows, simhash.similar_bits(0.8, simhash.WIDE)[1])


def test_keep_one_tells_rows_without_or_with_one_id_apart(spark):
    texts = ["the first of them speaks of ships and harbours", "another one is about bread and its baking", "the third tells how clocks were made", "gardens in winter need little work", "a fifth text on the price of wool", "and a last one about bridges"]
    rows = list(zip([None, None, None, 7, 7, 9], texts, strict=True))
    df = spark.createDataFrame([*rows, (None, texts[0]), (7, texts[3]), (12, texts[0])], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect())
    assert got == sorted([(12, texts[0]), (0, texts[1]), (0, texts[2]), (7, texts[3]), (7, texts[4]), (9, texts[5])])


def test_keep_one_and_odd_tables(spark):
    rows = [(5, "a b c d", "x", None, 1), (2, "A b c d", "x", "s", 1), (2, "A b c d", "x", "s", 1), (9, None, None, None, None), (None, "", None, None, None), (7, "quite another text", "x", "s", 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], DOCS + ", fp int").withColumnRenamed("fp", "component_id")
    for own in (df, df.withColumnRenamed("component_id", "_key"), df.withColumnRenamed("component_id", "_row")):
        out = simhash.keep_one(own)
        assert out.columns == own.columns
        assert sorted(r["doc_id"] for r in out.collect()) == [2, 7, 9]
    assert simhash.keep_one(df.limit(0)).count() == 0 and simhash.near_duplicates(df.limit(0)).count() == 0


def test_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
