import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from wardspan.llm import line_dedup

LONG = "This very line is repeated in a lot of documents, all of them"


def brute(rows, min_chars=40, min_docs=5):
    held = defaultdict(list)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line))
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k].append(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i != max(held[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


ROWS = [
    *[(i, f"own line {i}\n  {LONG if i % 2 else LONG.upper()}\t\n\n" + ("é" * 40 if i < 6 else "é" * 39) + "\n" + LONG) for i in range(8)],
    (8, None), (9, ""), (10, "\n\n"), (11, "x" * 200_000 + "\n" + LONG), (-3, LONG), (12, "four times only, this line isn't repeated enough"), (13, "four times only, this line isn't repeated enough"),
]


@pytest.mark.parametrize(("limit", "shard"), [(line_dedup.BROADCAST_BYTES, 65_536), (0, 65_536), (0, 1), (line_dedup.BROADCAST_BYTES, 1)])
def test_brute_force(spark, limit, shard):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = line_dedup.dedup_lines(df, broadcast_bytes=limit, shard_keys=shard)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == brute(ROWS)


def test_clashing_columns_repeats_and_nulls(spark):
    rows = [(i, LONG, "a") for i in (1, 2, 3, 4, 7, 7)] + [(None, LONG, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").withColumn("n_lines", line_dedup.F.lit(99)).withColumn("_row", line_dedup.F.lit(0))
    out = line_dedup.dedup_lines(df)
    got = sorted(((r["doc_id"], r["n_dropped"]) for r in out.collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (7, 0), (7, 0), (None, 1)], key=str)
    assert set(out.columns) == {"doc_id", "text", "kept", "_row", "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, np.uint64))
    p = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(p.places(keys)) == list(range(len(keys)))
    strangers = p.places(np.arange(100, dtype=np.uint64))
    assert strangers.min(initial=-1) >= -1 and strangers.max(initial=-1) < max(1, len(keys))


def test_shard_with_equal_first_hashes():
    import pyarrow as pa

    t = pa.table({"h1": pa.array([5, 5, 6], pa.int64()), "h2": pa.array([1, 2, 1], pa.int64()), "n": pa.array([5, 6, 7], pa.int64()), "keep": pa.array([1, None, 3], pa.int64()), "shard": pa.array([0, 0, 0], pa.int64())})
    asked = np.array([5, 5, 6, 5, 9], np.uint64), np.array([1, 2, 1, 3, 1], np.uint64)
    for min_docs, some in ((5, [True, True, True, False, False]), (6, [False, True, True, False, False]), (300, [False] * 5)):  # the counts tell
        row = line_dedup._build_shard(t, min_docs).to_pylist()[0]
        s = line_dedup.Shard(row["index_salt"], row["perfect"], row["prints"], row["counts"], row["keep"], min_docs)
        known, keep = s.keepers(*asked)
        assert known.tolist() == some and keep.tolist() == [k for k, x in zip([1, line_dedup.NO_ID, 3], some, strict=False) if x]
    assert row["asked"] == 18


def test_shards_in_parts(spark, monkeypatch):
    """Shards that are asked often go to several tasks."""
    monkeypatch.setattr(line_dedup, "ASKED", 3)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    out = line_dedup.dedup_lines(df, broadcast_bytes=0, shard_keys=3)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect()) == brute(ROWS)


def test_query_matches_sql(spark, sf_dir):
    from helpers import same_as_sql

    same_as_sql(line_dedup.query(spark, sf_dir), line_dedup.ORACLE, sf_dir)
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
