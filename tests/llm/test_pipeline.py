import hashlib

import numpy as np
import pytest
from test_line_dedup import brute as brute_lines
from test_simhash import brute_kept

corpus_pipeline = pytest.importorskip("corpus_pipeline")
import __spark_entry__  # noqa: E402
from wardspan.llm import mixing, simhash  # noqa: E402
from wardspan.llm.common import cut  # noqa: E402


def test_stages(spark, sf_dir):
    """Each stage against a plain version of it on the same input."""
    from tokenizers import Tokenizer

    from wardspan.llm import bpe, quality

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    good, lines, near, mixed, encoded = (f for _, f in corpus_pipeline.STAGES)
    before = {r["doc_id"]: r for r in docs.collect()}

    one = cut(good(spark, docs, sf_dir))
    assert one.columns == names
    kept = {r["doc_id"] for r in one.collect()}
    scored = {r["doc_id"]: r["predicted"] for r in quality.query(spark, sf_dir).collect()}
    assert kept == {i for i, p in scored.items() if p}
    assert all(i in kept for i, y in labels.items() if y) and np.mean([i not in kept for i, y in labels.items() if not y]) > 0.9

    two = cut(lines(spark, one, sf_dir))
    assert two.columns == names
    got = {r["doc_id"]: r for r in two.collect()}
    assert {i: r["text"] for i, r in got.items()} == {i: t for i, _, _, t in brute_lines([(i, before[i]["text"]) for i in kept])}
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())

    three = cut(near(spark, two, sf_dir))
    assert three.columns == names
    budget = simhash.similar_bits(simhash.SIMILARITY, simhash.WIDE)[1]
    assert {r["doc_id"] for r in three.collect()} == brute_kept([(i, r["text"]) for i, r in got.items()], budget)

    four = cut(mixed(spark, three, sf_dir))
    assert four.columns == names
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(three).collect()}
    assert {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()} == {i: c for i, c in plan.items() if c}

    library = Tokenizer.from_file(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in four.collect()}
    for r in encoded(spark, four, sf_dir).collect():
        own = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == own and r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
    assert corpus_pipeline.run(spark, sf_dir).count() == four.count()


def test_odd_documents(spark, sf_dir):
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "a", 0), (None, "word " * 500, None, "a", 2500), (3, "word " * 40_000, "en", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("_row", mixing.F.lit("mine"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() <= len(rows) * 3
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == len(rows)


def test_registered():
    found = __spark_entry__.queries()
    assert "pipeline" in found and all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(found)
