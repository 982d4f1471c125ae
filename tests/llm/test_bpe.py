import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from wardspan.llm import bpe

LIBRARY = Tokenizer.from_file(bpe.default_path())
with open(bpe.default_path(), encoding="utf-8") as f:
    VOCABULARY = bpe.Vocabulary(f.read())


def ids(text):
    return np.frombuffer(VOCABULARY.encode(text), "<u4").tolist()


def check(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert ids(text) == want
    assert VOCABULARY.decode(VOCABULARY.encode(text)).decode() == LIBRARY.decode(want, skip_special_tokens=False)


@given(st.one_of(st.text(max_size=60), st.text(alphabet="abeht inos'\n\x1c\x85\xa0²é日😀.,!1A", max_size=120)))
@settings(max_examples=600, deadline=None)
def test_equals_library(text):
    check(text)


def test_special_and_long():
    for text in ("", "<|endoftext|>", "a<|endoftext|> b<|endoftext|>", "<|endoftext", "z" * 5000, "ab" * 3000 + " x", "  \n \t end  ", "don't I'LL"):
        check(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    monkeypatch.setattr(bpe, "SEAMS", 2)
    with open(bpe.default_path(), encoding="utf-8") as f:
        v = bpe.Vocabulary(f.read())
    text = "the quick brown fox jumps over the lazy dog and the quick cat " * 5
    for k in range(0, 300, 7):
        assert v.encode(text[k:]) == VOCABULARY.encode(text[k:])


def test_operator(spark):
    rows = [(1, "Hello wörld\n"), (2, None), (2, ""), (3, "<|endoftext|>"), (None, "日本" * 9000)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_tokens string").withColumn("_row", bpe.F.lit(1))
    out = bpe.digests(bpe.encode(df))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in out.collect()}
    want = set()
    for i, t in rows:
        own = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(own, skip_special_tokens=False).encode()).hexdigest()))
    assert got == want and "_row" in out.columns
    assert bpe.encode(df.limit(0)).count() == 0
