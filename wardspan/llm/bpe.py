"""BPE encoding by per-prefix dynamic programming, and decoding.

For every prefix of a piece of text exactly one token can end its encoding. The tokens that end at a position are the suffix
matches of an automaton over the vocabulary. Of those, the right one is the one whose pair with the last token of the prefix
before it is compatible: merging the two tokens' bytes by rank gives these two tokens again, decided by undoing merges on
both sides of the seam until they contradict it or reach single bytes. Back-pointers from the end give the exact ids.

Pieces come from the tokenizer's split pattern; strings of special tokens are cut out before. Pieces repeat a lot, so each
Python worker remembers up to twice ``REMEMBERED`` pieces. The vocabulary file's path is a parameter; the file's content is
broadcast from the driver (its size is fixed by the tokenizer).

A null text is empty and has no ids. Invalid UTF-8 is read with replacement characters. Whole texts are encoded, whatever
their length; a piece's cost grows with its length times the tokens that match at a position. Repeated rows count each. An
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary, free_name, map_arrow, small_batches, table

#: Pieces that either half of a worker's memory holds, of at most so many characters each; pairs of tokens that it remembers.
REMEMBERED, REMEMBERED_CHARS, SEAMS = 120_000, 40, 200_000
# Fixed value: the split pattern of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts without characters from U+0100 on, with the classes written out: re is faster than regex.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_names() -> dict[str, int]:
    """The printable stand-ins that the vocabulary file has for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens by id, the two halves of each, the ranks of merges, and the automaton of suffix matches."""

    def __init__(self, file: str):
        spec = json.loads(file)
        names = byte_names()
        model = spec["model"]
        self.bytes: dict[int, bytes] = {i: bytes(names[c] for c in t) for t, i in model["vocab"].items()}
        ids = {t: i for i, t in self.bytes.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.made_at: dict[int, int] = {}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        for r, (a, b) in enumerate(merges):
            x, y = (ids[bytes(names[c] for c in side)] for side in (a, b))
            whole = ids[self.bytes[x] + self.bytes[y]]
            self.rank[x, y] = r
            self.halves[whole] = x, y
            self.made_at[whole] = r
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.single = {b: ids[bytes([b])] for b in range(256)}
        self.automaton = ahocorasick.Automaton()
        for i, t in self.bytes.items():
            if i not in self.special.values():
                self.automaton.add_word(t.decode("latin-1"), (i, len(t)))
        self.automaton.make_automaton()
        self.whole = {t: i for t, i in ids.items() if len(t) > 1}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.seams: dict[int, bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens by rank ends with the same two tokens."""
        key = left << 32 | right
        found = self.seams.get(key)
        if found is None:
            found = self._compatible(left, right)
            if len(self.seams) < SEAMS:
                self.seams[key] = found
        return found

    def _compatible(self, left: int, right: int) -> bool:
        # Seen backwards in time: a and b are the tokens at the seam before the merges of rank `now` and later were made.
        a, b, now = left, right, len(self.rank)
        made = self.made_at
        while True:
            across = self.rank.get((a, b))
            # The left of two equal merges comes first, so one across the seam wins a tie with one on its right.
            if across is not None and across < now:
                return False
            ra, rb = made.get(a, -1), made.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                now, a = ra, self.halves[a][1]
            else:
                now, b = rb + 1, self.halves[b][0]

    def _piece(self, data: bytes) -> tuple[int, ...]:
        n = len(data)
        if n == 1:
            return (self.single[data[0]],)
        last = [-1] * (n + 1)  # the token that ends the encoding of each prefix
        size = [0] * (n + 1)
        for end, (token, length) in self.automaton.iter(data.decode("latin-1")):
            at = end + 1
            if last[at] >= 0:
                continue
            before = at - length
            if before == 0 or (last[before] >= 0 and self.compatible(last[before], token)):
                last[at], size[at] = token, length
        out, at = [], n
        while at:
            out.append(last[at])
            at -= size[at]
        return tuple(reversed(out))

    def encode(self, text: str) -> bytes:
        """The ids, packed as little-endian unsigned 32-bit integers."""
        if not (self.special and any(x in text for x in self.special)):
            return self._part(text)
        return b"".join(self.special[x].to_bytes(4, "little") if x in self.special else self._part(x) for x in self.split.split(text))

    def _part(self, text: str) -> bytes:
        words = (LATIN if text.isascii() or max(text) < "\u0100" else self.pattern).findall(text)
        known, older = self.known, self.older
        distinct = set(words)
        new = distinct.difference(known)
        if not new:
            return b"".join(map(known.__getitem__, words))
        own = {w: older.get(w) or np.array(self._piece(w.encode()), "<u4").tobytes() for w in new}
        for w in distinct.difference(new):
            own[w] = known[w]
        if len(known) > REMEMBERED:  # frequent pieces come back from the older half
            self.older, self.known = known, {}
            known = self.known
        for w in new:
            if len(w) <= REMEMBERED_CHARS:
                known[w] = own[w]
        return b"".join(map(own.__getitem__, words))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace").encode()


_open: dict[str, Vocabulary] = {}


def vocabulary(file: str) -> Vocabulary:
    """One per process, by the file's digest."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _open:
        _open.clear()
        _open[key] = Vocabulary(file)
    return _open[key]


class _Encode:
    def __init__(self, file):
        self.file = file

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(self.file.value)
        for b in batches:
            ids, decoded, sizes = [], [], []
            for text in b.column("text").to_pylist():
                own = v.encode(text.decode("utf-8", "replace"))
                sizes.append(len(own) // 4)
                ids.append(own)
                decoded.append(v.decode(own))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["_row", "n_tokens", "ids", "decoded"])


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs without text, and beside: n_tokens, ids (little-endian unsigned 32-bit, packed) and decoded (the ids' text)."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(path or default_path(), encoding="utf-8") as f:
        file = spark.sparkContext.broadcast(f.read())
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names if c != "text"], F.lit(1).alias(free_name(names, "_one"))).alias("_row"), binary("text"))
    out = map_arrow(rows, _Encode(file), f"_row {rows.schema['_row'].dataType.simpleString()}, n_tokens long, ids binary, decoded binary")
    mine = ("n_tokens", "ids", "decoded", "text")
    return out.select(*[F.col("_row").getField(c).alias(c) for c in names if c.lower() not in mine], "n_tokens", "ids", F.col("decoded").cast("string").alias("decoded"))


def digests(encoded: DataFrame) -> DataFrame:
    hashed = [F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return encoded.select(*[c for c in encoded.columns if c not in ("ids", "decoded")], *hashed)


def query(spark, sf_dir):
    """op4: numbers of tokens and digests of ids and decoded texts."""
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
