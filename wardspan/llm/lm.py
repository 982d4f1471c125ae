"""Language-model scores: a word base line and prediction by partial matching.

Both models learn from all training documents. What they score is a text's tokens: words, A-Z lower-cased, then one end.

Base: add-half counts of tokens. Counts of all words are aggregated in Spark; the ``COMMON`` most frequent are broadcast (a
fixed number), a document's other words meet their counts in a join of numbers and words, never of texts.

Model: the words' bytes joined by one blank each, and an end, are predicted one by one from up to ``ORDER`` bytes before them. All
strings of ``ORDER + 1`` symbols of all training documents are counted, and every context that was seen is kept. A symbol that a
context has seen gets the share of its count less ``DISCOUNT``; the discounts are the escape, which leads to the next shorter
context, where the symbols already seen are excluded, down to equal shares of all symbols.

So a symbol's code length depends on its string of ``ORDER + 1`` symbols only. Texts are gathered to blocks, and each block asks
for its distinct strings. The counts are dealt to shards by the three bytes before the symbol, so a shard has all its contexts of
three bytes and more; their number grows with the input. Shorter contexts (as many as the alphabet makes at most) are counted
first and known to all. A shard answers the strings that blocks ask for, and the answers meet the blocks' texts again.

A null or empty text has one token, its end. Without training documents counts are 0 and all symbols are alike. A null id is
dealt by the hash of the empty text. Repeated rows count each. Words equally frequent are common in the order of their bytes. A
text is read whole and is never parted between blocks; a long one takes memory of some thirty times its size in its worker. Other
columns are not read. An empty table gives an empty result.

The base line gives every unknown word one and the same share, however it is spelled; the model spells it. Where many words are
unknown (small tables) the base line is the higher one for that reason.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, cut, lean, map_arrow, small_batches, table

ORDER, COMMON = 5, 150_000
#: The most frequent contexts that a caller wants kept; None keeps all.
NODES: int | None = None
#: Contexts of so many bytes at most are known to all shards.
LOW = 2
#: Bytes of texts that ask for their strings together; bytes of texts for which there is a shard.
ASKING, SHARD_BYTES = 8 << 20, 8 << 20
#: Symbols are bytes; of those that no word holds, one blank parts words, one is the end and one pads the start.
BLANK, END, START = 32, 10, 13
SYMBOLS = 256 - 6 + 2
#: Share of one that each kind of symbol seen gives to the escape.
DISCOUNT = 0.3
BITS = 8
PIECE = 512
#: Words that a task counts before it hands them on.
HELD = 400_000
BLOCK_BYTES = 1 << 20
_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def words(text: bytes) -> list[bytes]:
    own = text.translate(_BLANK).lower().split(b" ")
    return [w for w in own if w] if b"" in own else own


def _joined(text: bytes | list[bytes]) -> bytes:
    """A text's words by one blank each; they may be joined already."""
    return text if isinstance(text, bytes) else b" ".join(text)


def _symbols(texts: list[bytes] | list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Each text as ORDER pads, its bytes and the end; and where each begins, with the total last."""
    joined = [_joined(t) for t in texts]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    data = np.frombuffer(b"".join([bytes([START]) * ORDER + j + b"\0" for j in joined]), np.uint8).astype(np.int64)
    ends = np.cumsum(sizes + ORDER + 1)
    data[ends - 1] = END
    return data, np.concatenate([[0], ends])


def _strings(texts: list[list[bytes]]) -> np.ndarray:
    """All strings of ORDER + 1 symbols that end within a text, oldest symbol on top, in the order of the texts."""
    data, begin = _symbols(texts)
    code = np.zeros(len(data) - ORDER, np.int64)
    for k in range(ORDER + 1):
        code = code << BITS | data[k : k + len(code)]
    own = np.ones(len(code), bool)
    for k in range(ORDER):  # those that reach over an end
        at = begin[1:-1] - ORDER + k
        own[at] = False
    return code[own]


def _grams(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of these strings, and their counts."""
    code = np.sort(_strings(texts))
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.diff(np.append(first, len(code)))


def _merge(a, b):
    if a is None:
        return b
    code, n = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first)


def _blocks(texts: list[bytes] | list[list[bytes]]) -> Iterator[list]:
    block, size = [], 0
    for t in texts:
        own = len(_joined(t)) + 1
        if block and size + own > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(t)
        size += own
    if block:
        yield block


def _shard(code: np.ndarray, shards: int) -> np.ndarray:
    """By the three bytes before the symbol."""
    return (code >> BITS & 0xFFFFFF) * 40_503 % 16_777_213 % shards


def _planes(x: np.ndarray) -> bytes:
    """Longs, all first bytes first: high bytes are mostly alike, which files and shuffles then compress."""
    return x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _longs(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


_GATHERED = pa.schema([("block", pa.int64()), ("doc_id", pa.int64()), ("text", pa.binary()), ("word", pa.binary()), ("n", pa.int64()), ("shard", pa.int32()), ("codes", pa.binary()), ("counts", pa.binary())])
GATHERED = "block long, doc_id long, text binary, word binary, n long, shard int, codes binary, counts binary"


def _gathered(size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(size, f.type)).cast(f.type) for f in _GATHERED], schema=_GATHERED)


def _gather(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """Four kinds of rows: texts with their block; counts of training words; a block's strings by shard, with training counts; and
    (of no shard) the strings of LOW + 2 symbols that are in its training texts, which are few, with their counts."""
    seen: Counter[bytes] = Counter()
    block, size = TaskContext.get().partitionId() << 32, 0
    training: list[bytes] = []
    others: list[bytes] = []

    def told_words():
        return _gathered(len(seen), word=pa.array(list(seen), pa.binary()), n=pa.array(list(seen.values()), pa.int64()))

    def told_grams():
        grams = None
        for part in _blocks(training):
            grams = _merge(grams, _grams(part))
        for part in _blocks(others):
            code, n = _grams(part)
            grams = _merge(grams, (code, np.zeros_like(n)))
        code, n = grams
        if (n > 0).any():
            few, times, _ = _shorter(code[n > 0], n[n > 0], LOW + 1)
            yield _gathered(1, codes=pa.array([_planes(np.diff(few, prepend=0))], pa.binary()), counts=pa.array([_planes(times)], pa.binary()))
        shard = _shard(code, shards)
        order = np.argsort(shard, kind="stable")
        code, n, shard = code[order], n[order], shard[order]
        starts = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
        ends = np.append(starts[1:], len(code))
        codes = [_planes(np.diff(code[i:j], prepend=0)) for i, j in zip(starts, ends, strict=True)]
        counts = [_planes(n[i:j]) for i, j in zip(starts, ends, strict=True)]
        yield _gathered(len(starts), block=pa.array([block] * len(starts), pa.int64()), shard=pa.array(shard[starts]), codes=pa.array(codes, pa.binary()), counts=pa.array(counts, pa.binary()))

    lean()
    for b in batches:
        held = b.column("held").to_pylist()
        texts: list[bytes] = []
        lo = 0
        for i, (text, h) in enumerate(zip(b.column("text"), held, strict=True)):
            own = words(text.as_py())
            if not h:
                seen.update(own)
            texts.append(b" ".join(own))
            (others if h else training).append(texts[-1])
            size += len(texts[-1]) + 1 + ORDER
            if size > ASKING or i + 1 == len(held):
                yield _gathered(len(texts), block=pa.array([block] * len(texts), pa.int64()), doc_id=b.column("doc_id").slice(lo, len(texts)), text=pa.array(texts, pa.binary()))
                texts, lo = [], i + 1
            if size > ASKING:
                yield from told_grams()
                training, others, size, block = [], [], 0, block + 1
                lean()
        if len(seen) > HELD:
            yield told_words()
            seen.clear()
    if seen:
        yield told_words()
    if training or others:
        yield from told_grams()


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of each key of a partition that is sorted by it."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = b.column(key).to_numpy()
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for i, j in zip(starts, np.append(starts[1:], len(keys)), strict=True):
            if held and keys[i] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(keys[i])
            held.append(b.slice(i, j - i))
    if held:
        yield now, pa.Table.from_batches(held)


def _shorter(code: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings with contexts of k bytes, from those one byte longer: how often, and after how many."""
    code = code & ((1 << BITS * (k + 1)) - 1)
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    if not len(code):
        return code, n, n
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    return code[first], np.add.reduceat(n, first), np.diff(np.append(first, len(code)))


def _high(t: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A shard's strings by the length of the context, down to LOW (which other shards add to)."""
    grams = None
    for codes, counts in zip(t.column("codes").to_pylist(), t.column("counts").to_pylist(), strict=True):
        code, n = np.cumsum(_longs(codes)), _longs(counts)
        if (n > 0).any():
            grams = (code[n > 0], n[n > 0]) if grams is None else tuple(np.concatenate(x) for x in zip(grams, (code[n > 0], n[n > 0]), strict=True))
    if grams is None:
        return {}
    code, n, _ = _shorter(*grams, ORDER)
    out = {ORDER: (code, n, n)}
    for k in range(ORDER - 1, LOW - 1, -1):
        out[k] = _shorter(out[k + 1][0], out[k + 1][1], k)
    return out


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k, gram, n, m) of contexts of LOW bytes and more."""
    for _, t in _runs(batches, "shard"):
        for k, (code, n, m) in _high(t).items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), k, np.int32)), pa.array(code), pa.array(n), pa.array(m)], ["k", "gram", "n", "m"])


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n) of packed strings."""
    for b in batches:
        for codes, counts in zip(b.column("codes"), b.column("counts"), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_longs(codes.as_py()))), pa.array(_longs(counts.as_py()))], ["gram", "n"])


class Shard:
    """Code lengths (log10) of strings from the counts by the context's length k: (strings, n, m), strings sorted."""

    def __init__(self, levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], kept: np.ndarray | None = None):
        self.levels: dict[int, tuple[np.ndarray, ...]] = {}
        for k in range(ORDER + 1):
            code, n, m = levels.get(k, (np.empty(0, np.int64),) * 3)
            if kept is not None:
                own = np.isin(code >> BITS << 4 | k, kept)
                code, n, m = code[own], n[own], m[own]
            if not len(code):
                continue
            context = code >> BITS
            first = np.flatnonzero(np.append(True, context[1:] != context[:-1]))
            below = np.zeros(len(code), np.int64)
            if k:  # what the next shorter context counts of the symbols seen here
                up = self.levels[k - 1]
                below = up[2][np.searchsorted(up[0], code & ((1 << BITS * k) - 1))]
            self.levels[k] = (code, n, m, context[first], np.add.reduceat(n, first), np.add.reduceat(m, first), np.diff(np.append(first, len(code))), np.add.reduceat(below, first))

    def logs(self, code: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(code)), np.arange(len(code))
        escaped, less, fewer = np.zeros(len(code), bool), np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        for k in range(ORDER, -1, -1):
            if k not in self.levels or not len(todo):
                continue
            strings, n, m, contexts, sum_n, sum_m, kinds, below = self.levels[k]
            own = code[todo] & ((1 << BITS * (k + 1)) - 1)
            c = np.minimum(np.searchsorted(contexts, own >> BITS), len(contexts) - 1)
            there = contexts[c] == own >> BITS
            own, c, at = own[there], c[there], todo[there]
            g = np.minimum(np.searchsorted(strings, own), len(strings) - 1)
            hit, again = strings[g] == own, escaped[at]
            total = np.where(again, sum_m[c] - less[at], sum_n[c])
            left = kinds[c] - fewer[at]
            count = np.where(again, m[g], n[g])
            out[at[hit]] += np.log10((count[hit] - DISCOUNT) / total[hit])
            miss = ~hit & (left > 0)
            out[at[miss]] += np.log10(DISCOUNT * left[miss] / total[miss])
            gone = at[~hit]
            escaped[gone], less[gone], fewer[gone] = True, below[c[~hit]], kinds[c[~hit]]
            done = np.zeros(len(code), bool)
            done[at[hit]] = True
            todo = todo[~done[todo]]
        out[todo] -= np.log10(max(1, SYMBOLS - (int(self.levels[0][6][0]) if 0 in self.levels else 0)))
        return out


def _answer(batches: Iterator[pa.RecordBatch], low, kept) -> Iterator[pa.RecordBatch]:
    """Each block's strings of each shard: their code lengths, in their order."""
    for shard, t in _runs(batches, "shard"):
        lean()
        model = Shard(_high(t) | low.value, kept.value)
        asked = [np.cumsum(_longs(x)) for x in t.column("codes").to_pylist()]
        code, inverse = np.unique(np.concatenate(asked), return_inverse=True)
        logs = model.logs(code).astype("<f4")[inverse]
        parts = np.split(logs, np.cumsum([len(x) for x in asked])[:-1])
        yield pa.RecordBatch.from_arrays([t.column("block").combine_chunks(), pa.array(np.full(len(asked), shard, np.int32)), pa.array([x.tobytes() for x in parts], pa.binary())], ["block", "shard", "logs"])


class Trie:
    """The automaton: for each node and symbol a code length (log10) and the next node."""

    def __init__(self, k: np.ndarray, c: np.ndarray, s: np.ndarray, n: np.ndarray, m: np.ndarray, order: int = ORDER, discount: float = DISCOUNT):
        """A row per context c of k symbols and symbol s; n: how often s followed, m: after how many contexts one longer.

        Contexts are closed under dropping their oldest symbol. Escapes count m, so what a longer context predicts well
        doesn't weigh on the shorter one (update exclusion).
        """
        used = np.unique(np.append(s, [END, BLANK, START])).astype(np.int64)
        self.symbol = np.full(256, len(used), np.int64)  # all others share a column
        self.symbol[used] = np.arange(len(used))
        width = len(used) + 1
        names, row = np.unique(np.append(c.astype(np.int64) << 4 | k, 0), return_inverse=True)
        context, length = names >> 4, names & 15
        size = len(names)
        first, later = np.zeros((size, width), np.float32), np.zeros((size, width), np.float32)
        np.add.at(first, (row[:-1], self.symbol[s]), n)
        np.add.at(later, (row[:-1], self.symbol[s]), m)
        del row

        def find(context: np.ndarray, length: int) -> np.ndarray:
            """Nodes by context and length, -1 where there is none."""
            name = context << 4 | length
            at = np.minimum(np.searchsorted(names, name), size - 1)
            return np.where(names[at] == name, at, -1)

        logs, below, follow = np.zeros((size, width), np.float32), np.zeros((size, width), np.float32), np.zeros((size, width), np.int32)
        with np.errstate(divide="ignore", invalid="ignore"):
            for d in range(order + 1):
                every = np.flatnonzero(length == d)
                for at in np.array_split(every, -(-len(every) // 2048)) if len(every) else []:
                    seen = first[at] > 0
                    up = at
                    if d == 0:
                        below[at] = -np.log10(max(1, SYMBOLS - int(seen.sum())))
                    else:
                        up = find(context[at] & ((1 << 8 * (d - 1)) - 1), d - 1)
                        below[at] = self._escaped(np.where(seen, 0, later[up]), below[up], discount)
                    logs[at] = self._escaped(first[at], below[at], discount)
                    # The next node: the longest context that ends with this one and the symbol.
                    shorter = follow[up] if d else np.zeros((len(at), width), np.int32)
                    longer = context[at][:, None] << 8 | used[None, :]
                    if d == order:
                        longer &= (1 << 8 * order) - 1
                    there = find(longer, min(d + 1, order))
                    shorter[:, :-1] = np.where(there >= 0, there, shorter[:, :-1])
                    follow[at] = shorter
        self.width, self.logs, self.next = width, logs.ravel(), follow.ravel()
        self.next *= width

    @staticmethod
    def _escaped(counts: np.ndarray, below: np.ndarray, discount: float) -> np.ndarray:
        """log10 shares: each seen symbol's count less the discount; the discounts together are the escape."""
        counts, seen = counts.astype(np.float64), counts > 0
        total, kinds = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        escape = np.where(kinds > 0, np.log10(discount * kinds / total), 0.0)
        return np.where(seen, np.log10((counts - discount) / total), below + escape)

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """log10 of each text's probability."""
        out = np.zeros(len(texts))
        done = 0
        for block in _blocks(texts):
            data, begin = _symbols(block)
            data = self.symbol[data].astype(np.int32)
            sizes = np.diff(begin) - ORDER
            per = -(-sizes // PIECE)
            text = np.repeat(np.arange(len(block)), per)
            nth = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
            start = begin[text] + nth * PIECE  # ORDER symbols of context, then the piece
            length = np.minimum(PIECE, sizes[text] - nth * PIECE)
            order = np.argsort(-length, kind="stable")
            start, length, text = start[order], length[order], text[order]
            state, total = np.zeros(len(start), np.int32), np.zeros(len(start))
            for k in range(ORDER):
                state = self.next[state + data[start + k]]
            live = len(start)
            falling = np.searchsorted(-length, -np.arange(PIECE + 1), side="left")  # pieces longer than k
            for k in range(int(length[0]) if live else 0):
                live = int(falling[k])
                at = state[:live] + data[start[:live] + ORDER + k]
                total[:live] += self.logs[at]
                state[:live] = self.next[at]
            out[done : done + len(block)] = np.bincount(text, weights=total, minlength=len(block))
            done += len(block)
        return out


def _model_scores(texts: list[bytes], answers: np.ndarray, shards: int) -> np.ndarray:
    """log10 of each text's probability; answers: of the distinct strings by shard, sorted."""
    found = []
    for part in _blocks(texts):
        c, inverse = np.unique(_strings(part), return_inverse=True)
        found.append((c, inverse.astype(np.int32)))
    code = _distinct(np.concatenate([c for c, _ in found]))
    logs = np.empty(len(code))
    logs[np.argsort(_shard(code, shards), kind="stable")] = answers
    out, done = [], 0
    for c, inverse in found:  # sorted strings are sought in order, far faster than as they come
        symbol = logs[np.searchsorted(code, c)][inverse]
        sizes, at = [], 0
        while at < len(symbol):
            sizes.append(at)
            at += len(texts[done]) + 1
            done += 1
        out.append(np.add.reduceat(symbol, sizes))
    return np.concatenate(out)


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def _score(batches: Iterator[pa.RecordBatch], common, shards: int) -> Iterator[pa.RecordBatch]:
    """A block's answers come before its texts."""
    known = common.value
    for _, table_ in _runs(batches, "block"):
        lean()
        mine = table_.filter(pc.is_valid(table_.column("text")))
        answers = np.frombuffer(b"".join(table_.column("logs").drop_null().to_pylist()), "<f4")
        texts = mine.column("text").to_pylist()
        scores = _model_scores(texts, answers, shards)
        n_tokens, n_common, logs, rare, rare_n = [], [], [], [], []
        for text in texts:
            t = text.split(b" ") if text else []
            own = Counter(t)
            found = [known.get(w, 0) for w in own]
            times = np.fromiter(own.values(), np.int64, len(own))
            c = np.array(found, np.int64)
            hit = c > 0
            n_tokens.append(len(t) + 1)
            n_common.append(int(times[hit].sum()))
            logs.append(float((times[hit] * np.log10(c[hit] + 0.5)).sum()))
            rare.append([w for w, x in zip(own, found, strict=True) if not x])
            rare_n.append(times[~hit])
        lists = pa.array(rare, pa.list_(pa.binary()))
        times = pa.ListArray.from_arrays(lists.offsets, pa.array(np.concatenate(rare_n), pa.int64()))
        yield pa.RecordBatch.from_arrays([mine.column("doc_id").combine_chunks(), pa.array(n_tokens, pa.int64()), pa.array(n_common, pa.int64()), pa.array(logs, pa.float64()), pa.array(scores, pa.float64()), lists, times], ["doc_id", "n_tokens", "n_common", "logs", "score", "rare", "times"])


def _gather_all(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """What _gather() tells of docs (doc_id, text), the number of shards and of training rows."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), binary("text"), held_out(F.col("doc_id")).alias("held"))
    size, ends = rows.agg(F.sum(F.octet_length("text")), F.count(F.when(~F.col("held"), 1))).first()
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), (size or 0) // SHARD_BYTES)
    return cut(map_arrow(rows, partial(_gather, shards=shards), GATHERED), "zstd"), shards, ends


def _by_shard(gathered: DataFrame, *columns: str) -> DataFrame:
    n = int(gathered.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return gathered.filter("shard is not null").select("shard", *columns).repartition(n, "shard").sortWithinPartitions("shard")


def _common(gathered: DataFrame, ends: int) -> tuple[DataFrame, dict[bytes, int], int, int]:
    """Counts of all words, the common words, N and V."""
    word = cut(gathered.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")))
    total, kinds = word.agg(F.sum("n"), F.count(F.lit(1))).first()
    top = word.orderBy(F.desc("n"), "word").limit(COMMON).toArrow()
    return word, dict(zip(top.column("word").to_pylist(), top.column("n").to_pylist(), strict=True)), int(total or 0) + ends, int(kinds) + (ends > 0)


def _low(gathered: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Strings with contexts of LOW bytes and less: as many as the alphabet makes at most."""
    few = map_arrow(gathered.filter("shard is null and codes is not null").select("codes", "counts"), _few, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    got = few.groupBy(F.col("gram").bitwiseAND((1 << BITS * (LOW + 1)) - 1).alias("gram")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("m")).orderBy("gram").toArrow()
    out = {LOW: tuple(got.column(c).to_numpy().astype(np.int64) for c in ("gram", "n", "m"))}
    for k in range(LOW - 1, -1, -1):
        out[k] = _shorter(out[k + 1][0], out[k + 1][1], k)
    return out


def _every(levels: DataFrame, low: dict) -> DataFrame:
    """(k, c, s, n, m) of all strings, those of low among them."""
    short = pa.Table.from_arrays([pa.array(np.concatenate(x)) for x in zip(*[(np.full(len(v[0]), k, np.int32), *v) for k, v in low.items()], strict=True)], ["k", "gram", "n", "m"])
    rows = levels.filter(F.col("k") > LOW).unionByName(levels.sparkSession.createDataFrame(short))
    return rows.select("k", F.shiftright("gram", BITS).alias("c"), F.col("gram").bitwiseAND((1 << BITS) - 1).alias("s"), "n", "m")


def _most_frequent(every: DataFrame) -> DataFrame:
    """The NODES contexts that are most frequent (a context is never more frequent than its suffixes, so these stay too)."""
    return every.groupBy("k", "c").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "k", "c").limit(NODES).select("k", "c")


LEVELS = "k int, gram long, n long, m long"


def train(docs: DataFrame) -> tuple[DataFrame, Trie, dict[bytes, int], int, int, int]:
    """Of tables that fit one machine: word counts of the training rows (doc_id, text), the automaton, the common words, N, V, ends."""
    gathered, _, ends = _gather_all(docs)
    word, common, n, v = _common(gathered, ends)
    every = _every(cut(map_arrow(_by_shard(gathered, "codes", "counts"), _levels, LEVELS)), _low(gathered))
    kept = (every if NODES is None else every.join(F.broadcast(_most_frequent(every)), ["k", "c"], "left_semi")).toArrow()
    return word, Trie(*[kept.column(x).to_numpy().astype(np.int64) for x in ("k", "c", "s", "n", "m")]), common, n, v, ends


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs (doc_id, text)."""
    spark = docs.sparkSession
    gathered, shards, ends = _gather_all(docs)
    word, common, n, v = _common(gathered, ends)
    low, kept = _low(gathered), None
    if NODES is not None:
        levels = cut(map_arrow(_by_shard(gathered, "codes", "counts"), _levels, LEVELS))
        top = _most_frequent(_every(levels, low)).toArrow()
        kept = top.column("c").to_numpy().astype(np.int64) << 4 | top.column("k").to_numpy().astype(np.int64)
    send = spark.sparkContext.broadcast
    answers = map_arrow(_by_shard(gathered, "block", "codes", "counts"), partial(_answer, low=send(low), kept=send(kept)), "block long, shard int, logs binary")
    texts = gathered.filter("text is not null").select("block", "doc_id", "text")
    met = answers.select("block", "shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("text"), "logs").unionByName(texts.select("block", F.lit(shards).alias("shard"), "doc_id", "text", F.lit(None).cast("binary").alias("logs")))
    met = met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "shard")
    first = map_arrow(met, partial(_score, common=send(common), shards=shards), "doc_id long, n_tokens long, n_common long, logs double, score double, rare array<binary>, times array<long>")
    first = cut(first.withColumn("row", F.monotonically_increasing_id()))
    rare = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    met = rare.join(word, "word", "left")
    log = F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)
    sums = met.groupBy("row").agg(F.sum(log).alias("rare_logs"), F.sum(F.when(F.col("n") > 0, F.col("times"))).alias("rare_known"))
    end_log = float(np.log10(ends + 0.5))
    each = float(np.log10(n + 0.5 * (v + 1)))
    out = first.drop("rare", "times").join(sums, "row", "left")
    base = F.col("logs") + F.coalesce("rare_logs", F.lit(0.0)) + F.lit(end_log) - F.col("n_tokens") * F.lit(each)
    known = F.col("n_common") + F.coalesce("rare_known", F.lit(0)) + F.lit(1 if ends else 0)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def query(spark, sf_dir):
    """op7: base and model scores of every document."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"))
