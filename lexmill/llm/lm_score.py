"""Language-model scoring with a weighted backoff automaton over words.

1. All word n-grams of orders 1 to ``ORDER`` of all texts are counted. A text is preceded by ORDER - 1 begin marks and followed by an end mark, so each word, and the end, is
   predicted from exactly ORDER - 1 symbols.
2. Probabilities are smoothed by interpolation with a Dirichlet prior: p(w | c) = (n(c w) + K p(w | c less its first word)) / (n(c) + K), with a weight K for each order, down to a uniform
   distribution over ``VOCABULARY`` words. Every seen context is a state. A seen n-gram is an arc with its log-probability to the state of the longest seen suffix; every
   state has a failure arc, weighted by log(K / (n(c) + K)), to the state of its context less the first word. Only counts are needed, so the model is a table of n-grams.
   A document that is itself part of the corpus is scored by what all other rows have: its own counts are taken off, as every n-gram of it would else be seen.
3. Scoring traverses the automaton once from left to right: many texts advance in step, each with its own state; a missing arc follows failure arcs and adds their weights.
   Long texts are cut into segments that start by ORDER - 1 unscored words before them, which lead to the very state of an uncut traversal.

The model grows with the corpus and is nowhere held as a whole, neither by the driver nor by an executor. Texts are packed in blocks of about ``BLOCK`` bytes (or one document). A block asks for the n-grams that
occur in it: their hashes, in sorted chunks by ranges of the hash, go to the tasks that count the range over all blocks, and the totals come back in the order of what was asked. Each block then builds
the part of the automaton that its own texts can reach, which gives the very scores of the whole one. What is sent is proportional to the text; a frequent n-gram is one entry for each
block, so no key is hot. The number of ranges follows that of shuffle partitions; at a hundred times the data raise it, and ``block`` with it.

Defined cases: null and empty texts, and those without a word, consist of the end alone; a null doc_id is scored like others; rows that repeat count and are scored as often as they come;
without any row the result is empty; with another ``corpus`` that is empty, all probabilities are uniform. Other columns are ignored. N-grams are told apart by hashes that have ``MARGIN`` bits more than it takes to number those of the corpus (64 at most): up to 10^13 n-grams,
one in a million shares its hash with another, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._spark import stash
from lexmill.llm._words import Words, mix, pieces
from lexmill.session import ship

ORDER, VOCABULARY, BLOCK, SEGMENT, MARGIN = 3, 1 << 20, 4 << 20, 256, 20
#: The weight of the lower order in the counts of orders 1, 2 and 3; the last one holds for higher orders.
PRIOR = (1.0, 16.0, 2.0)
OUT = "doc_id bigint, n_tokens bigint, log_prob double, log_prob_per_token double, bits_per_token double"
_BEGIN, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)
_ODD = np.uint64(0xD6E8FEB86659FD93)
ROWS = "block bigint, part int, ids array<bigint>, sizes array<int>, vocab binary, data binary"
_SCHEMA = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("vocab", pa.binary()), ("data", pa.binary())])


def _row(block: int, part: int, data: bytes, ids=None, sizes=None, vocab=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((block, part, ids, sizes, vocab, data), _SCHEMA, strict=True)], schema=_SCHEMA)


def _planes(x: np.ndarray) -> bytes:
    """Integers, sorted or in few sorted stretches, as byte planes of their differences (modulo 2^64), compressed."""
    x = x.astype(np.uint64)
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _from_planes(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(x: np.ndarray) -> bytes:
    """Counts of mostly one byte, compressed: those of 255 and more follow the bytes."""
    low = zstandard.ZstdCompressor(level=3).compress(np.minimum(x, 255).astype(np.uint8).tobytes())
    return len(low).to_bytes(4, "little") + low + zstandard.ZstdCompressor(level=3).compress(x[x >= 255].astype(np.uint64).tobytes())


def _from_small(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    x = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 : 4 + n]), np.uint8).astype(np.int64)
    x[x == 255] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4 + n :]), np.uint64)
    return x


class Block:
    """The words of some texts: ``word`` has their numbers in ``vocab``, each text between order - 1 begin marks and an end mark."""

    def __init__(self, vocab: np.ndarray, codes: np.ndarray, sizes: np.ndarray, order: int):
        self.order, self.sizes = order, sizes
        n = len(sizes)
        self.begin, self.end = len(vocab), len(vocab) + 1
        self.first = np.concatenate([[0], np.cumsum(sizes + order)])
        self.word = np.full(int(self.first[-1]), self.begin, np.int64)
        inner = np.arange(len(codes)) + np.repeat(order * np.arange(n) + order - 1, sizes)
        self.word[inner] = codes
        self.word[self.first[1:] - 1] = self.end
        self.hash = np.concatenate([vocab, [_BEGIN, _END]]).astype(np.uint64)

    def predicted(self) -> np.ndarray:
        """Places of the words and ends."""
        ok = np.ones(len(self.word), bool)
        for j in range(self.order - 1):
            ok[self.first[:-1] + j] = False
        return np.flatnonzero(ok)

    def grams(self) -> list[np.ndarray]:
        """For each order, the hash of the n-gram that ends at each place; the first places of a text hold begin marks, so no n-gram of a predicted place leaves its text."""
        h = self.hash[self.word]
        out = [mix(h + np.uint64(1))]
        for m in range(1, self.order):
            x = np.zeros_like(h)
            x[1:] = mix(out[-1][:-1] * _ODD + h[1:] + np.uint64(m + 1))
            out.append(x)
        return out

    def types(self, bits: int = 64):
        """Sorted hashes of the n-grams at predicted places, the number of each at each place (orders x places), and how often it occurs."""
        at = self.predicted()
        keys, inverse, counts = np.unique(np.concatenate([g[at] for g in self.grams()]) >> np.uint64(64 - bits), return_inverse=True, return_counts=True)
        return keys, inverse.astype(np.int32).reshape(self.order, -1), counts


@dataclass
class Automaton:
    order: int
    symbols: int
    apart: bool
    key: np.ndarray  # state * symbols + word of each arc, sorted
    target: np.ndarray
    weight: np.ndarray  # log
    fail: np.ndarray
    fail_weight: np.ndarray  # log
    unseen: np.ndarray  # of each part, the log-probability of a word that its root has no arc for

    def advance(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next state and the log-probability of each word."""
        after, gain = np.zeros(len(state), np.int64), np.zeros(len(state))
        left, s, carried = np.arange(len(state)), state, np.zeros(len(state))
        while len(left):
            want = s * self.symbols + word[left]
            arc = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
            hit = self.key[arc] == want if len(self.key) else np.zeros(len(left), bool)
            after[left[hit]], gain[left[hit]] = self.target[arc[hit]], carried[hit] + self.weight[arc[hit]]
            at_root = (s % self.order == 0) & (s < len(self.unseen) * self.order)
            lost = ~hit & at_root
            after[left[lost]], gain[left[lost]] = s[lost], carried[lost] + self.unseen[s[lost] // self.order]
            on = ~hit & ~at_root
            carried = carried[on] + self.fail_weight[s[on]]
            left, s = left[on], self.fail[s[on]]
        return after, gain

    def score(self, block: Block) -> np.ndarray:
        """The log-probability of each text of the block."""
        n = block.sizes + 1
        segments = -(-n // SEGMENT)
        row = np.repeat(np.arange(len(n)), segments)
        inner = np.arange(segments.sum()) - np.repeat(np.cumsum(segments) - segments, segments)
        begin, length = block.first[row] + self.order - 1 + inner * SEGMENT, np.minimum(SEGMENT, n[row] - inner * SEGMENT)
        by = np.argsort(-length, kind="stable")
        row, begin, length, inner = row[by], begin[by], length[by], inner[by]
        root = (row if self.apart else np.zeros_like(row)) * self.order
        state, total = root.copy(), np.zeros(len(row))
        for t in range(-(self.order - 1), int(length[0]) if len(length) else 0):
            if t == 0:
                state[inner == 0] = root[inner == 0] + self.order - 1
            # begin marks are not predicted: the first segments of texts wait
            live = np.flatnonzero(inner > 0) if t < 0 else np.arange(np.searchsorted(-length, -t, "left"))
            if len(live):
                state[live], gain = self.advance(state[live], block.word[begin[live] + t])
                if t >= 0:
                    total[live] += gain
        return np.bincount(row, weights=total, minlength=len(n))


def automaton(block: Block, counts: np.ndarray, documents: int, tokens: int, apart: bool, prior: tuple[float, ...] = PRIOR, vocabulary: int = VOCABULARY, types=None) -> Automaton:
    """The part of the automaton that the block can reach; counts are those of the corpus for ``types()``. With ``apart`` each text has its own part, from whose counts its own are taken off.

    States of each part: the root, then order - 1 states of begin marks; after those of all parts, one for each n-gram of each part.
    """
    order, (keys, number, _) = block.order, types or block.types()
    at = block.predicted()
    place = np.full(len(block.word), -1)
    place[at] = np.arange(len(at))
    row = np.repeat(np.arange(len(block.sizes)), block.sizes + 1)
    of, parts = (row, len(block.sizes)) if apart else (np.zeros_like(row), 1)
    documents -= int(apart)
    rest = tokens - (block.sizes + 1 if apart else np.zeros(1, np.int64))
    weigh = lambda m: prior[min(m, len(prior)) - 1]
    base = parts * order
    fail, fail_weight = [np.maximum(np.arange(base) - 1, 0)], [np.tile([0.0] + [np.log(weigh(j + 1) / (documents + weigh(j + 1))) for j in range(1, order)], parts)]
    arcs, targets, weights = [], [], []
    node = p = have = np.empty(0, np.int64)  # of the last order: the state of each place; probability and count of each state
    low = 0  # its first state
    for m in range(1, order + 1):
        k = weigh(m)
        _, some, inverse, own = np.unique(of * len(keys) + number[m - 1], return_index=True, return_inverse=True, return_counts=True)
        part, word = of[some], block.word[at[some]]
        held = (counts[number[m - 1][some]] - (own if apart else 0)).astype(float)
        if m == 1:
            below, total, source, suffix = np.full(len(some), 1 / vocabulary), rest[part].astype(float), part * order, part * order
        else:
            below, suffix = p[node[some] - low], node[some]
            # the context: an n-gram that ends one place before, or begin marks alone
            before = place[at[some] - 1]
            context = node[before]
            total, source = np.where(before >= 0, have[context - low], documents).astype(float), np.where(before >= 0, context, part * order + m - 1)
        q = (held + k * below) / (total + k)
        first = base + sum(len(f) for f in fail[1:])
        to = first + np.arange(len(some)) if m < order else suffix
        seen = held > 0
        arcs.append((source * (block.end + 1) + word)[seen])
        targets.append(to[seen])
        weights.append(np.log(q[seen]))
        if m < order:  # the n-gram is a context
            fail.append(suffix)
            fail_weight.append(np.log(weigh(m + 1) / (held + weigh(m + 1))))
        node, p, have, low = first + inverse, q, held, first
    key, target, weight = (np.concatenate(x) for x in (arcs, targets, weights))
    by = np.argsort(key)
    unseen = np.log(weigh(1) / vocabulary / (rest + weigh(1)))
    return Automaton(order, block.end + 1, apart, key[by], target[by], weight[by], np.concatenate(fail), np.concatenate(fail_weight), unseen)


def pack(docs: DataFrame, order: int, block: int) -> DataFrame:
    """One row for each block of about ``block`` bytes of text: document ids, numbers of words, hashes and codes of words. Codes follow the frequency, so that most of their upper bytes are zero."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        ids: list = []
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal number, size
            words, inverse, n = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            by = np.argsort(-n, kind="stable")
            code = np.empty(len(by), np.uint16 if len(words) <= 1 << 16 else np.uint32)
            code[by] = np.arange(len(by))
            words, codes = words[by], code[inverse]
            row = _row(number, -1, bytes([codes.itemsize]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(codes.view(np.uint8).reshape(-1, codes.itemsize).T).tobytes()), list(ids), np.concatenate(sizes).tolist(), _planes(words))
            number += 1
            ids.clear(), held.clear(), sizes.clear()
            size = 0
            return row

        for batch in batches:
            text = batch.column(1)
            for a, b in pieces(text, block):
                # a kernel call takes one part of the block; a text is never cut
                for c, d in pieces(text.slice(a, b - a)):
                    w = Words(text.slice(a + c, d - c))
                    ids += batch.column(0).slice(a + c, d - c).to_pylist()
                    held.append(w.hash)
                    sizes.append(w.counts)
                    size += len(w.data)
                    if size >= block:
                        yield flush()
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, ROWS)


def _unpack(row: dict, order: int) -> Block:
    data, vocab = row["data"], _from_planes(row["vocab"])
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    codes = np.ascontiguousarray(raw.reshape(data[0], -1).T).view(f"<u{data[0]}").ravel()
    return Block(vocab, codes.astype(np.int64), np.array(row["sizes"], np.int64), order)


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _edges(parts: int, bits: int) -> np.ndarray:
    return np.array([(i << bits) // parts for i in range(parts)], np.uint64)


def _asks(blocks: DataFrame, order: int, parts: int, bits: int, counted: bool, asked: bool) -> DataFrame:
    """(block, part, vocab, data): the n-gram hashes of a block that lie in a range, and how often they occur; 0 times unless counted, block is -1 unless asked."""

    def run(batches):
        for row in _each(batches):
            keys, _, n = _unpack(row, order).types(bits)
            cut = np.append(np.searchsorted(keys, _edges(parts, bits)), len(keys))
            for i in np.flatnonzero(np.diff(cut)):
                a, b = cut[i], cut[i + 1]
                yield _row(row["block"] if asked else -1, int(i), _small(n[a:b] if counted else np.zeros(b - a, np.int64)), vocab=_planes(keys[a:b]))

    return blocks.mapInArrow(run, ROWS)


def _totals(asks: DataFrame, tasks: int) -> DataFrame:
    """For what each block asked for, in its order, the totals over all other blocks."""

    def run(batches):
        part, held = None, []

        def answer():
            keys, counts = [_from_planes(r["vocab"]) for r in held], [_from_small(r["data"]) for r in held]
            _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)
            at = 0
            for r, n in zip(held, counts, strict=True):
                if r["block"] >= 0:
                    yield _row(r["block"], part, _small(total[inverse[at : at + len(n)]] - n))
                at += len(n)

        for row in _each(batches):
            if row["part"] != part:
                if held:
                    yield from answer()
                part, held = row["part"], []
            held.append(row)
        if held:
            yield from answer()

    return asks.repartition(tasks, "part").sortWithinPartitions("part").mapInArrow(run, ROWS)


def lm_score(docs: DataFrame, corpus: DataFrame | None = None, order: int = ORDER, prior: tuple[float, ...] = PRIOR, vocabulary: int = VOCABULARY, block: int = BLOCK, parts: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, log_prob, log_prob_per_token, bits_per_token) of each document under the model of ``corpus``, or else of all other rows of docs; the end counts as a token."""
    if order < 1:
        raise ValueError("the order is 1 at least")
    spark = docs.sparkSession
    ship(spark)
    # two ranges for each partition of shuffles
    parts = parts or 2 * max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = stash(pack(docs, order, block), "blocks")
    known = blocks if corpus is None else stash(pack(corpus, order, block), "blocks")
    seen = known.select(F.size("sizes").alias("d"), F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("w")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("d"), F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first()
    apart, documents, tokens = corpus is None, int(seen["d"]), int(seen["w"]) + int(seen["d"])
    bits = min(64, (order * tokens).bit_length() + MARGIN)
    asks = _asks(blocks, order, parts, bits, apart, True)
    if not apart:
        asks = asks.unionByName(_asks(known, order, parts, bits, True, False))

    def run(batches):
        held: list[dict] = []

        def scored():
            own = _unpack(held[0], order)
            types = own.types(bits)
            counts = np.concatenate([_from_small(r["data"]) for r in held[1:]]) + (types[2] if apart else 0)
            logs, n = automaton(own, counts, documents, tokens, apart, prior, vocabulary, types).score(own), own.sizes + 1
            return pa.RecordBatch.from_arrays([pa.array(held[0]["ids"], pa.int64()), pa.array(n), pa.array(logs), pa.array(logs / n), pa.array(-logs / n / np.log(2))], [x.split()[0] for x in OUT.split(", ")])

        for row in _each(batches):
            if row["part"] < 0 and held:
                yield scored()
                held = []
            held.append(row)
        if held:
            yield scored()

    # a block is followed by its answers in the order of ranges
    return blocks.unionByName(_totals(asks, parts)).repartition(parts, "block").sortWithinPartitions("block", "part").mapInArrow(run, OUT)
