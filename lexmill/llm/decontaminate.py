"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

A document is contaminated by an item when some window of as many words as the item has is similar to it: weighted Jaccard similarity
of the multisets of 2-word shingles, sum(w * min) / sum(w * max), at least ``threshold``. Shingle weights are log(1 + D / (1 + f)),
where f is the number of the D documents that hold the shingle; f is counted over all documents, for shingles of items. Where a window is compared with an item, a shingle that
the item doesn't have weighs at most ``BOUND`` times the mean weight of the item's shingles, so equal edits score alike however many documents there are and however many hold the item.

1. Lossless screen: similarity s needs shared weight of at least s * (weight of the item). Prefix sums of the weights of item shingles over a document
   show in one pass which windows reach the least such sum among the items of their size; other windows cannot pass and are dropped.
2. Every window that is left gets a 128-bit weighted SimHash, with weights bounded on a ladder of steps of ``STEP``: one for each step that an item's bound lies on. Items of one size and step have
   a multi-index of their own: a table for each of ``BLOCKS`` 8-bit blocks, entered for every pattern of as many errors as the pigeonhole principle asks for (sum of allowed errors + 1 over
   blocks = radius + 1), which holds the items of an entry as bits: or-ing the entries of a window's blocks gives a superset of all items within the radius. At the default radius that prunes
   little, whatever the blocks, so it is kept cheap: 512 bytes an item, and a few operations a window for eight items.
3. What the entries name passes two exact tests in bulk: shared weight of at least threshold * (weight of the item), and the Hamming distance. The weighted similarity of what is
   left is computed exactly, for all windows of an item at once.

The benchmark is broadcast in parts of about ``MAX_INDEX_MB``, estimated from words and items, each part over all documents, with equal results. Long documents are searched in
stretches of ``STRETCH`` window starts, so memory doesn't grow with them. Documents are never cut: windows cross stretches and lines.

Defined cases: null or empty texts and texts of one word have no shingle, and are never contaminated; an item of fewer than two words is ignored; items of null item_id are
ignored; a document shorter than an item is one window; a null doc_id is reported as null; items that repeat are each reported; rows of documents that repeat are
reported once for each doc_id and item. Ties of windows go to the first. Other columns are ignored; empty tables give no row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._words import Words, mix, pieces
from lexmill.session import ship

THRESHOLD, RADIUS, BLOCKS, MAX_INDEX_MB, STRETCH, PAIRS = 0.6, 44, 16, 256, 8192, 1 << 21
BOUND, STEP = 1.5, 1.25
OUT = "doc_id bigint, item_id bigint, similarity double, start int, distance int"
_ODD = np.uint64(0xD6E8FEB86659FD93)


def pairs_of(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """At each word the hash of it and the next; whether both are of one row."""
    h, row = w.hash, w.row
    x = np.zeros(len(h), np.uint64)
    ok = np.zeros(len(h), bool)
    if len(h) > 1:
        x[:-1] = mix(h[:-1] * _ODD + h[1:])
        ok[:-1] = row[:-1] == row[1:]
    return x, ok


def _bits(h: np.ndarray) -> np.ndarray:
    """len(h) x 128 of 0 or 1: the bits of two hashes made from each."""
    two = np.stack([mix(h + np.uint64(1)), mix(h + np.uint64(2))], 1)
    return np.unpackbits(np.ascontiguousarray(two).view(np.uint8).reshape(len(h), 16), axis=1)


@dataclass
class Group:
    """Items of one size whose fingerprints have one bound of weights."""

    size: int
    top: float  # the most that a shingle weighs in fingerprints, the items' bound or the step above it
    items: np.ndarray
    marks: np.ndarray  # items x 2 of 64 bits
    tables: np.ndarray  # blocks x 256 x bytes: the items that a block's value may belong to, as bits
    least: np.ndarray  # of each item: the shared weight that it asks for


@dataclass
class Index:
    ids: np.ndarray
    sizes: np.ndarray  # words of each item
    weight: np.ndarray  # of each item
    vocab: np.ndarray  # sorted shingles of items
    vocab_weight: np.ndarray
    other: float  # the weight of a shingle that no item has
    bags: list[tuple[np.ndarray, np.ndarray]]  # of each item: index in vocab, count
    groups: list[Group]
    threshold: float
    radius: int
    bound: np.ndarray  # of each item: the most that a shingle weighs that it doesn't have

    def least(self) -> dict[int, float]:
        """For each size of items, the least shared weight that can suffice."""
        return {int(n): self.threshold * float(self.weight[self.sizes == n].min()) for n in np.unique(self.sizes)}


def fingerprint(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """16 bytes: bit j is set where the weights of shingles with bit j outweigh the rest."""
    return np.packbits((weight[:, None] * (2.0 * _bits(h) - 1)).sum(0) > 0)


def block_errors(radius: int) -> list[int]:
    base, more = divmod(radius + 1, BLOCKS)
    return [base + (i < more) - 1 for i in range(BLOCKS)]


def build(ids: list[int], texts: list[str], frequency: dict[int, int], documents: int, threshold: float, radius: int) -> Index | None:
    """The index of the items; frequency holds f of shingles."""
    w = Words(pa.array(texts, pa.string()))
    x, ok = pairs_of(w)
    row = w.row
    use = [i for i in range(len(ids)) if w.counts[i] >= 2]
    if not use:
        return None
    vocab = np.unique(x[ok])
    weigh = lambda f: np.log1p(documents / (1.0 + f))
    vocab_weight = weigh(np.array([frequency.get(int(h), 0) for h in vocab.view(np.int64)], float))
    other = float(weigh(0.0))
    bags, marks, weight, bound, top = [], [], [], [], []
    for i in use:
        at = np.searchsorted(vocab, x[w.first[i] : w.first[i + 1] - 1])
        k, n = np.unique(at, return_counts=True)
        bags.append((k, n))
        weight.append(float((vocab_weight[k] * n).sum()))
        bound.append(min(BOUND * weight[-1] / len(at), other))
        top.append(other / STEP ** np.floor(np.log(other / bound[-1]) / np.log(STEP) + 1e-9) if bound[-1] else other)
        marks.append(fingerprint(vocab[at], np.minimum(vocab_weight[at], top[-1])))
    marks, sizes, weight, top = np.array(marks), w.counts[use], np.array(weight), np.array(top)
    near = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8))
    groups = []
    for size, t in sorted(set(zip(sizes.tolist(), top.tolist(), strict=True))):
        own = np.flatnonzero((sizes == size) & (top == t))
        tables = np.stack([np.packbits(near[:, marks[own, b]] <= errors, axis=1) for b, errors in enumerate(block_errors(radius))])
        groups.append(Group(size, t, own, np.ascontiguousarray(marks[own]).view(np.uint64), tables, threshold * weight[own]))
    return Index(np.array([ids[i] for i in use]), sizes, weight, vocab, vocab_weight, other, bags, groups, threshold, radius, np.array(bound))


def _windows(index: Index, shared: np.ndarray, count: int):
    """(size, span, starts) of the windows of one document that the screen leaves. shared: prefix sums of item-shingle weights."""
    for size, least in index.least().items():
        span = min(size, count) - 1
        got = shared[span:] - shared[: len(shared) - span]
        starts = np.flatnonzero(got >= least - 1e-9)
        if len(starts):
            yield size, span, starts


def candidates(group: Group, marks: np.ndarray, got: np.ndarray, radius: int):
    """(window, item of the group, distance) of fingerprints (windows x 16 bytes) within the radius; got is the shared weight of each window."""
    step = max(1, PAIRS // len(group.items))
    for s in range(0, len(marks), step):
        some = marks[s : s + step]
        bits = group.tables[0][some[:, 0]]
        for b in range(1, BLOCKS):
            bits |= group.tables[b][some[:, b]]
        window, item = np.nonzero(np.unpackbits(bits, axis=1, count=len(group.items)))
        rich = got[s + window] >= group.least[item] - 1e-9
        window, item = window[rich], item[rich]
        distance = np.bitwise_count(np.ascontiguousarray(some).view(np.uint64)[window] ^ group.marks[item]).sum(1)
        ok = distance <= radius
        yield window[ok] + s, item[ok], distance[ok]


def similarities(index: Index, i: int, at: np.ndarray, weight: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """The similarity of item i and the windows that begin at starts."""
    k, n = index.bags[i]
    out = []
    step = max(1, PAIRS // max(span, len(k)))
    for s in range(0, len(starts), step):
        places = starts[s : s + step, None] + np.arange(span)
        window, heavy = at[places], weight[places]
        j = np.minimum(np.searchsorted(k, window), len(k) - 1)
        own = k[j] == window
        have = np.bincount((np.arange(len(places))[:, None] * len(k) + j)[own], minlength=len(places) * len(k)).reshape(-1, len(k))
        both = np.minimum(have, n) @ index.vocab_weight[k]
        either = np.where(own, heavy, np.minimum(heavy, index.bound[i])).sum(1) + index.weight[i] - both
        out.append(np.divide(both, either, out=np.zeros(len(both)), where=either > 0))
    return np.concatenate(out)


def search(index: Index, h: np.ndarray, at: np.ndarray) -> dict[int, tuple[float, int, int]]:
    """For each item found in one document: best similarity, first word of its window, distance.

    h: the document's shingles; at: their index in index.vocab, or -1.
    """
    found: dict[int, tuple[float, int, int]] = {}
    own = np.where(at >= 0, index.vocab_weight[at], 0.0)
    shared = np.concatenate([[0.0], np.cumsum(own)])
    weight = np.where(at >= 0, own, index.other)
    windows = list(_windows(index, shared, len(h) + 1))
    for low in sorted({int(c) for _, _, starts in windows for c in np.unique(starts // STRETCH)}):
        here = {size: (span, starts[np.searchsorted(starts, low * STRETCH) : np.searchsorted(starts, (low + 1) * STRETCH)]) for size, span, starts in windows}
        _stretch(index, h, at, shared, weight, {k: v for k, v in here.items() if len(v[1])}, found)
    return found


def _stretch(index: Index, h, at, shared, weight, here: dict[int, tuple[int, np.ndarray]], found: dict) -> None:
    # sums over bits only for the places that windows cover
    base = min(int(starts[0]) for _, starts in here.values())
    need = np.zeros(max(int(starts[-1]) + span for span, starts in here.values()) - base + 1, np.int32)
    for span, starts in here.values():
        np.add.at(need, starts - base, 1)
        np.add.at(need, starts - base + span, -1)
    used = np.flatnonzero(np.cumsum(need)[:-1] > 0)
    place = np.full(len(need), -1)
    place[used] = np.arange(len(used))
    used += base
    signs = 2.0 * _bits(h[used]) - 1
    top, acc = None, None
    for g in sorted((g for g in index.groups if g.size in here), key=lambda g: g.top):
        span, starts = here[g.size]
        if g.top != top:
            top, acc = g.top, np.concatenate([np.zeros((1, 128)), np.cumsum(np.minimum(weight[used, None], g.top) * signs, axis=0)])
        first = place[starts - base]
        marks = np.packbits(acc[first + span] - acc[first] > 1e-6, axis=1)
        for window, item, distance in candidates(g, marks, shared[starts + span] - shared[starts], index.radius):
            for j in np.unique(item):
                some = np.flatnonzero(item == j)
                sim = similarities(index, int(g.items[j]), at, weight, starts[window[some]], span)
                best = int(np.flatnonzero(sim >= sim.max() - 1e-12)[0])
                i = int(g.items[j])
                if sim[best] >= index.threshold and (i not in found or sim[best] > found[i][0] + 1e-12):
                    found[i] = (float(sim[best]), int(starts[window[some[best]]]), int(distance[some[best]]))


def _lookup(vocab: np.ndarray, quick: np.ndarray, x: np.ndarray, ok: np.ndarray) -> np.ndarray:
    at = np.full(len(x), -1)
    hit = np.flatnonzero(ok & quick[(x & np.uint64(0xFFFFF)).astype(np.int64)])
    if len(hit) and len(vocab):
        k = np.minimum(np.searchsorted(vocab, x[hit]), len(vocab) - 1)
        same = vocab[k] == x[hit]
        at[hit[same]] = k[same]
    return at


def _quick(vocab: np.ndarray) -> np.ndarray:
    quick = np.zeros(1 << 20, bool)
    quick[(vocab & np.uint64(0xFFFFF)).astype(np.int64)] = True
    return quick


def contamination(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, max_index_mb: float = MAX_INDEX_MB) -> DataFrame:
    """(doc_id, item_id, similarity, start, distance) for each document and item that is found in it; start is a word position."""
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], OUT)
    for ids, texts in _parts(items, max_index_mb):
        index = _index(text, ids, texts, threshold, radius)
        if index is not None:
            out = out.unionByName(_found(text, index))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("start"), "distance")).alias("x"))
    return best.select("doc_id", "item_id", F.round("x.similarity", 6).alias("similarity"), (-F.col("x.start")).alias("start"), F.col("x.distance").alias("distance"))


def _parts(items: DataFrame, max_index_mb: float) -> Iterator[tuple[list[int], list[str]]]:
    """Items in parts whose index takes about max_index_mb (or one item)."""
    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).dropna().orderBy("item_id", "text")
    ids, texts, size = [], [], 0.0
    for r in rows.toLocalIterator():
        # tables, fingerprint and lists of an item; hash, weight and bag of each word, and the text itself
        n = 1024 + 64 * len(r["text"].split()) + len(r["text"].encode())
        if size and size + n > max_index_mb * 1e6:
            yield ids, texts
            ids, texts, size = [], [], 0.0
        ids.append(r["item_id"])
        texts.append(r["text"])
        size += n
    if ids:
        yield ids, texts


def _index(text: DataFrame, ids: list[int], texts: list[str], threshold: float, radius: int):
    """The broadcast index of some items, with shingle frequencies of all documents; None if no item has a shingle."""
    sc = text.sparkSession.sparkContext
    w = Words(pa.array(texts, pa.string()))
    x, ok = pairs_of(w)
    vocab = np.unique(x[ok])
    words = sc.broadcast(vocab)

    def frequency(batches):
        vocab = words.value
        quick, total, rows = _quick(vocab), np.zeros(len(vocab), np.int64), 0
        for batch in batches:
            rows += batch.num_rows
            for a, b in pieces(batch.column(0)):
                w = Words(batch.column(0).slice(a, b - a))
                x, ok = pairs_of(w)
                at = _lookup(vocab, quick, x, ok)
                hit = np.flatnonzero(at >= 0)
                if len(hit):
                    k, n = np.unique(np.unique(w.row[hit] * len(vocab) + at[hit]) % len(vocab), return_counts=True)
                    total[k] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(vocab[some].view(np.int64), 0)), pa.array(np.append(total[some], rows)), pa.array(np.append(np.zeros(len(some), bool), True))], ["h", "n", "rows"])

    # as many rows as the items have shingles, at most
    counts = text.select("text").mapInArrow(frequency, "h bigint, n bigint, rows boolean").groupBy("h", "rows").agg(F.sum("n").alias("n")).collect()
    words.destroy()
    documents = sum(c["n"] for c in counts if c["rows"])
    index = build(ids, texts, {c["h"]: c["n"] for c in counts if not c["rows"]}, documents, threshold, radius)
    return None if index is None else sc.broadcast(index)


class Finder:
    """Searches batches of texts; one for each task."""

    def __init__(self, index: Index):
        self.index, self.quick = index, _quick(index.vocab)
        sizes = index.least()
        self.floor, self.longest = min(sizes.values()), max(sizes)

    def __call__(self, text: pa.Array) -> Iterator[tuple[int, dict]]:
        """Rows in which something is found, and what."""
        index = self.index
        for a, b in pieces(text):
            w = Words(text.slice(a, b - a))
            x, ok = pairs_of(w)
            at = _lookup(index.vocab, self.quick, x, ok)
            acc = np.concatenate([[0.0], np.cumsum(np.where(at >= 0, index.vocab_weight[at], 0.0))])
            # the longest window from each position must reach the least weight of any item
            ahead = np.minimum(np.arange(len(x)) + self.longest, len(x))
            rich = np.flatnonzero(acc[ahead] - acc[:-1] >= self.floor - 1e-9)
            for r in np.unique(w.row[rich]):
                lo, hi = w.first[r], w.first[r + 1] - 1
                if hi > lo and (found := search(index, x[lo:hi], at[lo:hi])):
                    yield a + int(r), found


def _found(text: DataFrame, shared) -> DataFrame:
    def run(batches):
        find = Finder(shared.value)
        for batch in batches:
            out = [(batch.column(0)[row].as_py(), int(find.index.ids[i]), *hit) for row, found in find(batch.column(1)) for i, hit in found.items()]
            if out:
                cols = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "item_id", "similarity", "start", "distance"])

    return text.mapInArrow(run, OUT)


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, max_index_mb: float = MAX_INDEX_MB) -> DataFrame:
    """The rows of docs in which no item is found, with the columns of docs whatever their names.

    Each row goes by its own text: one whose doc_id is null or repeats is judged like any other. No row moves.
    """
    ship(docs.sparkSession)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    at, out = docs.columns.index("text"), docs
    for ids, texts in _parts(items, max_index_mb):
        shared = _index(text, ids, texts, threshold, radius)
        if shared is None:
            continue

        def run(batches, shared=shared):
            find = Finder(shared.value)
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for row, _ in find(batch.column(at).cast(pa.string())):
                    clean[row] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, docs.schema)
    return out
