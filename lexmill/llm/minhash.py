"""MinHash near-duplicates by a multi-index Hamming join.

Each document gets ``K`` MinHash values of ``B`` bits over its 3-word shingles. The distance of two signatures
is the number of values that differ. The values are split into chunks of four. By the pigeonhole principle, when two
signatures differ in at most ``radius`` values and the allowed errors e_i of the chunks satisfy
``sum(e_i + 1) = radius + 1``, some chunk i differs in at most e_i values. A chunk with an allowed error is entered once for
each choice of values left out, so all pairs within the radius meet in some bucket: the join misses none.

Within a bucket, a breadth-first search over exact distances yields a spanning forest of the graph of near pairs, so a group
of n copies gives n-1 edges and not n*n/2. The union over buckets has the same components as the graph of all near pairs.
A bucket of more than ``SPLIT`` signatures is cut into pieces of that size; each two pieces are searched together by a task of their own, so no task holds
more than two pieces and no pair of the bucket is missed.

Defined cases: a null, empty or word-free text has no signature and belongs to no group; a text of one or two words
has one shingle; rows that repeat a doc_id are one document (in a group when any of its texts is); rows with a null doc_id belong to no group.
Columns other than doc_id and text are ignored whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._spark import components, cut, fresh, stash
from lexmill.llm._words import Words, mix, pieces, shingles
from lexmill.session import ship

K, CHUNK, WORDS, RADIUS, SPLIT = 64, 4, 3, 28, 8192
_SEEDS = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Rows that have a word, and their signatures (rows x K of uint16)."""
    rows, sigs = [], []
    for a, b in pieces(text):
        h, first = shingles(Words(text.slice(a, b - a)), WORDS)
        has = np.flatnonzero(np.diff(first))
        if not len(has):
            continue
        out = np.empty((len(has), K), np.uint16)
        at = first[has]
        for k in range(K):
            x = h * _SEEDS[k]
            x ^= x >> np.uint64(32)
            low = np.minimum.reduceat(x, at)
            out[:, k] = (low * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(48)
        rows.append(has + a)
        sigs.append(out)
    if not rows:
        return np.empty(0, np.int64), np.empty((0, K), np.uint16)
    return np.concatenate(rows), np.concatenate(sigs)


def chunk_masks(radius: int = RADIUS) -> list[np.ndarray]:
    """The value positions of each key: for a chunk of e allowed errors, every choice of CHUNK - e values."""
    chunks = K // CHUNK
    if not 0 <= radius < chunks * CHUNK:
        raise ValueError(f"radius is 0 to {chunks * CHUNK - 1}")
    base, more = divmod(radius + 1, chunks)
    out = []
    for i in range(chunks):
        errors = base + (i < more) - 1
        if errors >= 0:
            out += [np.array(c) for c in combinations(range(i * CHUNK, (i + 1) * CHUNK), CHUNK - errors)]
    return out


def _keys(sig: np.ndarray, radius: int) -> np.ndarray:
    masks = chunk_masks(radius)
    out = np.empty((len(sig), len(masks)), np.uint64)
    wide = sig.astype(np.uint64)
    for j, m in enumerate(masks):
        x = np.full(len(sig), j + 1, np.uint64)
        for p in m:
            x = mix(x * np.uint64(0xD6E8FEB86659FD93) + wide[:, p])
        out[:, j] = x
    return out.view(np.int64)


def forest(sig: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of row pairs within the radius."""
    left = np.arange(len(sig))
    edges: list[tuple[int, int]] = []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            q = queue.pop()
            near = np.zeros(len(left), bool)
            for s in range(0, len(left), 16384):
                near[s : s + 16384] = (sig[left[s : s + 16384]] != sig[q]).sum(1) <= radius
            new = left[near]
            edges += [(int(q), int(x)) for x in new]
            queue += list(new)
            left = left[~near]
    return edges


def buckets_of(keyed: DataFrame, split: int) -> DataFrame:
    """(key, piece, several, reps) of rows (key, rep): the distinct rows of each key that has two or more, in pieces of ``split`` at most.

    Each partition is read once in the order of keys; no more than a batch and a piece is held.
    """

    def run(batches):
        key, held, piece = None, np.empty(0, np.int64), 0

        def lists(keys, pieces_, several, groups):
            offsets = np.concatenate([[0], np.cumsum([len(g) for g in groups])]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(pieces_, pa.int32()), pa.array(several, pa.bool_()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(groups)))], ["key", "piece", "several", "reps"])

        for batch in batches:
            keys, reps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if not len(keys):
                continue
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (reps[1:] != reps[:-1])])
            keys, reps = keys[new], reps[new]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(head[1:], len(keys))
            out: tuple[list, list, list, list] = ([], [], [], [])

            def close(out=out):
                # the open bucket is complete
                if piece or len(held) > 1:
                    for j in range(0, len(held), split):
                        for c, v in zip(out, (key, piece + j // split, piece > 0 or len(held) > split, held[j : j + split]), strict=True):
                            c.append(v)

            first = 0
            if keys[0] == key:
                held = np.concatenate([held, reps[: ends[0]][reps[: ends[0]] > held[-1]]])
                first = 1
            if len(head) > first:
                close()
                # buckets that begin and end in this batch, but for the last, which may go on
                whole = np.flatnonzero((ends - head)[first:-1] > 1) + first
                for i in whole:
                    own = reps[head[i] : ends[i]]
                    for j in range(0, len(own), split):
                        for c, v in zip(out, (keys[head[i]], j // split, len(own) > split, own[j : j + split]), strict=True):
                            c.append(v)
                key, held, piece = keys[-1], reps[head[-1] :], 0
            while len(held) > split:
                for c, v in zip(out, (key, piece, True, held[:split]), strict=True):
                    c.append(v)
                held, piece = held[split:], piece + 1
            if out[0]:
                yield lists(*out)
        if key is not None and (piece or len(held) > 1):
            yield lists([key], [piece], [piece > 0], [held])

    return keyed.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(run, "key bigint, piece int, several boolean, reps array<bigint>")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Documents of groups of two or more near-duplicates: (doc_id, group_id, keep).

    group_id is the least doc_id of the group; keep is true for that document alone. Documents outside any group have no row.
    """

    def sign(batches):
        for batch in batches:
            rows, sig = signatures(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([r.tobytes() for r in sig], pa.binary())], ["doc_id", "sig"])

    def spread(batches):
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, K)
            keys = _keys(sig, radius)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column("rep").to_numpy(), keys.shape[1]))], ["key", "rep"])

    def link(table: pa.Table) -> pa.Table:
        rep = table["rep"].to_numpy()
        sig = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, K)
        order = np.argsort(rep)
        pairs = forest(sig[order], radius)
        rep = rep[order]
        a, b = (np.array([rep[p[i]] for p in pairs], np.int64) for i in (0, 1))
        return pa.table({"a": a, "b": b})

    ship(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    signed = cut(ids.mapInArrow(sign, "doc_id bigint, sig binary"))
    reps = cut(signed.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    same = signed.join(reps.where("n > 1"), "sig").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # one representative stands for all equal signatures, so hot groups of exact copies never meet in a bucket;
    # a doc_id that repeats with other texts may stand for several signatures
    one = reps.select("rep", "sig")
    keyed = one.mapInArrow(spread, "key bigint, rep bigint")
    full = stash(buckets_of(keyed, split), "buckets")
    # members of a group meet in many buckets of the same members: one of them is enough
    plain = full.where("not several").select("reps").distinct().select(F.xxhash64("reps").alias("bucket"), F.explode("reps").alias("rep"))
    hot = full.where("several")
    pieces_ = hot.groupBy("key").agg(F.max("piece").alias("last"))
    other = hot.join(pieces_, "key").select("key", "piece", "reps", F.explode(F.sequence(F.lit(0), "last")).alias("other")).where("other <> piece")
    crossed = other.select(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other")).alias("bucket"), F.explode("reps").alias("rep"))
    met = plain.unionByName(crossed).join(one, "rep").select("bucket", "rep", "sig")
    edges = met.groupBy("bucket").applyInArrow(link, "a bigint, b bigint").unionByName(same)
    return components(edges).select(F.col("node").alias("doc_id"), F.col("root").alias("group_id"), (F.col("node") == F.col("root")).alias("keep"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The rows of docs without those of near-duplicates that aren't kept, with the columns of docs whatever their names.

    Of rows that repeat a doc_id and its text the least stays. A doc_id that occurs with different texts doesn't tell them apart: all its texts stay. Rows whose doc_id
    is null all stay, and so do those whose text is null or has no word.
    """
    own, n, low, high = fresh(docs.columns, "own_id", "n_rows", "low_hash", "high_hash")
    id_ = F.col("doc_id").cast("bigint")
    times = docs.where(id_.isNotNull()).groupBy(id_.alias(own)).agg(F.count("*").alias(n), F.min(F.xxhash64("text")).alias(low), F.max(F.xxhash64("text")).alias(high)).where(F.col(n) > 1)
    times = cut(times.select(own, (F.col(low) != F.col(high)).alias(n)))
    gone = near_duplicates(docs, radius).where("not keep").select(F.col("doc_id").alias(own))
    if times.isEmpty():
        return docs.join(gone, id_ == F.col(own), "left_anti")
    held = docs.join(gone.join(times.where(n).select(own), own, "left_anti"), id_ == F.col(own), "left_anti")
    single, again = (held.join(times.select(own), id_ == F.col(own), how) for how in ("left_anti", "left_semi"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if any("map<" in kind for _, kind in docs.dtypes):
        return single.unionByName(again.dropDuplicates(["doc_id", "text"]))
    least = again.groupBy(id_.alias(own), F.col("text").alias(low)).agg(F.min(F.struct(*columns)).alias(high))
    return single.unionByName(least.select(*[F.col(f"`{high}`").getField(c).alias(c) for c in docs.columns]))
