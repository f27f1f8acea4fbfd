"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

1. A document is a set of terms: its words and *shape* terms (how much of it is capitals, symbols, separators, repeated words ...).
2. From a bounded sample of labelled documents (``max_labelled`` rows, the least hashes of doc_id; the bound is the only one) each term
   gets, for either label, its smoothed log-odds ratio; of those whose likelihood ratio statistic is ``min_z`` squared at least (``min_shape_z`` for the few shape terms) the ``max_terms`` largest are kept, weighted
   by the square. What tells little thus weighs little, however often it occurs.
   A constant term that every document has stands for what is ordinary.
3. The singular value decomposition of the weighted sample matrix gives the latent space; the labelled vectors in it are broadcast:
   at most max_labelled x dims floats, whatever the input. ``fit`` checks that size.
4. Every document is projected; exact cosines with all labelled vectors are computed in blocks of matrix products. Its neighbours are
   all labelled vectors whose cosine is not below the ``k``-th largest one by more than ``TIE`` (ties all count, in spite of the last digits of 32-bit products), and each votes with its similarity.
5. keep = quality vote >= ``min_quality`` and toxic vote < ``max_toxic``.

Defined cases: labels with a null doc_id, quality or toxic are left out; a doc_id labelled more than once gives one sample row per label row.
A document with null or empty text has the constant term and the shape of an empty text. Without any usable label, scores are null and
all documents stay. Null doc_ids are scored like others, repeated rows each get a row, and other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm._words import STEP, Words, mix, pieces
from lexmill.session import ship

MAX_LABELLED, MAX_TERMS, DIMS, NEIGHBOURS = 8192, 1024, 64, 15
CONSTANT_WEIGHT = 4.0
MIN_Z, MIN_SHAPE_Z, MIN_QUALITY, MAX_TOXIC, MODEL_MB, TIE, ROWS = 4.2, 3.0, 0.5, 0.5, 64, 1e-4, 256
OUT = "doc_id bigint, quality_score double, toxic_score double, keep boolean"

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*!@^~<>{}[]\\=+_"]] = True
_BAR = np.zeros(256, bool)
_BAR[[ord(c) for c in "|\t;"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True
_STEPS = np.array([0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9])
_SHAPES = 8
_CONSTANT = np.uint64(0)


def _raw(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    from lexmill.llm._words import buffers

    return buffers(text)


def _sums(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    acc = np.zeros(len(flag) + 1, np.int64)
    np.cumsum(flag, out=acc[1:])
    return acc[off[1:]] - acc[off[:-1]]


def shapes(text: pa.Array, w: Words) -> np.ndarray:
    """Rows x 8 of ratios in [0, 1]: capitals, symbols, bars, words that repeat the last, the second, third or fifth last, and missing words."""
    data, off = _raw(text)
    size = np.maximum(_sums(~_SPACE[data], off), 1)
    row, h, first = w.row, w.hash, w.first
    count = np.maximum(w.counts, 1)
    out = [np.minimum(1, 1.2 * _sums(_UPPER[data], off) / size), np.minimum(1, 2 * _sums(_SYMBOL[data], off) / size), np.minimum(1, 6 * _sums(_BAR[data], off) / size)]
    for lag in (1, 2, 3, 5):
        same = np.zeros(len(h), bool)
        if len(h) > lag:
            same[lag:] = (h[lag:] == h[:-lag]) & (row[lag:] == row[:-lag])
        out.append(_sums(same, first) / count)
    out.append((w.counts == 0).astype(float))
    return np.stack(out, 1)


def terms(text: pa.Array, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, term hash) pairs, sorted; with ``among`` (sorted hashes) the second is the index in it and other terms are left out."""
    rows, found = [], []
    quick = None
    if among is not None:
        quick = np.zeros(1 << 16, bool)
        quick[(among & np.uint64(0xFFFF)).astype(np.int64)] = True
    for a, b in pieces(text):
        part = text.slice(a, b - a)
        w = Words(part)
        s = shapes(part, w)
        r, j = np.nonzero(s[:, :, None].repeat(len(_STEPS), 2).reshape(len(s), -1) > np.tile(_STEPS, _SHAPES))
        n = b - a
        h, row = w.hash, w.row
        if quick is not None:
            hit = quick[(h & np.uint64(0xFFFF)).astype(np.int64)]
            h, row = h[hit], row[hit]
        h = np.concatenate([h, mix(j.astype(np.uint64) + np.uint64(1000)), np.full(n, _CONSTANT)])
        row = np.concatenate([row, r, np.arange(n)])
        if among is not None:
            at = np.searchsorted(among, h)
            at[at == len(among)] = 0
            ok = among[at] == h
            pair = np.unique(row[ok].astype(np.int64) * len(among) + at[ok])
            rows.append(pair // len(among) + a)
            found.append(pair % len(among))
        else:
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            rows.append(row[new] + a)
            found.append(h[new])
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Model:
    vocab: np.ndarray  # sorted term hashes
    basis: np.ndarray  # terms x dims, weights included
    vectors: np.ndarray  # labelled x dims, of unit length
    good: np.ndarray
    toxic: np.ndarray
    k: int

    def project(self, text: pa.Array) -> np.ndarray:
        row, term = terms(text, self.vocab)
        out = np.zeros((len(text), self.basis.shape[1]), np.float32)
        if len(row):
            first = np.flatnonzero(np.diff(row, prepend=-1))
            for s in range(0, len(first), 4096):
                lo, hi = first[s], first[s + 4096] if s + 4096 < len(first) else len(row)
                out[row[first[s : s + 4096]]] = np.add.reduceat(self.basis[term[lo:hi]], first[s : s + 4096] - lo, axis=0)
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def vote(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good, toxic = np.empty(len(vectors)), np.empty(len(vectors))
        k = min(self.k, len(self.vectors))
        for s in range(0, len(vectors), ROWS):
            # in place: cosines become weights
            cos = vectors[s : s + ROWS] @ self.vectors.T
            least = np.partition(cos, cos.shape[1] - k, axis=1)[:, cos.shape[1] - k, None] - np.float32(TIE)
            far = cos < least
            np.maximum(cos, np.float32(1e-3), out=cos)
            cos[far] = 0
            total = cos.sum(1)
            good[s : s + ROWS], toxic[s : s + ROWS] = cos @ self.good / total, cos @ self.toxic / total
        return good, toxic

    def judge(self, text: pa.Array, min_quality: float, max_toxic: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Quality and toxic votes of texts, and whether they are kept."""
        good, toxic = self.vote(self.project(text)) if len(text) else (np.empty(0), np.empty(0))
        return good, toxic, (good >= min_quality) & (toxic < max_toxic)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS, dims: int = DIMS, k: int = NEIGHBOURS, min_z: float = MIN_Z, min_shape_z: float = MIN_SHAPE_Z) -> Model | None:
    """The model of a bounded sample of labelled rows; None if there are no usable labels."""
    usable = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).dropna()
    sample = usable.orderBy(F.xxhash64("id"), "id", "q", "t").limit(max_labelled)
    rows = F.broadcast(sample).join(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")), "id")

    def gather(batches):
        for batch in batches:
            r, h = terms(batch.column("text"))
            at = np.searchsorted(r, np.arange(batch.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("q"), batch.column("t"), lists], ["id", "q", "t", "terms"])

    from lexmill.llm._spark import cut

    seen = cut(rows.select("id", "q", "t", "text").mapInArrow(gather, "id bigint, q int, t int, terms array<bigint>"))
    size = seen.agg(F.count("*"), F.sum(F.when(F.col("q") > 0, 1).otherwise(0)), F.sum(F.when(F.col("t") > 0, 1).otherwise(0))).first()
    n = size[0]
    if not n:
        return None
    each = seen.select("q", "t", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum(F.when(F.col("q") > 0, 1).otherwise(0)).alias("q"), F.sum(F.when(F.col("t") > 0, 1).otherwise(0)).alias("t"))

    def odds(have: str, total: int):
        # log-odds of the term in one class against the other with add-1/2 smoothing; 0 where the likelihood ratio says little
        have_, n_ = F.col(have).cast("double"), F.col("n").cast("double")
        cell = lambda x, row, side: F.when(x > 0, x * F.log(x * n / (row * side))).otherwise(0.0)
        table = [(have_, n_, total), (n_ - have_, n_, n - total), (total - have_, n - n_, total), (n - total - n_ + have_, n - n_, n - total)]
        g = 2 * sum((cell(x, row, F.lit(float(side))) for x, row, side in table), F.lit(0.0))
        a, c = have_ + 0.5, n_ - have_ + 0.5
        return F.when(g >= F.when(F.col("term").isin(*shape), min_shape_z**2).otherwise(min_z**2), F.abs(F.log(a * (n - total + 1.0 - c) / ((total + 1.0 - a) * c)))).otherwise(0.0)

    shape = [int(x) for x in mix(np.arange(_SHAPES * len(_STEPS), dtype=np.uint64) + np.uint64(1000)).view(np.int64)]
    top = each.where(F.col("term") != int(_CONSTANT)).withColumn("w", F.greatest(odds("q", size[1]), odds("t", size[2]))).where("w > 0").orderBy(F.desc("w"), "term").limit(max_terms).collect()
    vocab = np.array([np.uint64(0)] + [np.uint64(r["term"] & 0xFFFFFFFFFFFFFFFF) for r in top], np.uint64)
    weight = np.array([CONSTANT_WEIGHT] + [r["w"] ** 2 for r in top], np.float32)
    order = np.argsort(vocab)
    vocab, weight = vocab[order], weight[order]
    # of the sample only the kept terms come to the driver
    kept = F.array(*[F.lit(int(x)) for x in vocab.view(np.int64)])
    got = seen.select("q", "t", F.array_intersect("terms", kept).alias("terms")).orderBy("q", "t", F.xxhash64("id"), "id").toArrow()
    x = np.zeros((got.num_rows, len(vocab)), np.float32)
    lists = got["terms"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    at = np.searchsorted(vocab, lists.flatten().to_numpy().view(np.uint64))
    x[np.repeat(np.arange(got.num_rows), np.diff(lists.offsets.to_numpy())), at] = 1
    x *= weight
    values, axes = np.linalg.eigh((x.T @ x).astype(np.float64))
    basis = np.ascontiguousarray(axes[:, np.argsort(-values)[:dims]] * weight[:, None]).astype(np.float32)
    vectors = (x / weight) @ basis
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    model = Model(vocab, basis, vectors.astype(np.float32), (got["q"].to_numpy() > 0).astype(np.float32), (got["t"].to_numpy() > 0).astype(np.float32), k)
    held = sum(v.nbytes for v in vars(model).values() if isinstance(v, np.ndarray)) / 1e6
    if held > MODEL_MB:
        raise ValueError(f"the model has {held:.0f} MB: lower max_labelled, max_terms or dims")
    return model


def classify(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC, **how) -> DataFrame:
    """(doc_id, quality_score, toxic_score, keep) of every document."""
    ship(docs.sparkSession)
    model = fit(docs, labels, **how)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("quality_score"), F.lit(None).cast("double").alias("toxic_score"), F.lit(True).alias("keep"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        for batch in batches:
            good, toxic, keep = shared.value.judge(batch.column(1), min_quality, max_toxic)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(toxic), pa.array(keep)], ["doc_id", "quality_score", "toxic_score", "keep"])

    return rows.mapInArrow(score, OUT)


def keep_good(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC, **how) -> DataFrame:
    """The rows of docs that classify() keeps, with the columns of docs whatever their names. Nulls and repeated rows are judged as by classify(); no row moves."""
    ship(docs.sparkSession)
    model = fit(docs, labels, **how)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(shared.value.judge(batch.column(at).cast(pa.string()), min_quality, max_toxic)[2]))

    return docs.mapInArrow(run, docs.schema)
