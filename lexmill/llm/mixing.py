"""Soft-membership mixing of documents to target weights of domains.

1. A multinomial naive Bayes classifier is fitted on a bounded sample of labelled documents (``max_labelled`` rows of the labelled table,
   the least hashes of doc_id) whose domain is known; its table is ``buckets`` x domains floats, whatever the input.
2. Each document gets a posterior p over the domains from its whole text (log-likelihood ratios are tempered to ``evidence`` words) and its number n of words.
3. With A the matrix of rows n_i * p_i and c = A'1 the present totals, the rates r minimise sum_d (A'r - t)_d^2 / c_d over r >= 0 by accelerated
   projected gradient from r = 1, where t are the target token totals. The gradient of document i is scaled by 1 / n_i, so that long and short documents of a domain move
   alike; the step is 1 / the greatest eigenvalue of the Hessian. A step needs only the residual (A'r - t) / c, one vector of domain length, summed over the
   documents in Spark. The rate of a document is a fold over the residuals so far, so no table of rates is written or joined, and no lineage grows with the steps.
   The fit ends when the totals are within ``TOLERANCE`` of the targets, or when ``STALL`` steps in turn lower the objective by less than a millionth of it, as where no rates reach
   the targets; after ``STEPS`` steps without either, a warning states how far off the totals are, and the rates are those of the last step.

Targets: either given weights of domains, or the present totals to the power ``alpha``. Their sum is ``budget`` present totals; by default
the least budget at which no domain is asked for less than it has: rare domains are repeated and nothing is thrown away.

Why domains and not the raw source column by default: the domain column is a parameter; the registered query takes ``lang``, as the sources of
the test tables are drawn without regard to the text, so that posteriors over them would be flat.

Defined cases: documents without a word get n = 0, the classifier's prior as posterior, and rate 1; without any labelled document, posteriors are uniform over
the known domains; without any known domain all rates are 1. Null doc_ids are mixed like others; repeated rows each get the same rate. Other columns are ignored.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from lexmill.llm._spark import cut, fresh
from lexmill.llm._words import Words, pieces
from lexmill.session import ship

MAX_LABELLED, BUCKETS, EVIDENCE, ALPHA, STEPS, TOLERANCE, STALL = 8192, 1 << 16, 12.0, 0.7, 200, 1e-4, 10


@dataclass
class Bayes:
    domains: list[str]
    prior: np.ndarray  # log
    table: np.ndarray  # buckets x domains, log-likelihood of a word minus its mean over domains
    evidence: float

    def posterior(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows x domains, and the number of words of each row."""
        out, count = np.empty((len(text), len(self.domains))), np.empty(len(text), np.int64)
        for a, b in pieces(text):
            w = Words(text.slice(a, b - a))
            n = w.counts
            score = np.zeros((b - a, len(self.domains)))
            has = np.flatnonzero(n)
            if len(has):
                score[has] = np.add.reduceat(self.table[(w.hash & np.uint64(len(self.table) - 1)).astype(np.int64)], w.first[has], axis=0)
            score *= (np.minimum(n, self.evidence) / np.maximum(n, 1))[:, None]
            score += self.prior
            score -= score.max(1, keepdims=True)
            p = np.exp(score)
            out[a:b], count[a:b] = p / p.sum(1, keepdims=True), n
        return out, count


def fit(docs: DataFrame, labels: DataFrame, domain: str, max_labelled: int = MAX_LABELLED, buckets: int = BUCKETS, evidence: float = EVIDENCE) -> Bayes | None:
    """The classifier of the domain column; None if no document has a domain."""
    known = sorted(r[0] for r in docs.select(F.col(f"`{domain}`").cast("string").alias("d")).where("d is not null").distinct().collect())
    if not known:
        return None
    sample = labels.select(F.col("doc_id").cast("bigint").alias("id")).dropna().distinct().orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    rows = F.broadcast(sample).join(docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col(f"`{domain}`").cast("string").alias("d"), F.col("text").cast("string").alias("text")), "id").where("d is not null").select("d", "text")

    def count(batches):
        total, seen = np.zeros((len(known), buckets)), np.zeros(len(known))
        for batch in batches:
            at = np.searchsorted(known, batch.column(0).to_numpy(zero_copy_only=False).astype(str))
            seen += np.bincount(at, minlength=len(known))
            for a, b in pieces(batch.column(1)):
                w = Words(batch.column(1).slice(a, b - a))
                np.add.at(total, (at[a:b][w.row], (w.hash & np.uint64(buckets - 1)).astype(np.int64)), 1)
        d, k = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d, np.arange(len(known))]).astype(np.int32)), pa.array(np.concatenate([k, np.full(len(known), -1)]).astype(np.int32)), pa.array(np.concatenate([total[d, k], seen]))], ["d", "k", "n"])

    # at most domains x buckets rows come back
    got = rows.mapInArrow(count, "d int, k int, n double").groupBy("d", "k").agg(F.sum("n").alias("n")).toArrow()
    d, k, n = (got[c].to_numpy() for c in ("d", "k", "n"))
    words, seen = np.zeros((buckets, len(known))), np.zeros(len(known))
    words[k[k >= 0], d[k >= 0]] = n[k >= 0]
    seen[d[k < 0]] = n[k < 0]
    table = np.log((words + 0.1) / (words.sum(0) + 0.1 * buckets))
    return Bayes(known, np.log((seen + 1) / (seen + 1).sum()), (table - table.mean(1, keepdims=True)).astype(np.float32), evidence)


def rates_of(n: np.ndarray, p: np.ndarray, residuals: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """The rates after one accelerated projected-gradient step for each residual, from 1; and where the next gradient is taken."""
    rate = ahead = np.ones(len(n))
    t = 1.0
    for g in residuals:
        moved = np.where(n > 0, np.maximum(0, ahead - step * (p @ g)), 1.0)
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = moved + (t - 1) / later * (moved - rate)
        rate, t = moved, later
    return rate, ahead


def posteriors(docs: DataFrame, model: Bayes, names: list[str], residuals: np.ndarray | None = None, step: float = 1.0) -> DataFrame:
    """docs with the number of words and the posterior of each text in columns of the first two names, and with residuals the rate in one of the third."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model, residuals))
    at = docs.columns.index("text")
    more = [StructField(n, t) for n, t in zip(names, [LongType(), ArrayType(DoubleType()), DoubleType()][: 2 if residuals is None else 3], strict=False)]

    def run(batches):
        m, moves = shared.value
        for batch in batches:
            p, n = m.posterior(batch.column(at).cast(pa.string()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            extra = [pa.array(n), lists] + ([] if moves is None else [pa.array(rates_of(n, p, moves, step)[0])])
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, *[f.name for f in more]])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *more]))


def targets(have: np.ndarray, domains: list[str], weights: dict[str, float] | None, alpha: float, budget: float | None) -> np.ndarray:
    """Target totals by domain."""
    share = np.array([max(0.0, float((weights or {}).get(d, 0))) for d in domains]) if weights else np.maximum(have, 0) ** alpha
    if not share.sum():
        return have.copy()
    share = share / share.sum()
    if budget is None:
        some = share > 0
        return share * float(np.max(have[some] / share[some]))
    return share * budget * have.sum()


def solve(table: DataFrame, domains: list[str], weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None, steps: int = STEPS, tolerance: float = TOLERANCE):
    """Residuals (steps x domains), the step length, the totals reached and the targets, for a table of numbers of words and posteriors."""
    k = len(domains)
    sc = table.sparkSession.sparkContext

    def matrix(batch):
        return batch.column(0).to_numpy().astype(float), batch.column(1).flatten().to_numpy().reshape(-1, k)

    def moments(batches):
        acc = np.zeros((k + 1, k))
        for batch in batches:
            n, p = matrix(batch)
            acc[0] += n @ p
            acc[1:] += p.T @ (p * n[:, None])
        yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()], pa.list_(pa.float64()))], ["x"])

    def total(fn, size: int) -> np.ndarray:
        # one short vector for each partition, summed in Spark
        out = np.zeros(size)
        for c in table.mapInArrow(fn, "x array<double>").select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[c["i"]] = c["v"]
        return out

    m = total(moments, (k + 1) * k).reshape(k + 1, k)
    have, gram = m[0], m[1:]
    goal = targets(have, domains, weights, alpha, budget)
    inverse = np.where(have > 0, 1 / np.maximum(have, 1e-9), 0)
    hessian = np.sqrt(inverse)[:, None] * gram * np.sqrt(inverse)
    step = 1 / max(float(np.linalg.eigvalsh((hessian + hessian.T) / 2)[-1]), 1e-9)
    residuals: list[np.ndarray] = []
    now = ahead = have
    objective = lambda x: float((((x - goal) ** 2) * inverse).sum())
    best, still = objective(now), 0
    while np.abs(now - goal).sum() > tolerance * goal.sum() and still < STALL:
        if len(residuals) == steps:
            warnings.warn(f"mixing stopped after {steps} steps: totals are off by {np.abs(now - goal).sum() / goal.sum():.2%} of the targets", stacklevel=2)
            break
        residuals.append((ahead - goal) * inverse)
        shared = sc.broadcast(np.array(residuals))

        def apply(batches, shared=shared):
            acc = np.zeros((2, k))
            for batch in batches:
                n, p = matrix(batch)
                acc += (np.stack(rates_of(n, p, shared.value, step)) * n) @ p
            yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()], pa.list_(pa.float64()))], ["x"])

        now, ahead = total(apply, 2 * k).reshape(2, k)
        shared.destroy()
        still = 0 if objective(now) < best * (1 - 1e-6) else still + 1
        best = min(best, objective(now))
    return np.array(residuals).reshape(-1, k), step, now, goal


def _rated(docs: DataFrame, labels: DataFrame, domain: str, weights, alpha: float, budget: float | None, steps: int, names: list[str], **how) -> tuple[DataFrame, list[str]] | None:
    """docs with columns of the names for number of words, posterior and rate, and the domains; None without a domain."""
    ship(docs.sparkSession)
    model = fit(docs, labels, domain, **how)
    if model is None:
        return None
    small = cut(posteriors(docs.select(F.col("text").cast("string").alias("text")), model, ["n", "p"]).select("n", "p"))
    residuals, step, _, _ = solve(small, model.domains, weights, alpha, budget, steps)
    return posteriors(docs, model, names, residuals, step), model.domains


def mix(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None, steps: int = STEPS, **how) -> DataFrame:
    """(doc_id, n_tokens, domain, posterior, rate) of every document; domain is the likeliest."""
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(f"`{domain}`").cast("string").alias("known"))
    made = _rated(slim, labels, "known", weights, alpha, budget, steps, ["n_tokens", "posterior", "rate"], **how)
    if made is None:
        return slim.select("doc_id", F.lit(0).cast("bigint").alias("n_tokens"), F.lit(None).cast("string").alias("domain"), F.array().cast("array<double>").alias("posterior"), F.lit(1.0).alias("rate"))
    rated, domains = made
    likeliest = F.element_at(F.array(*[F.lit(d) for d in domains]), F.array_position("posterior", F.array_max("posterior")).cast("int"))
    return rated.select("doc_id", "n_tokens", likeliest.alias("domain"), "posterior", "rate")


def resample(docs: DataFrame, labels: DataFrame, domain: str = "lang", weights: dict[str, float] | None = None, alpha: float = ALPHA, budget: float | None = None, steps: int = STEPS, **how) -> DataFrame:
    """docs with each row floor(rate + u) times, u in [0, 1) a hash of its doc_id and text: the expected number of copies is the rate. Columns stay whatever their names.

    Rows with a null doc_id or text have a u of what they have; rows that repeat doc_id and text get the same number of copies each.
    """
    n, p, rate, copy = fresh(docs.columns, "n_tokens", "posterior", "rate", "copy")
    made = _rated(docs, labels, domain, weights, alpha, budget, steps, [n, p, rate], **how)
    if made is None:
        return docs
    u = F.xxhash64("doc_id", "text", F.lit(17)).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    copies = F.floor(F.col(rate) + u).cast("int")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return made[0].where(copies > 0).select(*columns, F.explode(F.array_repeat(F.lit(1), copies)).alias(copy)).select(*columns)
