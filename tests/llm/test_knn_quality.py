import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.llm._words import mix
from lexmill.llm.knn_quality import Model, classify, fit, keep_good, terms


def test_votes_equal_brute_force():
    rng = np.random.default_rng(3)
    unit = lambda n: (lambda x: (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))(rng.normal(size=(n, 8)))
    model = Model(np.zeros(1, np.uint64), np.zeros((1, 8), np.float32), np.concatenate([unit(50), unit(1).repeat(6, 0)]), rng.integers(0, 2, 56).astype(np.float32), rng.integers(0, 2, 56).astype(np.float32), 5)
    docs = np.concatenate([unit(40), model.vectors[-1:]])
    good, toxic = model.vote(docs)
    for i, d in enumerate(docs):
        cos = model.vectors @ d
        near = cos >= np.sort(cos)[-5] - 1e-4
        w = np.maximum(cos[near], 1e-3)
        assert abs(good[i] - (w * model.good[near]).sum() / w.sum()) < 1e-4
        assert abs(toxic[i] - (w * model.toxic[near]).sum() / w.sum()) < 1e-4


def test_held_out_accuracy(spark):
    """Labels that the model hasn't seen: junk and toxic documents go, clean ones stay."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(4)) > 0
    got = classify(docs, labels.where(train)).join(labels.where(~train), "doc_id")
    rate = {(r["quality"], r["toxic"]): (r["kept"], r["n"]) for r in got.groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert rate[1, 0][0] > 0.97
    assert rate[0, 0][0] < 0.05
    assert rate[1, 1][0] < 0.2


def test_toxic_words_are_caught(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    bad = docs.where(F.lower("text").rlike(r"\b(idiot|moron|trash|scum|clown|loser)\b"))
    assert classify(docs, labels).join(bad, "doc_id").where("keep").count() == 0


def test_odd_rows(spark, odd, nothing, labels):
    got = classify(odd, labels)
    assert got.count() == odd.count() and got.columns == ["doc_id", "quality_score", "toxic_score", "keep"]
    assert keep_good(odd, labels).columns == odd.columns
    assert classify(nothing, labels).collect() == []
    assert fit(odd, labels.limit(0)) is None
    free = classify(odd, labels.limit(0)).collect()
    assert len(free) == odd.count() and all(r["keep"] and r["quality_score"] is None for r in free)


def plain_scores(texts, sample, k=15):
    """The whole classifier by its definition, with dictionaries: (good, toxic) of each text. sample has (text, quality, toxic)."""
    from lexmill.llm.knn_quality import CONSTANT_WEIGHT, DIMS, MAX_TERMS, MIN_SHAPE_Z, MIN_Z

    def bag(x):
        return {int(t) for t in terms(pa.array([x], pa.string()))[1]}

    bags = [bag(x) for x, _, _ in sample]
    shape = {int(t) for t in mix(np.arange(64, dtype=np.uint64) + np.uint64(1000))}
    n, weight = len(bags), {0: CONSTANT_WEIGHT}
    for term in set().union(*bags) - {0}:
        best = 0.0
        for label in (1, 2):
            have = [term in b for b in bags]
            a, c = sum(h and s[label] for h, s in zip(have, sample, strict=True)), sum(h and not s[label] for h, s in zip(have, sample, strict=True))
            total = sum(s[label] for s in sample)
            b, d = total - a, n - total - c
            g = 2 * sum(x * np.log(x * n / (row * col)) for x, row, col in ((a, a + c, total), (c, a + c, n - total), (b, b + d, total), (d, b + d, n - total)) if x)
            if g >= (MIN_SHAPE_Z if term in shape else MIN_Z) ** 2:
                best = max(best, abs(np.log((a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5)))))
        if best:
            weight[term] = best
    top = sorted((-w, np.int64(np.uint64(t)) if t < 1 << 63 else t - (1 << 64), t) for t, w in weight.items() if t)[:MAX_TERMS]
    vocab = [0] + [t for _, _, t in top]
    w = np.array([CONSTANT_WEIGHT] + [weight[t] ** 2 for t in vocab[1:]])
    x = np.array([[t in b for t in vocab] for b in bags], float)
    _, _, axes = np.linalg.svd(x * w, full_matrices=False)
    project = lambda v: (lambda y: y / max(np.linalg.norm(y), 1e-9))((v * w) @ axes[:DIMS].T)
    vectors = np.array([project(v) for v in x])
    out = []
    for text in texts:
        b = bag(text)
        cos = vectors @ project(np.array([t in b for t in vocab], float))
        near = cos >= np.sort(cos)[-min(k, n)] - 1e-4
        v = np.maximum(cos[near], 1e-3)
        out.append(tuple((v * np.array([s[i] for s in sample])[near]).sum() / v.sum() for i in (1, 2)))
    return out


def test_classifier_equals_its_definition(spark, documents, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    text = {r["doc_id"]: r["text"] for r in rows}
    sample = [(text[r["doc_id"]], int(r["quality"] > 0), int(r["toxic"] > 0)) for r in labels.collect() if r["doc_id"] in text]
    got = {r["doc_id"]: (r["quality_score"], r["toxic_score"]) for r in classify(documents, labels).collect()}
    want = dict(zip(text, plain_scores(list(text.values()), sample), strict=True))
    far = [d for d in text if abs(got[d][0] - want[d][0]) > 0.02 or abs(got[d][1] - want[d][1]) > 0.02]
    # a neighbour at the very edge of the ties may differ by rounding
    assert len(far) <= 0.02 * len(text)


def test_names_of_columns_clash_with_nothing(spark, labels):
    rows = [(1, "one two", True, 1.0), (None, None, None, None), (4, "", False, 0.0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, keep boolean, id double")
    assert {tuple(r) for r in keep_good(docs, labels.limit(0)).collect()} == set(rows)
    kept = keep_good(docs, labels, min_quality=-1.0, max_toxic=2.0)
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == set(rows)
