import numpy as np
from pyspark.sql import functions as F

from lexmill.llm.mixing import fit, mix, posteriors, rates_of, resample, solve, targets


def objective(n, p, goal, have, r):
    return float((((n * r) @ p - goal) ** 2 / have).sum())


def test_rates_minimise_the_objective(spark):
    """Against coordinate descent on random soft memberships, with a target that forces some rates to 0."""
    rng = np.random.default_rng(6)
    n = rng.integers(1, 200, 60).astype(float)
    p = rng.dirichlet([0.3, 0.3, 0.3], 60)
    have = n @ p
    df = spark.createDataFrame([(int(a), [float(x) for x in b]) for a, b in zip(n, p, strict=True)], "n bigint, p array<double>")
    for weights, budget in (({"a": 1, "b": 1, "c": 1}, 1.0), ({"a": 1, "b": 0, "c": 0}, 0.3), ({"a": 5, "b": 1, "c": 2}, None)):
        residuals, step, now, goal = solve(df, ["a", "b", "c"], weights, budget=budget, steps=150)
        r, _ = rates_of(n, p, residuals, step)
        assert (r >= 0).all() and np.allclose((n * r) @ p, now, rtol=1e-9)
        best = np.ones(60)
        for _ in range(400):
            for i in range(60):
                a = n[i] * p[i]
                rest = (n * best) @ p - a * best[i] - goal
                best[i] = max(0, -(a * rest / have).sum() / (a * a / have).sum())
        assert objective(n, p, goal, have, r) <= objective(n, p, goal, have, best) + 1e-3 * goal.sum()


def test_targets():
    have = np.array([60.0, 30.0, 10.0])
    t = targets(have, list("abc"), None, 0.5, None)
    assert (t >= have - 1e-9).all() and np.isclose((t / have).min(), 1)
    assert targets(have, list("abc"), {"a": 1, "b": 1}, 0.5, 1.0).tolist() == [50, 50, 0]


def test_classifier_and_totals(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = mix(documents, labels)
    out = got.join(documents.select("doc_id", "lang"), "doc_id")
    assert out.where(F.col("lang") == F.col("domain")).count() > 0.95 * documents.count()
    model = fit(documents, labels, "lang")
    rows = posteriors(documents, model, ["n", "p"]).select("n", "p").collect()
    n, p = np.array([r[0] for r in rows], float), np.array([r[1] for r in rows])
    goal = targets(n @ p, model.domains, None, 0.7, None)
    reached = np.zeros(len(goal))
    for r in got.collect():
        reached += r["rate"] * r["n_tokens"] * np.array(r["posterior"])
    assert np.abs(reached - goal).sum() <= 2e-4 * goal.sum()


def test_resampling_keeps_all_and_follows_the_rates(spark, sf, documents):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    out = resample(documents, labels)
    assert out.columns == documents.columns
    assert out.select("doc_id").distinct().count() == documents.count()
    rates = {r["doc_id"]: r["rate"] for r in mix(documents, labels).collect()}
    for r in out.groupBy("doc_id").count().collect():
        assert np.floor(rates[r["doc_id"]] - 1e-6) <= r["count"] <= np.ceil(rates[r["doc_id"]] + 1e-6)


def test_odd_rows(odd, nothing, labels):
    got = mix(odd, labels).collect()
    assert len(got) == odd.count()
    assert all(r["rate"] == 1 and r["n_tokens"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mix(nothing, labels).collect() == [] and resample(nothing, labels).collect() == []
    assert resample(odd, labels.limit(0)).columns == odd.columns
    assert mix(odd, labels, domain="node").select("domain").distinct().count() == 1
    assert all(r["rate"] == 1.0 for r in mix(odd.withColumn("lang", F.lit(None).cast("string")), labels).collect())


def test_targets_out_of_reach_end_the_fit(spark, recwarn):
    """Where all posteriors are alike, no rates reach other shares: the fit ends by itself; too few steps are told."""
    df = spark.createDataFrame([(10, [0.5, 0.5])] * 8, "n bigint, p array<double>")
    residuals, _, now, goal = solve(df, ["a", "b"], {"a": 9, "b": 1}, budget=1.0)
    told = lambda: [w for w in recwarn.list if "mixing stopped" in str(w.message)]
    assert len(residuals) < 200 and np.abs(now - goal).sum() > 0.1 and not told()
    uneven = spark.createDataFrame([(10, [0.9, 0.1]), (10, [0.4, 0.6]), (300, [0.55, 0.45])], "n bigint, p array<double>")
    solve(uneven, ["a", "b"], {"a": 9, "b": 1}, steps=1)
    assert told()


def test_names_of_columns_clash_with_nothing(spark, labels):
    rows = [(1, "a b c", "en", 7, "x", 0.5, None), (4, None, None, None, None, None, 3), (None, "d e", "de", 1, "y", 2.0, 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n_tokens bigint, posterior string, rate double, copy int")
    got = resample(docs, labels)
    assert got.columns == docs.columns and {tuple(r) for r in got.collect()} == set(rows)
