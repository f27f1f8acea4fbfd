import re

import numpy as np
import pyarrow as pa

from lexmill.llm.minhash import K, buckets_of, RADIUS, chunk_masks, drop_near_duplicates, forest, near_duplicates, signatures


def groups(rows):
    return {r["doc_id"]: r["group_id"] for r in rows}


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def brute(docs, radius=RADIUS):
    rows = [r for r in docs.select("doc_id", "text").collect() if r["doc_id"] is not None]
    keep, sig = signatures(pa.array([r["text"] for r in rows], pa.string()))
    ids = [rows[i]["doc_id"] for i in keep]
    near = ((sig[:, None] != sig[None]).sum(2) <= radius) | (np.array(ids)[:, None] == np.array(ids)[None])
    root = components(len(ids), np.argwhere(near).tolist())
    low = {}
    for i, r in enumerate(root):
        low[r] = min(low.get(r, ids[i]), ids[i])
    out = {ids[i]: low[r] for i, r in enumerate(root)}
    size = {}
    for g in out.values():
        size[g] = size.get(g, 0) + 1
    return {d: g for d, g in out.items() if size[g] > 1}


def test_join_equals_brute_force(documents):
    assert groups(near_duplicates(documents).collect()) == brute(documents)


def test_pigeonhole_holds_for_every_radius():
    rng = np.random.default_rng(1)
    for radius in (0, 3, 15, 16, 28, 40):
        masks = chunk_masks(radius)
        for _ in range(200):
            differ = np.zeros(K, bool)
            differ[rng.choice(K, radius, replace=False)] = True
            assert any(not differ[m].any() for m in masks)


def test_forest_has_the_components_of_all_pairs():
    rng = np.random.default_rng(2)
    sig = rng.integers(0, 3, (60, K)).astype(np.uint16)
    sig[20:40] = sig[:20]
    sig[20:40, :5] = 9
    for radius in (5, 30, 42):
        linked = np.argwhere(((sig[:, None] != sig[None]).sum(2) <= radius)).tolist()
        assert components(60, forest(sig, radius)) == components(60, linked)


def test_recall_of_close_pairs(documents):
    """Pairs whose shingle similarity is 0.7 and more are found with recall 0.9 at least."""
    rows = documents.select("doc_id", "text").collect()
    words = {r["doc_id"]: re.findall(r"[a-z0-9\u0080-￿]+", r["text"].lower()) for r in rows}
    sets = {d: {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} for d, w in words.items()}
    ids = sorted(sets)
    close = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])]
    got = groups(near_duplicates(documents).collect())
    assert close and sum(got.get(a, -1) == got.get(b, -2) for a, b in close) >= 0.9 * len(close)


def test_odd_rows(odd, nothing):
    got = {r["doc_id"]: (r["group_id"], r["keep"]) for r in near_duplicates(odd).collect()}
    assert got == {1: (1, True), 2: (1, False), 6: (6, True), 7: (6, False)}
    kept = drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, d) for d in (1, 3, 4, 5, 6, 8, 9)] + [(True, 0)] * 2
    assert near_duplicates(nothing).collect() == [] and drop_near_duplicates(nothing).collect() == []


def test_long_chains_settle(spark):
    from lexmill.llm._spark import components as join

    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in join(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_hot_buckets_are_cut_without_losing_a_pair(spark, documents):
    """Signatures that share four values meet in one bucket; cut into pieces of 7, all groups are still found."""
    base = [f"common{i}" for i in range(60)]
    rng = np.random.default_rng(8)
    rows = []
    for d in range(90):
        words = list(base)
        for i in rng.choice(60, d % 9, replace=False):
            words[i] = f"own{d}x{i}"
        rows.append((d, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(docs)
    assert len(want) > 40 and groups(near_duplicates(docs, split=7).collect()) == want == groups(near_duplicates(docs).collect())


def test_buckets_hold_all_rows_in_pieces(spark):
    rng = np.random.default_rng(9)
    keys = np.concatenate([rng.integers(0, 400, 3000), np.full(25_000, 7), [999]])
    rows = list(zip(keys.tolist(), rng.integers(0, 10**6, len(keys)).tolist(), strict=True))
    got: dict = {}
    for r in buckets_of(spark.createDataFrame(rows, "key bigint, rep bigint"), 1000).collect():
        assert len(r["reps"]) <= 1000 and r["piece"] not in got.setdefault(r["key"], {})
        got[r["key"]][r["piece"]] = (r["several"], r["reps"])
    want: dict = {}
    for k, v in rows:
        want.setdefault(k, set()).add(v)
    want = {k: sorted(v) for k, v in want.items() if len(v) > 1}
    assert {k: [x for i in sorted(p) for x in p[i][1]] for k, p in got.items()} == want
    assert all({s for s, _ in p.values()} == {len(p) > 1} for p in got.values()) and len(got[7]) > 20


def test_texts_under_one_id_are_not_lost(spark):
    """Rows with equal id and text are one; different texts under one id all stay, whatever the other columns are named."""
    text = "a text of some length that two documents have but for a word or two at the very end of it all now"
    rows = [(1, text, 1, "p"), (1, "quite another text about other things that no other row has at all", 2, "q"), (2, text + " then", 3, "r"), (3, "single words of a third kind", 4, "s"), (3, "single words of a third kind", 5, "t"), (None, text, 6, "u")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, own_id int, n_rows string")
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert {tuple(r) for r in got.collect()} == {rows[0], rows[1], rows[3], rows[5]}
