import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm._words import Words
from lexmill.llm.decontaminate import RADIUS, block_errors, build, candidates, contamination, drop_contaminated, pairs_of, search


def brute(docs, items, threshold):
    """Best similarity of each document and item over all windows, by plain loops."""
    from collections import Counter

    def bag(h, lo, hi):
        return [(h[i], h[i + 1]) for i in range(lo, hi - 1)]

    words = lambda t: (lambda w: w.hash.tolist())(Words(pa.array([t], pa.string())))
    docs, items = [(d, words(t)) for d, t in docs], [(i, words(t)) for i, t in items]
    items = [(i, h) for i, h in items if len(h) > 1]
    f = Counter(x for _, h in docs for x in set(bag(h, 0, len(h))))
    known = {x for _, h in items for x in bag(h, 0, len(h))}
    weight = lambda x: np.log1p(len(docs) / (1 + (f[x] if x in known else 0)))
    out = {}
    for d, h in docs:
        for i, g in items:
            own = Counter(bag(g, 0, len(g)))
            size = min(len(g), len(h))
            for s in range(len(h) - size + 1):
                win = Counter(bag(h, s, s + size))
                if not win:
                    continue
                both = sum(weight(x) * min(win[x], own[x]) for x in win.keys() & own.keys())
                either = sum(weight(x) * max(win[x], own[x]) for x in win.keys() | own.keys())
                if both / either >= threshold:
                    out[d, i] = max(out.get((d, i), 0), round(both / either, 6))
    return out


@pytest.fixture(scope="module")
def case(spark):
    rng = np.random.default_rng(4)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda n: [vocabulary[i] for i in rng.integers(0, 300, n)]
    items = [say(int(n)) for n in rng.integers(8, 40, 25)]
    docs = []
    for d in range(60):
        body = say(int(rng.integers(1, 150)))
        if d % 2:
            item = list(items[d % 25])
            for _ in range(int(rng.integers(0, 6))):
                item[int(rng.integers(0, len(item)))] = "changed"
            at = int(rng.integers(0, len(body)))
            body = body[:at] + item + body[at:]
        docs.append((d, " ".join(body)))
    return docs, [(i, ". ".join(x)) for i, x in enumerate(items)]


def test_equals_brute_force(spark, case):
    docs, items = case
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    want = brute(docs, items, 0.5)
    exact = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contamination(df, bench, 0.5, radius=127).collect()}
    assert exact.keys() == want.keys() and all(abs(exact[k] - want[k]) < 1e-5 for k in want)
    near = {(r["doc_id"], r["item_id"]) for r in contamination(df, bench, 0.5).collect()}
    assert near <= want.keys() and len(near) >= 0.9 * len(want)
    parts = {(r["doc_id"], r["item_id"]): r["similarity"] for r in contamination(df, bench, 0.5, radius=127, max_index_mb=0.01).collect()}
    assert parts == exact


def test_tables_find_every_item_within_the_radius():
    rng = np.random.default_rng(5)
    index = build([1], ["alpha beta gamma delta epsilon"], {}, 10, 0.5, RADIUS)
    assert sum(e + 1 for e in block_errors(RADIUS)) == RADIUS + 1
    mark = np.unpackbits(index.groups[0].marks.view(np.uint8)[0])
    for _ in range(300):
        other = mark.copy()
        other[rng.choice(128, RADIUS, replace=False)] ^= 1
        found = list(candidates(index.groups[0], np.packbits(other)[None], np.array([99.0]), RADIUS))
        assert [(w.tolist(), i.tolist(), d.tolist()) for w, i, d in found] == [([0], [0], [RADIUS])]


def test_candidates_equal_all_pairs_within_the_radius():
    """10,000 items of one size: what the tables name, after the exact tests, is what comparing all fingerprints gives."""
    rng = np.random.default_rng(7)
    index = build(list(range(10_000)), [" ".join(f"x{k}" for k in rng.integers(0, 10**9, 12)) for _ in range(10_000)], {}, 10, 0.6, RADIUS)
    group = max(index.groups, key=lambda g: len(g.items))
    assert len(group.items) == 10_000 and group.tables.nbytes < 6_000_000
    marks = rng.integers(0, 256, (200, 16)).astype(np.uint8)
    marks[:50] = group.marks.view(np.uint8)[:50]
    marks[:50, 3] ^= 7
    want = {(w, i) for w in range(200) for i in np.flatnonzero(np.bitwise_count(marks[w : w + 1].view(np.uint64) ^ group.marks).sum(1) <= RADIUS)}
    got = {(int(w), int(i)) for ws, items, _ in candidates(group, marks, np.full(200, 1e9), RADIUS) for w, i in zip(ws, items, strict=True)}
    assert got == want and len(got) >= 50


def test_long_documents_are_searched_in_stretches(spark):
    words = [f"q{i % 4001}" for i in range(60_000)]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    for at in (8185, 8192, 59_999):
        words.insert(at, item)
    docs = spark.createDataFrame([(1, " ".join(words)), (2, item)], "doc_id bigint, text string")
    got = contamination(docs, spark.createDataFrame([(1, item), (2, " ".join(words[30_000:30_040]))], "item_id bigint, text string")).collect()
    assert {(r["doc_id"], r["item_id"], r["similarity"]) for r in got} == {(1, 1, 1.0), (2, 1, 1.0), (1, 2, 1.0)}


def test_planted_items_are_found_and_no_others(spark, sf, documents):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    flat = lambda t: " ".join(map(str, Words(pa.array([t])).hash.tolist()))
    texts = {r["doc_id"]: f" {flat(r['text'])} " for r in documents.collect()}
    want = {(d, r["item_id"]) for r in items.collect() for d, t in texts.items() if f" {flat(r['text'])} " in t}
    got = {(r["doc_id"], r["item_id"]) for r in contamination(documents, items).collect()}
    assert want and want <= got and len(got - want) <= 0.02 * len(texts)


def test_odd_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "Over the lazy dog and RUNS far away!"), (1, None), (None, "fox jumps over"), (2, "single"), (3, ""), (4, "over the lazy dog and runs far away")], "item_id bigint, text string")
    got = sorted(((r["doc_id"] or -1), r["item_id"]) for r in contamination(odd, items).collect())
    assert got == [(-1, 1), (-1, 4), (1, 1), (1, 4), (2, 1), (2, 4)]
    kept = drop_contaminated(odd, items)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 3, 4, 5, 6, 7, 8, 9]
    assert contamination(nothing, items).collect() == [] and contamination(odd, items.limit(0)).collect() == []
    assert drop_contaminated(odd, items.limit(0)).count() == odd.count()


def test_rows_go_by_their_own_text_and_keep_their_columns(spark):
    rows = [(1, "the item of the benchmark is here", 5, True), (1, "another text altogether", 6, False), (2, None, 7, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, __row bigint, __bad boolean")
    kept = drop_contaminated(docs, spark.createDataFrame([(1, "item of the benchmark is here")], "item_id bigint, text string"))
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == sorted(rows[1:])


def test_windows_of_one_document():
    index = build([7], ["a b c d"], {}, 5, 0.6, 127)
    x, ok = pairs_of(Words(pa.array(["z a b c d z"])))
    at = np.searchsorted(index.vocab, x[:-1])
    at = np.where(np.isin(x[:-1], index.vocab), at, -1)
    assert search(index, x[:-1], at)[0][:2] == (1.0, 1)


@pytest.mark.parametrize("rate", [0.01, 0.1, 0.5])
def test_equal_edits_score_alike_at_every_size(rate):
    """Items of 15 words with one inner word changed, held by a share of the documents, at the default threshold."""
    rng = np.random.default_rng(6)
    words = lambda n: [f"u{i}" for i in rng.integers(0, 1 << 40, n)]
    items = [words(15) for _ in range(40)]
    edited = [words(9) + x[:7] + ["changed"] + x[8:] + words(9) for x in items]
    scores = []
    for documents in (1_000, 100_000, 6_000_000):
        for radius in (127, RADIUS):
            x, ok = pairs_of(Words(pa.array([" ".join(i) for i in items])))
            index = build(list(range(40)), [" ".join(i) for i in items], {int(h): int(rate * documents) for h in x[ok].view(np.int64)}, documents, 0.6, radius)
            got = []
            for i, text in enumerate(edited):
                y, inside = pairs_of(Words(pa.array([" ".join(text)])))
                y = y[inside]
                at = np.minimum(np.searchsorted(index.vocab, y), len(index.vocab) - 1)
                got.append(search(index, y, np.where(index.vocab[at] == y, at, -1)).get(i))
            assert sum(g is not None for g in got) >= (40 if radius == 127 else 36)
            scores += [g[0] for g in got if g]
    assert min(scores) > 0.7 and max(scores) - min(scores) < 0.001
