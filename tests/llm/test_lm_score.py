import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm._words import Words
from lexmill.llm.lm_score import PRIOR, Block, _from_planes, _from_small, _planes, _small, automaton, lm_score


class Plain:
    """Dirichlet-smoothed word n-grams by their definition."""

    def __init__(self, texts, order, vocabulary=1 << 20):
        self.order, self.vocabulary = order, vocabulary
        self.c, self.context = Counter(), Counter()
        for x in texts:
            y = self.pad(x)
            for i in range(order - 1, len(y)):
                for m in range(1, order + 1):
                    self.c[y[i - m + 1 : i + 1]] += 1
                    self.context[y[i - m + 1 : i]] += 1

    def pad(self, x):
        return ("<",) * (self.order - 1) + tuple(re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (x or "").lower())) + (">",)

    def p(self, gram):
        if not gram:
            return 1 / self.vocabulary
        k = PRIOR[min(len(gram), len(PRIOR)) - 1]
        return (self.c[gram] + k * self.p(gram[1:])) / (self.context[gram[:-1]] + k)

    def score(self, x):
        y = self.pad(x)
        return sum(math.log(self.p(y[i - self.order + 1 : i + 1])) for i in range(self.order - 1, len(y)))


def others(texts, i, order=3):
    return Plain(texts[:i] + texts[i + 1 :], order).score(texts[i])


LONG = " ".join(f"w{i * i % 41}" for i in range(2000))
TEXTS = ["The cat sat on the mat", "the cat sat on the hat", "the cat sat on the hat", None, "", " .", LONG, "a a a a b a a", "Ünïcode cat"]
ASKED = [*TEXTS, "the hat sat", "never seen", "sat on sat on the cat w1 w4", LONG[500:1500]]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_equals_the_definition(order):
    w = Words(pa.array(TEXTS, pa.string()))
    vocab, codes = np.unique(w.hash, return_inverse=True)
    block = Block(vocab, codes, w.counts, order)
    types = block.types()
    size = len(codes) + len(TEXTS)
    plain = Plain(TEXTS, order)
    assert np.allclose(automaton(block, types[2], len(TEXTS), size, False, types=types).score(block), [plain.score(x) for x in TEXTS], rtol=1e-9)
    assert np.allclose(automaton(block, types[2], len(TEXTS), size, True, types=types).score(block), [others(TEXTS, i, order) for i in range(len(TEXTS))], rtol=1e-9)


def test_probabilities_of_a_state_sum_to_one():
    w = Words(pa.array(TEXTS, pa.string()))
    vocab, codes = np.unique(w.hash, return_inverse=True)
    block = Block(vocab, codes, w.counts, 3)
    types = block.types()
    m = automaton(block, types[2], len(TEXTS), len(codes) + len(TEXTS), False, vocabulary=len(vocab) + 1, types=types)
    symbols = np.append(np.arange(len(vocab)), block.end)
    for state in range(0, len(m.fail), 7):
        _, gain = m.advance(np.full(len(symbols), state), symbols)
        assert abs(np.exp(gain).sum() - 1) < 1e-9


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


@pytest.mark.parametrize("block,parts", [(1 << 20, 4), (200, 3)])
def test_scores_equal_the_definition_however_blocks_are_cut(spark, block, parts):
    got = {r["doc_id"]: r for r in lm_score(frame(spark, TEXTS), block=block, parts=parts).collect()}
    plain = Plain(TEXTS, 3)
    assert np.allclose([got[i]["log_prob"] for i in range(len(TEXTS))], [others(TEXTS, i) for i in range(len(TEXTS))], rtol=1e-9)
    assert [got[i]["n_tokens"] for i in range(len(TEXTS))] == [len(plain.pad(x)) - 2 for x in TEXTS]


def test_other_texts_follow_failure_arcs(spark):
    got = {r["doc_id"]: r["log_prob"] for r in lm_score(frame(spark, ASKED), frame(spark, TEXTS), block=300, parts=3).collect()}
    plain = Plain(TEXTS, 3)
    assert np.allclose([got[i] for i in range(len(ASKED))], [plain.score(x) for x in ASKED], rtol=1e-9)
    empty = {r["doc_id"]: r["log_prob"] for r in lm_score(frame(spark, ASKED), frame(spark, [])).collect()}
    assert math.isclose(empty[0], 7 * math.log(1 / (1 << 20)))


def test_odd_rows(spark, odd, nothing):
    rows = lm_score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r["log_prob"]) and r["n_tokens"] >= 1 for r in rows)
    texts = [r["text"] for r in odd.select("text").collect()]
    assert sorted(round(r["log_prob"], 4) for r in rows) == sorted(round(others(texts, i), 4) for i in range(len(texts)))
    assert sum(r["doc_id"] is None for r in rows) == 2 and lm_score(nothing).count() == 0


def test_documents_that_occur_twice_score_apart(spark, documents):
    some = documents.where("length(text) > 500").dropDuplicates(["text"]).select("doc_id", "text").orderBy("doc_id").limit(60)
    twice = some.where("doc_id % 3 = 0")
    got = {r["doc_id"]: r["log_prob_per_token"] for r in lm_score(some.unionByName(twice)).collect()}
    double = {r["doc_id"] for r in twice.select("doc_id").collect()}
    assert np.median([got[d] for d in double]) > np.quantile([v for d, v in got.items() if d not in double], 0.9)


def test_codes_of_hashes_and_counts_are_whole():
    rng = np.random.default_rng(3)
    for x in (np.empty(0, np.int64), np.array([0, 254, 255, 256, 1 << 40]), rng.integers(0, 400, 5000)):
        assert np.array_equal(_from_small(_small(x)), x)
    keys = np.unique(rng.integers(0, 1 << 56, 3000, dtype=np.uint64))
    assert np.array_equal(_from_planes(_planes(keys)), keys)
