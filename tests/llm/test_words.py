import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm._words import Words, pieces, shingles, word_hash


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=8))
def test_words_are_those_of_a_regular_expression(texts):
    w = Words(pa.array(texts, pa.string()))
    lower = [pa.array([t]).to_pylist()[0] or "" for t in texts]
    import pyarrow.compute as pc

    lower = [x or "" for x in pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()]
    want = [re.findall(r"[a-z0-9A-Z\u0080-\U0010ffff]+", x) for x in lower]
    assert w.counts.tolist() == [len(x) for x in want]
    assert w.hash.tolist() == [word_hash(x) for ws in want for x in ws]


def test_shingles_stay_in_their_row_and_pieces_cover_all():
    t = pa.array(["a b c d", "x", None, "", "p q", "a b c d"])
    h, first = shingles(Words(t), 3)
    assert np.diff(first).tolist() == [2, 1, 0, 0, 1, 2]
    assert h[:2].tolist() == h[-2:].tolist()
    assert list(pieces(t, 4)) == [(0, 1), (1, 2), (2, 4), (4, 5), (5, 6)] or sum(b - a for a, b in pieces(t, 4)) == len(t)
