import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm._words import Words
from lexmill.llm.suffix_family import Family, repeats, windows


def covered(rows):
    return {(r["doc_id"], i) for r in rows for i in range(r["start"], r["end"])}


def brute(rows, length):
    """Word places of windows that occur in two documents at least, and of those that occur twice at all."""
    seen = {}
    for d, t in rows:
        h = Words(pa.array([t], pa.string())).hash.tolist()
        for i in range(len(h) - length + 1):
            seen.setdefault(tuple(h[i : i + length]), set()).add((d, i))
    spread = lambda keep: {(d, i + j) for at in seen.values() if keep(at) for d, i in at for j in range(length)}
    return spread(lambda at: len({d for d, _ in at}) > 1), spread(lambda at: len(at) > 1)


@pytest.mark.parametrize(("length", "prefix", "batches", "send"), [(50, 25, 4, 64), (50, 25, 3, 0), (12, 5, 1, 64)])
def test_equals_brute_force(documents, length, prefix, batches, send):
    got = covered(repeats(documents, length, prefix, batches, send).collect())
    across, any_ = brute([(r["doc_id"], r["text"]) for r in documents.collect()], length)
    assert across <= got <= any_


def test_equal_windows_have_equal_leads():
    rng = np.random.default_rng(7)
    passage = " ".join(f"p{i}" for i in rng.integers(0, 99, 60))
    rows = [" ".join(f"q{i}" for i in rng.integers(0, 99, 30)) + " " + passage + " tail" for _ in range(4)]
    _, _, lead, whole = windows(pa.array(rows), 50, 25)
    by = {}
    for k, h in zip(lead.tolist(), whole.tolist(), strict=True):
        by.setdefault(h, set()).add(k)
    assert all(len(v) == 1 for v in by.values()) and len(by) < len(whole)


def test_partner_and_levels(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 60])) for i in range(6)] + [(10, " ".join(words[0:55] + ["z"] + words[0:55]))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r["doc_id"], r["start"], r["end"]): r["other"] for r in repeats(df, 50, 25).collect()}
    assert got == {(0, 0, 55): 10, (10, 0, 55): 0, (10, 56, 111): 0}
    family = Family(spark, 50, 25)
    for i in range(5):
        family.add(df.where(f"doc_id % 5 = {i}").select("doc_id", "text"))
    assert [rank for rank, _ in family.levels] == [2, 0]
    assert sum(spark.read.parquet(p).count() for _, p in family.levels) >= len(rows)
    family.close()
    assert family.levels == []


def test_odd_rows(spark, odd, nothing):
    got = {(r["doc_id"], r["start"], r["other"]) for r in repeats(odd, 20, 8).collect()}
    assert {d for d, _, _ in got} == {1, 2} and (1, 0, 2) in got and (2, 0, 1) in got
    assert repeats(nothing).collect() == []
    same = spark.createDataFrame([(1, "der " * 300)], "doc_id bigint, text string")
    assert repeats(same).collect() == []
    with pytest.raises(ValueError, match="prefix"):
        repeats(odd, 5, 9)


@pytest.mark.parametrize("send", [64, 0])
def test_repeats_within_one_document_equal_brute_force(spark, send):
    """Notices of few and many words over and over, each in one document alone; a part that only overlaps itself is none."""
    rows = [(p, " ".join([f"h{p}x{i}" for i in range(30)] + [f"n{p}x{i}" for i in range(p)] * (2000 // p) + [f"t{p}x{i}" for i in range(70)])) for p in (2, 5, 20, 25, 26, 27, 40, 60)]
    short = (100, " ".join([f"s{i}" for i in range(20)] * 4))
    got = repeats(spark.createDataFrame([*rows, short], "doc_id bigint, text string"), send_mb=send).collect()
    assert covered(got) == brute(rows, 50)[1]
    assert {(r["doc_id"], r["start"], r["other"]) for r in got} == {(p, 30, p) for p, _ in rows}


def test_a_kept_family_takes_later_batches(spark):
    words = [f"w{i * 7919 % 5003}" for i in range(300)]
    old = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(f"o{i}" for i in range(200)))], "doc_id bigint, text string")
    new = spark.createDataFrame([(3, "intro " + " ".join(words[100:200])), (4, " ".join(f"n{i}" for i in range(200)))], "doc_id bigint, text string")
    family = Family(spark)
    assert family.add(old).count() == 0
    later = Family.open(spark, family.save())
    found = later.add(new)
    assert found.count() > 0 and [rank for rank, _ in later.levels] == [1]
    level = spark.read.parquet(later.levels[0][1])
    assert {r["doc_id"] for r in level.join(found, "lead", "left_semi").collect()} == {1, 3}
    later.close()
