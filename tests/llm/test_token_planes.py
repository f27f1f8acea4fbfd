import numpy as np
import pyarrow as pa
import pytest

from lexmill.llm.token_planes import TOKENIZER, encoding, pack, read_tokens, token_planes, unpack


def whole(blocks):
    out = {}
    for r in sorted(read_tokens(blocks).collect(), key=lambda r: (r["shard"], r["block"], r["start"])):
        out.setdefault((r["shard"], r["doc_id"]), []).extend(r["ids"])
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(n):
    ids = np.random.default_rng(n).integers(0, 50256, n).astype(np.uint32)
    offsets, payload = pack(ids, 16)
    assert len(offsets) == 17 and offsets[-1] == len(payload)
    assert unpack(payload, offsets, n).tolist() == ids.tolist()


def test_every_token_comes_back(documents):
    enc = encoding(open(TOKENIZER, "rb").read())
    blocks = token_planes(documents.coalesce(1), block=4096).cache()
    got = whole(blocks)
    for r in documents.collect():
        assert got[0, r["doc_id"]] == enc.encode_ordinary(r["text"])
    sizes = [r["n_ids"] for r in blocks.orderBy("block").collect()]
    assert set(sizes[:-1]) == {4096} and 0 < sizes[-1] <= 4096


def test_damage_is_noticed(spark, documents):
    from pyspark.sql import functions as F

    broken = token_planes(documents.limit(3)).withColumn("crc", F.col("crc") + 1)
    with pytest.raises(Exception, match="damaged"):
        read_tokens(broken).collect()


def test_special_tokens_are_text_and_odd_rows(spark, odd, nothing):
    enc = encoding(open(TOKENIZER, "rb").read())
    text = "a <|endoftext|> b"
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert list(whole(token_planes(df)).values()) == [enc.encode_ordinary(text)]
    rows = read_tokens(token_planes(odd.coalesce(1))).collect()
    pieces = [r for r in rows if r["doc_id"] in (3, 4)]
    assert len(pieces) == 2 and all(r["ids"] == [] for r in pieces)
    assert sum(r["doc_id"] is None for r in rows) == 2
    assert token_planes(nothing).collect() == []
    assert pa.types.is_binary(token_planes(odd).toArrow().schema.field("payload").type)
