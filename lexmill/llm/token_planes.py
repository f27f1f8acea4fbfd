"""Token ids as compressed bit planes.

The documents of a partition are encoded one after the other; ids are cut into blocks of ``BLOCK`` whatever document they
belong to. A block is transposed: plane j holds bit j of every id, packed eight to a byte, and is compressed by zstandard by itself.
High planes are nearly constant and shrink to almost nothing. One row is one block:

(shard, block, n_ids, width, docs ARRAY<STRUCT<doc_id, start, n>>, offsets ARRAY<INT>, payload BINARY, crc BIGINT)

``offsets`` has width + 1 entries: plane j is payload[offsets[j]:offsets[j+1]]. ``docs`` is the chunk index: the pieces
of documents in the block, each with its first position in the block. A document of more than one block has a piece in each.
No row moves: there is no shuffle, and a lost task is made again alone.

Defined cases: a null text counts as empty; a document without any token has one piece of n = 0; a null doc_id stays null;
repeated rows are written as often as they come; an empty table gives no block. Other columns are ignored. Special-token strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import ship

BLOCK, LEVEL = 65536, 3
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "shard int, block int, n_ids int, width int, docs array<struct<doc_id: bigint, start: int, n: int>>, offsets array<int>, payload binary, crc bigint"
_made: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a tiktoken vocabulary file's content; one for each process."""
    import tiktoken

    key = zlib.crc32(ranks)
    if key not in _made:
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _made[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _made[key]


def pack(ids: np.ndarray, width: int, level: int = LEVEL) -> tuple[list[int], bytes]:
    """Bit planes of a block, compressed; the offset of each plane and the end."""
    squeeze = zstandard.ZstdCompressor(level=level)
    out, offsets = [], [0]
    for j in range(width):
        z = squeeze.compress(np.packbits((ids >> np.uint32(j)).astype(np.uint8) & 1).tobytes())
        out.append(z)
        offsets.append(offsets[-1] + len(z))
    return offsets, b"".join(out)


def unpack(payload: bytes, offsets: list[int], n: int) -> np.ndarray:
    """The ids of a block: the inverse of pack()."""
    ids = np.zeros(n, np.uint32)
    for j in range(len(offsets) - 1):
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[offsets[j] : offsets[j + 1]]), np.uint8)
        ids |= np.unpackbits(bits)[:n].astype(np.uint32) << np.uint32(j)
    return ids


def token_planes(docs: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """Blocks of bit planes of all documents; see the module."""
    ship(docs.sparkSession)
    with open(tokenizer, "rb") as f:
        ranks = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches):
        from pyspark import TaskContext

        enc = encoding(shared.value)
        width = max(1, int(enc.n_vocab - 1).bit_length())
        shard, number = TaskContext.get().partitionId(), 0
        parts: list[np.ndarray] = []
        index: list[dict] = []
        filled = 0
        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int32()), ("width", pa.int32()), ("docs", pa.list_(pa.struct([("doc_id", pa.int64()), ("start", pa.int32()), ("n", pa.int32())]))), ("offsets", pa.list_(pa.int32())), ("payload", pa.binary()), ("crc", pa.int64())])

        def flush():
            nonlocal parts, index, filled, number
            ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
            offsets, payload = pack(ids, width, level)
            row = {"shard": shard, "block": number, "n_ids": filled, "width": width, "docs": index, "offsets": offsets, "payload": payload, "crc": zlib.crc32(ids.tobytes())}
            parts, index, filled, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array(enc.encode_ordinary(text.as_py() or ""), np.uint32)
                at = 0
                while True:
                    take = min(len(ids) - at, block - filled)
                    index.append({"doc_id": doc, "start": filled, "n": take})
                    parts.append(ids[at : at + take])
                    filled += take
                    at += take
                    if filled == block:
                        yield flush()
                    if at >= len(ids):
                        break
        if index:
            yield flush()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def read_tokens(blocks: DataFrame) -> DataFrame:
    """The documents' ids again: (shard, doc_id, block, start, ids) for each piece, in the order of shard, block and start."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["offsets"], row["n_ids"])
                if zlib.crc32(ids.tobytes()) != row["crc"]:
                    raise ValueError(f"block {row['shard']}/{row['block']} is damaged")
                out = [{"shard": row["shard"], "block": row["block"], "doc_id": d["doc_id"], "start": d["start"], "ids": ids[d["start"] : d["start"] + d["n"]].tolist()} for d in row["docs"]]
                yield pa.RecordBatch.from_pylist(out, pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("start", pa.int32()), ("ids", pa.list_(pa.int32()))]))

    return blocks.mapInArrow(run, "shard int, block int, doc_id bigint, start int, ids array<int>")
