"""Token counts that follow edits.

A text is cut into segments of whole pre-tokens, about ``SEGMENT`` characters each, the leaves of a segment tree; an inner node holds the
characters and tokens below it. An edit (start, n, new) replaces n characters by new. The tree finds the touched leaves by descent over character sums; their text is
joined and edited. Where an edge of the result is no longer a certain pre-token boundary, the neighbouring leaf is added as context. Only that region is encoded again, and sums
change on the paths to the root.

Trees can be kept: ``plant`` makes a table of leaves and their counts, ``edit_trees`` applies a batch of edits to it and gives the table for the next batch, so a later batch encodes what it touches and
nothing else. ``counts_after`` does both in one pass, for edits that a function makes of the text.

A cut is certain where a single space lies between two characters that aren't white space: every pre-token of the pattern takes at most one space, at its front, or white
space alone. So the count of a text is the sum of its leaves, before and after any edit.

Defined cases: a null text counts as empty, with no token; edits are clipped to the text at the time; an edit with null start or n takes 0, null text is empty; edits of one document apply in
the order of seq, then of start, n and new; a null doc_id has no edit in a table of edits; repeated rows are each counted. Other columns are ignored; an empty table gives no row.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.token_planes import TOKENIZER, encoding
from lexmill.session import ship

SEGMENT = 512
OUT = "doc_id bigint, n_edits int, tokens_before bigint, tokens_after bigint, tokens_encoded bigint, chars_after bigint"
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
_NAMES = [x.split()[0] for x in OUT.split(", ")]
Edit = tuple[int, int, str]

_SUSPECT = re.compile(r"[\d@=]|AKIA")
_PRIVATE = re.compile(
    r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+"  # mail address, from the start of its run so that long runs are read once
    r"|\bAKIA[0-9A-Z]{16}\b|\b(?:token|secret|password|api_key)\s*=\s*\"[^\"]*\""  # key
    r"|\b\d{1,3}(?:\.\d{1,3}){3}\b"  # IPv4 address
    r"|\+\d{1,3} \(\d{3}\) \d{3}-\d{4}|\b\d{13,19}\b"  # telephone, card
)


def redactions(text: str, mask: str = "[private]") -> list[Edit]:
    """Edits that put a mask for personal data and secrets, from the end so that starts hold."""
    if not _SUSPECT.search(text):
        return []
    return [(m.start(), m.end() - m.start(), mask) for m in _PRIVATE.finditer(text)][::-1]


def _certain(left: str, right: str) -> bool:
    """Whether the end of one text and the start of the next is a certain boundary."""
    return bool(left) and not left[-1].isspace() and len(right) > 1 and right[0] == " " and not right[1].isspace()


def cuts(text: str, segment: int = SEGMENT) -> list[str]:
    """The text in segments at certain boundaries; one without any is whole."""
    out, at, n = [], 0, len(text)
    while n - at > segment:
        k = text.find(" ", at + segment)
        while 0 < k < n - 1 and (text[k - 1].isspace() or text[k + 1].isspace()):
            k = text.find(" ", k + 1)
        if k < 0 or k >= n - 1:
            break
        out.append(text[at:k])
        at = k
    out.append(text[at:])
    return out


class Tree:
    """A segment tree of the leaves of one text."""

    def __init__(self, text: str, count: Callable[[str], int], segment: int = SEGMENT):
        self.count, self.segment = count, segment
        self.encoded = 0
        self._plant(text)

    @classmethod
    def restore(cls, leaves: list[str], tokens: list[int], count: Callable[[str], int], segment: int = SEGMENT) -> Tree:
        """The tree of kept leaves and counts; nothing is encoded."""
        tree = cls.__new__(cls)
        tree.count, tree.segment, tree.encoded = count, segment, 0
        tree._grow(leaves or [""], tokens or [0])
        return tree

    def kept(self) -> tuple[list[str], list[int]]:
        """Leaves and counts, for restore()."""
        some = [(leaf, self.tokens[self.size + i]) for i, leaf in enumerate(self.leaves) if leaf] or [("", 0)]
        return [x for x, _ in some], [n for _, n in some]

    def _plant(self, text: str) -> None:
        leaves = cuts(text, self.segment) if text else [""]
        self._grow(leaves, [self.count(leaf) if leaf else 0 for leaf in leaves])

    def _grow(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = list(leaves)
        self.size = 1
        while self.size < len(self.leaves):
            self.size *= 2
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (leaf, n) in enumerate(zip(self.leaves, tokens, strict=True)):
            self.chars[self.size + i], self.tokens[self.size + i] = len(leaf), n
        for i in range(self.size - 1, 0, -1):
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def _set(self, i: int, leaf: str) -> None:
        self.leaves[i] = leaf
        n = self.count(leaf) if leaf else 0
        self.encoded += n
        i += self.size
        self.chars[i], self.tokens[i] = len(leaf), n
        while i > 1:
            i //= 2
            self.chars[i], self.tokens[i] = self.chars[2 * i] + self.chars[2 * i + 1], self.tokens[2 * i] + self.tokens[2 * i + 1]

    def find(self, at: int) -> tuple[int, int]:
        """The leaf of a character and its place there; for the end of the text the last leaf that isn't empty."""
        i, at = 1, min(at, self.chars[1] - 1)
        while i < self.size:
            i *= 2
            if at >= self.chars[i]:
                at -= self.chars[i]
                i += 1
        return i - self.size, at

    def edit(self, start: int, n: int, new: str) -> None:
        total = self.chars[1]
        start = min(max(start, 0), total)
        n = min(max(n, 0), total - start)
        if not n and not new:
            return
        if not total:
            self._plant(new)
            self.encoded += self.tokens[1]
            return
        a, inner = self.find(start)
        if start == total:
            inner = len(self.leaves[a])
        b = self.find(start + n - 1)[0] if n else a
        b = max(a, b)
        text = "".join(self.leaves[a : b + 1])
        text = text[:inner] + new + text[inner + n :]
        # context until both edges are certain boundaries again
        while True:
            low = next((i for i in range(a - 1, -1, -1) if self.leaves[i]), None)
            high = next((i for i in range(b + 1, len(self.leaves)) if self.leaves[i]), None)
            if not text:
                if low is None or high is None or _certain(self.leaves[low], self.leaves[high]):
                    break
                a, text = low, self.leaves[low]
            elif low is not None and not _certain(self.leaves[low], text):
                a, text = low, self.leaves[low] + text
            elif high is not None and not _certain(text, self.leaves[high]):
                b, text = high, text + self.leaves[high]
            else:
                break
        parts = cuts(text, self.segment)
        room = b - a + 1
        if len(parts) > room:
            parts[room - 1 :] = ["".join(parts[room - 1 :])]
        for i in range(room):
            part = parts[i] if i < len(parts) else ""
            if part != self.leaves[a + i]:
                self._set(a + i, part)
        if len(self.leaves[a + min(len(parts), room) - 1]) > 16 * self.segment:
            # a leaf that grew too long: the tree is planted anew (this counts as encoding)
            self._plant("".join(self.leaves))
            self.encoded += self.tokens[1]


def follow(text: str, edits: Iterable[Edit], count: Callable[[str], int], segment: int = SEGMENT) -> tuple[int, int, int, int, int]:
    """Number of edits, tokens before and after, tokens encoded for the edits, characters after."""
    tree = Tree(text, count, segment)
    before, n = tree.tokens[1], 0
    for start, size, new in edits:
        tree.edit(start, size, new)
        n += 1
    return n, before, tree.tokens[1], tree.encoded, tree.chars[1]


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def counts_after(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = redactions, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> DataFrame:
    """Counts of every document before and after the edits that a function makes of its text. No row moves."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(tokenizer))

    def run(batches):
        enc = encoding(shared.value)
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = text.as_py() or ""
                rows.append((doc, *follow(t, edits_of(t), count, segment)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, OUT)


def counts_after_table(docs: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> DataFrame:
    """The same for edits in a table (doc_id, seq, start, n, new); starts are places in the text as earlier edits left it."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(tokenizer))
    each = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("__id")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "n", F.col("new")))).alias("edits"))
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        enc = encoding(shared.value)
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            rows = []
            for doc, text, own in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                todo = [(e["start"] or 0, e["n"] or 0, e["new"] or "") for e in own.as_py() or []]
                rows.append((doc, *follow(text.as_py() or "", todo, count, segment)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return text.join(each, F.col("doc_id") == F.col("__id"), "left").select("doc_id", "text", "edits").mapInArrow(run, OUT)


TREES = "doc_id bigint, leaves array<string>, tokens array<int>"
EDITED = TREES + ", n_edits int, tokens_before bigint, tokens_after bigint, tokens_encoded bigint, chars_after bigint"
_KEPT = [pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32())]


def plant(docs: DataFrame, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> DataFrame:
    """(doc_id, leaves, tokens): the segment tree of each document, to be written as a table. Null text has one empty leaf; no row moves."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(_ranks(tokenizer))

    def run(batches):
        enc = encoding(shared.value)
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            rows = [(doc, *Tree(text.as_py() or "", count, segment).kept()) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KEPT, strict=True)], ["doc_id", "leaves", "tokens"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, TREES)


def edit_trees(trees: DataFrame, edits: DataFrame, tokenizer: str = TOKENIZER, segment: int = SEGMENT) -> DataFrame:
    """Trees after a batch of edits (doc_id, seq, start, n, new), with the counts before and after and the tokens encoded for it; (doc_id, leaves, tokens) of the result are the trees for the next batch.

    Documents without an edit pass through and nothing of them is encoded.
    """
    ship(trees.sparkSession)
    shared = trees.sparkSession.sparkContext.broadcast(_ranks(tokenizer))
    each = edits.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("of")).agg(F.array_sort(F.collect_list(F.struct("seq", "start", "n", F.col("new")))).alias("edits"))

    def run(batches):
        enc = encoding(shared.value)
        count = lambda s: len(enc.encode_ordinary(s))
        for batch in batches:
            rows = []
            for doc, leaves, tokens, own in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tree = Tree.restore(leaves, tokens, count, segment)
                before = tree.tokens[1]
                for e in own or []:
                    tree.edit(e["start"] or 0, e["n"] or 0, e["new"] or "")
                rows.append((doc, *tree.kept(), len(own or []), before, tree.tokens[1], tree.encoded, tree.chars[1]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [*_KEPT, *_TYPES[1:]], strict=True)], [x.split()[0] for x in EDITED.split(", ")])

    joined = trees.select("doc_id", "leaves", "tokens").join(each, F.col("doc_id") == F.col("of"), "left")
    return joined.select("doc_id", "leaves", "tokens", "edits").mapInArrow(run, EDITED)
