"""Repeated passages by a logarithmic family of sparse suffix arrays.

A passage is ``LENGTH`` consecutive words (case and punctuation aside); a window is one of its occurrences. Each window is led by the least fingerprint among its ``PREFIX``-word
prefixes of suffixes, a function of its words alone, so equal windows are led by equal fingerprints. Consecutive windows of the same lead form a
run. The *suffix array* of a batch of documents holds one entry for each run, (lead, doc_id, start, n): the suffixes that start at leads, sorted by the fingerprint of their
first PREFIX words, about 2 / (LENGTH - PREFIX + 2) of all suffixes. No repeated window can be missed by leaving out the others.

``Family`` keeps the arrays as sorted levels in the shared folder. A new batch gets its array, which is scanned in merge order against itself and each level: leads that
occur again, or in a run of more than LENGTH windows, are what may repeat. Then it becomes a level of rank 0, and as long as two levels have the same rank they are merged to one of the next rank: n batches leave at most
log2(n) + 1 levels, and an entry is rewritten log2(n) times at most. ``save`` keeps a family for later batches, ``Family.open`` takes it up again. The order of the arrays is that of
fingerprints of 25-word blocks, not of letters: suffixes with equal first blocks lie next to each other, which is what the scan needs; the lengths of matches come from the exact step at the end.

At last the runs of leads that occur again are read with the 64-bit hashes of all their windows, and those hashes that occur in at least two runs, or
in one run at starts LENGTH or more apart (text of a short period), are repeats: exact but for hash collisions. They are merged to maximal spans of words.

Defined cases: null and empty texts and those of fewer than LENGTH words have no window; rows with a null doc_id are left out; rows that repeat a doc_id with equal text are one document,
with other text they are parts of one document; a passage that only overlaps itself within one run, and a run of one word repeated on and on, is no repeat by itself, elsewhere in the same document it is.
Other columns are ignored; empty tables give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.llm._spark import remove, scratch
from lexmill.llm._words import Words, mix, pieces
from lexmill.session import ship

LENGTH, PREFIX, BATCHES, SEND_MB = 50, 25, 4, 64
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("p", ())) < n:
        for key, base in (("p", _BASE), ("i", _INVERSE)):
            x = np.full(max(n, 1 << 19), base, np.uint64)
            x[0] = 1
            _powers[key] = np.multiply.accumulate(x)
    return _powers["p"][:n], _powers["i"][:n]


def _grams(acc: np.ndarray, inverse: np.ndarray, k: int) -> np.ndarray:
    n = len(acc) - k
    return mix((acc[k:] - acc[:n]) * inverse[:n]) if n > 0 else np.empty(0, np.uint64)


def windows(text: pa.Array, length: int = LENGTH, prefix: int = PREFIX):
    """Of all windows of a piece of text rows: row, start word in the row, lead, hash; in order."""
    w = Words(text)
    n = len(w.hash)
    if n < length:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    p, inverse = _power(n + 1)
    acc = np.zeros(n + 1, np.uint64)
    np.cumsum(w.hash * p[:n], out=acc[1:])
    low = _grams(acc, inverse, prefix)
    # the least of length - prefix + 1 neighbours, by doubling
    span, done = length - prefix + 1, 1
    while done < span:
        step = min(done, span - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    whole = _grams(acc, inverse, length)
    row = w.row
    ok = np.flatnonzero(row[: n - length + 1] == row[length - 1 :])
    return row[ok], ok - w.first[row[ok]], low[: n - length + 1][ok], whole[ok]


def runs(text: pa.Array, length: int = LENGTH, prefix: int = PREFIX):
    """Of each run: row, start, number of windows, lead; and the hashes of all windows in order."""
    row, start, lead, whole = windows(text, length, prefix)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (lead[1:] != lead[:-1])
    at = np.flatnonzero(new)
    return row[at], start[at], np.diff(np.append(at, len(row))), lead[at], whole


def suffix_array(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX) -> DataFrame:
    """The entries (lead, doc_id, start, n) of a batch, not yet sorted."""

    def run(batches):
        for batch in batches:
            for a, b in pieces(batch.column(1)):
                row, start, n, lead, _ = runs(batch.column(1).slice(a, b - a), length, prefix)
                if len(row):
                    yield pa.RecordBatch.from_arrays([pa.array(lead.view(np.int64)), batch.column(0).take(pa.array(row + a)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["lead", "doc_id", "start", "n"])

    return docs.select("doc_id", "text").mapInArrow(run, "lead bigint, doc_id bigint, start int, n int")


class Family:
    """Levels of sorted suffix arrays in the shared folder."""

    def __init__(self, spark: SparkSession, length: int = LENGTH, prefix: int = PREFIX):
        self.spark, self.length, self.prefix = spark, length, prefix
        self.folder = scratch(spark, "suffixes")
        self.levels: list[tuple[int, str]] = []
        self.found: list[str] = []
        self.made = 0
        ship(spark)

    def _write(self, df: DataFrame, kind: str) -> str:
        self.made += 1
        path = f"{self.folder}/{kind}{self.made}"
        df.write.parquet(path)
        return path

    def save(self) -> str:
        """Write what open() needs; the folder."""
        rows = [("level", rank, path) for rank, path in self.levels] + [("found", 0, path) for path in self.found] + [("made", self.made, f"{self.length} {self.prefix}")]
        self.spark.createDataFrame(rows, "kind string, rank int, path string").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/family")
        return self.folder

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Family:
        """The family that save() has kept in a folder."""
        rows = spark.read.parquet(f"{folder}/family").collect()
        made = next(r for r in rows if r["kind"] == "made")
        family = cls(spark, *map(int, made["path"].split()))
        family.folder, family.made = folder, made["rank"]
        family.levels = sorted(((r["rank"], r["path"]) for r in rows if r["kind"] == "level"), key=lambda x: -x[0])
        family.found = [r["path"] for r in rows if r["kind"] == "found"]
        return family

    def add(self, docs: DataFrame) -> DataFrame:
        """Index a batch of new documents (doc_id, text); the leads that occur again in it or in a level."""
        return self.index(suffix_array(docs, self.length, self.prefix))

    def index(self, entries: DataFrame) -> DataFrame:
        """The same for the entries of a batch."""
        new = self._write(entries.repartition("lead").sortWithinPartitions("lead", "doc_id", "start"), "level")
        array = self.spark.read.parquet(new)
        # the same lead next to itself in merge order, or in one run that can hold a window twice: within the batch, or first in the batch and then in a level
        again = array.groupBy("lead").agg(F.count("*").alias("k"), F.max("n").alias("n"))
        leads = again.where((F.col("k") > 1) | (F.col("n") > self.length)).select("lead")
        for _, path in self.levels:
            leads = leads.unionByName(again.select("lead").hint("merge").join(self.spark.read.parquet(path).select("lead"), "lead", "left_semi"))
        self.found.append(self._write(leads.distinct(), "found"))
        self.levels.append((0, new))
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (rank, a), (_, b) = self.levels[-2:]
            both = self.spark.read.parquet(a).unionByName(self.spark.read.parquet(b))
            merged = self._write(both.repartition("lead").sortWithinPartitions("lead", "doc_id", "start"), "level")
            self.levels[-2:] = [(rank + 1, merged)]
            remove(self.spark, a)
            remove(self.spark, b)
        return self.spark.read.parquet(self.found[-1])

    def leads(self) -> DataFrame:
        """All leads that were found again so far."""
        return self.spark.read.parquet(*self.found).distinct()

    def close(self) -> None:
        """Remove the levels; what was found stays."""
        for _, path in self.levels:
            remove(self.spark, path)
        self.levels = []


def _spans(table: pa.Table, length: int):
    """Spans of windows that occur in two runs at least or apart in one, of all runs of some leads."""
    lists = table["hashes"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    h = lists.flatten().to_numpy()
    run = np.repeat(np.arange(len(size)), size)
    doc = table["doc_id"].to_numpy()
    start = table["start"].to_numpy()[run] + np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size)
    by = np.lexsort((start, run, h))
    h, run, start = h[by], run[by], start[by]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    head = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    fresh = np.concatenate([[True], new[1:] | (run[1:] != run[:-1])])
    repeated = np.add.reduceat(fresh.astype(np.int64), head) > 1
    # of each hash in each run: the first start and the last, and whether windows next to each other are equal, which is one word on and on
    part = np.flatnonzero(fresh)
    last = np.append(part[1:], len(start)) - 1
    beside = np.concatenate([[False], ~fresh[1:] & (start[1:] == start[:-1] + 1)])
    apart = (start[last] - start[part] >= length) & ~np.logical_or.reduceat(beside, part)
    repeated[group[part[apart]]] = True
    repeated = repeated[group]
    none = np.iinfo(np.int64).max
    own = doc[run]
    least = np.minimum.reduceat(own, head)[group]
    second = np.minimum.reduceat(np.where(own == least, none, own), head)[group]
    other = np.where(own != least, least, second)[repeated]
    own, start = own[repeated], start[repeated]
    if not len(own):
        return
    # windows that follow each other in a document are one row
    by = np.lexsort((start, own))
    own, start, other = own[by], start[by], other[by]
    cut = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (start[1:] > start[:-1] + 1)]))
    last = np.append(cut[1:], len(own)) - 1
    away = np.minimum.reduceat(other, cut)
    yield pa.RecordBatch.from_arrays([pa.array(own[cut]), pa.array(start[cut].astype(np.int32)), pa.array((start[last] + length).astype(np.int32)), pa.array(np.where(away == none, own[cut], away))], ["doc_id", "start", "end", "other"])


def repeats(docs: DataFrame, length: int = LENGTH, prefix: int = PREFIX, batches: int = BATCHES, send_mb: int = SEND_MB) -> DataFrame:
    """(doc_id, start, end, n_words, other): maximal spans of words [start, end) of windows that occur again.

    other is a document that shares a window of the span: the least but for doc_id itself, or doc_id where the passage repeats in it alone. Documents are indexed in ``batches``
    by a hash of doc_id.
    """
    if not 0 < prefix <= length:
        raise ValueError("prefix must be from 1 to length")
    spark = docs.sparkSession
    ship(spark)
    text = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    family = Family(spark, length, prefix)
    # one pass over the text makes the entries of all batches
    entries = scratch(spark, "entries")
    suffix_array(text, length, prefix).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(entries)
    table = spark.read.schema("lead bigint, doc_id bigint, start int, n int, batch int").parquet(entries)
    for i in range(batches):
        family.index(table.where(F.col("batch") == i).drop("batch"))
    remove(spark, entries)
    family.close()
    leads = family.leads()
    number = leads.count()
    # leads that fit are sent to where the text is; otherwise all runs go to where the leads are, with equal results
    sent = None
    if number * 8 <= send_mb * 1_000_000:
        sent = spark.sparkContext.broadcast(np.sort(leads.toArrow()["lead"].to_numpy().view(np.uint64)))

    def read(batches_):
        some = sent.value if sent is not None else None
        quick = None
        if some is not None:
            quick = np.zeros(1 << 22, bool)
            quick[(some & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        for batch in batches_:
            for a, b in pieces(batch.column(1)):
                row, start, n, lead, whole = runs(batch.column(1).slice(a, b - a), length, prefix)
                ends = np.cumsum(n)
                keep = np.arange(len(row))
                if some is not None:
                    keep = np.flatnonzero(quick[(lead & np.uint64((1 << 22) - 1)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(some, lead[keep]), max(len(some) - 1, 0))
                    keep = keep[some[at] == lead[keep]] if len(some) else keep[:0]
                if not len(keep):
                    continue
                size = n[keep]
                inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                hashes = whole[np.repeat(ends[keep] - size, size) + inner]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(lead[keep].view(np.int64)), batch.column(0).take(pa.array(row[keep] + a)), pa.array(start[keep].astype(np.int32)), lists], ["lead", "doc_id", "start", "hashes"])

    met = text.mapInArrow(read, "lead bigint, doc_id bigint, start int, hashes array<bigint>")
    if sent is None:
        met = met.join(leads, "lead", "left_semi")
    # rows that repeat a document would repeat its windows
    met = met.dropDuplicates(["lead", "doc_id", "start", "hashes"])

    def confirm(batches_):
        """Rows come sorted by lead; a lead that goes on in the next batch waits for it."""
        rest = None
        for batch in batches_:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            lead = table["lead"].to_numpy()
            n = int(np.searchsorted(lead == lead[-1], True)) if len(lead) else 0
            rest = table.slice(n)
            if n:
                yield from _spans(table.slice(0, n), length)
        if rest is not None and rest.num_rows:
            yield from _spans(rest, length)

    # each partition is read in the order of leads: few calls, however many leads there are
    spans = met.repartition("lead").sortWithinPartitions("lead").mapInArrow(confirm, "doc_id bigint, start int, end int, other bigint")
    by_doc = Window.partitionBy("doc_id").orderBy("start", "end")
    before = F.max("end").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    island = spans.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0)).withColumn("island", F.sum("new").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    merged = island.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.when(F.col("other") != F.col("doc_id"), F.col("other"))).alias("x"))
    return merged.select("doc_id", "start", "end", (F.col("end") - F.col("start")).alias("n_words"), F.coalesce("x", "doc_id").alias("other"))
