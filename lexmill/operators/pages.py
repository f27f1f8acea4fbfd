"""Page ranges, page merging and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T


def parse_ranges(specs: DataFrame) -> DataFrame:
    """(doc_id, spec, total, error, ranges): the page-range grammar ``n`` or ``a-b``, comma-separated; error is null where it holds."""
    items = F.filter(F.transform(F.split("spec", ","), lambda x: F.trim(x)), lambda x: x != "")
    low = lambda x: F.regexp_extract(x, r"^(\d+)", 1).try_cast("int")
    high = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"-\s*(\d+)$", 1), F.lit("")).try_cast("int"), low(x))
    ok = lambda x: x.rlike(r"^\d+(\s*-\s*\d+)?$")
    ranges = F.transform(items, lambda x: F.struct(low(x).alias("a"), high(x).alias("b")))
    out = specs.withColumn("items", items).withColumn("ranges", F.when(F.forall("items", ok), ranges))
    error = (
        F.when(F.size("items") == 0, "empty")
        .when(F.col("ranges").isNull(), "bad character")
        .when(F.exists("ranges", lambda r: (r["a"] < 1) | (r["b"] < 1)), "below 1")
        .when(F.exists("ranges", lambda r: r["a"] > r["b"]), "start after end")
        .when(F.exists("ranges", lambda r: r["b"] > F.col("total")), "beyond the last page")
    )
    return out.withColumn("error", error).select("doc_id", "spec", "total", "error", F.when(F.col("error").isNull(), F.col("ranges")).alias("ranges"))


def merge_ranges(parsed: DataFrame) -> DataFrame:
    """(doc_id, a, b): overlapping or adjacent ranges as one."""
    r = parsed.where("error is null").select("doc_id", F.explode("ranges").alias("r")).select("doc_id", "r.a", "r.b").distinct()
    w = Window.partitionBy("doc_id").orderBy("a", "b")
    before = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0)
    return r.withColumn("new", new).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def selected_pages(merged: DataFrame) -> DataFrame:
    """(doc_id, page, place): the pages of merged ranges, and each one's place among them from 0."""
    p = merged.select("doc_id", F.explode(F.sequence("a", "b")).alias("page")).distinct()
    return p.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1)


def suggestions(parsed: DataFrame) -> DataFrame:
    """(doc_id, advice): what to change in a range that doesn't hold."""
    e = F.col("error")
    advice = F.array_compact(F.array(F.when(e == "empty", "give a page or a range"), F.when(e == "bad character", "use digits, hyphens and commas"), F.when(e == "below 1", "pages start at 1"), F.when(e == "start after end", "put the lower page first"), F.when(e == "beyond the last page", F.concat(F.lit("the last page is "), F.col("total")))))
    return parsed.where(e.isNotNull()).select("doc_id", F.array_join(advice, "; ").alias("advice"))


def merge_pages(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two extractions of the same pages: the text that is over 1.5 times as long, else that of higher quality, of equal ones the first."""
    j = a.select("doc_id", "page", F.col("text").alias("ta")).join(b.select("doc_id", "page", F.col("text").alias("tb")), ["doc_id", "page"], "full")
    la, lb = F.length(F.coalesce("ta", F.lit(""))), F.length(F.coalesce("tb", F.lit("")))
    qa, qb = (F.round(T.text_quality(F.coalesce(c, F.lit(""))), 9) for c in ("ta", "tb"))
    pick = F.when(F.col("tb").isNull(), "a").when(F.col("ta").isNull(), "b").when(la > 1.5 * lb, "a").when(lb > 1.5 * la, "b").when(qb > qa, "b").otherwise("a")
    return j.select("doc_id", "page", pick.alias("source"), F.when(pick == "a", F.col("ta")).otherwise(F.col("tb")).alias("text"))


def missing_pages(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(doc_id, page) of expected that aren't present."""
    return expected.select("doc_id", "page").join(present.select("doc_id", "page"), ["doc_id", "page"], "left_anti")


def needs_ocr(pages: DataFrame) -> DataFrame:
    """Whether a document's extraction is so thin that pages should be recognised again."""
    g = pages.groupBy("doc_id").agg(F.max("page").alias("last"), F.countDistinct("page").alias("n"), F.sum(F.length("text")).alias("chars"))
    gap = F.col("last") - F.col("n")
    wide = F.when(F.col("last") < 50, gap > 0).when(F.col("last") < 500, gap > 0.1 * F.col("last")).otherwise(gap > 0.2 * F.col("last"))
    return g.select("doc_id", "last", "n", ((F.col("chars") / F.col("last") < 100) | (F.col("chars") < 500) | wide).alias("needs_ocr"))


def sentences(docs: DataFrame) -> DataFrame:
    """(doc_id, i, sentence): cut at white space after a full stop, an exclamation or a question mark."""
    return docs.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("i", "sentence")).where("sentence <> ''")


def pack(docs: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """Sentence chunks (doc_id, chunk, text, n_sentences): greedy, each but the first opened by the end of the one before.

    A sentence longer than the size stays whole. A fold over the sentences of a document, inside the JVM.
    """
    parts = F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: x != "")
    empty = F.expr("named_struct('out', cast(array() as array<struct<t:string,n:int>>), 'cur', '', 'n', 0)")

    def step(a, s):
        fits = (F.length(a["cur"]) + F.length(s) + 1 <= size) | (a["cur"] == "")
        tail = F.trim(F.right(a["cur"], F.lit(overlap)))
        grown = F.struct(a["out"].alias("out"), F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s)).alias("cur"), (a["n"] + 1).alias("n"))
        done = F.struct(F.concat(a["out"], F.array(F.struct(a["cur"].alias("t"), a["n"].alias("n")))).alias("out"), F.trim(F.concat(tail, F.lit(" "), s)).alias("cur"), F.lit(1).alias("n"))
        return F.when(fits, grown).otherwise(done)

    last = lambda a: F.when(a["cur"] == "", a["out"]).otherwise(F.concat(a["out"], F.array(F.struct(a["cur"].alias("t"), a["n"].alias("n")))))
    return docs.select("doc_id", F.posexplode(F.aggregate(parts, empty, step, last)).alias("chunk", "c")).select("doc_id", "chunk", F.col("c.t").alias("text"), F.col("c.n").alias("n_sentences"))


def token_windows(docs: DataFrame, width: int = 200, overlap: int = 200) -> DataFrame:
    """(doc_id, start, text, n_words): windows of words, each width - overlap // 4 after the last."""
    w = F.filter(F.split("text", r"(?U)\s+"), lambda x: x != "")
    step = width - overlap // 4
    d = docs.select("doc_id", w.alias("w")).where("size(w) > 0").select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("start"))
    cut = F.slice("w", F.col("start") + 1, F.lit(width))
    return d.select("doc_id", "start", F.array_join(cut, " ").alias("text"), F.size(cut).alias("n_words"))


def section_chunks(elements: DataFrame, size: int = 400, overlap: int = 60) -> DataFrame:
    """Chunks of each element's heading and body, numbered through the document."""
    text = F.concat_ws(" ", F.when(F.col("number") != "", F.concat_ws(" ", "number", "title")), F.regexp_replace("body", r"\s+", " "))
    keyed = elements.select(F.struct("doc_id", "seq").alias("doc_id"), text.alias("text"))
    c = pack(keyed, size, overlap).select("doc_id.*", "chunk", "text", "n_sentences")
    return c.select("doc_id", "seq", (F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "chunk")) - 1).alias("chunk"), "text", F.md5("text").alias("chunk_hash"), T.n_words("text").alias("n_words"))
