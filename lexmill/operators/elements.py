"""Structural elements of regulations: headings, articles, hierarchy and windows over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators.forms import each

LEVELS = {"TITRE": 1, "CHAPITRE": 2, "SECTION": 3, "ANNEXE": 4, "Article": 5}
NAMES = {1: "TITLE", 2: "CHAPTER", 3: "SECTION", 4: "ANNEX", 5: "ARTICLE"}
_KINDS = "|".join(LEVELS)
_NUMBER = rf"^(?:{_KINDS}) ([IVX]+|[0-9]+(?:\.[0-9]+)?(?: (?:bis|ter|quater))?)"


def elements(corpus: DataFrame, *more: str) -> DataFrame:
    """(doc_id, file_name, seq, pos, level, number, title, body): the text cut before each heading line; level 0 is what precedes the first. Further columns go along."""
    parts = each(corpus, F.split("txt", rf"(?m)^(?=(?:{_KINDS}) )"), "seg", "seq")
    order = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.substring_index("seg", " ", 1)
    level = reduce(lambda a, kv: a.when(kind == kv[0], kv[1]), LEVELS.items(), F.when(F.lit(False), 0)).otherwise(0)
    return parts.select(
        "doc_id",
        "file_name",
        "seq",
        F.coalesce(F.sum(F.length("seg")).over(order), F.lit(0)).cast("bigint").alias("pos"),
        F.when(F.col("seg").rlike(_NUMBER), level).otherwise(0).alias("level"),
        F.regexp_extract("seg", _NUMBER, 1).alias("number"),
        F.regexp_extract("seg", r"^[^\n]* - ([^\n]*)", 1).alias("title"),
        F.rtrim(F.regexp_replace(F.when(F.instr("seg", "\n") > 0, F.expr("substring(seg, instr(seg, '\n') + 1)")).otherwise(""), r"\n+$", "")).alias("body"),
        *more,
    )


def articles(corpus: DataFrame, least: int = 50) -> DataFrame:
    """Articles of more than ``least`` characters; of equal numbers in a document the first stays."""
    w = Window.partitionBy("doc_id", "number").orderBy("seq")
    a = elements(corpus).where("level = 5").where(F.length("body") > least)
    return a.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "level")


def longest_by_number(corpus: DataFrame) -> DataFrame:
    """One article for each leading number: that of the longest body, of equal ones the first."""
    a = elements(corpus).where("level = 5").withColumn("main", T.number_key("number")["main"])
    best = F.max_by(F.struct("number", "title", "body", "seq"), F.struct(F.length("body"), -F.col("seq")))
    return a.groupBy("doc_id", "main").agg(best.alias("b")).select("doc_id", "main", "b.number", "b.title", "b.seq", F.length("b.body").cast("bigint").alias("n_chars"))


def hierarchy(corpus: DataFrame) -> DataFrame:
    """Elements with the path of their ancestors: at each level the last heading before, unless a higher one came since."""
    e = elements(corpus).where("level > 0")
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = e
    for k in (1, 2, 3, 4):
        out = out.withColumn(f"s{k}", F.last(F.when(F.col("level") == k, F.col("seq")), True).over(w)).withColumn(f"n{k}", F.last(F.when(F.col("level") == k, F.col("number")), True).over(w))

    def live(k: int) -> Column:
        # the heading of level k holds while nothing higher came after it and the element lies below it
        above = [F.coalesce(F.col(f"s{j}"), F.lit(-1)) for j in range(1, k)]
        ok = F.col(f"s{k}").isNotNull() & (F.col("level") > k)
        return ok & (F.col(f"s{k}") > F.greatest(*above, F.lit(-1))) if above else ok

    steps = [F.when(live(k), F.concat(F.lit(NAMES[k] + " "), F.col(f"n{k}"))) for k in (1, 2, 3, 4)]
    own = reduce(lambda a, kv: a.when(F.col("level") == kv[0], kv[1]), NAMES.items(), F.when(F.lit(False), ""))
    parent = F.greatest(*[F.when(live(k), F.col(f"s{k}")) for k in (1, 2, 3, 4)])
    path = F.array_join(F.array_compact(F.array(*steps, F.concat(own, F.lit(" "), F.col("number")))), " > ")
    depth = F.size(F.array_compact(F.array(*steps)))
    return out.select("doc_id", "seq", "pos", "level", "number", "title", "body", parent.alias("parent_seq"), depth.alias("depth"), path.alias("path"))


def segment_ends(corpus: DataFrame) -> DataFrame:
    """For each element the position of the next one of the same or a higher level, or the end of the text."""
    e = elements(corpus).where("level > 0")
    after = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    ends = [F.min(F.when(F.col("level") <= k, F.col("pos"))).over(after) for k in range(1, 6)]
    pick = reduce(lambda a, k: a.when(F.col("level") == k, ends[k - 1]), range(1, 6), F.when(F.lit(False), F.lit(0).cast("bigint")))
    size = corpus.select(F.col("doc_id").alias("d"), F.length("txt").cast("bigint").alias("size"))
    return e.withColumn("e", pick).join(size, F.col("doc_id") == F.col("d")).select("doc_id", "seq", "level", "pos", F.coalesce("e", "size").alias("end_pos"))


def near_duplicates(arts: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Articles but for those whose word set is similar (Jaccard above threshold) to an earlier one of the document that stays.

    Order-dependent within a document: a fold over its articles.
    """
    words = F.array_distinct(F.filter(F.split(F.lower("body"), r"(?U)\s+"), lambda x: x != ""))
    rows = arts.select("doc_id", F.struct("seq", "number", words.alias("w")).alias("r")).groupBy("doc_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    empty = F.expr("cast(array() as array<struct<seq:int,number:string,w:array<string>>>)")

    def keep(kept, r):
        similar = F.exists(kept, lambda k: F.size(F.array_intersect(k["w"], r["w"])) > F.lit(threshold) * F.size(F.array_union(k["w"], r["w"])))
        return F.when(similar, kept).otherwise(F.concat(kept, F.array(r)))

    return rows.select("doc_id", F.explode(F.aggregate("rs", empty, keep)).alias("k")).select("doc_id", "k.seq", "k.number", F.size("k.w").cast("bigint").alias("n_words"))


def cited(c: str) -> Column:
    """Array of (kind, dst): the articles that a text cites, lists and ranges one by one."""
    kinds = [("conformity", r"(?iu)conformément (?:à l'article|aux articles) ([0-9]+(?: à [0-9]+)?)"), ("modification", r"(?iu)modifie l'article ([0-9]+)")]

    def of(kind: str):
        low = lambda x: F.regexp_extract(x, r"^(\d+)", 1).cast("int")
        high = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, r"à (\d+)$", 1), F.lit("")).cast("int"), low(x))
        return lambda x: F.transform(F.sequence(low(x), F.greatest(low(x), high(x))), lambda i: F.struct(F.lit(kind).alias("kind"), i.alias("dst")))

    return F.concat(*[F.flatten(F.transform(F.regexp_extract_all(c, F.lit(p), 1), of(k))) for k, p in kinds])


def links(arts: DataFrame) -> DataFrame:
    """(doc_id, v, refs): articles by their leading number, with the articles they cite as (kind, dst)."""
    return arts.select("doc_id", F.regexp_extract("number", r"^(\d+)", 1).cast("int").alias("v"), cited("body").alias("refs"))


def references(arts: DataFrame) -> DataFrame:
    """Cross-references (doc_id, src, dst, kind): lists and ranges of cited articles, one row each."""
    return each(links(arts), F.col("refs"), "x").select("doc_id", F.col("v").alias("src"), "x.dst", "x.kind")
