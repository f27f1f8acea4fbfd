"""Quality scores of documents, articles and chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.plans.registry import ELEM, REG, query, sql_any, sql_ends, sql_hits, sql_words
from lexmill.sources.corpus import reg_corpus

_PAGES = 2  # pages of a document of the corpus
_MAIN = "CAST(regexp_extract(number, '^([0-9]+)', 1) AS INT)"
_C3 = f"(0.4 * least({sql_words('txt')} / 200.0::DOUBLE, 1) + 0.3 * least(length(txt) / 1000.0::DOUBLE, 1) + 0.3 * least({sql_hits('txt', L.LEGAL_TERMS)} / 5.0::DOUBLE, 1))"
_C5 = f"greatest(0.0, {sql_hits('txt', L.ACCURACY_TERMS)} / 9.0::DOUBLE - 0.1 * {sql_hits('txt', L.MISSPELT)})"
_C6 = rf"greatest(0.0, least(1.0, 1 - (0.5 * length(regexp_replace(txt, '[\p{{L}}\p{{N}}\s.,;:!?()''\"-]', '', 'g'))::DOUBLE / length(txt) + 0.3 * len(regexp_extract_all(txt, '\p{{L}}{{10,}}'))::DOUBLE / greatest({sql_words('txt')}, 1))))"
_STATUS = "CASE WHEN {0} >= 0.9 THEN 'EXCELLENT' WHEN {0} >= 0.8 THEN 'GOOD' WHEN {0} >= 0.7 THEN 'ACCEPTABLE' WHEN {0} >= 0.5 THEN 'NEEDS_REVIEW' ELSE 'FAILED' END"
_BANDS = [(0.9, "EXCELLENT"), (0.8, "GOOD"), (0.7, "ACCEPTABLE"), (0.5, "NEEDS_REVIEW")]
_DOC = f"""{ELEM}, c4 AS (SELECT doc_id, (max((level = 1)::INT) + max((level = 2)::INT) + max((level = 3)::INT) + max((level = 5)::INT)) / 4.0::DOUBLE AS kinds FROM elem GROUP BY doc_id),
lg AS (SELECT doc_id, {_MAIN} AS n, lag({_MAIN}) OVER (PARTITION BY doc_id ORDER BY seq) AS p FROM elem WHERE level = 5), c4b AS (SELECT doc_id, greatest(0.0, 1 - 0.1 * count(*) FILTER (n - p > 2))::DOUBLE AS sequence FROM lg GROUP BY doc_id),
q AS (SELECT doc_id, {_C3} AS c3, 0.7 * kinds + 0.3 * coalesce(sequence, 0) AS c4, {_C5} AS c5, {_C6} AS c6 FROM reg JOIN c4 USING (doc_id) LEFT JOIN c4b USING (doc_id)),
o AS (SELECT *, round(0.25 * c6 + 0.30 * c3 + 0.25 * c4 + 0.20 * c5, 6) AS overall FROM q)"""


def _measures(corpus):
    """The corpus with c3, c5 and c6 of each text."""
    x, low = "txt", "low"
    c = T.measured(corpus, x)
    c3 = 0.4 * F.least(F.col("words") / (100.0 * _PAGES), F.lit(1.0)) + 0.3 * F.least(F.length(x) / (500.0 * _PAGES), F.lit(1.0)) + 0.3 * F.least(T.hits_low(low, L.LEGAL_TERMS) / 5.0, F.lit(1.0))
    c5 = F.greatest(F.lit(0.0), T.hits_low(low, L.ACCURACY_TERMS) / 9.0 - 0.1 * T.hits_low(low, L.MISSPELT))
    return c.withColumns({"c3": c3, "c5": c5, "c6": T.ocr_confidence(x, F.col("words"))})


def document_quality(corpus, *more):
    """(doc_id, c3, c4, c5, c6, overall, status, n_articles): completeness, coherence, term accuracy, OCR confidence and the number of articles.

    One pass: what is known of a text goes along with its elements, and its first element takes up what windows of the document say of the others. Further columns are of ``elements_of``.
    """
    return graded(elements_of(_measures(corpus), *more)).drop(*(set(_PER_ELEMENT) - set(more)))


_PER_ELEMENT = ["seq", "level", "number", "title", "body", "main", "kept"]


def elements_of(measured, *more):
    """The elements of measured texts, with their leading number and whether each is an article that counts: of more than 50 characters, the first of its number."""
    e = E.elements(measured, "c3", "c5", "c6", *more).withColumn("main", T.number_key("number")["main"])
    long = F.coalesce((F.col("level") == 5) & (F.length("body") > 50), F.lit(False))
    first = F.row_number().over(Window.partitionBy("doc_id", "number", long).orderBy("seq"))
    return e.withColumn("kept", long & (first == 1))


def graded(e, **totals):
    """The first element of each text with the qualities of its document, and further totals over the document's elements."""
    whole, before = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    article = F.col("level") == 5
    gap = F.when(article, F.col("main") - F.last(F.when(article, F.col("main")), True).over(before))
    kinds = sum((F.max((F.col("level") == k).cast("int")).over(whole) for k in (1, 2, 3, 5)), F.lit(0)) / 4.0
    e = e.withColumn("gap", gap).withColumns({"kinds": kinds, "wide": F.count_if(F.col("gap") > 2).over(whole), "any_article": F.bool_or(article).over(whole), "n_articles": F.count_if("kept").over(whole), **{k: v.over(whole) for k, v in totals.items()}})
    d = e.where("seq = 0").withColumn("c4", 0.7 * F.col("kinds") + 0.3 * F.when(F.col("any_article"), F.greatest(F.lit(0.0), 1 - 0.1 * F.col("wide"))).otherwise(0.0))
    d = d.withColumn("overall", F.round(0.25 * F.col("c6") + 0.30 * F.col("c3") + 0.25 * F.col("c4") + 0.20 * F.col("c5"), 6))
    return d.withColumn("status", T.band("overall", _BANDS, "FAILED"))


@query("c3_c4_c5_c7_document_quality", f"{_DOC} SELECT doc_id, round(c3, 6) AS completeness, round(c4, 6) AS coherence, round(c5, 6) AS accuracy, round(c6, 6) AS confidence, overall, {_STATUS.format('overall')} AS status, (c3 < 0.7)::INT + (c4 < 0.7)::INT + (c5 < 0.7)::INT + (c6 < 0.7)::INT AS n_advice FROM o")
def c7(spark, sf):
    d = document_quality(reg_corpus(spark, sf))
    low = lambda c: F.when(F.col(c) < 0.7, 1).otherwise(0)
    return d.select("doc_id", F.round("c3", 6).alias("completeness"), F.round("c4", 6).alias("coherence"), F.round("c5", 6).alias("accuracy"), F.round("c6", 6).alias("confidence"), "overall", "status", (low("c3") + low("c4") + low("c5") + low("c6")).alias("n_advice"))


_WORDS = f"{sql_hits('body', L.ARTICLE_WORDS)}"
_ART = f"""{ELEM}, a AS (SELECT *, {_MAIN} AS n FROM arts), c8 AS (SELECT doc_id, greatest(0.0, 1 - (max(n) - min(n) - (count(*) - 1))::DOUBLE / count(*)) AS c8, count(*) - count(DISTINCT n) AS n_repeated, count(*) AS n_articles FROM a GROUP BY doc_id),
c9 AS (SELECT doc_id, avg(0.3 * CASE WHEN length(body) BETWEEN 100 AND 2000 THEN 1.0 WHEN length(body) < 100 THEN 0.5 ELSE 0.8 END + 0.4 * least({_WORDS} / 3.0::DOUBLE, 1) + 0.3 * least({sql_ends('body')}::DOUBLE / greatest(len(string_split(body, chr(10))), 1), 1)) AS c9,
  avg(0.5 * regexp_matches(number, '^[0-9]+')::INT + 0.3 * (title <> '')::INT + 0.2) AS c10, avg(0.6 + 0.4 * ({sql_any('body', L.CRITICAL + L.HIGH)})::INT) AS c11 FROM arts GROUP BY doc_id)"""


@query("c8_c9_c10_c11_c12_article_quality", f"{_ART} SELECT doc_id, round(c8, 6) AS continuity, round(c9::DOUBLE, 6) AS content, round(c10::DOUBLE, 6) AS structure, round(c11::DOUBLE, 6) AS materiality, round(((c8 + c9 + c10 + c11) / 4 * 100)::DOUBLE, 4) AS quality, n_repeated FROM c8 JOIN c9 USING (doc_id)")
def c12(spark, sf):
    return article_quality(E.articles(reg_corpus(spark, sf)))


def article_measures():
    """c9, c10 and c11 of an article with its body in lower case."""
    size = F.length("body")
    return {
        "c9": 0.3 * F.when(size.between(100, 2000), 1.0).when(size < 100, 0.5).otherwise(0.8) + 0.4 * F.least(T.hits_low("low", L.ARTICLE_WORDS) / 3.0, F.lit(1.0)) + 0.3 * F.least(T.n_ends("body") / F.greatest(F.size(F.split("body", "\n")), F.lit(1)), F.lit(1.0)),
        "c10": 0.5 * F.col("number").rlike("^[0-9]+").cast("int") + 0.3 * (F.col("title") != "").cast("int") + 0.2,
        "c11": 0.6 + 0.4 * T.any_low("low", L.CRITICAL + L.HIGH).cast("int"),
    }


def article_quality(arts):
    """(doc_id, continuity, content, structure, materiality, quality, n_repeated)."""
    one = arts.select("doc_id", T.number_key("number")["main"].alias("n"), "number", "title", "body", F.lower("body").alias("low")).select("doc_id", "n", *[v.alias(k) for k, v in article_measures().items()])
    g = one.groupBy("doc_id").agg(F.greatest(F.lit(0.0), 1 - (F.max("n") - F.min("n") - (F.count("*") - 1)) / F.count("*")).alias("c8"), F.avg("c9").alias("c9"), F.avg("c10").alias("c10"), F.avg("c11").alias("c11"), (F.count("*") - F.countDistinct("n")).alias("n_repeated"))
    total = (F.col("c8") + F.col("c9") + F.col("c10") + F.col("c11")) / 4 * 100
    return g.select("doc_id", F.round("c8", 6).alias("continuity"), F.round("c9", 6).alias("content"), F.round("c10", 6).alias("structure"), F.round("c11", 6).alias("materiality"), F.round(total, 4).alias("quality"), "n_repeated")


@query("c12_gap_list", f"{ELEM}, a AS (SELECT DISTINCT doc_id, {_MAIN} AS n FROM arts), r AS (SELECT doc_id, unnest(range(min(n), max(n) + 1))::INT AS n FROM a GROUP BY doc_id) SELECT doc_id, n FROM r ANTI JOIN a USING (doc_id, n)")
def c12_gaps(spark, sf):
    a = E.articles(reg_corpus(spark, sf)).select("doc_id", T.number_key("number")["main"].alias("n")).distinct()
    return a.groupBy("doc_id").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).select("doc_id", F.explode(F.sequence("lo", "hi")).alias("n")).join(a, ["doc_id", "n"], "left_anti")


_CHAIN = f"""{ELEM}, s AS (SELECT doc_id, CASE WHEN length(txt) = 0 THEN 0 WHEN length(txt) < 100 THEN 25 WHEN {sql_words('txt')} / (length(txt) / 5.0::DOUBLE) < 0.5 THEN 75 ELSE 100 END AS extraction FROM reg),
g AS (SELECT doc_id, n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS gap FROM (SELECT doc_id, {_MAIN} AS n FROM arts)), l AS (SELECT doc_id, greatest(0, 100 - 10 * count(*) FILTER (gap > 5)) AS legal, CASE WHEN count(*) >= 5 THEN 100 WHEN count(*) >= 2 THEN 75 ELSE 50 END AS complete FROM g GROUP BY doc_id),
c AS (SELECT doc_id, extraction, 75 AS chunks, coalesce(legal, 50) AS legal, coalesce(complete, 0) AS complete FROM s LEFT JOIN l USING (doc_id))"""


@query("c15_c16_c17_c18_c19_w2_chain", f"{_CHAIN} SELECT doc_id, extraction, chunks, legal::INT AS legal, complete, round((0.25 * extraction + 0.25 * chunks + 0.30 * legal + 0.20 * complete)::DOUBLE, 4) AS overall FROM c")
def c19(spark, sf):
    r = reg_corpus(spark, sf)
    n = F.length("txt")
    s = r.select("doc_id", F.when(n == 0, 0).when(n < 100, 25).when(T.n_words("txt") / (n / 5.0) < 0.5, 75).otherwise(100).alias("extraction"))
    a = E.articles(r).withColumn("n", T.number_key("number")["main"])
    gap = F.col("n") - F.lag("n").over(Window.partitionBy("doc_id").orderBy("n"))
    g = a.withColumn("gap", gap).groupBy("doc_id").agg(F.greatest(F.lit(0), 100 - 10 * F.count_if(F.col("gap") > 5)).cast("int").alias("legal"), F.when(F.count("*") >= 5, 100).when(F.count("*") >= 2, 75).otherwise(50).alias("complete"))
    c = s.join(g, "doc_id", "left").select("doc_id", "extraction", F.lit(75).alias("chunks"), F.coalesce("legal", F.lit(50)).alias("legal"), F.coalesce("complete", F.lit(0)).alias("complete"))
    return c.withColumn("overall", F.round(0.25 * F.col("extraction") + 0.25 * F.col("chunks") + 0.30 * F.col("legal") + 0.20 * F.col("complete"), 4))


@query("w17_validation_sheet", f"{_CHAIN} SELECT doc_id, round((0.25 * extraction + 0.25 * chunks + 0.30 * legal + 0.20 * complete)::DOUBLE, 4) AS overall, CASE WHEN extraction = 100 AND legal = 100 AND complete = 100 THEN 'None' ELSE concat_ws('; ', CASE WHEN extraction < 100 THEN 'extraction ' || extraction END, CASE WHEN legal < 100 THEN 'legal structure ' || legal::INT END, CASE WHEN complete < 100 THEN 'completeness ' || complete END) END AS issues FROM c")
def w17(spark, sf):
    c = c19(spark, sf)
    found = F.concat_ws("; ", *[F.when(F.col(k) < 100, F.concat(F.lit(label + " "), k)) for k, label in (("extraction", "extraction"), ("legal", "legal structure"), ("complete", "completeness"))])
    return c.select("doc_id", "overall", F.when(found == "", "None").otherwise(found).alias("issues"))


@query("c40_ocr_text_confidence", rf"""{REG} SELECT doc_id, round(greatest(0.0, least(1.0, 0.4 * least({sql_hits('txt', L.LEGAL_TERMS)} / 10.0::DOUBLE, 1) + 0.3 * least(len(regexp_extract_all(txt, '(?m)^(?:Article|TITRE|CHAPITRE)'))::DOUBLE / 5, 1) + 0.3 * least(len(regexp_extract_all(lower(txt), ' (?:le|la|les|de|du|des|et) '))::DOUBLE / 20, 1) - 0.05 * {sql_hits('txt', L.MISSPELT)})), 6) AS confidence FROM reg""")
def c40(spark, sf):
    x = "txt"
    heads = F.regexp_count(F.col(x), F.lit(r"(?m)^(?:Article|TITRE|CHAPITRE)"))
    french = F.regexp_count(F.lower(F.col(x)), F.lit(r" (?:le|la|les|de|du|des|et) "))
    c = 0.4 * F.least(T.hits(x, L.LEGAL_TERMS) / 10.0, F.lit(1.0)) + 0.3 * F.least(heads / 5.0, F.lit(1.0)) + 0.3 * F.least(french / 20.0, F.lit(1.0)) - 0.05 * T.hits(x, L.MISSPELT)
    return reg_corpus(spark, sf).select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6).alias("confidence"))
