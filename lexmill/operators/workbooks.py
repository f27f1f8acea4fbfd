"""Whole-document processing and the sheets of its workbooks, one DataFrame for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.operators import pages as P

GLOSSARY = [("COBAC", "Commission bancaire de l'Afrique centrale"), ("CEMAC", "Communauté économique et monétaire de l'Afrique centrale"), ("CRITICAL", "act at once"), ("HIGH", "act within a month"), ("MEDIUM", "act within a quarter"), ("LOW", "keep in view")]


def process(corpus: DataFrame, accept: Column) -> tuple[DataFrame, DataFrame]:
    """Documents that are accepted, with statistics, number of articles and quality; and the others, which go no further."""
    from lexmill.plans.scores import document_quality

    good, bad = corpus.where(accept), corpus.where(~accept)
    n = E.articles(good).groupBy("doc_id").agg(F.count("*").alias("n_articles"))
    stats = good.select("doc_id", "file_name", F.length("txt").cast("bigint").alias("n_chars"), T.n_words("txt").alias("n_words"), T.n_ends("txt").alias("n_sentences"))
    done = stats.join(n, "doc_id", "left").join(document_quality(good).select("doc_id", "overall", "status"), "doc_id").na.fill(0, ["n_articles"])
    return done, bad.select("doc_id", "file_name", F.length("txt").alias("n_chars"))


def process_pages(pages: DataFrame, selected: DataFrame, accept: Column) -> tuple[DataFrame, DataFrame]:
    """The same for selected pages (doc_id, page) of (doc_id, file_name, page, text): markers keep the original numbers."""
    kept = pages.join(selected.select("doc_id", "page"), ["doc_id", "page"], "left_semi")
    marked = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("--- PAGE "), x["page"], F.lit(" ---\n"), x["text"]))
    return process(kept.groupBy("doc_id", "file_name").agg(F.array_join(marked, "\n").alias("txt")), accept)


def technical(corpus: DataFrame) -> dict[str, DataFrame]:
    """The technical workbook: metadata, data, validation results, statistics and summary, in this order."""
    arts = E.articles(corpus)
    done, _ = process(corpus, F.lit(True))
    kind = T.document_type("file_name")
    metadata = corpus.select("doc_id", "file_name", kind.alias("document_type"), F.sha2("txt", 256).alias("file_hash"), F.length("txt").alias("n_chars"))
    heads = arts.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("SUMMARY").alias("kind"), F.lit("").alias("number"), F.concat(F.col("n").cast("string"), F.lit(" articles")).alias("detail"))
    data = heads.unionByName(arts.select("doc_id", F.lit("ARTICLE").alias("kind"), "number", F.col("body").alias("detail")))
    total = done.agg(F.count("*").cast("double").alias("a"), F.sum("n_chars").cast("double").alias("b"), F.round(F.avg("n_words"), 2).alias("c"))
    stats = total.select(F.expr("stack(3, 'documents', a, 'characters', b, 'mean words', c) as (metric, value)")).unionByName(metadata.groupBy("document_type").count().select(F.concat(F.lit("type "), "document_type").alias("metric"), F.col("count").cast("double").alias("value")))
    summary = done.agg(F.count("*").alias("documents"), F.sum("n_articles").alias("articles"), F.round(F.avg("overall"), 4).alias("mean_quality"))
    return {"Document_Metadata": metadata, "Data": data, "Validation_Results": done.select("doc_id", "overall", "status"), "Statistics": stats, "Summary": summary}


def client(corpus: DataFrame) -> dict[str, DataFrame]:
    """The client's workbook: executive summary, document overview, articles with content cut at 500, the first ten articles of each priority, and a glossary."""
    spark = corpus.sparkSession
    a = E.articles(corpus).withColumn("priority", T.materiality("body"))
    counts = a.agg(F.countDistinct("doc_id").alias("d"), F.count("*").alias("n"), *[F.count_if(F.col("priority") == k).alias(k) for k in ("CRITICAL", "HIGH", "MEDIUM", "LOW")])
    pairs = ", ".join(f"'{label}', {c}" for label, c in (("Total Regulatory Documents", "d"), ("Total Articles Analyzed", "n"), ("Critical Priority Items", "CRITICAL"), ("High Priority Items", "HIGH"), ("Medium Priority Items", "MEDIUM"), ("Low Priority Items", "LOW")))
    overview = a.groupBy("doc_id", "file_name").agg(F.count("*").alias("total"), F.count_if(F.col("priority") == "CRITICAL").alias("critical"), F.count_if(F.col("priority") == "HIGH").alias("high"))
    first = a.withColumn("place", F.row_number().over(Window.partitionBy("priority").orderBy("doc_id", "seq"))).where("place <= 10")
    return {
        "Executive Summary": counts.select(F.expr(f"stack(6, {pairs}) as (label, value)")), "Document Overview": overview,
        "Compliance Articles": a.select("file_name", "number", T.truncate("body", 500).alias("content"), "priority"), "Priority Actions": first.select("priority", "place", "file_name", "number"),
        "Glossary": spark.createDataFrame(GLOSSARY, "term string, meaning string"),
    }


def score_chunks(chunks: DataFrame, scorer: Callable[[Column], Column] | None = None) -> DataFrame:
    """Chunks with a completeness score: that of a column function of the text, by default 75 for all."""
    return chunks.withColumn("completeness", scorer(F.col("text")) if scorer else F.lit(75.0))


def enhanced(found: DataFrame, other: DataFrame) -> DataFrame:
    """For each document the rows of another extractor where they are more than the ones found, else those found."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    better = count(other, "m").join(count(found, "n"), "doc_id", "left").where(F.col("m") > F.coalesce("n", F.lit(0))).select("doc_id")
    return found.join(better, "doc_id", "left_anti").unionByName(other.join(better, "doc_id", "left_semi"))


def chunked(corpus: DataFrame) -> DataFrame:
    """Chunks of the documents of a corpus, for scoring."""
    return P.pack(corpus.select("doc_id", F.col("txt").alias("text")))
