"""Text cleaning, scalars and document statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.plans.registry import ELEM, REG, query, quoted, sql_alnum, sql_any, sql_ends, sql_hits, sql_words, table
from lexmill.sources.corpus import reg_corpus


def _case(pairs, rest):
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + f" ELSE {rest} END"


SQL_TYPE = _case([(sql_any("file_name", terms), quoted(kind)) for kind, terms in L.DOCUMENT_TYPES], "'OTHER'")
SQL_MATERIALITY = f"CASE WHEN {sql_any('body', L.CRITICAL)} THEN 'CRITICAL' WHEN {sql_any('body', L.HIGH)} THEN 'HIGH' WHEN length(body) > 500 THEN 'MEDIUM' ELSE 'LOW' END"


@query("m0_materiality_by_type", f"{ELEM} SELECT {SQL_TYPE} AS document_type, {SQL_MATERIALITY} AS materiality, count(*) AS n_articles, sum(length(body))::BIGINT AS n_chars FROM arts GROUP BY ALL")
def m0(spark, sf):
    a = E.articles(reg_corpus(spark, sf))
    return a.groupBy(T.document_type("file_name").alias("document_type"), T.materiality("body").alias("materiality")).agg(F.count("*").alias("n_articles"), F.sum(F.length("body")).alias("n_chars"))


@query("t1_clean_text", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\s\x{00A0}\x{0085}]+', ' ', 'g'), '\.{3,}', '...', 'g'), '(\p{L})- (\p{Ll})', '\1\2', 'g'), '[\x{00}-\x{1F}\x{7F}-\x{9F}]', '', 'g')) AS cleaned FROM documents""")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("cleaned"))


@query("t2_t3_file_fields", rf"""{REG} SELECT doc_id, {SQL_TYPE} AS document_type, coalesce(nullif(regexp_extract(file_name, 'R-(\d{{4}}_\d{{1,2}})', 1), ''), nullif(regexp_extract(file_name, 'I-(\d{{4}}_\d{{1,2}})', 1), ''), nullif(regexp_extract(file_name, 'LC-(\d{{2,}})', 1), ''), nullif(regexp_extract(file_name, 'D-(\d{{4}}_\d{{1,2}})', 1), ''), nullif(regexp_extract(file_name, '(\d{{4}}_\d{{1,2}})', 1), '')) AS document_number FROM reg""")
def t2(spark, sf):
    return reg_corpus(spark, sf).select("doc_id", T.document_type("file_name").alias("document_type"), T.document_number("file_name").alias("document_number"))


@query("t4_t5_t6_display", """SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.2f B', round(b, 2)) WHEN b < 1048576 THEN printf('%.2f KB', round(b / 1024, 2)) WHEN b < 1073741824 THEN printf('%.2f MB', round(b / 1048576, 2)) ELSE printf('%.2f GB', round(b / 1073741824, 2)) END AS size, CASE WHEN length(text) > 60 THEN substring(text, 1, 57) || '...' ELSE text END AS short, CASE WHEN length(source) > 200 THEN substring(source, 1, 197) || '...' ELSE coalesce(source, '') END AS cell FROM (SELECT *, (n_chars * n_chars)::DOUBLE AS b FROM documents)""")
def t4(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.human_size(F.col("n_chars") * F.col("n_chars")).alias("size"), T.truncate("text", 60).alias("short"), T.safe_cell("source").alias("cell"))


@query("t7_hashes", "SELECT doc_id, md5(text) AS md5, sha256(text) AS sha256 FROM documents")
def t7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5("text").alias("md5"), F.sha2("text", 256).alias("sha256"))


@query("t15_t16_t18_numbers", rf"""{ELEM}, n AS (SELECT doc_id, seq, level, CASE WHEN level = 5 AND number = '1' THEN 'Premier' WHEN level = 5 AND number = '2' THEN 'deuxième ' WHEN level = 5 THEN replace(number, '3', '3,1') ELSE number END AS raw FROM elem WHERE level > 0),
c AS (SELECT *, regexp_replace(replace(CASE trim(lower(raw)) {' '.join(f"WHEN {quoted(w)} THEN '{i}'" for i, w in enumerate(L.ORDINALS, 1))} ELSE trim(lower(raw)) END, ',', '.'), '\s+', ' ', 'g') AS number FROM n)
SELECT doc_id, seq, number, 'Article ' || number AS target, CASE WHEN regexp_matches(upper(number), '^[IVXLC]+$') THEN upper(number) ELSE number END AS heading, coalesce(try_cast(regexp_extract(number, '^(\d+)', 1) AS INT), 9999) AS main, coalesce(try_cast(regexp_extract(number, '^\d+[.-](\d+)', 1) AS INT), 0) AS sub, regexp_extract(number, '(bis|ter|quater)$', 1) AS suffix FROM c""")
def t15(spark, sf):
    e = E.elements(reg_corpus(spark, sf)).where("level > 0")
    art = F.col("level") == 5
    raw = F.when(art & (F.col("number") == "1"), "Premier").when(art & (F.col("number") == "2"), "deuxième ").when(art, F.regexp_replace("number", "3", "3,1")).otherwise(F.col("number"))
    c = e.select("doc_id", F.col("seq").cast("bigint").alias("seq"), T.canonical_number(raw).alias("number"))
    key = T.number_key("number")
    heading = F.when(F.upper("number").rlike("^[IVXLC]+$"), F.upper("number")).otherwise(F.col("number"))
    return c.select("doc_id", "seq", "number", F.concat(F.lit("Article "), "number").alias("target"), heading.alias("heading"), key["main"].alias("main"), key["sub"].alias("sub"), key["suffix"].alias("suffix"))


@query("t19_g25_number_groups", rf"""{REG}, n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(txt, 'Article (\d+)', 1))::INT AS n FROM reg), g AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS k FROM n), s AS (SELECT doc_id, k, min(n) AS a, max(n) AS b FROM g GROUP BY doc_id, k)
SELECT doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) AS articles FROM s GROUP BY doc_id""")
def t19(spark, sf):
    n = reg_corpus(spark, sf).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("txt", F.lit(r"Article (\d+)"), 1))).alias("n")).withColumn("n", F.col("n").cast("int"))
    islands = n.withColumn("k", F.col("n") - F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))).groupBy("doc_id", "k").agg(F.min("n").alias("a"), F.max("n").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat("a", F.lit("-"), "b"))
    return islands.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("s")))), lambda x: x["s"]), ", ").alias("articles"))


@query("a1_document_statistics", f"{REG} SELECT doc_id, length(txt)::BIGINT AS n_chars, {sql_words('txt')}::BIGINT AS n_words, {sql_ends('txt')}::BIGINT AS n_sentences FROM reg")
def a1(spark, sf):
    return reg_corpus(spark, sf).select("doc_id", F.length("txt").cast("bigint").alias("n_chars"), T.n_words("txt").cast("bigint").alias("n_words"), T.n_ends("txt").cast("bigint").alias("n_sentences"))


@query("a2_run_summary", f"{REG} SELECT {SQL_TYPE} AS document_type, count(*) AS n_documents, count(*) FILTER (length(txt) > 500) AS n_long, round(avg(length(txt)), 2) AS mean_chars, sum({sql_words('txt')})::BIGINT AS n_words FROM reg GROUP BY ALL")
def a2(spark, sf):
    r = reg_corpus(spark, sf)
    return r.groupBy(T.document_type("file_name").alias("document_type")).agg(F.count("*").alias("n_documents"), F.count_if(F.length("txt") > 500).alias("n_long"), F.round(F.avg(F.length("txt")), 2).alias("mean_chars"), F.sum(T.n_words("txt")).alias("n_words"))


@query("a3_a4_statistics_sheet", f"{REG}, s AS (SELECT {SQL_TYPE} AS t, length(txt) AS n FROM reg) SELECT 'documents' AS metric, count(*)::DOUBLE AS value FROM s UNION ALL SELECT 'characters', sum(n)::DOUBLE FROM s UNION ALL SELECT 'mean characters', round(avg(n), 2) FROM s UNION ALL SELECT 'type ' || t, count(*)::DOUBLE FROM s GROUP BY t")
def a3(spark, sf):
    s = reg_corpus(spark, sf).select(T.document_type("file_name").alias("t"), F.length("txt").alias("n"))
    total = s.agg(F.count("*").cast("double").alias("documents"), F.sum("n").cast("double").alias("characters"), F.round(F.avg("n"), 2).alias("mean characters"))
    long = total.select(F.expr("stack(3, 'documents', documents, 'characters', characters, 'mean characters', `mean characters`) as (metric, value)"))
    return long.unionByName(s.groupBy("t").count().select(F.concat(F.lit("type "), "t").alias("metric"), F.col("count").cast("double").alias("value")))


def _sql_quality(c):
    return f"(CASE WHEN w > 50 THEN 0.3 WHEN w > 20 THEN 0.2 WHEN w > 10 THEN 0.1 ELSE 0.0 END + least(0.4 * {sql_alnum(c)}, 0.4) + CASE WHEN e > 5 THEN 0.2 WHEN e > 2 THEN 0.1 ELSE 0.0 END + CASE WHEN {sql_hits(c, L.LEGAL_TERMS)} >= 3 THEN 0.1 ELSE 0.0 END)::DOUBLE"


@query("p1_c1_c2_acceptance", rf"""{REG}, b AS (SELECT doc_id, txt AS text, 'reg' AS origin FROM reg UNION ALL SELECT doc_id, text, 'doc' FROM documents), q AS (SELECT *, {sql_words('text')} AS w, {sql_ends('text')} AS e, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS lines FROM b), c AS (SELECT *, {_sql_quality('text')} AS c1, CASE WHEN len(lines) > 0 THEN list_sum(list_transform(lines, lambda x: length(x)))::DOUBLE / len(lines) ELSE 0 END AS mean FROM q)
SELECT origin, doc_id, round(c1, 6) AS quality, round((CASE WHEN w > 10 THEN 0.3 ELSE 0.0 END + 0.3 * {sql_alnum('text')} + CASE WHEN e > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN mean > 20 AND mean < 100 THEN 0.2 ELSE 0.0 END)::DOUBLE, 6) AS text_quality, (length(trim(text)) >= 100 AND w >= 10 AND (c1 >= 0.6 OR ({sql_hits('text', L.ACCEPTANCE_TERMS)} >= 2 AND c1 >= 0.4))) AS accepted FROM c""")
def p1(spark, sf):
    b = reg_corpus(spark, sf).select("doc_id", F.col("txt").alias("text"), F.lit("reg").alias("origin")).unionByName(table(spark, sf, "documents").select("doc_id", "text", F.lit("doc").alias("origin")))
    q = T.measured(b, "text").withColumn("q", T.extraction_quality())
    return q.select("origin", "doc_id", F.round("q", 6).alias("quality"), F.round(T.text_quality(), 6).alias("text_quality"), T.accepted("text", "q").alias("accepted"))


@query("c6_ocr_confidence", rf"""SELECT doc_id, round(greatest(0.0, least(1.0, 1 - (0.5 * CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[\p{{L}}\p{{N}}\s.,;:!?()''"-]', '', 'g'))::DOUBLE / length(text) ELSE 1 END + 0.3 * len(regexp_extract_all(text, '\p{{L}}{{10,}}'))::DOUBLE / greatest({sql_words('text')}, 1))))::DOUBLE, 6) AS confidence FROM documents""")
def c6(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(T.ocr_confidence("text"), 6).alias("confidence"))
