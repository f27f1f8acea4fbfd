"""Articles, hierarchy and what is found in them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.plans.registry import ELEM, query, quoted, sql_any, sql_hits
from lexmill.sources.corpus import reg_corpus

HIER = ELEM + """,
up AS (SELECT *, """ + ", ".join(f"max(CASE WHEN level = {k} THEN seq END) OVER w AS s{k}, arg_max(number, CASE WHEN level = {k} THEN seq END) OVER w AS n{k}" for k in (1, 2, 3, 4)) + """ FROM elem WHERE level > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)),
hier AS (SELECT *, (s1 IS NOT NULL AND level > 1) AS l1, (s2 IS NOT NULL AND level > 2 AND s2 > coalesce(s1, -1)) AS l2, (s3 IS NOT NULL AND level > 3 AND s3 > greatest(coalesce(s1, -1), coalesce(s2, -1))) AS l3, (s4 IS NOT NULL AND level > 4 AND s4 > greatest(coalesce(s1, -1), coalesce(s2, -1), coalesce(s3, -1))) AS l4 FROM up),
tree AS (SELECT doc_id, seq, pos, level, number, title, body, CASE WHEN l4 THEN s4 WHEN l3 THEN s3 WHEN l2 THEN s2 WHEN l1 THEN s1 END AS parent_seq, l1::INT + l2::INT + l3::INT + l4::INT AS depth,
  concat_ws(' > ', CASE WHEN l1 THEN 'TITLE ' || n1 END, CASE WHEN l2 THEN 'CHAPTER ' || n2 END, CASE WHEN l3 THEN 'SECTION ' || n3 END, CASE WHEN l4 THEN 'ANNEX ' || n4 END, CASE level WHEN 1 THEN 'TITLE ' WHEN 2 THEN 'CHAPTER ' WHEN 3 THEN 'SECTION ' WHEN 4 THEN 'ANNEX ' ELSE 'ARTICLE ' END || number) AS path FROM hier)"""


@query("g12_g14_g15_x1_articles", f"{ELEM} SELECT doc_id, seq::INT AS seq, pos::BIGINT AS pos, number, title, md5(body) AS body_hash FROM arts")
def g12(spark, sf):
    return E.articles(reg_corpus(spark, sf)).select("doc_id", "seq", "pos", "number", "title", F.md5("body").alias("body_hash"))


@query("w3_longest_by_number", f"{ELEM}, n AS (SELECT *, CAST(regexp_extract(number, '^([0-9]+)', 1) AS INT) AS main FROM elem WHERE level = 5) SELECT doc_id, main, number, title, seq::INT AS seq, length(body)::BIGINT AS n_chars FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, main ORDER BY length(body) DESC, seq) = 1")
def w3(spark, sf):
    return E.longest_by_number(reg_corpus(spark, sf))


@query("g17_g19_elements", f"{ELEM} SELECT doc_id, seq::INT AS seq, level, number, title, pos::BIGINT AS pos FROM elem WHERE level > 0")
def g17(spark, sf):
    return E.elements(reg_corpus(spark, sf)).where("level > 0").select("doc_id", "seq", "level", "number", "title", "pos")


@query("j4_n1_n2_n3_hierarchy", f"{HIER} SELECT doc_id, seq::INT AS seq, level, parent_seq::INT AS parent_seq, depth, path FROM tree")
def j4(spark, sf):
    return E.hierarchy(reg_corpus(spark, sf)).select("doc_id", "seq", "level", "parent_seq", "depth", "path")


@query("j5_segment_ends", f"{ELEM} SELECT e.doc_id, e.seq::INT AS seq, e.level, e.pos::BIGINT AS pos, coalesce(min(f.pos), any_value(length(txt)))::BIGINT AS end_pos FROM elem e JOIN reg USING (doc_id) LEFT JOIN elem f ON f.doc_id = e.doc_id AND f.seq > e.seq AND f.level > 0 AND f.level <= e.level WHERE e.level > 0 GROUP BY ALL")
def j5(spark, sf):
    return E.segment_ends(reg_corpus(spark, sf))


@query("n4_g31_contents_table", f"{HIER}, k AS (SELECT doc_id, parent_seq AS seq, count(*) AS n FROM tree WHERE parent_seq IS NOT NULL GROUP BY ALL) SELECT t.doc_id, t.seq::INT AS seq, t.depth, t.path, coalesce(k.n, 0) AS n_children, CASE WHEN length(body) > 200 THEN substring(body, 1, 197) || '...' ELSE body END AS preview FROM tree t LEFT JOIN k ON k.doc_id = t.doc_id AND k.seq = t.seq")
def n4(spark, sf):
    h = E.hierarchy(reg_corpus(spark, sf))
    k = h.where("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count("*").alias("n"))
    return h.join(k, ["doc_id", "seq"], "left").select("doc_id", "seq", "depth", "path", F.coalesce("n", F.lit(0)).alias("n_children"), T.truncate("body", 200).alias("preview"))


@query("a26_section_summary", f"{HIER}, c AS (SELECT doc_id, parent_seq AS seq, count(*) FILTER (level = 5) AS n_articles, count(*) FILTER (level < 5) AS n_sections, sum(length(body))::BIGINT AS n_chars FROM tree WHERE parent_seq IS NOT NULL GROUP BY ALL) SELECT c.doc_id, c.seq::INT AS seq, path, n_articles, n_sections, n_chars FROM c JOIN tree t ON t.doc_id = c.doc_id AND t.seq = c.seq")
def a26(spark, sf):
    h = E.hierarchy(reg_corpus(spark, sf))
    c = h.where("parent_seq is not null").groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.count_if(F.col("level") == 5).alias("n_articles"), F.count_if(F.col("level") < 5).alias("n_sections"), F.sum(F.length("body")).alias("n_chars"))
    return c.join(h.select("doc_id", "seq", "path"), ["doc_id", "seq"])


@query("a27_tree_summary", f"{HIER} SELECT doc_id, count(*) FILTER (level = 1) AS titles, count(*) FILTER (level = 2) AS chapters, count(*) FILTER (level = 3) AS sections, count(*) FILTER (level = 5) AS articles, max(depth) AS max_depth FROM tree GROUP BY doc_id")
def a27(spark, sf):
    h = E.hierarchy(reg_corpus(spark, sf))
    return h.groupBy("doc_id").agg(*[F.count_if(F.col("level") == k).alias(n) for k, n in ((1, "titles"), (2, "chapters"), (3, "sections"), (5, "articles"))], F.max("depth").alias("max_depth"))


_TERMS = ["solvabilité", "amende", "reporting"]


@query("p5_theme_search", f"{ELEM} SELECT doc_id, number FROM arts WHERE {sql_any('title', _TERMS)} OR {sql_any('body', _TERMS)}")
def p5(spark, sf):
    return E.articles(reg_corpus(spark, sf)).where(T.any_of("title", _TERMS) | T.any_of("body", _TERMS)).select("doc_id", "number")


@query("c22_themes", f"{ELEM} SELECT doc_id, number, array_to_string(list_filter([{', '.join(f'CASE WHEN {sql_any('body', terms)} THEN {quoted(k)} END' for k, terms in L.THEMES.items())}], lambda x: x IS NOT NULL), ',') AS themes FROM arts")
def c22(spark, sf):
    return E.articles(reg_corpus(spark, sf)).select("doc_id", "number", F.array_join(T.themes("body"), ",").alias("themes"))


@query("w4_x2_near_duplicates", f"""{ELEM.replace('WITH ', 'WITH RECURSIVE ', 1)}, w AS MATERIALIZED (SELECT doc_id, seq, number, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k, list_distinct(list_filter(regexp_split_to_array(lower(body), '[\\s\\x{{00A0}}\\x{{0085}}]+'), lambda x: x <> '')) AS w FROM arts),
sim AS MATERIALIZED (SELECT a.doc_id, a.k, b.k AS j FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.k < a.k WHERE len(list_intersect(a.w, b.w)) > 0.9 * len(list_distinct(list_concat(a.w, b.w)))),
f AS (SELECT doc_id, 1::BIGINT AS k, [1::BIGINT] AS kept FROM w WHERE k = 1 UNION ALL SELECT w.doc_id, w.k, CASE WHEN EXISTS (SELECT 1 FROM sim s WHERE s.doc_id = w.doc_id AND s.k = w.k AND list_contains(f.kept, s.j)) THEN f.kept ELSE list_append(f.kept, w.k) END FROM f JOIN w ON w.doc_id = f.doc_id AND w.k = f.k + 1),
l AS (SELECT doc_id, unnest(max_by(kept, k)) AS k FROM f GROUP BY doc_id)
SELECT doc_id, seq::INT AS seq, number, len(w)::BIGINT AS n_words FROM l JOIN w USING (doc_id, k)""")
def w4(spark, sf):
    return E.near_duplicates(E.articles(reg_corpus(spark, sf)))


@query("g18_c25_document_parts", r"""WITH """ + ELEM[5:] + r""" SELECT doc_id, regexp_extract(txt, '^([^\n]+)', 1) AS header, regexp_extract(txt, '(?m)^(relati[^\n]+)', 1) AS subject, regexp_extract(txt, '(?m)^(La Commission[^\n]+)', 1) AS preamble, regexp_extract(txt, '(?s)Fait à [^\n]+\n([^\n]+)', 1) AS signatory, regexp_extract(txt, '(?m)^Fait à [^,]+, le ([^\n]+)', 1) AS signed, regexp_extract(txt, '([RID]-[0-9]{4}/[0-9]{2})', 1) AS reference FROM reg""")
def g18(spark, sf):
    x = lambda p: F.regexp_extract("txt", p, 1)
    return reg_corpus(spark, sf).select("doc_id", x(r"^([^\n]+)").alias("header"), x(r"(?m)^(relati[^\n]+)").alias("subject"), x(r"(?m)^(La Commission[^\n]+)").alias("preamble"), x(r"Fait à [^\n]+\n([^\n]+)").alias("signatory"), x(r"(?m)^Fait à [^,]+, le ([^\n]+)").alias("signed"), x(r"([RID]-[0-9]{4}/[0-9]{2})").alias("reference"))


@query("g20_regulatory_references", r"WITH " + ELEM[5:] + r""", r AS (SELECT doc_id, seq, unnest(regexp_extract_all(body, 'règlement (R-[0-9]{4}/[0-9]{2})', 1)) AS reference FROM arts) SELECT doc_id, reference, min(seq)::INT AS first_seq, count(*) AS n FROM r GROUP BY doc_id, reference""")
def g20(spark, sf):
    r = E.articles(reg_corpus(spark, sf)).select("doc_id", "seq", F.explode(F.regexp_extract_all("body", F.lit(r"règlement (R-[0-9]{4}/[0-9]{2})"), 1)).alias("reference"))
    return r.groupBy("doc_id", "reference").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"))


def _sentence_sql(column, terms):
    return "coalesce(" + ", ".join(f"list_filter(list_transform(string_split({column}, '.'), lambda x: trim(x, chr(10) || ' ')), lambda x: contains(lower(x), {quoted(t)}))[1]" for t in terms) + ")"


@query("g27_g28_j6_requirements", f"{ELEM} SELECT doc_id, number, {_sentence_sql('body', L.REQUIREMENT)} AS requirement, {_sentence_sql('body', L.PENALTY)} AS penalty FROM arts")
def g28(spark, sf):
    a = E.articles(reg_corpus(spark, sf))
    req = a.select("doc_id", "number", T.keyword_sentence("body", L.REQUIREMENT).alias("requirement")).where("requirement is not null")
    pen = a.select("doc_id", "number", T.keyword_sentence("body", L.PENALTY).alias("penalty")).where("penalty is not null")
    return a.select("doc_id", "number").join(req, ["doc_id", "number"], "left").join(pen, ["doc_id", "number"], "left")


@query("c20_a5_materiality_counts", f"{ELEM}, m AS (SELECT doc_id, CASE WHEN {sql_any('body', L.CRITICAL)} THEN 'CRITICAL' WHEN {sql_any('body', L.HIGH)} THEN 'HIGH' WHEN length(body) > 500 THEN 'MEDIUM' ELSE 'LOW' END AS m FROM arts) SELECT doc_id, count(*) FILTER (m = 'CRITICAL') AS critical, count(*) FILTER (m = 'HIGH') AS high, count(*) FILTER (m = 'MEDIUM') AS medium, count(*) FILTER (m = 'LOW') AS low FROM m GROUP BY doc_id")
def c20(spark, sf):
    m = E.articles(reg_corpus(spark, sf)).select("doc_id", T.materiality("body").alias("m"))
    return m.groupBy("doc_id").agg(*[F.count_if(F.col("m") == k.upper()).alias(k) for k in ("critical", "high", "medium", "low")])


_C21 = f"CASE WHEN {sql_hits('body', L.EXPORT_HIGH)} >= 2 THEN 'HIGH' WHEN {sql_hits('body', L.EXPORT_HIGH)} = 1 OR {sql_hits('body', L.EXPORT_MEDIUM)} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"


@query("c21_a7_export_materiality", f"{ELEM}, m AS (SELECT doc_id, {_C21} AS m FROM arts) SELECT doc_id, count(*) FILTER (m = 'HIGH') AS high, count(*) FILTER (m = 'MEDIUM') AS medium, count(*) FILTER (m = 'LOW') AS low FROM m GROUP BY doc_id")
def c21(spark, sf):
    m = E.articles(reg_corpus(spark, sf)).select("doc_id", T.export_materiality("body").alias("m"))
    return m.groupBy("doc_id").agg(*[F.count_if(F.col("m") == k.upper()).alias(k) for k in ("high", "medium", "low")])


@query("a6_document_overview", f"{ELEM}, m AS (SELECT doc_id, seq, number, {sql_any('body', L.CRITICAL)} AS c FROM arts) SELECT doc_id, count(*) AS total, count(*) FILTER (c) AS critical, array_to_string(list(number ORDER BY seq)[1:3], ', ') || CASE WHEN count(*) > 3 THEN ', ...' ELSE '' END AS labels FROM m GROUP BY doc_id")
def a6(spark, sf):
    m = E.articles(reg_corpus(spark, sf)).select("doc_id", "seq", "number", T.any_of("body", L.CRITICAL).alias("c"))
    g = m.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if("c").alias("critical"), F.array_sort(F.collect_list(F.struct("seq", "number"))).alias("s"))
    return g.select("doc_id", "total", "critical", F.concat(F.array_join(F.transform(F.slice("s", 1, 3), lambda x: x["number"]), ", "), F.when(F.col("total") > 3, ", ...").otherwise("")).alias("labels"))


@query("a8_x6_top_by_priority", f"{ELEM}, m AS (SELECT doc_id, seq, number, {_C21} AS materiality FROM arts) SELECT materiality, doc_id, number, row_number() OVER (PARTITION BY materiality ORDER BY doc_id, seq) AS place FROM m QUALIFY place <= 10")
def a8(spark, sf):
    m = E.articles(reg_corpus(spark, sf)).select("doc_id", "seq", "number", T.export_materiality("body").alias("materiality"))
    w = Window.partitionBy("materiality").orderBy("doc_id", "seq")
    return m.withColumn("place", F.row_number().over(w)).where("place <= 10").select("materiality", "doc_id", "number", "place")


_EXPECTED = ["TITRE I", "TITRE II", "CHAPITRE 2", "SECTION 1", "ANNEXE"]


@query("a31_structure_insight", f"{ELEM}, s AS (SELECT doc_id, count(*) FILTER (level BETWEEN 1 AND 3) AS n FROM elem GROUP BY doc_id) SELECT doc_id, n AS n_sections, CASE WHEN n > 10 THEN 'High' WHEN n > 5 THEN 'Medium' ELSE 'Low' END AS complexity, array_to_string(list_filter({[*_EXPECTED]}, lambda x: NOT contains(txt, x)), ', ') AS missing FROM s JOIN reg USING (doc_id)")
def a31(spark, sf):
    r = reg_corpus(spark, sf)
    s = E.elements(r).groupBy("doc_id").agg(F.count_if(F.col("level").between(1, 3)).alias("n_sections"))
    gone = F.filter(F.array(*[F.lit(x) for x in _EXPECTED]), lambda x: ~F.col("txt").contains(x))
    return s.join(r, "doc_id").select("doc_id", "n_sections", F.when(F.col("n_sections") > 10, "High").when(F.col("n_sections") > 5, "Medium").otherwise("Low").alias("complexity"), F.array_join(gone, ", ").alias("missing"))


@query("a32_flat_sheet", f"{ELEM}, g AS (SELECT doc_id, count(*) AS n FROM arts GROUP BY doc_id) SELECT doc_id, 'SUMMARY' AS kind, '' AS number, n::VARCHAR AS detail FROM g UNION ALL SELECT doc_id, 'ARTICLE', number, CASE WHEN title = '' THEN '-' ELSE title END FROM arts")
def a32(spark, sf):
    a = E.articles(reg_corpus(spark, sf))
    top = a.groupBy("doc_id").count().select("doc_id", F.lit("SUMMARY").alias("kind"), F.lit("").alias("number"), F.col("count").cast("string").alias("detail"))
    return top.unionByName(a.select("doc_id", F.lit("ARTICLE").alias("kind"), "number", F.when(F.col("title") == "", "-").otherwise(F.col("title")).alias("detail")))


@query("a9_a33_s7_metadata_sheet", f"""{ELEM}, n AS (SELECT doc_id, count(*) AS n_articles FROM arts GROUP BY doc_id) SELECT doc_id, file_name, sha256(txt) AS file_hash, length(txt)::BIGINT AS n_chars, coalesce(n_articles, 0) AS n_articles, CASE WHEN coalesce(n_articles, 0) > 0 THEN 'processed' ELSE 'empty' END AS state FROM reg LEFT JOIN n USING (doc_id)""")
def a9(spark, sf):
    r = reg_corpus(spark, sf)
    n = E.articles(r).groupBy("doc_id").agg(F.count("*").alias("n"))
    j = r.join(n, "doc_id", "left").withColumn("n_articles", F.coalesce("n", F.lit(0)))
    return j.select("doc_id", "file_name", F.sha2("txt", 256).alias("file_hash"), F.length("txt").cast("bigint").alias("n_chars"), "n_articles", F.when(F.col("n_articles") > 0, "processed").otherwise("empty").alias("state"))


@query("g16_article_extracts", f"{ELEM} SELECT doc_id, number, substring(body, 1, 300) AS extract, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS place FROM arts QUALIFY place <= 15")
def g16(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("seq")
    return E.articles(reg_corpus(spark, sf)).withColumn("place", F.row_number().over(w)).where("place <= 15").select("doc_id", "number", F.substring("body", 1, 300).alias("extract"), "place")


_SENTENCES = r"list_filter(list_transform(regexp_split_to_array(body, '[.\n]+'), lambda x: trim(x)), lambda x: length(x) > 20 AND " + sql_any("x", L.OBLIGATION) + ")"


@query("g30_g24_obligation_rows", f"{ELEM}, o AS (SELECT doc_id, number, seq, {_SENTENCES} AS s FROM arts), e AS (SELECT doc_id, number, seq, generate_subscripts(s, 1) AS i, unnest(s) AS obligation FROM o) SELECT doc_id, number, obligation FROM e QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY seq, i) <= 15")
def g30(spark, sf):
    parts = F.filter(F.transform(F.split("body", r"[.\n]+"), lambda x: F.trim(x)), lambda x: (F.length(x) > 20) & T.any_of(x, L.OBLIGATION))
    e = E.articles(reg_corpus(spark, sf)).select("doc_id", "number", "seq", F.posexplode(parts).alias("i", "obligation"))
    w = Window.partitionBy("doc_id").orderBy("seq", "i")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 15").select("doc_id", "number", "obligation")


_ROW = "regexp_matches(line, '[0-9]') AND regexp_matches(line, 'FCFA|/')"


@query("g26_text_tables", f"{ELEM}, l AS (SELECT doc_id, seq, string_split(body, chr(10)) AS p FROM arts), n AS (SELECT doc_id, seq, generate_subscripts(p, 1) AS i, unnest(p) AS line FROM l), h AS (SELECT * FROM n WHERE {_ROW}) SELECT doc_id, seq::INT AS seq, count(*) AS n_rows, min(i)::INT AS first_line FROM h GROUP BY doc_id, seq")
def g26(spark, sf):
    n = E.articles(reg_corpus(spark, sf)).select("doc_id", "seq", F.posexplode(F.split("body", "\n")).alias("i", "line"))
    return n.where(F.col("line").rlike("[0-9]") & F.col("line").rlike("FCFA|/")).groupBy("doc_id", "seq").agg(F.count("*").alias("n_rows"), (F.min("i") + 1).alias("first_line"))


@query("x8_set_operations", f"{ELEM}, a AS (SELECT DISTINCT number FROM arts WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT number FROM arts WHERE doc_id % 2 = 1) SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'even only', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def x8(spark, sf):
    arts = E.articles(reg_corpus(spark, sf))
    a, b = (arts.where(F.col("doc_id") % 2 == k).select("number").distinct() for k in (0, 1))
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count("both", a.intersect(b)).unionByName(count("even only", a.exceptAll(b))).unionByName(count("either", a.union(b).distinct()))
