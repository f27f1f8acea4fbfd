"""Mapping regulations to fields and categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.plans.registry import ELEM, REG, query, quoted, sql_any, sql_hits
from lexmill.sources.corpus import reg_corpus


def _sql_list(column, terms, low, high, most):
    cond = " OR ".join(f"contains(lower(x), {quoted(t)})" for t in terms)
    return f"array_to_string(list_filter(list_transform(regexp_split_to_array({column}, '[.\\n]+'), lambda x: trim(x)), lambda x: length(x) BETWEEN {low} AND {high} AND ({cond}))[1:{most}], '; ')"


def key_sentences(terms, low, high, most):
    """The first sentences with a term, of a length between the bounds, joined; of columns parts, the trimmed sentences, and lows, the same in lower case."""
    found = F.filter("parts", lambda x, i: F.length(x).between(low, high) & T.any_low(F.get("lows", i), terms))
    return F.array_join(F.slice(found, 1, most), "; ")


_SCORE = [f"{w}::DOUBLE * {sql_hits('txt', terms)}" for _, w, terms in L.CATEGORIES]
_CAT = f"CASE WHEN greatest({', '.join(_SCORE)}) < 1.0 THEN 'II' " + " ".join(f"WHEN {s} = greatest({', '.join(_SCORE)}) THEN '{n}'" for s, (n, _, _) in zip(_SCORE, L.CATEGORIES, strict=True)) + " END"
_IMPACT = f"CASE WHEN {sql_hits('txt', L.IMPACT_HIGH)} >= 3 THEN 'ÉLEVÉ' WHEN {sql_hits('txt', L.IMPACT_HIGH)} >= 1 OR {sql_hits('txt', L.IMPACT_MEDIUM)} >= 3 THEN 'MOYEN' ELSE 'FAIBLE' END"
_FIELDS = rf"""{REG}, f AS (SELECT doc_id, file_name, txt, coalesce(nullif(regexp_extract(txt, '([RID]-[0-9]{{4}}/[0-9]{{2}})', 1), ''), file_name) AS reference, CASE WHEN regexp_extract(txt, '(?m)^(relati[^\n]+)', 1) = '' THEN file_name ELSE regexp_extract(txt, '(?m)^(relati[^\n]+)', 1) END AS title,
  coalesce(nullif(regexp_extract(txt, '(?m)^Fait à [^,]+, le ([^\n]+)', 1), ''), nullif(regexp_extract(file_name, '([0-9]{{4}}[_-][0-9]+)', 1), '')) AS published, {_sql_list('txt', L.OBLIGATION, 30, 250, 4)} AS obligations, {_sql_list('txt', L.SANCTION, 20, 200, 3)} AS sanctions, {_IMPACT} AS impact, {_CAT} AS category FROM reg)"""


def fields(corpus):
    """One row of fields for each regulation."""
    x = lambda c, p: F.regexp_extract(c, p, 1)
    none = lambda c: F.nullif(c, F.lit(""))
    # at single points: what stands between two is empty, and shorter than any sentence that counts
    sentences = lambda c: F.transform(F.split(F.replace(c, F.lit("\n"), F.lit(".")), r"\."), lambda x: F.trim(x))
    return corpus.withColumn("low", F.lower("txt")).withColumns({"parts": sentences("txt"), "lows": sentences("low")}).select(
        "doc_id",
        "file_name",
        F.coalesce(none(x("txt", r"([RID]-[0-9]{4}/[0-9]{2})")), "file_name").alias("reference"),
        F.coalesce(none(x("txt", r"(?m)^(relati[^\n]+)")), "file_name").alias("title"),
        F.coalesce(none(x("txt", r"(?m)^Fait à [^,]+, le ([^\n]+)")), none(x("file_name", r"(\d{4}[-_]\d+)"))).alias("published"),
        key_sentences(L.OBLIGATION, 30, 250, 4).alias("obligations"),
        key_sentences(L.SANCTION, 20, 200, 3).alias("sanctions"),
        T.impact("low").alias("impact"),
        T.category("low").alias("category"),
    )


@query("g29_c26_c27_c28_c30_c32_c39_fields", f"{_FIELDS} SELECT doc_id, reference, title, published, obligations, sanctions, impact, category FROM f")
def c39(spark, sf):
    return fields(reg_corpus(spark, sf)).drop("file_name")


@query("a34_k4_j10_category_counts", f"{_FIELDS}, n(category, name) AS (VALUES {', '.join(f'({quoted(k)}, {quoted(v)})' for k, v in L.CATEGORY_NAMES.items())}) SELECT category, name, count(*) AS n, count(DISTINCT reference) AS n_references FROM f JOIN n USING (category) GROUP BY ALL")
def a34(spark, sf):
    names = F.broadcast(spark.createDataFrame(list(L.CATEGORY_NAMES.items()), "category string, name string"))
    return fields(reg_corpus(spark, sf)).join(names, "category").groupBy("category", "name").agg(F.count("*").alias("n"), F.countDistinct("reference").alias("n_references"))


_ENTRY = ", ".join(f"CASE WHEN length({c}) > 10 AND NOT {sql_any(c, L.PLACEHOLDERS)} THEN {w} ELSE 0 END AS w_{c}" for c, w in (("reference", 10), ("title", 20), ("published", 15), ("obligations", 20), ("sanctions", 15)))


@query("c37_c38_entry_quality", f"{_FIELDS}, w AS (SELECT doc_id, {_ENTRY}, (impact <> 'FAIBLE')::INT * 5 AS bonus FROM f) SELECT doc_id, least(100, w_reference + w_title + coalesce(w_published, 0) + w_obligations + w_sanctions + bonus)::INT AS quality, (w_reference + w_title + coalesce(w_published, 0) + w_obligations + w_sanctions + bonus) < 30 AS emergency FROM w")
def c37(spark, sf):
    f = fields(reg_corpus(spark, sf))
    good = lambda c: (F.length(c) > 10) & ~T.any_of(c, L.PLACEHOLDERS)
    total = sum((F.when(good(c), w).otherwise(0) for c, w in (("reference", 10), ("title", 20), ("published", 15), ("obligations", 20), ("sanctions", 15))), F.lit(0)) + F.when(F.col("impact") != "FAIBLE", 5).otherwise(0)
    return f.select("doc_id", F.least(F.lit(100), total).alias("quality"), (total < 30).alias("emergency"))


@query("g22_g23_segments", r"WITH " + ELEM[5:] + r""", t AS (SELECT doc_id, seq, pos, number, title, lead(pos) OVER (PARTITION BY doc_id ORDER BY seq) AS nx FROM elem WHERE level = 1) SELECT t.doc_id, seq::INT AS seq, number, title, (coalesce(nx, length(txt)) - pos)::BIGINT AS n_chars FROM t JOIN reg USING (doc_id)""")
def g22(spark, sf):
    from pyspark.sql import Window

    r = reg_corpus(spark, sf)
    t = E.elements(r).where("level = 1").withColumn("nx", F.lead("pos").over(Window.partitionBy("doc_id").orderBy("seq")))
    return t.join(r.select("doc_id", F.length("txt").cast("bigint").alias("size")), "doc_id").select("doc_id", "seq", "number", "title", (F.coalesce("nx", "size") - F.col("pos")).alias("n_chars"))


@query("c29_summary", r"WITH " + ELEM[5:] + r""" SELECT doc_id, CASE WHEN length(s) > 500 THEN substring(s, 1, 497) || '...' ELSE s END AS summary FROM (SELECT doc_id, regexp_replace(trim(regexp_replace(txt, '(?m)^(TITRE|CHAPITRE|SECTION|Article)[^\n]*', '', 'g'), chr(10) || ' '), '\s+', ' ', 'g') AS s FROM reg)""")
def c29(spark, sf):
    s = F.regexp_replace(F.trim(F.regexp_replace("txt", r"(?m)^(TITRE|CHAPITRE|SECTION|Article)[^\n]*", ""), F.lit("\n ")), r"\s+", " ")
    return reg_corpus(spark, sf).select("doc_id", T.truncate(s, 500).alias("summary"))


@query("c23_c24_type_by_content", f"{REG} SELECT doc_id, CASE WHEN contains(upper(txt), 'RÈGLEMENT COBAC') THEN 'Règlement' WHEN contains(upper(txt), 'INSTRUCTION COBAC') THEN 'Instruction' WHEN contains(upper(txt), 'DÉCISION COBAC') THEN 'Décision' ELSE 'Document réglementaire' END AS kind FROM reg")
def c23(spark, sf):
    up = F.upper("txt")
    return reg_corpus(spark, sf).select("doc_id", F.when(up.contains("RÈGLEMENT COBAC"), "Règlement").when(up.contains("INSTRUCTION COBAC"), "Instruction").when(up.contains("DÉCISION COBAC"), "Décision").otherwise("Document réglementaire").alias("kind"))
