"""Rewriting of scans, category ladders, entries, errors and answers over the corpus of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import rules as R
from lexmill.functions import text as T
from lexmill.plans.registry import query, quoted, table
from lexmill.sources.forms import forms_corpus, forms_sql

FORMS = "WITH " + forms_sql()


def gsub(x: str, rules: list[tuple[str, str]], flags: str = "g") -> str:
    """Nested regexp_replace in DuckDB."""
    for pattern, new in rules:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(new)}, '{flags}')"
    return x


_NUMBERS = [(r"\bl\b", "1"), (r"\bO\b", "0"), (r"(\d),(\d)", r"\1.\2")]
_T8 = gsub("noisy", [*_NUMBERS, (r"\s+", " "), (r"([.!?])([A-Z])", r"\1 \2"), (r"AIT\.", "ART."), (r"([Aa])iticle", r"\1rticle")])


@query("t8_basic_ocr", f"{FORMS} SELECT doc_id, trim({_T8}) AS fixed FROM forms")
def t8(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", R.basic_ocr("noisy").alias("fixed"))


_TERMS = ["Commission Bancaire", "établissement de crédit", "fonds propres", "ratio de solvabilité", "liquidité", "provisions", "créances", "immobilisations", "surveillance", "contrôle", "inspection", "sanction", "astreinte", "pénalité"]
_T9 = gsub(gsub(gsub("noisy", [*_NUMBERS, (r"AIT\.", "ART."), (r"([Aa])iticle", r"\1rticle"), ("ARIICLE", "ARTICLE"), ("ariicle", "article")]), [(t.replace(" ", r"\s+"), t) for t in _TERMS], "gi"), [(r"(Article|ARTICLE)\s+(\d+)", r"\1 \2"), (r"Art\.\s*(\d+)", r"Art. \1"), (r"(TITRE|CHAPITRE|SECTION)\s+([IVX]+)", r"\1 \2"), (r"(\d+)\s*-\s*", r"\1. "), (r"([a-z])\)\s*", r"\1) "), (r"\s+", " ")])
_T9 = gsub(f"trim({_T9})", [(r"Article\s+(\d+)\s*[.:]?\s*([A-Z])", r"Article \1. \2"), (r"(TITRE|CHAPITRE)\s+([IVX]+)\s*[.:]?\s*([A-Z])", r"\1 \2 - \3"), (r"(COBAC|CEMAC)\s+([RID][-\s]*\d+[-\s]*\d+)", r"\1 \2"), (r"(\d{1,2})\s*[/\-.]\s*(\d{1,2})\s*[/\-.]\s*(\d{4})", r"\1/\2/\3"), (r"(\d+)\s*%", r"\1%"), (r"(\d+)\s*(FCFA|EUR|USD)", r"\1 \2")])


@query("t9_staged_ocr", f"{FORMS} SELECT doc_id, {_T9} AS fixed FROM forms")
def t9(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", R.staged_ocr("noisy").alias("fixed"))


_PAIRS = [(r"\b0\b", "O"), (r"\bl\b", "I"), (r"rn\b", "ni"), (r"\bm\b", "ni"), ("C0BAC", "COBAC"), ("CQBAC", "COBAC"), ("CEMAO", "CEMAC"), ("CEMAG", "CEMAC"), ("banqu0", "banque"), ("créd1t", "crédit"), ("débit0ur", "débiteur"), ("crédit0ur", "créditeur"), ("établissem0nt", "établissement"), ("articl0", "article"), ("alln0a", "alinéa"), ("paragrap0e", "paragraphe"), ("chap1tre", "chapitre"), ("t1tre", "titre"), ("0/00", "‰"), ("0/0", "%")]
_T12 = " + ".join(f"greatest(0, len(regexp_extract_all(noisy, {quoted('(?i)' + p)})) - len(regexp_extract_all(fixed, {quoted('(?i)' + p)})))" for p, _ in _PAIRS)


@query("t10_t12_regulator_ocr", f"{FORMS}, f AS (SELECT doc_id, noisy, {gsub('noisy', _PAIRS, 'gi')} AS fixed FROM forms) SELECT doc_id, fixed, CASE WHEN noisy = fixed THEN 0 ELSE {_T12} END::INT AS n_corrections FROM f")
def t10(spark, sf):
    f = forms_corpus(spark, sf).select("doc_id", "noisy", R.regulator_ocr("noisy").alias("fixed"))
    return f.select("doc_id", "fixed", R.n_corrections("noisy", "fixed").alias("n_corrections"))


_T11 = gsub(gsub("noisy", [(r"Art[il]cle\s+(\d+)", r"Article \1"), (r"SECT[I1]ON\s+([IVX\d]+)", r"SECTION \1"), (r"CHAP[IT]TRE\s+([IVX\d]+)", r"CHAPITRE \1"), (r"T[IT]TRE\s+([IVX\d]+)", r"TITRE \1")], "gi"), [(r"([.!?])\s*([A-Z][a-z])", "\\1\n\n\\2"), (r"\s+([,.;:!?])", r"\1"), (r"([,.;:!?])([A-Za-z])", r"\1 \2")])


@query("t11_structure_repair", f"{FORMS} SELECT doc_id, {_T11} AS repaired FROM forms")
def t11(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", R.repair_structure("noisy").alias("repaired"))


_RAW = "concat(replace(txt, 'Article 1', 'Arlicle 1'), 'fin- \n  nale 15°C b )Oui.Non   fin\n\n\n\nend')"
_T13 = gsub(_RAW, [("Arlicle|Artide|Artiele", "Article"), (r"\s*\n\s*", "\n"), (r"[ \t]+", " "), (r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", r"\1\2")])
_T14 = gsub(_RAW, [(r"\n{3,}", "\n\n"), (r" {2,}", " "), (r"(\d+)\s*°\s*", r"\1° "), (r"([a-z])\s*\)\s*", r"\1) "), (r"([.!?,:;])([A-Z])", r"\1 \2")])


@query("t13_t14_article_rewriting", f"{FORMS} SELECT doc_id, md5({_T13}) AS text_hash, md5(trim({_T14}, ' \n\t')) AS content_hash FROM forms")
def t13(spark, sf):
    raw = F.concat(F.replace("txt", F.lit("Article 1"), F.lit("Arlicle 1")), F.lit("fin- \n  nale 15°C b )Oui.Non   fin\n\n\n\nend"))
    return forms_corpus(spark, sf).select("doc_id", F.md5(R.article_text(raw)).alias("text_hash"), F.md5(R.article_content(raw)).alias("content_hash"))


_NUMBERS17 = ["Article 12", "Art. 3 bis", "4-2", "5.1 ter", "7 a", "8 b quater", "premier", "Article 9.3", "12BIS", "ART 6"]
_X17 = r"trim(regexp_replace(number, '^\s*(article|art\.?)\s*', '', 'i'))"
_RANK = lambda p: f"coalesce(list_position(['bis', 'ter', 'quater'], nullif(lower(regexp_extract(x, '{p}', 1)), '')), 0)"
_INT = lambda p, rest="0": f"coalesce(try_cast(regexp_extract(x, '{p}', 1) AS INT), {rest})"


@query("t17_sort_keys", rf"""{FORMS}, n AS (SELECT doc_id, ({_NUMBERS17})[(doc_id % 10 + 1)::INT] AS number FROM forms), k AS (SELECT doc_id, number, {_X17} AS x FROM n), m AS (SELECT *, try_cast(regexp_extract(x, '^(\d+)', 1) AS INT) AS main FROM k)
SELECT doc_id, number, coalesce(main, 9999) AS main, CASE WHEN main IS NULL THEN 0 ELSE {_INT(r'^\d+[.-](\d+)')} END AS sub_a, CASE WHEN main IS NULL THEN 0 ELSE {_RANK(r'(?i)^\d+(?:[.-]\d+)?\s*(bis|ter|quater)')} END::INT AS suffix_a,
  CASE WHEN main IS NULL THEN 0 ELSE {_INT(r'^\d+\s*[.-](\d+)', _RANK(r'(?i)^\d+\s*(bis|ter|quater)'))} END::INT AS sub_b, CASE WHEN main IS NULL THEN 0 ELSE {_INT(r'^\d+\.(\d+)')} END AS sub_c,
  CASE WHEN main IS NULL THEN 0 ELSE coalesce(ascii(nullif(lower(regexp_extract(x, '(?i)^\d+(?:\.\d+)?\s*([a-z])', 1)), '')) - 97, 0) END::INT AS letter_c, CASE WHEN main IS NULL THEN 0 ELSE {_RANK(r'(?i)^\d+(?:\.\d+)?\s*[a-z]?\s*(bis|ter|quater)')} END::INT AS suffix_c FROM m""")
def t17(spark, sf):
    n = forms_corpus(spark, sf).select("doc_id", F.get(F.array(*map(F.lit, _NUMBERS17)), (F.col("doc_id") % 10).cast("int")).alias("number"))
    a, b, c = R.sort_keys("number")
    return n.select("doc_id", "number", a["main"].alias("main"), a["sub"].alias("sub_a"), a["suffix"].alias("suffix_a"), b["sub"].alias("sub_b"), c["sub"].alias("sub_c"), c["letter"].alias("letter_c"), c["suffix"].alias("suffix_c"))


_TYPES = ["FileNotFoundError", "MemoryError", "JSONDecodeError", "TimeoutError", "KeyError", "OSError", "AttributeError", "PermissionError", "ValueError", "TypeError", "UnicodeDecodeError", "ConnectionError"]
_MESSAGES = ["cannot open PDF", "invalid value", "could not save workbook", "Connection reset", "unauthorized", "nothing of the kind", "api key refused", "bad format of file"]
_EVENT = f"SELECT event_id, ({_TYPES})[(event_id % 12 + 1)::INT] AS error_type, ({_MESSAGES})[(event_id % 8 + 1)::INT] AS message FROM events"


def _error_log(spark, sf):
    at = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (F.col("event_id") % n).cast("int"))
    return table(spark, sf, "events").select("event_id", "ts", at(_TYPES, 12).alias("error_type"), at(_MESSAGES, 8).alias("message"))


@query("t22_t23_w22_errors", f"""WITH e AS ({_EVENT}), c AS (SELECT *, lower(message) AS m FROM e), k AS (SELECT *, CASE WHEN regexp_matches(m, 'pdf|extract|document|file') THEN 'DOCUMENT_PROCESSING' WHEN regexp_matches(m, 'validation|invalid|format') THEN 'VALIDATION' WHEN regexp_matches(m, 'export|excel|save|write') THEN 'EXPORT' WHEN regexp_matches(m, 'network|connection|timeout|api') THEN 'NETWORK' WHEN regexp_matches(m, 'authentication|unauthorized') THEN 'AUTHENTICATION' ELSE 'SYSTEM' END AS category FROM c)
SELECT event_id, category, CASE WHEN error_type IN ('FileNotFoundError', 'PermissionError') THEN 'HIGH' WHEN error_type = 'MemoryError' THEN 'CRITICAL' WHEN error_type IN ('JSONDecodeError', 'KeyError', 'ValueError') THEN 'LOW' ELSE 'MEDIUM' END AS severity,
  CASE WHEN error_type = 'MemoryError' THEN 'FAIL' WHEN error_type IN ('ConnectionError', 'TimeoutError', 'TypeError', 'OSError') THEN 'RETRY' ELSE 'FALLBACK' END AS strategy,
  CASE category WHEN 'SYSTEM' THEN 'see the log' WHEN 'DOCUMENT_PROCESSING' THEN 'check that the document is readable or extract it by another method' WHEN 'VALIDATION' THEN 'check the key and the connection of the validator' WHEN 'EXPORT' THEN 'check that the folder exists, may be written and holds no open workbook' WHEN 'NETWORK' THEN 'check the connection and try again' ELSE 'check that the key is right and not expired' END AS suggestion FROM k""")
def t22(spark, sf):
    e = _error_log(spark, sf).withColumn("category", R.error_category("message"))
    return e.select("event_id", "category", R.lookup("error_type", R.SEVERITIES, "MEDIUM").alias("severity"), R.lookup("error_type", R.STRATEGIES, "RETRY").alias("strategy"), R.lookup("category", R.ADVICE, "see the log").alias("suggestion"))


_KEYS31 = [("XI", 11), ("X", 10), ("IX", 9), ("VIII", 8), ("VII", 7), ("VI", 6), ("V", 5), ("IV", 4), ("III", 3), ("II", 2), ("I", 1)]
_C31 = "CASE " + " ".join(rf"WHEN regexp_matches(upper(title || ' ' || summary), '\b({n}|{i})\b[\s.]') THEN '{n}'" for n, i in _KEYS31) + " ELSE 'II' END"
_LIKE = lambda c, words: f"regexp_matches(lower({c}), '{words}')"
_STEPS = [("IV", "comptable|bilan|compte de résultat"), ("VII", "contrôle interne|gestion des risques|audit"), ("V", "paiement|chèque|virement|carte bancaire"), ("III", "agrément|autorisation|licence bancaire"), ("IX", "protection|consommateur|client|réclamation"), ("VIII", "groupe bancaire|holding|consolidation"), ("I", "organisation|fonctionnement|cobac")]
_LADDER = lambda c, steps, rest: "CASE " + " ".join(f"WHEN {_LIKE(c, w)} THEN '{n}'" for n, w in steps) + f" ELSE {rest} END"
_C34 = _LADDER("summary", [("VI", "ratio|fonds propres|capital|solvabilité|prudentiel"), *_STEPS], "'II'")
_BYFILE = _LADDER("file_name", [("IV", "comptable|r-98|r-93"), ("V", "paiement|systeme|moyen"), ("VI", "prudentiel|ratio|fonds_propres|capital|r-2016"), ("VII", "controle|interne|risque|supervision|r-2008"), ("VIII", "groupe|bancaire|holding"), ("IX", "protection|consommateur|client|r-2019"), ("III", "agrement|exercice|profession|r-2001"), ("I", "organisation|fonctionnement|cobac")], "NULL")
_RELAXED = [("VI", ["ratio", "fonds propres", "capital"]), ("IV", ["comptable", "compte"]), ("VII", ["contrôle", "risque"]), ("V", ["paiement", "virement"]), ("III", ["agrément"]), ("IX", ["client", "protection"]), ("VIII", ["groupe"]), ("I", ["cobac"])]
_C33 = f"""r AS (SELECT doc_id, unnest([{', '.join(f"{{'o': {i}, 'c': '{n}', 'n': " + " + ".join(f"contains(lower(summary), '{t}')::INT" for t in ts) + "}" for i, (n, ts) in enumerate(_RELAXED))}]) AS x FROM forms), b AS (SELECT doc_id, min_by(x.c, -100 * x.n + x.o) AS c FROM r WHERE x.n > 0 GROUP BY doc_id)"""


@query("c31_numeral_category", f"{FORMS} SELECT doc_id, {_C31} AS category FROM forms")
def c31(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", R.numeral_category("title", "summary", F.lit("II")).alias("category"))


@query("c33_document_ladder", f"""{FORMS}, {_C33} SELECT doc_id, doc_id % 2 = 1 AS partial, CASE WHEN doc_id % 2 = 1 THEN coalesce({_BYFILE}, b.c, 'II') WHEN {_LIKE('file_name', 'cobac2021|recueil|compilation')} THEN {_LADDER('summary', [('VI', 'ratio|fonds propres|capital|solvabilité|prudentiel'), *_STEPS[:3]], "'VI'")}
  ELSE coalesce({_BYFILE}, {_LADDER('summary', [('VI', 'ratio|fonds propres|capital|solvabilité'), *_STEPS], "'VI'")}) END AS category FROM forms LEFT JOIN b USING (doc_id)""")
def c33(spark, sf):
    partial = F.col("doc_id") % 2 == 1
    return forms_corpus(spark, sf).select("doc_id", partial.alias("partial"), R.document_category("file_name", "summary", partial).alias("category"))


@query("c34_content_ladder", f"{FORMS} SELECT doc_id, {_C34} AS category FROM forms")
def c34(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", R.ladder("summary", R.CONTENT_LADDER, "II").alias("category"))


_HEAD35 = "coalesce(" + ", ".join(rf"nullif(trim(regexp_extract(x, '(?i)(?:{n}+\.|{n}\s+[-.]\s*)({p})', 1)), '')" for n, p in R.HEADERS.items()) + ")"
_VAR35 = ", ".join(f"('{n}', {quoted(v)})" for n, vs in R.VARIANTS.items() for v in vs.split("|"))
_NAMES = ", ".join(f"('{k}', {quoted(v)})" for k, v in R.CATEGORY_NAMES.items())


@query("c35_w16_display_name", f"""{FORMS}, v(category, variant) AS (VALUES {_VAR35}), n(category, name) AS (VALUES {_NAMES}), c AS (SELECT doc_id, upper(title || ' ' || summary) AS x, {_C31} AS category FROM forms),
s AS (SELECT doc_id, variant, len(list_filter(string_split(variant, ' '), lambda w: length(w) > 2 AND contains(x, w)))::DOUBLE / len(list_filter(string_split(variant, ' '), lambda w: length(w) > 2)) + contains(x, variant)::INT * 0.5 + 0.05 * len(string_split(variant, ' ')) AS score FROM c JOIN v USING (category)),
b AS (SELECT doc_id, variant FROM s WHERE score >= 0.3 - 1e-9 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score::DOUBLE, 9) DESC, length(variant) DESC, variant DESC) = 1)
SELECT doc_id, category, coalesce({_HEAD35}, variant, name, '') AS name FROM c LEFT JOIN b USING (doc_id) LEFT JOIN n USING (category)""")
def c35(spark, sf):
    c = forms_corpus(spark, sf).select("doc_id", F.concat("title", F.lit(" "), "summary").alias("x"), R.numeral_category("title", "summary", F.lit("II")).alias("category"))
    return c.select("doc_id", "category", R.display_name("x", "category").alias("name"))


_DEF36 = "CASE category " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in R.SUB_DEFAULT.items()) + " ELSE '' END"
_T36 = "CASE " + " ".join(f"WHEN category = '{k}' AND regexp_matches(lower(title), {quoted('|'.join(terms))}) THEN {quoted(name)}" for k, name, terms in R.SUB_BY_TITLE) + f" ELSE {_DEF36} END"
_R36 = "CASE " + " ".join(f"WHEN category = '{k}' AND regexp_matches(title || chr(1) || reference, {quoted(codes)}) THEN {quoted(name)}" for k, rows in R.SUB_BY_CODE.items() for name, codes in rows.items()) + f" ELSE {_DEF36} END"


@query("c36_sub_categories", f"{FORMS}, c AS (SELECT doc_id, title, reference, ['II', 'IV', 'V', 'VI', 'VII', 'IX', 'I', 'X'][(doc_id % 8 + 1)::INT] AS category FROM forms) SELECT doc_id, category, {_T36} AS by_title, {_R36} AS by_code FROM c")
def c36(spark, sf):
    kinds = F.array(*map(F.lit, ["II", "IV", "V", "VI", "VII", "IX", "I", "X"]))
    c = forms_corpus(spark, sf).select("doc_id", "title", "reference", F.get(kinds, (F.col("doc_id") % 8).cast("int")).alias("category"))
    return c.select("doc_id", "category", R.sub_category("title", "category").alias("by_title"), R.sub_category_by_code("title", "reference", "category").alias("by_code"))


_MAP = ", ".join(f"({i}, {quoted(k)}, '{c}')" for i, (k, c) in enumerate(R.PREDEFINED))


@query("j9_j10_predefined", f"""{FORMS}, k(ord, key, category) AS (VALUES {_MAP}), n(category, name) AS (VALUES {_NAMES}), p AS (SELECT doc_id, ord, category FROM forms JOIN k ON contains(title, key) OR contains(reference, key)),
q AS (SELECT doc_id, 1000 + ord AS ord, category FROM forms JOIN k ON contains(title, array_to_string(string_split(key, ' ')[1:3], ' ')) OR contains(reference, array_to_string(string_split(key, ' ')[1:3], ' '))), b AS (SELECT doc_id, min_by(category, ord) AS category FROM (SELECT * FROM p UNION ALL SELECT * FROM q) GROUP BY doc_id)
SELECT doc_id, category, name FROM forms LEFT JOIN b USING (doc_id) LEFT JOIN n USING (category)""")
def j9(spark, sf):
    names = F.broadcast(spark.createDataFrame(list(R.CATEGORY_NAMES.items()), "category string, name string"))
    c = forms_corpus(spark, sf).select("doc_id", R.predefined_category("title", "reference").alias("category"))
    return c.join(names, "category", "left").select("doc_id", "category", "name")


_ANSWER = {"title": "title", "summary": "CASE WHEN doc_id % 5 = 0 THEN ' null ' ELSE summary END", "obligations": "CASE doc_id % 4 WHEN 0 THEN 'tenir ; payer chaque mois' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL ELSE 'obligation simple de forme' END", "article_references": "CASE WHEN doc_id % 3 = 0 THEN 'Articles 3 et 7 du texte' ELSE '' END", "sanctions": "CASE WHEN doc_id % 2 = 0 THEN 'amende de 10 millions FCFA' ELSE 'à évaluer plus tard' END", "impact": "CASE doc_id % 5 WHEN 0 THEN 'Impact tres eleve' WHEN 1 THEN 'plutôt élevé' WHEN 2 THEN 'assez faible ici' WHEN 3 THEN 'x' ELSE 'sans avis clair' END", "publication_date": "'15 mars 2016'", "effective_date": "'2016'"}
_ENTRY = ", ".join(f"{x} AS {c}" for c, x in _ANSWER.items())
_CLEAN = ", ".join(f"CASE WHEN length(trim(coalesce({c}, ''))) > 5 AND lower(trim({c})) NOT IN ('none', 'null', 'n/a', '...') THEN trim({c}) ELSE {quoted(d)} END AS {c}" for c, d in R.DEFAULTS.items())
_IMP = "CASE WHEN regexp_matches(lower(impact), 'très élevé|tres eleve') THEN 'Très élevé' WHEN regexp_matches(lower(impact), 'élevé|eleve') THEN 'Élevé' WHEN contains(lower(impact), 'faible') THEN 'Faible' ELSE 'Moyen' END"
_EMPTY = "à analyser|à identifier|à évaluer|à compléter|non disponible|non spécifié"
_W = lambda c, w, more: f"CASE WHEN length({c}) > 10 AND NOT regexp_matches(lower({c}), '{_EMPTY}') THEN {w} + {more} ELSE 0 END"
_C37 = " + ".join([_W("title", 10, "0"), _W("summary", 20, "(length(summary) > 100)::INT * 5"), _W("obligations", 20, "regexp_matches(obligations, '[;\n]')::INT * 5"), _W("article_references", 15, "regexp_matches(article_references, '[0-9]')::INT * 5"), _W("sanctions", 15, "regexp_matches(lower(sanctions), 'fcfa|amende|emprisonnement')::INT * 5"), _W("impact", 10, "(impact IN ('Très élevé', 'Élevé', 'Moyen', 'Faible'))::INT * 5"), _W("publication_date", 5, "0"), _W("effective_date", 5, "0")])


@query("c37_c38_entries", f"{FORMS}, a AS (SELECT doc_id, {_ENTRY} FROM (SELECT doc_id, title, summary FROM forms) t), d AS (SELECT doc_id, {_CLEAN} FROM a), e AS (SELECT * REPLACE ({_IMP} AS impact) FROM d) SELECT *, least(100, {_C37})::INT AS quality, least(100, {_C37}) < 30 AS emergency FROM e")
def c37(spark, sf):
    a = forms_corpus(spark, sf).select("doc_id", "title", "summary").selectExpr("doc_id", *[f"{x} AS {c}" for c, x in _ANSWER.items()])
    e = a.select("doc_id", *[R.filled(c).alias(c) for c in R.WEIGHTS])
    return e.withColumn("quality", R.entry_quality()).withColumn("emergency", F.col("quality") < 30)


_KW41 = R.OCR_KEYWORDS
_N41 = " + ".join(f"contains(lower(txt), '{w}')::INT" for w in _KW41)
_Q41 = rf"(0.4 * conf + 0.3 * found / {len(_KW41)} + 0.3 * (regexp_matches(lower(txt), 'article\s+\d+')::INT * 10 + regexp_matches(lower(txt), 'titre|chapitre|section')::INT * 8 + (found > 0)::INT * 6 + regexp_matches(txt, '\d+[°.]')::INT * 4) / 30)::DOUBLE"


@query("c41_w26_ocr_quality", f"{FORMS}, k AS (SELECT doc_id, x.txt, (doc_id % 11) / 10.0::DOUBLE AS conf FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN noisy ELSE txt END AS txt FROM forms) x), f AS (SELECT *, {_N41} AS found FROM k), q AS (SELECT doc_id, round({_Q41}, 6) AS quality FROM f) SELECT doc_id, quality, quality >= 0.6 AS valid, CASE WHEN quality < 0.5 THEN 4 WHEN quality < 0.7 THEN 3 WHEN quality < 0.8 THEN 2 ELSE 1 END AS n_advice FROM q")
def c41(spark, sf):
    k = forms_corpus(spark, sf).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("noisy")).otherwise(F.col("txt")).alias("txt"), ((F.col("doc_id") % 11) / 10.0).alias("conf"))
    q = k.select("doc_id", F.round(R.ocr_quality("txt", F.col("conf")), 6).alias("quality"))
    return q.select("doc_id", "quality", (F.col("quality") >= 0.6).alias("valid"), F.size(R.ocr_advice(F.col("quality"))).alias("n_advice"))


_JSON = ['{"articles": [{"n": 1}], "document_info": {}, "statistiques": 3}', '{"articles": []}', "not json", '{"evaluation": 1, "niveau_materialite": "HIGH", "justification": "x", "actions_requises": []}', '{"structure_hierarchique": [], "justification": null, "evaluation": 2}']
_A43 = {0: (0.6, 0.0), 1: (0.0, 0.0), 3: (0.0, 0.8), 4: (0.2, 0.5)}


@query("c43_w14_answer_scores", "WITH a AS (SELECT event_id, event_id % 5 AS k FROM events) SELECT event_id, " + ", ".join(f"CASE k {' '.join(f'WHEN {k} THEN {v[i]}' for k, v in _A43.items())} END::DOUBLE AS {name}" for i, name in enumerate(("article_score", "materiality_score"))) + ", CASE k WHEN 2 THEN 'JSON formatting' ELSE '' END AS failure FROM a")
def c43(spark, sf):
    a = table(spark, sf, "events").select("event_id", F.get(F.array(*map(F.lit, _JSON)), (F.col("event_id") % 5).cast("int")).alias("answer"))
    bad = F.try_parse_json("answer").isNull()
    return a.select("event_id", R.answer_score("answer", "articles").alias("article_score"), R.answer_score("answer", "materiality").alias("materiality_score"), F.when(bad, "JSON formatting").otherwise("").alias("failure"))
