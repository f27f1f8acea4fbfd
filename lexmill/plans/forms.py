"""Articles, citations, references and fields over the corpus of forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import forms as O
from lexmill.plans.registry import query, quoted, sql_any
from lexmill.plans.rules import FORMS
from lexmill.sources.forms import forms_corpus

_N = r"\d+(?:[.,]\d+)?"
_ORD = "premier|deuxième|troisième|quatrième|cinquième|sixième|septième|huitième|neuvième|dixième"
_HEADS = [
    ("article", rf"article\s+({_N}(?:\s*(?:bis|ter|quater|quinquies|sexies|septies|octies|novies|decies)\b)?)"), ("numbered", rf"({_N})\s*[-–—]"), ("art", r"art\.\s*(\d+)\s*cobac"), ("r", rf"r\s*({_N})"),
    ("rule", rf"(?:regle|règle)\s*({_N})"), ("ordinal", rf"article\s+({_ORD})"), ("account", r"le\s+compte\s+divisionnaire\s+«\s*(\d+[^»]*?)\s*»"), ("quoted", rf"l['’]article\s+({_N})\s+(?:stipule|dispose|prévoit|énonce|précise)"),
]
_ANY = "|".join(p for _, p in _HEADS).replace("(" + _N, "(?:" + _N)
_CUT = "'(?mi)^([ \\t]*(?:" + _ANY.replace("'", "''") + r"|(?:titre|chapitre|section|annexe)\s+[ivx]+|art\.\s*\d+))'"
_SEGS = f"segs AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS seg FROM (SELECT doc_id, string_split(regexp_replace(txt, {_CUT}, chr(1) || '\\1', 'g'), chr(1)) AS p FROM forms))"
_BODY = "CASE WHEN contains(seg, chr(10)) THEN trim(substring(seg, strpos(seg, chr(10)) + 1), ' \n\t') ELSE '' END"
_DIGIT = "CASE trim(lower({0})) " + " ".join(f"WHEN '{w}' THEN '{i}'" for i, w in enumerate(_ORD.split("|"), 1)) + r" ELSE regexp_replace(replace(trim(lower({0})), ',', '.'), '\s+', ' ', 'g') END"
_AT = lambda p: quoted("(?i)^[ \t]*(?:" + p + ")")
_RAW = "CASE form " + " ".join(f"WHEN '{n}' THEN regexp_extract(seg, {_AT(p)}, 1)" for n, p in _HEADS) + " END"
_ARTS = f"""{FORMS}, {_SEGS},
f AS (SELECT doc_id, seq, seg, CASE {' '.join(f"WHEN regexp_matches(seg, {_AT(p)}) THEN '{n}'" for n, p in _HEADS)} END AS form, {_BODY} AS body FROM segs),
own AS (SELECT doc_id, seq, list_position({[n for n, _ in _HEADS]}, form) AS rank, form, {_RAW} AS raw, trim(regexp_replace(string_split(seg, chr(10))[1], {quoted("(?i)^[ \t]*(?:" + _ANY + r")(?:\s*\([^)]*\))?\s*[:.-]?\s*")}, '')) AS title, body FROM f WHERE form IS NOT NULL),
cit AS (SELECT doc_id, seq, 99 AS rank, 'citation' AS form, regexp_extract(seg, {quoted(rf"(?is)(?:en vertu de|conformément à|selon|au sens de) l['’]article\s+({_N})(.*)$")}, 1) AS raw, '' AS title, trim(regexp_extract(seg, {quoted(rf"(?is)(?:en vertu de|conformément à|selon|au sens de) l['’]article\s+({_N})(.*)$")}, 2), ' \n\t') AS body FROM f),
al AS (SELECT doc_id, rank, seq, form, {_DIGIT.format('raw')} AS number, title, body FROM (SELECT * FROM own UNION ALL SELECT * FROM cit WHERE raw <> '')),
arts AS (SELECT doc_id, form, number, title, body FROM (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY rank, seq) = 1) WHERE length(body) > 50)"""


@query("g12_p4_article_forms", f"{_ARTS} SELECT doc_id, form, number, title, md5(body) AS body_hash FROM arts")
def g12(spark, sf):
    return O.article_forms(forms_corpus(spark, sf)).select("doc_id", "form", "number", "title", F.md5("body").alias("body_hash"))


_GAPPED = "replace(txt, '\nArticle', '\n\nArticle')"


@query("g13_section_articles", rf"""{FORMS}, p AS (SELECT doc_id, string_split(regexp_replace({_GAPPED}, '\n{{2,}}((?i:(?:article|art\.)\s+\d|\d+\s*[-–—]))', chr(1) || '\1', 'g'), chr(1)) AS p FROM forms), s AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS seg FROM p)
SELECT doc_id, seq::INT AS seq, replace(regexp_extract(seg, '(?i)^\s*(?:article|art\.)\s+({_N})', 1), ',', '.') AS number, trim(regexp_extract(seg, '(?i)^\s*(?:article|art\.)\s+{_N}\s*[:.-]?\s*([^\n]*)', 1)) AS title, md5({_BODY}) AS body_hash FROM s WHERE length(trim(seg)) >= 50 AND regexp_matches(seg, '(?i)^\s*(?:article|art\.)\s+{_N}') AND length({_BODY}) > 50""")
def g13(spark, sf):
    texts = forms_corpus(spark, sf).withColumn("txt", F.replace("txt", F.lit("\nArticle"), F.lit("\n\nArticle")))
    return O.section_articles(texts).select("doc_id", "seq", "number", "title", F.md5("body").alias("body_hash"))


_HEAD14 = rf"(?i)^\s*(?:article|art\.)\s*({_N}(?:\s*(?:bis|ter|quater)\b)?)\s*[:.-]?\s*([^\n]*)"


@query("g14_fallback_articles", rf"""{FORMS}, {_SEGS}, a AS (SELECT doc_id, seq, trim(regexp_extract(seg, {quoted(_HEAD14)}, 1)) AS number, trim(regexp_extract(seg, {quoted(_HEAD14)}, 2)) AS title, trim(regexp_replace({_BODY}, '\s+', ' ', 'g')) AS body FROM segs WHERE regexp_matches(seg, {quoted(_HEAD14)})),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY seq) = 1) SELECT doc_id, number, CASE WHEN title = '' THEN 'Article ' || number ELSE title[1:200] END AS title, md5(body[1:5000]) AS body_hash FROM b WHERE length(body) > 50""")
def g14(spark, sf):
    return O.fallback_articles(forms_corpus(spark, sf)).select("doc_id", "number", "title", F.md5("body").alias("body_hash"))


_LISTS = "concat(txt, '4. - Un point de la liste assez long\n5) Un autre point de la liste\n5) le même numéro une fois de plus\n6) court\n')"
_E1, _E2 = r"(?i)^\s*(?:article|art\.)\s*(\d+(?:\.\d+)?(?:\s*(?:bis|ter|quater)\b)?)[^\n]*\n", r"(?i)^\s*(?:(\d+)\.\s*[-–]|(\d+)\))"


@query("g15_export_articles", rf"""{FORMS}, p AS (SELECT doc_id, string_split(regexp_replace({_LISTS}, '(?mi)^([ \t]*(?:(?:article|art\.)\s*\d|\d+\.\s*[-–]|\d+\)))', chr(1) || '\1', 'g'), chr(1)) AS p FROM forms), s AS (SELECT doc_id, generate_subscripts(p, 1) AS seq, unnest(p) AS seg FROM p),
a AS (SELECT doc_id, seq, CASE WHEN regexp_matches(seg, '{_E1}') THEN trim(regexp_extract(seg, '{_E1}', 1)) ELSE regexp_extract(seg, '{_E2}', 1) || regexp_extract(seg, '{_E2}', 2) END AS number, trim(regexp_replace(CASE WHEN regexp_matches(seg, '{_E1}') THEN regexp_replace(seg, '{_E1}', '') ELSE regexp_replace(seg, '{_E2}', '') END, '\s+', ' ', 'g')) AS body FROM s WHERE regexp_matches(seg, '{_E1}') OR regexp_matches(seg, '{_E2}'))
SELECT doc_id, number, md5(body[1:5000]) AS body_hash FROM (SELECT * FROM a WHERE length(body) > 20) QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY seq) = 1""")
def g15(spark, sf):
    texts = forms_corpus(spark, sf).withColumn("txt", F.concat("txt", F.lit("4. - Un point de la liste assez long\n5) Un autre point de la liste\n5) le même numéro une fois de plus\n6) court\n")))
    return O.export_articles(texts).select("doc_id", "number", F.md5("body").alias("body_hash"))


_MIXED = "replace(txt, 'TITRE II - ', CASE doc_id % 5 WHEN 0 THEN 'CHAPTER 4: ' WHEN 1 THEN 'Sous-section 2.1 - ' WHEN 2 THEN '§ 3 ' WHEN 3 THEN 'TITLE V. ' ELSE 'SECTION IX – ' END)"
_LV = [(1, r"(?:titre|title)\s+([ivxlcdm]+)"), (2, r"(?:chapitre|chapter)\s+([ivxlcdm]+|\d+)"), (4, r"(?:sous-section|§)\s*([ivxlcdm]+\b|\d+(?:\.\d+)?)"), (3, r"section\s+([ivxlcdm]+|\d+(?:\.\d+)?)"), (5, rf"(?:article|art\.)\s*({_N}(?:\s*(?:bis|ter|quater)\b)?)")]
_LVP = lambda p: quoted(rf"(?i)^\s*(?:{p})\s*[:.–-]?\s*(.*)$")


@query("g17_g19_t18_headings", f"""{FORMS}, l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS line FROM (SELECT doc_id, string_split({_MIXED}, chr(10)) AS p FROM forms)), k AS (SELECT *, CASE {' '.join(f'WHEN regexp_matches(line, {_LVP(p)}) THEN {k}' for k, p in _LV)} END AS level FROM l)
SELECT doc_id, seq::INT AS seq, level::INT AS level, CASE level {' '.join(f"WHEN {k} THEN " + (f"upper(regexp_extract(line, {_LVP(p)}, 1))" if k < 5 else f"replace(lower(regexp_extract(line, {_LVP(p)}, 1)), ',', '.')") for k, p in _LV)} END AS number, CASE level {' '.join(f'WHEN {k} THEN trim(regexp_extract(line, {_LVP(p)}, 2))' for k, p in _LV)} END AS title FROM k WHERE level IS NOT NULL""")
def g17(spark, sf):
    texts = forms_corpus(spark, sf).withColumn("txt", F.expr(_MIXED))
    return O.headings(texts)


_POS = "list_sum(list_transform({g}[1:i], lambda v: length(v))) + coalesce(list_sum(list_transform({w}[1:i - 1], lambda v: length(v))), 0)"


def _located_sql(source: str, columns: str, x: str, patterns: list[tuple[str, str, str]]) -> str:
    """Union over patterns (kind, pattern, group expression over m): columns, kind, m, pos."""
    parts = []
    for kind, p, _ in patterns:
        parts.append(f"SELECT {columns}, '{kind}' AS kind, w[i] AS m, ({_POS.format(g='g', w='w')})::INT AS pos, t FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM (SELECT {columns}, {x} AS t, regexp_extract_all({x}, {quoted(p)}) AS w, regexp_split_to_array({x}, {quoted(p)}) AS g FROM {source}))")
    return " UNION ALL ".join(parts)


_NB = rf"{_N}(?:\s*(?:bis|ter|quater)\b)?"
_FR = [
    ("conformity", rf"conformément (?:à|aux) (?:l')?articles?\s+{_NB}(?:\s*(?:et|à)\s*{_N})*"), ("conformity", rf"en vertu des? (?:l')?articles?\s+{_NB}"), ("conformity", rf"selon (?:les dispositions de )?(?:l')?articles?\s+{_NB}"), ("conformity", rf"au sens des? (?:l')?articles?\s+{_NB}"),
    ("conformity", rf"prévue?s?\s+(?:à|par|aux)\s+(?:l')?articles?\s+{_NB}"), *(("modification", rf"{v} (?:l')?articles?\s+{_NB}") for v in ("modifie", "remplace", "abroge", "complète")),
    ("reference", rf"voir (?:l')?articles?\s+{_NB}"), ("reference", rf"cf\.\s*(?:l')?articles?\s+{_NB}"), ("reference", rf"se référer à (?:l')?articles?\s+{_NB}"), ("reference", rf"définie?s?\s+(?:à|dans)\s+(?:l')?articles?\s+{_NB}"),
    ("application", rf"(?:pour l'|en )?application des? (?:l')?articles?\s+{_NB}"), ("application", rf"aux fins des? (?:l')?articles?\s+{_NB}"),
    ("exception", rf"(?:par dérogation|nonobstant) (?:à |aux |les dispositions de )?(?:l')?articles?\s+{_NB}"), ("exception", rf"sauf (?:disposition contraire de |dans )?(?:l')?articles?\s+{_NB}"), ("exception", rf"à l'exception des? (?:l')?articles?\s+{_NB}"),
]
_EN = [*(("conformity", rf"{v} articles?\s+{_NB}") for v in ("in accordance with", "pursuant to", "as per", "under")), *(("modification", rf"{v} articles?\s+{_NB}") for v in ("amends", "replaces", "repeals")), *(("reference", rf"{v} articles?\s+{_NB}") for v in ("see", "refer to", "as defined in"))]


def _xref_sql(pairs):
    hits = _located_sql("arts", "doc_id, number, body", "body", [(k, "(?i)" + p, "") for k, p in pairs])
    return rf"""{_ARTS}, hits AS ({hits}), x AS (SELECT doc_id, number AS source, kind, m AS text, substring(body, greatest(pos - 50, 0) + 1, pos - greatest(pos - 50, 0) + length(m) + 50) AS context, regexp_extract(m, '(?i)articles?\s+(.*)$', 1) AS listed FROM hits),
n AS (SELECT *, CASE WHEN NOT regexp_matches(text, '(?i)^conformément') THEN [regexp_extract(listed, '^({_NB})', 1)] WHEN regexp_matches(listed, '{_N}\s*à\s*{_N}') THEN list_transform(range(regexp_extract(listed, '(\d+)(?:[.,]\d+)?\s*à', 1)::INT, greatest(regexp_extract(listed, '(\d+)(?:[.,]\d+)?\s*à', 1)::INT, regexp_extract(listed, 'à\s*(\d+)', 1)::INT) + 1), lambda i: i::VARCHAR) ELSE regexp_extract_all(listed, '{_NB}') END AS ns FROM x)
SELECT doc_id, source, 'Article ' || replace(unnest(ns), ',', '.') AS target, kind, text, context FROM n"""


@query("g21_cross_references_fr", _xref_sql(_FR))
def g21_fr(spark, sf):
    return O.cross_references(O.article_forms(forms_corpus(spark, sf)), "fr")


@query("g21_cross_references_en", _xref_sql(_EN))
def g21_en(spark, sf):
    return O.cross_references(O.article_forms(forms_corpus(spark, sf)), "en")


_RX = [("Regulation", r"(?i)règlement\s+(?:COBAC|CEMAC)?\s*(?:n°\s*)?([RIC]-\d{4}[_/-]\d{2,3})"), ("Instruction", r"(?i)instruction\s+(?:COBAC|CEMAC)?\s*(?:n°\s*)?([RIC]-\d{4}[_/-]\d{2,3})"), ("Basel", r"(?i)(Bâle\s+[IVX]+|Basel\s+[IVX]+|Accords?\s+de\s+Bâle)"), ("Treaty", r"(?i)((?:Traité|Convention)\s+CEMAC|Acte\s+additionnel)"), ("Law", r"(?i)(Loi\s+n°\s*[^,\n]+|Code\s+[^,\n]+)")]


@query("g20_typed_references", f"{FORMS}, h AS ({_located_sql('forms', 'doc_id', 'txt', [(k, p, '') for k, p in _RX])}), r AS (SELECT doc_id, kind, CASE kind {' '.join(f'WHEN {quoted(k)} THEN regexp_extract(m, {quoted(p)}, 1)' for k, p in _RX)} END AS reference, pos, trim(substring(t, greatest(pos - 50, 0) + 1, pos - greatest(pos - 50, 0) + length(m) + 50), ' \n\t') AS context FROM h) SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, kind, reference ORDER BY pos) = 1")
def g20(spark, sf):
    return O.regulatory_references(forms_corpus(spark, sf))


_X = lambda x, ps, g=1: "coalesce(" + ", ".join(f"nullif(regexp_extract({x}, {quoted('(?i)' + p)}, {g}), '')" for p in ps) + ")"
_CODE25 = r"([RIC]-\d{4}[_/-]\d{2,3})"
_KINDS25 = "(?:Règlement|Instruction|Circulaire|Décision)"


@query("c25_content_metadata", rf"""{FORMS} SELECT doc_id, {_X('txt[1:1000]', [_KINDS25 + r'\s+(?:n°\s*)?' + _CODE25, r'n°\s*' + _CODE25, _CODE25])} AS reference, {_X('txt[1:1000]', [r'du\s+\d{1,2}\s+[\p{L}\p{N}_]+\s+\d{4}', r'\d{1,2}[/-]\d{1,2}[/-]\d{4}', r'\d{4}[/-]\d{1,2}[/-]\d{1,2}'], 0)} AS date_raw,
trim({_X('txt[1:2000]', [_KINDS25 + r'[^\n]*?(?:relatif|relative)\s+(?:à|aux?)\s+([^\n.]+)', r'Objet\s*:\s*([^\n]+)', r'portant\s+([^\n.]+)'])}) AS subject, trim({_X('right(txt, 1000)', [r'Le\s+Secrétaire\s+Général\s*,?\s*([^\n]+)', r'Le\s+Président\s*,?\s*([^\n]+)', r'Pour\s+le\s+Secrétaire\s+Général\s*,?\s*([^\n]+)'])}) AS signatory FROM forms""")
def c25(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", *[v.alias(k) for k, v in O.content_metadata("txt").items()])


_U, _Y = r"\d{2}[/-]\d{2}[/-]CEMAC[/-]UMAC[/-]", r"\d{4}[/-]\d{2}"
_F26 = [rf"Règlement\s+COBAC\s+R-({_Y})", rf"Règlement\s+n°\s*({_U}COBAC)", rf"Règlement\s+n°\s*({_U}CM)", rf"Instruction\s+COBAC\s+I-({_Y})", rf"Décision\s+COBAC\s+D-({_Y})", r"Décision\s+n°\s*(\d{2}[/-]\d{2}-FGD-CD)", rf"R-({_Y})", rf"I-({_Y})", rf"D-({_Y})", r"Convention[^\n]*?(\d{2}\s+[\p{L}\p{N}_]+\s+\d{4})", r"LC-(/\d{2})"]
_NAMED, _BARE = _X("txt[1:2000]", _F26, 0), _X("txt[1:2000]", _F26)
_CLEAN26 = "replace(replace(file_name, '.pdf', ''), '_', ' ')"
_C26 = f"""CASE WHEN contains(lower(file_name), 'cobac2021') THEN 'Recueil des textes légaux et réglementaires COBAC (Edition 2021)' WHEN {_NAMED} IS NOT NULL THEN CASE WHEN regexp_matches(lower({_NAMED}), 'règlement|convention|instruction|décision|lc-') THEN {_NAMED} ELSE 'Règlement COBAC ' || {_BARE} END
  WHEN {_X('file_name', _F26)} IS NOT NULL THEN 'Règlement COBAC ' || {_X('file_name', _F26)} WHEN contains(lower({_CLEAN26}), 'cobac') THEN 'Document COBAC - ' || ({_CLEAN26})[1:40] ELSE 'Texte réglementaire - ' || ({_CLEAN26})[1:40] END"""
_F27 = [rf"Règlement\s+COBAC\s+R-{_Y}[^.]*", rf"Règlement\s+n°\s*{_U}COBAC[^.]*", rf"Règlement\s+n°\s*{_U}CM[^.]*", rf"Instruction\s+COBAC\s+I-{_Y}[^.]*", rf"Décision\s+COBAC\s+D-{_Y}[^.]*", r"Décision\s+n°\s*\d{2}[/-]\d{2}-FGD-CD[^.]*", r"LC-/\d{2}[^.]*", r"Convention[^.]{10,100}"]
_FIT = lambda p: f"list_filter(list_transform(ls, lambda x: trim(regexp_replace(regexp_extract(x, {quoted('(?i)' + p)}), '\\s+', ' ', 'g'))), lambda x: length(x) BETWEEN 21 AND 299)[1][1:200]"
_PLAIN = "list_filter(list_transform(ls, lambda x: trim(x)), lambda x: length(x) BETWEEN 31 AND 199 AND regexp_matches(lower(x), 'règlement|instruction|décision|relatif|portant') AND NOT regexp_matches(lower(x), 'article|chapitre|section|page'))[1][1:200]"
_MADE = r"trim(replace(replace(replace(regexp_replace(replace(replace(replace(file_name, '.pdf', ''), '_', ' '), '-', ' '), '[0-9]{4}[_-][0-9]{2}', '', 'g'), 'reglement', 'Règlement'), 'cobac', 'COBAC'), 'cemac', 'CEMAC'))"
_C27 = f"CASE WHEN contains(lower(file_name), 'cobac2021') THEN 'Recueil des textes légaux et réglementaires régissant l''activité des établissements de crédit dans l''UMAC' ELSE coalesce({', '.join(_FIT(p) for p in _F27)}, {_PLAIN}, CASE WHEN length({_MADE}) > 5 THEN ({_MADE})[1:150] END, 'Texte réglementaire COBAC') END"
_MON = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
_PUB = rf"coalesce(nullif(regexp_replace(regexp_extract(file_name, '\d{{4}}[_-]\d{{2}}'), '_', '-'), ''), {_X('txt[1:2000]', [r'\d{1,2}[/-]\d{1,2}[/-]\d{4}', r'\d{4}[/-]\d{1,2}[/-]\d{1,2}', r'\d{1,2}\s+(?:' + _MON + r')\s+\d{4}'], 0)}, 'Date à identifier')"
_EFF = rf"coalesce({_X('txt[1:2000]', [cue + r'[^0-9]*(\d{1,2}[/-]\d{1,2}[/-]\d{4})' for cue in ('entrée en vigueur', 'applicable', 'effet')])}, {_PUB})"


@query("c26_c27_c28_reference_title_dates", f"{FORMS}, l AS (SELECT doc_id, file_name, txt, string_split(txt, chr(10))[1:30] AS ls FROM forms) SELECT doc_id, {_C26} AS reference, {_C27} AS title, {_PUB} AS published, {_EFF} AS effective FROM l")
def c26(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", O.reference_of("file_name", "txt").alias("reference"), O.title_of("file_name", "txt").alias("title"), O.published_on("file_name", "txt").alias("published"), O.effective_on("file_name", "txt").alias("effective"))


_P18 = {"header": r"(?is)^(.*?(?:COMMISSION\s+BANCAIRE|COBAC|CEMAC).*?)(?:\n\s*\n|\n(?:VU|CONSIDÉRANT|DECIDE|Article))", "preamble": r"(?is)((?:\bVU\b|CONSIDÉRANT|AYANT\s+ÉGARD).*?)(?:\n\s*\n\s*DECIDE|Article\s+premier|Article\s+1)", "decide": r"(?is)(DECIDE\s*:?\s*\n.*?)(?:Article\s+(?:premier|\d+)|TITRE|CHAPITRE)", "articles": r"(?is)(Article\s+(?:premier|\d+).*?)\n\s*\n\s*(?:Fait|Le\s+Secrétaire|ANNEXE)", "signature": r"(?is)((?:\bFait\b|Le\s+Secrétaire|Le\s+Président).*)$"}
_PART = lambda p: f"trim(regexp_extract(txt, {quoted(p)}, 1), ' \n\t')"


@query("g18_document_parts", f"{FORMS} SELECT doc_id, " + ", ".join(f"CASE WHEN length({_PART(p)}) > 10 THEN md5({_PART(p)}) END AS {n}" for n, p in _P18.items()) + " FROM forms")
def g18(spark, sf):
    return forms_corpus(spark, sf).select("doc_id", *[F.md5(v).alias(k) for k, v in O.document_parts("txt").items()])


_ROM = r"(?mi)^[ \t]*([IVX]+)\.?[ \t]+(\p{L}[^\n]{20,200})"
_REG22 = "|".join([rf"Règlement\s+(?:COBAC\s+)?R-{_Y}[^\n]*", rf"Règlement\s+n°\s*{_U}(?:COBAC|CM)[^\n]*", rf"Instruction\s+(?:COBAC\s+)?I-{_Y}[^\n]*", rf"Décision\s+(?:COBAC\s+)?D-{_Y}[^\n]*", r"Décision\s+n°\s*\d{2}[/-]\d{2}-FGD-CD[^\n]*", r"Convention\s+[^\n]{10,100}", r"LC-/\d{2}[^\n]*"])
_COLL = "CASE WHEN doc_id % 3 = 0 THEN concat(txt, 'II. Des règles communes aux banques\nPremier corps.\nIV Normes de la surveillance\nSecond corps.\n') ELSE txt END"


@query("g22_regulation_split", f"""{FORMS}, c AS (SELECT doc_id, {_COLL} AS txt FROM forms), h AS ({_located_sql('c', 'doc_id', 'txt', [('roman', _ROM, ''), ('titled', '(?i)(?:' + _REG22 + ')', '')])}), o AS (SELECT *, count(*) FILTER (kind = 'roman') OVER (PARTITION BY doc_id) AS r FROM h), k AS (SELECT doc_id, kind, m, pos, t FROM o WHERE kind = 'roman' OR r = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS seq, lead(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS nx, trim(regexp_replace(m, '\\s+', ' ', 'g')) AS x FROM k)
SELECT doc_id, seq::INT AS seq, CASE kind WHEN 'roman' THEN regexp_replace(x, '(?i)^([IVX]+)\\.? ', '\\1. ') ELSE x END AS title, md5(trim(substring(t, pos + 1, coalesce(nx, length(t)) - pos), ' \n\t')) AS body_hash FROM n UNION ALL SELECT doc_id, 0, 'Document réglementaire', md5(trim(txt, ' \n\t')) FROM c WHERE doc_id NOT IN (SELECT doc_id FROM k)""")
def g22(spark, sf):
    texts = forms_corpus(spark, sf).select("doc_id", F.expr(_COLL).alias("txt"))
    return O.regulations_of(texts).select("doc_id", "seq", "title", F.md5("body").alias("body_hash"))


_IND = [r"^\s*\|", r"^\s*[-–—]{3,}", r"^\s*\d+\s*[.)\-]\s*[^\n]+\s+\d+", r"^(?:Tableau|Table)\s*\d*\s*:"]
_TAB = " UNION ALL ".join(f"SELECT doc_id, {i} AS indicator, ls, list_position(list_transform(ls, lambda x: regexp_matches(x, {quoted(p)})), true) AS a FROM t" for i, p in enumerate(_IND))
_SRC26 = "CASE WHEN doc_id % 5 = 0 THEN concat(txt, '\nTableau 3 : seuils\n---- \n1) fonds 10\n2) ratio 20\n') ELSE txt END"


@query("g26_c42_k8_text_tables", f"""{FORMS}, t AS (SELECT doc_id, string_split({_SRC26}, chr(10)) AS ls FROM forms), f AS ({_TAB}), r AS (SELECT doc_id, indicator, ls[a:] AS rest FROM f WHERE a IS NOT NULL AND a > 0), b AS (SELECT doc_id, indicator, CASE WHEN coalesce(list_position(list_transform(rest, lambda x: trim(x) = ''), true), 0) > 0 THEN rest[1:list_position(list_transform(rest, lambda x: trim(x) = ''), true) - 1] ELSE rest END AS b FROM r),
c AS (SELECT doc_id, indicator, len(b)::INT AS n_lines, array_to_string(b, chr(10)) AS content FROM b WHERE len(b) > 2) SELECT doc_id, indicator::INT AS indicator, n_lines, md5(content) AS content_hash, CASE WHEN regexp_matches(lower(content), 'capital|fonds\\s+propres|ratio') THEN 'capital_requirements_tables' WHEN regexp_matches(lower(content), 'sanctions|pénalités|amendes') THEN 'penalties_tables' WHEN regexp_matches(lower(content), 'seuils|limites|plafonds') THEN 'thresholds_tables' WHEN regexp_matches(lower(content), 'taux|pourcentage|%') THEN 'rates_tables' WHEN regexp_matches(lower(content), 'délais|échéances|dates\\s+limites') THEN 'deadlines_tables' ELSE 'other_tables' END AS category FROM c""")
def g26(spark, sf):
    from lexmill.functions.rules import table_category

    t = O.text_tables(forms_corpus(spark, sf).select("doc_id", F.expr(_SRC26).alias("txt")))
    return t.select("doc_id", "indicator", "n_lines", F.md5("content").alias("content_hash"), table_category("content").alias("category"))


_OB = [r"(?:doit|doivent|est tenu|sont tenus)\s+(?:de\s+)?[^.]+", r"(?:obligation|obligatoire)\s+(?:de\s+)?[^.]+", r"il est (?:interdit|prohibé)\s+(?:de\s+)?[^.]+"]
_OBTEXT = "concat(body, ' Il est interdit de prêter sans garantie. Les banques doivent tenir des comptes clairs. Cette obligation de forme vaut partout. Il doit payer.')"


@query("g27_obligation_forms", f"{_ARTS}, e AS (SELECT doc_id, number, " + "list_concat(" * 2 + ", ".join(f"regexp_extract_all({_OBTEXT}, {quoted('(?i)' + p)})" + (")" if i else "") for i, p in enumerate(_OB)) + f" AS ms FROM arts), u AS (SELECT doc_id, number, generate_subscripts(ms, 1) AS i, trim(unnest(ms)) AS m FROM e) SELECT doc_id, 'Art. ' || number || ': ' || m AS obligation FROM u WHERE length(m) > 20 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY number, i) <= 15")
def g27(spark, sf):
    from pyspark.sql import Window

    body = F.expr(_OBTEXT)
    a = O.article_forms(forms_corpus(spark, sf)).select("doc_id", "number", body.alias("x"))
    found = F.concat(*[F.regexp_extract_all("x", F.lit("(?iu)" + p), F.lit(0)) for p in _OB])
    e = a.select("doc_id", "number", F.posexplode(found).alias("i", "m")).withColumn("m", F.trim("m")).where(F.length("m") > 20)
    w = Window.partitionBy("doc_id").orderBy("number", "i")
    return e.withColumn("rn", F.row_number().over(w)).where("rn <= 15").select("doc_id", F.concat(F.lit("Art. "), "number", F.lit(": "), "m").alias("obligation"))


_PAIRS = [("modification", "conformity"), ("exception", "conformity"), ("modification", "application")]


@query("j8_j13_conflicts_of_forms", _xref_sql(_FR).replace("SELECT doc_id, source, 'Article ' || replace(unnest(ns), ',', '.') AS target, kind, text, context FROM n", f", r AS (SELECT doc_id, 'Article ' || source AS source, 'Article ' || replace(unnest(ns), ',', '.') AS target, kind FROM n), g AS (SELECT doc_id, target, list_sort(list(DISTINCT kind)) AS kinds FROM r GROUP BY ALL), b AS (SELECT DISTINCT a.doc_id, a.source, a.target FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.source = b.target AND a.target = b.source AND a.source <> a.target) SELECT r.doc_id, r.source, r.target, r.kind, b.source IS NOT NULL AS both_ways, (" + " OR ".join(f"list_contains(kinds, '{a}') AND list_contains(kinds, '{b}')" for a, b in _PAIRS) + ") AS conflict FROM r JOIN g USING (doc_id, target) LEFT JOIN b USING (doc_id, source, target)").replace("ns FROM x)\n, r AS", "ns FROM x), r AS"))
def j13(spark, sf):
    from pyspark.sql import Window

    r = O.cross_references(O.article_forms(forms_corpus(spark, sf))).where("doc_id is not null").select("doc_id", F.concat(F.lit("Article "), "source").alias("source"), "target", "kind")
    cited, ends = Window.partitionBy("doc_id", "target"), Window.partitionBy("doc_id", F.least("source", "target"), F.greatest("source", "target"))
    has = {k: F.bool_or(F.col("kind") == k).over(cited) for k in sorted({k for p in _PAIRS for k in p})}
    clash = None
    for a, b in _PAIRS:
        clash = has[a] & has[b] if clash is None else clash | (has[a] & has[b])
    up = F.col("source") < F.col("target")
    both = (F.col("source") != F.col("target")) & F.bool_or(up).over(ends) & F.bool_or(~up).over(ends)
    return r.select("doc_id", "source", "target", "kind", clash.alias("conflict")).select("doc_id", "source", "target", "kind", both.alias("both_ways"), "conflict")
