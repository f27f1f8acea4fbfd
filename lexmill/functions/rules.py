"""Ordered rewriting rules, category ladders, checklists and maps of regulation processing, as data with the expressions that apply them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexmill.functions.text import any_of, col

# --- rewriting: (pattern, replacement); Java syntax, (?iu) where case doesn't count
_ONES = [(r"\bl\b", "1"), (r"\bO\b", "0"), (r"([0-9]),([0-9])", "$1.$2")]
BASIC_OCR = [*_ONES, (r"\s+", " "), (r"([.?!])([A-Z])", "$1 $2"), (r"AIT\.", "ART."), ("Aiticle", "Article"), ("aiticle", "article")]
CHARACTERS = [*_ONES, (r"AIT\.", "ART."), ("Aiticle", "Article"), ("aiticle", "article"), ("ARIICLE", "ARTICLE"), ("ariicle", "article")]
_PHRASES = ["Commission Bancaire", "établissement de crédit", "fonds propres", "ratio de solvabilité", "liquidité", "provisions", "créances", "immobilisations", "surveillance", "contrôle", "inspection", "sanction", "astreinte", "pénalité"]
TERMINOLOGY = [("(?iu)" + p.replace(" ", r"\s+"), p) for p in _PHRASES]
STRUCTURAL = [(rf"{word}\s+({what})", f"{word} $1") for word, what in (("Article", "[0-9]+"), ("ARTICLE", "[0-9]+"))] + [(r"Art\.\s*([0-9]+)", "Art. $1")]
STRUCTURAL += [(rf"{word}\s+([XVI]+)", f"{word} $1") for word in ("TITRE", "CHAPITRE", "SECTION")] + [(r"([0-9]+)\s*-\s*", "$1. "), (r"([a-z])\)\s*", "$1) ")]
_ROMAN = r"\s+([XVI]+)\s*[:.]?\s*([A-Z])"
CONTEXTUAL = [
    (r"Article\s+([0-9]+)\s*[:.]?\s*([A-Z])", "Article $1. $2"), ("TITRE" + _ROMAN, "TITRE $1 - $2"), ("CHAPITRE" + _ROMAN, "CHAPITRE $1 - $2"),
    *((rf"{who}\s+([DIR][\s-]*[0-9]+[\s-]*[0-9]+)", f"{who} $1") for who in ("COBAC", "CEMAC")),
    (r"([0-9]{1,2})\s*[-/.]\s*([0-9]{1,2})\s*[-/.]\s*([0-9]{4})", "$1/$2/$3"), (r"([0-9]+)\s*%", "$1%"), (r"([0-9]+)\s*(FCFA|USD|EUR)", "$1 $2"),
]
REGULATOR = [(r"\b0\b", "O"), (r"\bl\b", "I"), (r"rn\b", "ni"), (r"\bm\b", "ni")] + [
    (a, b) for a, b in (x.split(">") for x in "C0BAC>COBAC CQBAC>COBAC CEMAO>CEMAC CEMAG>CEMAC banqu0>banque créd1t>crédit débit0ur>débiteur crédit0ur>créditeur établissem0nt>établissement articl0>article alln0a>alinéa paragrap0e>paragraphe chap1tre>chapitre t1tre>titre 0/00>‰ 0/0>%".split())
]
STRUCTURE_REPAIR = [
    (r"(?iu)Artlcle\s+([0-9]+)", "Article $1"), (r"(?iu)Art[li]cle\s+([0-9]+)", "Article $1"), *((rf"(?iu){p}\s+([XVI0-9]+)", f"{w} $1") for p, w in (("SECT[1I]ON", "SECTION"), ("CHAP[TI]TRE", "CHAPITRE"), ("T[TI]TRE", "TITRE"))),
    (r"([.?!])\s*([A-Z][a-z])", "$1\n\n$2"), (r"\s+([.,:;?!])", "$1"), (r"([.,:;?!])([a-zA-Z])", "$1 $2"),
]
ARTICLE_TEXT = [("Arlicle|Artide|Artiele", "Article"), (r"\s*\n\s*", "\n"), (r"[\t ]+", " "), (r"([\p{L}\p{N}_]+)-\s*\n\s*([\p{L}\p{N}_]+)", "$1$2")]
ARTICLE_CONTENT = [(r"\n{3,}", "\n\n"), (" {2,}", " "), (r"([0-9]+)\s*°\s*", "$1° "), (r"([a-z])\s*\)\s*", "$1) "), (r"([.,:;?!])([A-Z])", "$1 $2")]


def rewrite(c: Column | str, rules: list[tuple[str, str]]) -> Column:
    """The rules in order."""
    return reduce(lambda x, r: F.regexp_replace(x, *r), rules, col(c))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def ignoring_case(rules: list[tuple[str, str]]) -> list[tuple[str, str]]:
    return [("(?iu)" + p, r) for p, r in rules]


def basic_ocr(c: Column | str) -> Column:
    """A fix-up of scanned text, then runs of blank lines to one."""
    return strip(F.regexp_replace(rewrite(c, BASIC_OCR), r"\n\s*\n\s*\n", "\n\n"))


def staged_ocr(c: Column | str) -> Column:
    """Characters, terminology, structure, white space and context, in this order."""
    return rewrite(strip(F.regexp_replace(rewrite(c, CHARACTERS + TERMINOLOGY + STRUCTURAL), r"\s+", " ")), CONTEXTUAL)


def regulator_ocr(c: Column | str) -> Column:
    return rewrite(c, ignoring_case(REGULATOR))


def repair_structure(c: Column | str) -> Column:
    return rewrite(c, STRUCTURE_REPAIR)


def n_corrections(before: Column | str, after: Column | str) -> Column:
    """Over the regulator's rules, how many matches are gone; none where the texts are equal."""
    gone = [F.greatest(F.lit(0), F.regexp_count(col(before), F.lit("(?iu)" + p)) - F.regexp_count(col(after), F.lit("(?iu)" + p))) for p, _ in REGULATOR]
    return F.when(col(before) == col(after), 0).otherwise(reduce(lambda a, b: a + b, gone))


def article_text(c: Column | str) -> Column:
    """An article's text before it is searched: misread headers, line ends, blanks, hyphens at line ends."""
    return rewrite(c, ARTICLE_TEXT)


def article_content(c: Column | str) -> Column:
    """An article's content as it is reported."""
    return F.trim(rewrite(c, ARTICLE_CONTENT), F.lit(" \n\t"))


_SUFFIX = "lower(regexp_extract({}, '(?i)(bis|ter|quater)', 1))"


def sort_keys(c: Column | str) -> tuple[Column, Column, Column]:
    """The three keys by which articles are sorted: (main, sub, suffix), (main, sub, original) and (main, sub, letter, suffix); 9999 first where there's no number."""
    x = F.trim(F.regexp_replace(col(c), r"(?i)^\s*(?:article|art\.?)\s*", ""))
    part = lambda p, g=1: F.nullif(F.regexp_extract(x, p, g), F.lit(""))
    zero = lambda y: F.coalesce(y.cast("int"), F.lit(0))
    main = part(r"^(\d+)").cast("int")
    rank = lambda s: F.coalesce(F.array_position(F.array(*map(F.lit, ("bis", "ter", "quater"))), F.lower(s)).cast("int"), F.lit(0))
    none = main.isNull()
    key = lambda **k: F.struct(*[F.when(none, 9999 if i == 0 else 0).otherwise(v).alias(n) for i, (n, v) in enumerate(k.items())])
    first = key(main=main, sub=zero(part(r"^\d+[.-](\d+)")), suffix=rank(part(r"(?i)^\d+(?:[.-]\d+)?\s*(bis|ter|quater)")))
    second = key(main=main, sub=F.coalesce(part(r"^\d+\s*[.-](\d+)").cast("int"), rank(part(r"(?i)^\d+\s*(bis|ter|quater)"))))
    letter = part(r"(?i)^\d+(?:\.\d+)?\s*([a-z])")
    third = key(main=main, sub=zero(part(r"^\d+\.(\d+)")), letter=F.coalesce(F.ascii(F.lower(letter)) - 97, F.lit(0)), suffix=rank(part(r"(?i)^\d+(?:\.\d+)?\s*[a-z]?\s*(bis|ter|quater)")))
    return first, second, third


# --- errors
CATEGORY_WORDS = [("DOCUMENT_PROCESSING", "pdf extract document file"), ("VALIDATION", "validation invalid format"), ("EXPORT", "export excel save write"), ("NETWORK", "network connection timeout api"), ("AUTHENTICATION", "authentication unauthorized")]
ADVICE = {
    "DOCUMENT_PROCESSING": "check that the document is readable or extract it by another method", "VALIDATION": "check the key and the connection of the validator", "EXPORT": "check that the folder exists, may be written and holds no open workbook",
    "NETWORK": "check the connection and try again", "AUTHENTICATION": "check that the key is right and not expired", "CONFIGURATION": "review the settings",
}
_MEDIUM = ("ConnectionError", "TimeoutError", "UnicodeDecodeError", "AttributeError", "TypeError")
SEVERITIES = {"MemoryError": "CRITICAL", **dict.fromkeys(("FileNotFoundError", "PermissionError"), "HIGH"), **dict.fromkeys(_MEDIUM, "MEDIUM"), **dict.fromkeys(("JSONDecodeError", "KeyError", "ValueError"), "LOW")}
STRATEGIES = {**dict.fromkeys(("FileNotFoundError", "PermissionError", "JSONDecodeError", "UnicodeDecodeError", "AttributeError", "KeyError", "ValueError"), "FALLBACK"), "MemoryError": "FAIL"}


def ladder(c: Column | str, steps: list[tuple[str, list[str]]], rest: str | None) -> Column:
    """The label of the first step of which the lower-cased text contains a term."""
    out = F.lit(rest)
    for label, terms in reversed(steps):
        out = F.when(any_of(c, terms), label).otherwise(out)
    return out


def error_category(message: Column | str) -> Column:
    return ladder(message, [(k, v.split()) for k, v in CATEGORY_WORDS], "SYSTEM")


def lookup(c: Column | str, table: dict[str, str], rest: str) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[col(c)], F.lit(rest))


# --- categories
CATEGORY_NAMES = {
    "I": "ORGANISATION ET FONCTIONNEMENT De LA COBAC", "II": "REGLEMENTATION GENERALE", "III": "AGREMENT ET EXERCICE DE LA PROFESSION", "IV": "REGLEMENTATION COMPTABLE", "V": "SYSTEMES ET MOYENS DE PAIEMENT",
    "VI": "NORMES PRUDENTIELLES", "VII": "CONTROLE DES ETABLISSEMENTS DE CREDIT", "VIII": "SUPERVISION DES GROUPES BANCAIRES", "IX": "PROTECTION DES CONSOMMATEURS",
}
NUMERALS = ["XI", "X", "IX", "VIII", "VII", "VI", "V", "IV", "III", "II", "I"]
_ACCOUNTS, _CONTROL, _PAYMENT = ["comptable", "bilan", "compte de résultat"], ["contrôle interne", "gestion des risques", "audit"], ["paiement", "chèque", "virement", "carte bancaire"]
_RATIOS = ["ratio", "fonds propres", "capital", "solvabilité"]
_BY_CONTENT = [("IV", _ACCOUNTS), ("VII", _CONTROL), ("V", _PAYMENT), ("III", ["agrément", "autorisation", "licence bancaire"]), ("IX", ["protection", "consommateur", "client", "réclamation"]), ("VIII", ["groupe bancaire", "holding", "consolidation"]), ("I", ["organisation", "fonctionnement", "cobac"])]
CONTENT_LADDER = [("VI", [*_RATIOS, "prudentiel"]), *_BY_CONTENT]
DOCUMENT_LADDER = [("VI", _RATIOS), *_BY_CONTENT]
COLLECTION_LADDER = [("VI", [*_RATIOS, "prudentiel"]), ("IV", _ACCOUNTS), ("VII", _CONTROL), ("V", _PAYMENT)]
FILE_LADDER = [(k, v.split()) for k, v in (("IV", "comptable r-98 r-93"), ("V", "paiement systeme moyen"), ("VI", "prudentiel ratio fonds_propres capital r-2016"), ("VII", "controle interne risque supervision r-2008"), ("VIII", "groupe bancaire holding"), ("IX", "protection consommateur client r-2019"), ("III", "agrement exercice profession r-2001"), ("I", "organisation fonctionnement cobac"))]
RELAXED = [("VI", ["ratio", "fonds propres", "capital"]), ("IV", ["comptable", "compte"]), ("VII", ["contrôle", "risque"]), ("V", ["paiement", "virement"]), ("III", ["agrément"]), ("IX", ["client", "protection"]), ("VIII", ["groupe"]), ("I", ["cobac"])]


def numeral_category(title: Column | str, summary: Column | str, rest: Column) -> Column:
    """The category whose numeral or number stands by itself before a blank or a stop in the upper-cased title and summary, tested from XI to I; else rest."""
    text = F.upper(F.concat(col(title), F.lit(" "), col(summary)))
    out = rest
    for i, name in enumerate(reversed(NUMERALS), 1):
        out = F.when(text.rlike(rf"\b({name}|{i})\b[\s.]"), name).otherwise(out)
    return out


def document_category(file_name: Column | str, text: Column | str, partial: Column) -> Column:
    """By the file name and then the text; a selection of pages goes by the file name, then by the most terms of a short list, else II."""
    counts = [F.lit(0) + reduce(lambda a, b: a + b, [F.lower(col(text)).contains(t).cast("int") for t in terms]) for _, terms in RELAXED]
    most = F.greatest(*counts)
    relaxed = F.lit("II")
    for (name, _), n in reversed(list(zip(RELAXED, counts, strict=True))):
        relaxed = F.when((n == most) & (most > 0), name).otherwise(relaxed)
    by_file = ladder(file_name, FILE_LADDER, None)
    whole = F.when(any_of(file_name, ["cobac2021", "recueil", "compilation"]), ladder(text, COLLECTION_LADDER, "VI")).otherwise(F.coalesce(by_file, ladder(text, DOCUMENT_LADDER, "VI")))
    return F.when(partial, F.coalesce(by_file, relaxed)).otherwise(whole)


VARIANTS = {
    "I": "ORGANISATION ET FONCTIONNEMENT DE LA COBAC|ORGANISATION FONCTIONNEMENT COBAC|COMMISSION BANCAIRE AFRIQUE CENTRALE|COMMISSION BANCAIRE ORGANISATION",
    "II": "CONDITIONS D'EXERCICE DE LA PROFESSION BANCAIRE|CONDITIONS EXERCICE PROFESSION|PROFESSION BANCAIRE|EXERCICE ACTIVITES BANCAIRES",
    "III": "ORGANISATION ET GOUVERNANCE|AGREMENT ET EXERCICE DE LA PROFESSION|GOUVERNANCE ETABLISSEMENTS|GOUVERNANCE",
    "IV": "REGLEMENTATION COMPTABLE|COMPTABILITE DES ETABLISSEMENTS|PLAN COMPTABLE|COMPTABILITE ETABLISSEMENTS",
    "V": "SYSTEMES ET MOYENS DE PAIEMENT|MOYENS DE PAIEMENT|SYSTEMES PAIEMENT|PAIEMENTS",
    "VI": "NORMES PRUDENTIELLES|PRUDENTIELLES|RATIOS PRUDENTIELS|RATIOS ET NORMES PRUDENTIELLES",
    "VII": "CONTROLE DES ETABLISSEMENTS DE CREDIT|CONTROLE ETABLISSEMENTS|CONTROLE INTERNE|SURVEILLANCE ET CONTROLE",
    "VIII": "SUPERVISION DES GROUPES BANCAIRES|GROUPES BANCAIRES|SUPERVISION GROUPES|CONSOLIDATION",
    "IX": "PROTECTION DES CONSOMMATEURS|PROTECTION CONSOMMATEURS|RELATIONS CLIENTELE|PROTECTION ET RELATIONS CLIENTELE",
    "X": "TRAITEMENT DES ETABLISSEMENTS DE CREDIT EN DIFFICULTE|ETABLISSEMENTS EN DIFFICULTE|TRAITEMENT DIFFICULTE|LIQUIDATION",
    "XI": "MARCHE MONETAIRE|TITRES PUBLICS|OPERATIONS REFINANCEMENT",
}
HEADERS = {
    "I": "ORGANISATION ET FONCTIONNEMENT DE LA COBAC", "II": "CONDITIONS?.*EXERCICE.*PROFESSION", "III": "ORGANISATION ET GOUVERNANCE", "IV": "REGLEMENTATION COMPTABLE", "V": "SYSTEMES ET MOYENS DE PAIEMENT", "VI": "NORMES PRUDENTIELLES",
    "VII": "CONTR[OÔ]LE.*ETABLISSEMENTS", "VIII": "SUPERVISION.*GROUPES", "IX": "PROTECTION.*CONSOMMATEURS", "X": "TRAITEMENT.*DIFFICULTE?", "XI": "MARCHE? MONETAIRE",
}


def header_pattern(numeral: str) -> str:
    """An explicit header of a category: its numeral, the last letter of it perhaps repeated, and a stop; or blank, dash or stop. Its name is group 1."""
    return rf"(?:{numeral}+\.|{numeral}\s+[.-]\s*)({HEADERS[numeral]})"


def display_name(text: Column | str, category: Column | str) -> Column:
    """The category's name in an upper-cased text: an explicit header, else the variant of its category that scores best at 0.3 and more, else the fixed name.

    A variant scores the share of its words of more than two letters that the text contains, 0.5 more for the whole phrase, and 0.05 for each word; of equal scores the longer one stays.
    """
    x = F.upper(col(text))
    headers = F.coalesce(*[F.nullif(F.trim(F.regexp_extract(x, "(?iu)" + header_pattern(n), 1)), F.lit("")) for n in HEADERS])
    rows = sorted(((n, v) for n, vs in VARIANTS.items() for v in vs.split("|")), key=lambda r: -len(r[1]))
    table = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(v).alias("v"), F.array(*[F.lit(w) for w in v.split() if len(w) > 2]).alias("w"), F.lit(len(v.split())).alias("k")) for n, v in rows])

    def score(r):
        share = F.size(F.filter(r["w"], lambda w: x.contains(w))) / F.size(r["w"])
        return F.round(share + F.when(x.contains(r["v"]), 0.5).otherwise(0.0) + r["k"] * 0.05, 9)

    own = F.transform(F.filter(table, lambda r: r["n"] == col(category)), lambda r: F.struct(score(r).alias("s"), F.length(r["v"]).alias("l"), r["v"].alias("v")))
    best = F.array_max(F.filter(own, lambda r: r["s"] >= 0.3))
    return F.coalesce(headers, best["v"], lookup(category, CATEGORY_NAMES, ""), F.lit(""))


_SUB = {
    "II": [("II.1. Accès à la profession bancaire", "agrément|installation|unique"), ("II.2. Conditions d'exercice", "conditions|exercice|catégories|capital")],
    "IV": [("IV.1. Etablissement et publication des comptes", "plan comptable|comptes|publication"), ("IV.2. Reporting des états réglementaires", "reporting|états|cerber"), ("IV.3. Comptabilisation de certaines opérations", "comptabilisation|créances|titres")],
    "V": [("V.1. Régime général", "systèmes|moyens|incidents"), ("V.2. Services de paiement", "services de paiement|prestataires"), ("V.3. Transferts extérieurs et change", "change|transferts|devises")],
    "VI": [("VI.1. Ratios assis sur les fonds propres", "fonds propres|capital|participation|immobilisation"), ("VI.2. Autres ratios prudentiels", "liquidité|transformation|portefeuille")],
    "VII": [("VII.1. Contrôle interne et gestion des risques", "contrôle interne|continuité|risques"), ("VII.2. Lutte contre le blanchiment de capitaux et le financement du terrorisme", "blanchiment|terrorisme|lcb"), ("VII.3. Contrôle externe", "commissaires aux comptes|contrôle externe")],
    "IX": [("IX.1. Relations avec la clientèle", "clientèle|relations|taux|usure"), ("IX.2. Garantie des dépôts", "garantie|dépôts")],
}
SUB_BY_TITLE = [(k, name, terms.split("|")) for k, rows in _SUB.items() for name, terms in rows]
SUB_BY_CODE = {
    "II": {"Accès à la profession": "01/00/CEMAC|agrément unique", "Conditions d'exercice": "02/08/CEMAC|02/15/CEMAC|R-2009/01|R-2009/02|R-2016/01|R-2016/02"},
    "IV": {"IV.1. Etablissement et publication des comptes": "R-98/01|R-99/01|R-2003/01", "IV.2. Reporting des états réglementaires": "I-99/03|I-2008/01|CERBER", "IV.3. Comptabilisation de certaines opérations": "R-98/02|R-2003/03|R-2003/04|R-2018/01"},
    "V": {"V.1. Régime général": "03/16/CEMAC", "V.2. Services de paiement": "04/18/CEMAC|R-2019/01|R-2019/02", "V.3. Transferts extérieurs et change": "02/18/CEMAC"},
    "VI": {"VI.1. Ratios assis sur les fonds propres": "R-93/05|R-93/10|R-93/11|R-93/13|R-2016/03", "VI.2. Autres ratios prudentiels": "R-93/06|R-93/07|R-94/01|R-96/01"},
    "VII": {"VII.1. Contrôle interne et gestion des risques": "R-2008/01|R-2016/04", "VII.2. Lutte contre le blanchiment": "01/16/CEMAC|R-2005/01", "VII.3. Contrôle externe": "04/03/CEMAC"},
    "IX": {"IX.1. Relations avec la clientèle": "04/19/CEMAC|01/20/CEMAC|R-2020/05|R-2020/06", "IX.2. Garantie des dépôts": "01/09/CEMAC|R-2009/03"},
}
SUB_DEFAULT = {
    "I": "I-1_Regime general", "II": "II-1_Dispositions générales", "III": "III-1_Conditions d'agrément", "IV": "IV.1. Etablissement et publication des comptes", "V": "V-1_Regime general", "VI": "VI. 1. Ratios assis sur les fonds propres",
    "VII": "VII.1. Contrôle interne et gestion des risques", "VIII": "VIII_ SUPERVISION DES GROUPES BANCAIRES", "IX": "IX-1-RELATIONS AVEC LA CLIENTELE",
}


def sub_category(title: Column | str, category: Column | str) -> Column:
    """By words of the title, in a fixed order; else the category's default."""
    out = lookup(category, SUB_DEFAULT, "")
    for k, name, terms in reversed(SUB_BY_TITLE):
        out = F.when((col(category) == k) & any_of(title, terms), name).otherwise(out)
    return out


def sub_category_by_code(title: Column | str, reference: Column | str, category: Column | str) -> Column:
    """By the codes that the title or the reference contains, else the category's default."""
    out = lookup(category, SUB_DEFAULT, "")
    for k, rows in reversed(SUB_BY_CODE.items()):
        for name, codes in reversed(rows.items()):
            has = reduce(lambda a, b: a | b, [col(c).contains(x) for c in (title, reference) for x in codes.split("|")])
            out = F.when((col(category) == k) & has, name).otherwise(out)
    return out


def _keys() -> list[tuple[str, str]]:
    """The known regulations and their categories, in order: codes of one issuer are written together."""
    r, d, umac = "Règlement COBAC R-", "Décision COBAC D-", "/CEMAC/UMAC/COBAC"
    rows = [
        ("I", ["Convention portant création d'une Commission Bancaire", "Convention portant harmonisation de la réglementation bancaire", "Règlement N° 02/09" + umac, *(r + x for x in "93/12 2020/03".split()), *(d + x for x in "92/01 93/08 2010/004 2011/177".split())]),
        ("II", [*(f"Règlement N° {x}{umac}" for x in "01/00 02/08 02/15".split()), *(r + x for x in "2009/01 2009/02 2016/01 2016/02".split()), *("Instruction COBAC I-" + x for x in "2016/02 2016/03".split()), "LC-COB/44"]),
        ("III", ["Règlement N° 04/08" + umac, *"LC/COB/26 LC/131 LC-COB/04 LC/20 LC-COB/02 LC-COB/12/DREGRI/DRNM/TPO".split()]),
        ("IV", ["Règlement n° 03/03" + umac, *(r + x for x in "98/01 99/01 2003/01 98/02 2003/03 2003/04 2010/03 2013/03 2018/01".split())]),
        ("V", ["Règlement N°03/16/CEMAC/UMAC/CM", "Instruction n° 01/GR/2014", "Règlement n° 04/18/CEMAC/ UMAC/COBAC", *(r + x for x in "2019/01 2019/02".split()), "Règlement n°02/18/CEMAC/ UMAC/CM"]),
        ("VI", [r + x for x in "93/05 93/10 93/11 93/13 2001/04 2001/05 2001/06 2003/02 2010/01 2010/02 2013/02 2016/03 2020/01 93/06 93/07 94/01 96/01 2013/04".split()]),
        ("VII", [*(r + x for x in "2008/01 2016/04".split()), "Règlement CEMAC N°01/16/CEMAC/UMAC /CM", r + "2005/01", "Règlement n° 04/03" + umac]),
        ("VIII", ["Règlement N° 01/15" + umac]),
        ("IX", ["Règlement n° 04/19/CEMAC/UMAC/CM", "Règlement n° 01/20" + umac, *(r + x for x in "2020/06 2020/05".split()), "Règlement N° 01/09" + umac, r + "2009/03"]),
    ]
    return [(k, c) for c, keys in rows for k in keys]


PREDEFINED = _keys()


def predefined_category(title: Column | str, reference: Column | str) -> Column:
    """The category of the first known regulation that the title or the reference contains; else of the first whose first three words they contain; else null."""
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(" ".join(k.split()[:3])).alias("h"), F.lit(c).alias("c")) for k, c in PREDEFINED])
    inside = lambda k: F.trim(col(title)).contains(k) | F.trim(col(reference)).contains(k)
    first = lambda f: F.get(F.filter(table, lambda r: inside(r[f])), F.lit(0))["c"]
    return F.coalesce(first("k"), first("h"))


# --- entries
PLACEHOLDERS = ["à analyser", "à identifier", "à évaluer", "à compléter", "non disponible", "non spécifié"]
WEIGHTS = {"title": 10, "summary": 20, "obligations": 20, "article_references": 15, "sanctions": 15, "impact": 10, "publication_date": 5, "effective_date": 5}
DEFAULTS = {
    "title": "Titre non disponible", "summary": "Résumé non disponible", "obligations": "Obligations non identifiées", "article_references": "Articles non spécifiés", "sanctions": "Sanctions non spécifiées", "impact": "Impact non évalué",
    "publication_date": "Date non disponible", "effective_date": "Date non disponible",
}


def entry_quality() -> Column:
    """0 to 100 for a row of the fields in WEIGHTS: the weight of each field of more than 10 characters that is no placeholder, and 5 more for detail."""
    detail = {
        "summary": F.length("summary") > 100, "obligations": F.col("obligations").rlike("[;\n]"), "article_references": F.col("article_references").rlike("[0-9]"),
        "sanctions": any_of("sanctions", ["fcfa", "amende", "emprisonnement"]), "impact": F.col("impact").isin("Très élevé", "Élevé", "Moyen", "Faible"),
    }
    total = F.lit(0)
    for field, weight in WEIGHTS.items():
        good = (F.length(field) > 10) & ~any_of(field, PLACEHOLDERS)
        total = total + F.when(good, F.lit(weight) + (F.when(detail[field], 5).otherwise(0) if field in detail else 0)).otherwise(0)
    return F.least(F.lit(100), total)


def filled(field: str) -> Column:
    """A field of a model's answer, or its default where it is missing, short or a word for nothing; the impact is one of four labels."""
    value = F.trim(F.coalesce(F.col(field), F.lit("")))
    out = F.when((F.length(value) > 5) & ~F.lower(value).isin("none", "null", "n/a", "..."), value).otherwise(DEFAULTS[field])
    if field != "impact":
        return out
    has = lambda *t: any_of(out, list(t))
    return F.when(has("très élevé", "tres eleve"), "Très élevé").when(has("élevé", "eleve"), "Élevé").when(has("faible"), "Faible").otherwise("Moyen")


# --- scans and answers
OCR_KEYWORDS = "commission bancaire cobac cemac règlement instruction décision article chapitre section établissement crédit banque fonds propres ratio solvabilité liquidité provisions surveillance contrôle sanction".split()
OCR_POINTS = {"articles": 10, "structure": 8, "terms": 6, "formatting": 4}


def ocr_quality(c: Column | str, confidence: Column) -> Column:
    """0.4 confidence + 0.3 share of keywords + 0.3 points of 30: for articles, structure, terms and formatting."""
    from lexmill.functions.text import hits

    low, found = F.lower(col(c)), hits(c, OCR_KEYWORDS)
    points = F.when(low.rlike(r"article\s+[0-9]+"), 10).otherwise(0) + F.when(low.rlike("titre|chapitre|section"), 8).otherwise(0) + F.when(found > 0, 6).otherwise(0) + F.when(col(c).rlike("[0-9]+[°.]"), 4).otherwise(0)
    return 0.4 * confidence + 0.3 * (found / len(OCR_KEYWORDS)) + 0.3 * (points / 30.0)


def ocr_advice(quality: Column) -> Column:
    lists = [
        (0.5, ["scan at a higher resolution", "preprocess the images", "try another engine", "review by hand"]), (0.7, ["tune the engine", "correct the text afterwards", "verify key terms"]), (0.8, ["correct small errors", "validate article numbers"]),
    ]
    out = F.array(F.lit("quality is acceptable"))
    for bound, items in reversed(lists):
        out = F.when(quality < bound, F.array(*map(F.lit, items))).otherwise(out)
    return out


ANSWER_KEYS = {"articles": {"articles": 0.3, "document_info": 0.2, "structure_hierarchique": 0.2, "statistiques": 0.1}, "materiality": {"evaluation": 0.3, "niveau_materialite": 0.2, "justification": 0.2, "actions_requises": 0.1}}


def answer_score(answer: Column | str, kind: str) -> Column:
    """The summed weights of the keys that a JSON answer has; articles must not be empty. Null where it isn't JSON."""
    x = F.try_parse_json(col(answer))
    out = F.lit(0.0)
    for key, weight in ANSWER_KEYS[kind].items():
        path = "$.articles[0]" if key == "articles" else f"$.{key}"
        out = out + F.when(F.try_variant_get(x, path, "variant").isNotNull(), weight).otherwise(0.0)
    return F.when(x.isNull(), None).otherwise(F.round(out, 6))


TABLE_CLASSES = [("capital_requirements", r"capital|fonds\s+propres|ratio"), ("penalties", "sanctions|pénalités|amendes"), ("thresholds", "seuils|limites|plafonds"), ("rates", "taux|pourcentage|%"), ("deadlines", r"délais|échéances|dates\s+limites")]


def table_category(c: Column | str) -> Column:
    """The class of the first pattern that a table's lower-cased text matches."""
    out = F.lit("other_tables")
    for name, pattern in reversed(TABLE_CLASSES):
        out = F.when(F.lower(col(c)).rlike(pattern), f"{name}_tables").otherwise(out)
    return out


# --- checklist
CHECKLIST = {
    "Document Structure": ["sequential numbers", "consistent hierarchy", "cross-references", "complete sections"], "Content Quality": ["technical terms", "regulatory language", "dates and numbers", "legal formatting"],
    "Materiality Assessment": ["justified levels", "business impact", "regulatory priority", "clear requirements"], "Output Quality": ["workbook format", "data structure", "complete information", "clear presentation"],
}
