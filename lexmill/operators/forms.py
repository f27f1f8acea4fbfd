"""Articles in every form of header, citations, references and fields of a regulation, each found in one pass over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.functions.text import col, let

_NUM = r"[0-9]+(?:[,.][0-9]+)?"
_ORDINAL = "premier|deuxième|troisième|quatrième|cinquième|sixième|septième|huitième|neuvième|dixième"
_LATIN = "bis|ter|quater|quinquies|sexies|septies|octies|novies|decies"
_VERB = "stipule|dispose|prévoit|énonce|précise"
#: Header forms by priority; group 1 is the number. Words stand at the start of a line, in any case.
HEADER_FORMS = [
    ("article", rf"Article\s+({_NUM}(?:\s*(?:{_LATIN})\b)?)"),
    ("numbered", rf"({_NUM})\s*[–—-]"),
    ("art", r"Art\.\s*([0-9]+)\s*COBAC"),
    ("r", rf"R\s*({_NUM})"),
    ("rule", rf"R[EÈ]GLE\s*({_NUM})"),
    ("ordinal", rf"Article\s+({_ORDINAL})"),
    ("account", r"Le\s+compte\s+divisionnaire\s+«\s*([0-9]+[^»]*?)\s*»"),
    ("quoted", rf"L['’]article\s+({_NUM})\s+(?:{_VERB})"),
]
_MARKS = r"(?:TITRE|CHAPITRE|SECTION|ANNEXE)\s+[XVI]+|Art\.\s*[0-9]+"
_START = "|".join(p.replace("(", "(?:", 1) if not p.startswith("(") else "(?:" + p[1:] for _, p in HEADER_FORMS)
# the look at the first letter spares most places the alternatives
_CITED = rf"(?isu)(?=[ecsa])(?:en vertu de|conformément à|selon|au sens de) l['’]article\s+({_NUM})(.*)$"


def segments(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, seq, seg): the text cut before each line that starts with a header form, a title, chapter, section or annex."""
    return each(texts, F.split(c, rf"(?miu)^(?=[ \t]*(?:{_START}|{_MARKS}))"), "seg", "seq").select("doc_id", "seq", "seg")


def _after(c: Column | str) -> Column:
    """What follows the first line."""
    at = F.instr(col(c), "\n")
    return F.when(at > 0, F.trim(F.substring(col(c), at + 1, F.length(col(c))), F.lit(" \n\t"))).otherwise("")


def article_forms(texts: DataFrame, least: int = 50) -> DataFrame:
    """(doc_id, form, number, title, body) of articles of more than ``least`` characters.

    Each header takes the first form that it has. Of equal numbers the header of the earliest form stays, of one form the first; it blocks the others even where its body is too
    short. A citation ("conformément à l'article n") counts, with the rest of its segment, where no header has its number.
    """
    at = lambda p: rf"(?iu)^[ \t]*(?:{p})"
    first = F.lit(None).cast("int")
    for i, (_, p) in reversed(list(enumerate(HEADER_FORMS))):
        first = F.when(F.col("seg").rlike(at(p)), i).otherwise(first)
    header = F.col("rank") < len(HEADER_FORMS)
    # a segment is a header, a citation or both; each is found once, and the text is read again for what was found alone
    found = each(segments(texts), F.array_compact(F.array(first, F.when(F.col("seg").rlike(_CITED), len(HEADER_FORMS)))), "rank")
    number, form = F.regexp_extract("seg", _CITED, 1), F.lit("citation")
    for i, (name, p) in reversed(list(enumerate(HEADER_FORMS))):
        number, form = F.when(F.col("rank") == i, F.regexp_extract("seg", at(p), 1)).otherwise(number), F.when(F.col("rank") == i, name).otherwise(form)
    title = F.regexp_replace(F.regexp_extract("seg", r"^([^\n]*)", 1), rf"(?iu)^[ \t]*(?:{_START})(?:\s*\([^)]*\))?\s*[:.-]?\s*", "")
    body = F.when(header, _after("seg")).otherwise(F.trim(F.regexp_extract("seg", _CITED, 2), F.lit(" \n\t")))
    rows = found.select("doc_id", "seq", "rank", form.alias("form"), T.canonical_number(number).alias("number"), F.when(header, F.trim(title)).otherwise("").alias("title"), body.alias("body"))
    order = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("rank", "seq"))
    return rows.withColumn("rn", order).where((F.col("rn") == 1) & (F.length("body") > least)).select("doc_id", "form", "number", "title", "body")


def section_articles(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, number, title, body): articles that begin after a blank line, of more than 50 characters, for texts whose headers give few."""
    parts = texts.select("doc_id", F.posexplode(F.split(c, r"(?iu)\n{2,}(?=(?:Article|Art\.)\s+[0-9]|[0-9]+\s*[–—-])")).alias("seq", "part"))
    head = rf"(?iu)^\s*(?:Article|Art\.)\s+({_NUM})\s*[:.-]?\s*([^\n]*)"
    rows = parts.where((F.length(F.trim("part")) >= 50) & F.col("part").rlike(head)).select("doc_id", "seq", F.replace(F.regexp_extract("part", head, 1), F.lit(","), F.lit(".")).alias("number"), F.trim(F.regexp_extract("part", head, 2)).alias("title"), _after("part").alias("body"))
    return rows.where(F.length("body") > 50)


def fallback_articles(texts: DataFrame) -> DataFrame:
    """(doc_id, number, title, body): Article and Art. headers alone, white space collapsed, of more than 50 characters and cut at 5,000; the first of a number stays, whatever its length."""
    head = rf"(?iu)^\s*(?:Article|Art\.)\s*({_NUM}(?:\s*(?:bis|ter|quater)\b)?)\s*[:.-]?\s*([^\n]*)"
    rows = segments(texts).where(F.col("seg").rlike(head)).select("doc_id", "seq", F.trim(F.regexp_extract("seg", head, 1)).alias("number"), F.trim(F.regexp_extract("seg", head, 2)).alias("title"), F.trim(F.regexp_replace(_after("seg"), r"\s+", " ")).alias("body"))
    first = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("seq"))
    kept = rows.withColumn("rn", first).where((F.col("rn") == 1) & (F.length("body") > 50))
    return kept.select("doc_id", "number", F.when(F.col("title") == "", F.concat(F.lit("Article "), "number")).otherwise(F.substring("title", 1, 200)).alias("title"), F.substring("body", 1, 5000).alias("body"))


def export_articles(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, number, body): the exporter's headers, with "n. -" and "n)" lists, of more than 20 characters and cut at 5,000; first of a number."""
    head = r"(?iu)^\s*(?:(?:Article|Art\.)\s*([0-9]+(?:\.[0-9]+)?(?:\s*(?:bis|ter|quater)\b)?)[^\n]*\n|([0-9]+)\.\s*[–-]|([0-9]+)\))"
    parts = texts.select("doc_id", F.posexplode(F.split(c, r"(?miu)^(?=[ \t]*(?:(?:Article|Art\.)\s*[0-9]|[0-9]+\.\s*[–-]|[0-9]+\)))")).alias("seq", "part")).where(F.col("part").rlike(head))
    number = F.trim(F.concat(*[F.regexp_extract("part", head, g) for g in (1, 2, 3)]))
    rows = parts.select("doc_id", "seq", number.alias("number"), F.trim(F.regexp_replace(F.regexp_replace("part", head, ""), r"\s+", " ")).alias("body")).where(F.length("body") > 20)
    first = F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("seq"))
    return rows.withColumn("rn", first).where("rn = 1").select("doc_id", "number", F.substring("body", 1, 5000).alias("body"))


#: Headings of five levels in French and English: (level, pattern) with the number in group 1.
LEVELS = [(1, r"TIT(?:RE|LE)\s+([CDILMVX]+)"), (2, r"CHAP(?:ITRE|TER)\s+([CDILMVX]+|[0-9]+)"), (4, r"(?:SOUS-SECTION|§)\s*([CDILMVX]+\b|[0-9]+(?:\.[0-9]+)?)"), (3, r"SECTION\s+([CDILMVX]+|[0-9]+(?:\.[0-9]+)?)"), (5, rf"(?:Article|Art\.)\s*({_NUM}(?:\s*(?:bis|ter|quater)\b)?)")]


def headings(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, seq, level, number, title): lines that start with a heading of a level; article numbers take a point, Roman ones capitals."""
    lines = texts.select("doc_id", F.posexplode(F.split(c, "\n")).alias("seq", "line"))
    level, number, title = F.lit(None), F.lit(None), F.lit(None)
    for k, p in reversed(LEVELS):
        whole = rf"(?iu)^\s*(?:{p})\s*[:.–-]?\s*(.*)$"
        has = F.col("line").rlike(whole)
        level, number, title = F.when(has, k).otherwise(level), F.when(has, F.upper(F.regexp_extract("line", whole, 1)) if k < 5 else F.replace(F.lower(F.regexp_extract("line", whole, 1)), F.lit(","), F.lit("."))).otherwise(number), F.when(has, F.trim(F.regexp_extract("line", whole, 2))).otherwise(title)
    return lines.select("doc_id", "seq", level.alias("level"), number.alias("number"), title.alias("title")).where("level is not null")


def each(rows: DataFrame, items: Column, name: str, place: str | None = None) -> DataFrame:
    """The rows with one item of an array in each and, if named, the item's place.

    The array is computed once a row: a filter on what an inner explode gives, which Spark adds by itself, would compute it again.
    """
    item = F.posexplode_outer(items).alias(place, name) if place else F.explode_outer(items).alias(name)
    return rows.select("*", item).where(F.col(name).isNotNull())


def _parted(c: Column | str, pattern: str, fn) -> Column:
    """fn(struct of w, the matches in order, and g, what stands before each and after the last); an empty list of matches takes one pass over the text."""
    gaps = lambda w: F.when(F.size(w) > 0, F.split(col(c), pattern, -1))
    return let(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(0)), lambda w: let(F.struct(w.alias("w"), gaps(w).alias("g")), fn))


def located(c: Column | str, pattern: str) -> Column:
    """Array of (m, at): the matches of a pattern in order and the characters before each, counted on from match to match."""
    start = "named_struct('at', 0, 'out', cast(array() as array<struct<m:string,at:int>>))"

    def step(a, x):
        at = a["at"] + F.length(x["g"])
        return F.struct((at + F.length(x["w"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["w"].alias("m"), at.alias("at")))).alias("out"))

    ordered = lambda s: F.zip_with(s["w"], F.slice(s["g"], F.lit(1), F.size(s["w"])), lambda w, g: F.struct(w.alias("w"), g.alias("g")))
    return _parted(c, pattern, lambda s: F.when(F.size(s["w"]) > 0, F.aggregate(ordered(s), F.expr(start), step, lambda a: a["out"])).when(s["w"].isNotNull(), F.expr("cast(array() as array<struct<m:string,at:int>>)")))


def pieces(c: Column | str, pattern: str) -> Column:
    """Array of (m, rest): the matches of a pattern in order, and what follows each up to the next."""
    rests = lambda s: F.zip_with(s["w"], F.slice(s["g"], F.lit(2), F.size(s["w"])), lambda w, g: F.struct(w.alias("m"), g.alias("rest")))
    return _parted(c, pattern, lambda s: F.when(F.size(s["w"]) > 0, rests(s)).when(s["w"].isNotNull(), F.expr("cast(array() as array<struct<m:string,rest:string>>)")))


def context(c: Column | str, at: Column, m: Column, around: int = 50) -> Column:
    """The match with the characters around it."""
    low = F.greatest(at - around, F.lit(0))
    return F.substring(col(c), low + 1, at - low + F.length(m) + around)


#: What leads to a citation, by kind; each begins with a letter, by which they are searched.
_LEAD_FR = {
    "conformity": [r"conformément (?:à|aux) ", "en vertu des? ", "selon (?:les dispositions de )?", "au sens des? ", r"prévue?s?\s+(?:à|par|aux)\s+"],
    "modification": ["modifie ", "remplace ", "abroge ", "complète "],
    "reference": ["voir ", r"cf\.\s*", "se référer à ", r"définie?s?\s+(?:à|dans)\s+"],
    "application": ["pour l'application des? ", "en application des? ", "application des? ", "aux fins des? "],
    "exception": ["par dérogation (?:à |aux |les dispositions de )?", "nonobstant (?:à |aux |les dispositions de )?", "sauf (?:disposition contraire de |dans )?", "à l'exception des? "],
}
_LEAD_EN = {"conformity": ["in accordance with ", "pursuant to ", "as per ", "under "], "modification": ["amends ", "replaces ", "repeals "], "reference": ["see ", "refer to ", "as defined in "]}
LEADS = {"fr": _LEAD_FR, "en": _LEAD_EN}


def _by_letter(leads: list[str]) -> str:
    """An alternation that tries at each place only what begins with the letter there."""
    letters = dict.fromkeys(x[0] for x in leads)
    return f"(?=[{''.join(letters)}])(?:" + "|".join(f"{a}(?:" + "|".join(x[1:] for x in leads if x[0] == a) + ")" for a in letters) + ")"


def _places(c: Column | str, found: Column) -> Column:
    """Array of (m, at) for matches in order of a pattern that looks at nothing around a match, so each begins where its text next occurs."""
    start = "named_struct('next', 1, 'out', cast(array() as array<struct<m:string,at:int>>))"

    def step(a, m):
        return let(F.call_function("locate", m, col(c), a["next"]), lambda at: F.struct((at + F.length(m)).alias("next"), F.concat(a["out"], F.array(F.struct(m.alias("m"), (at - 1).alias("at")))).alias("out")))

    return F.aggregate(found, F.expr(start), step, lambda a: a["out"])


def cross_references(arts: DataFrame, language: str = "fr") -> DataFrame:
    """(doc_id, source, target, kind, text, context): citations of articles, one row for each article cited.

    One alternation finds all citations of a body; which lead it has says the kind. After "conformément" a list or range is read ("2 à 4" gives all whole numbers between, else each number counts);
    after the others the first number alone.
    """
    leads = LEADS[language]
    cite = rf"(?iu){_by_letter([x for xs in leads.values() for x in xs])}(?:l['’])?articles?\s+{_NUM}(?:\s*(?:bis|ter|quater)\b)?(?:\s*(?:et|à)\s*{_NUM})*"
    rows = each(arts, _places("body", F.regexp_extract_all("body", F.lit(cite), F.lit(0))), "x").select("doc_id", F.col("number").alias("source"), F.col("x.m").alias("text"), context("body", F.col("x.at"), F.col("x.m")).alias("context"))
    kind = F.lit(None)
    for k, xs in reversed(leads.items()):
        kind = F.when(F.col("text").rlike(rf"(?iu)^(?:{'|'.join(xs)})(?:l['’])?article"), k).otherwise(kind)
    listed = F.regexp_extract("text", r"(?iu)articles?\s+(.*)$", 1)
    first = F.regexp_extract(listed, rf"^({_NUM})", 1)
    low, high = (F.regexp_extract(listed, rf"({_NUM})\s*à\s*({_NUM})", g) for g in (1, 2))
    whole = lambda c: F.regexp_extract(c, r"^([0-9]+)", 1).cast("int")
    between = F.transform(F.sequence(whole(low), F.greatest(whole(low), whole(high))), lambda i: i.cast("string"))
    numbers = F.when(~F.col("text").rlike("(?iu)^conformément"), F.array(F.regexp_extract(listed, rf"^({_NUM}(?:\s*(?:bis|ter|quater)\b)?)", 1))).when(low != "", between).otherwise(F.regexp_extract_all(listed, F.lit(rf"{_NUM}(?:\s*(?:bis|ter|quater)\b)?"), F.lit(0)))
    kept = each(rows, F.when(first != "", numbers), "n").withColumn("kind", kind)
    return kept.select("doc_id", "source", F.concat(F.lit("Article "), F.replace("n", F.lit(","), F.lit("."))).alias("target"), "kind", "text", "context")


_CODE = r"([CIR]-[0-9]{4}[-_/][0-9]{2,3})"
TYPED = [
    ("Regulation", rf"règlement\s+(?:COBAC|CEMAC)?\s*(?:n°\s*)?{_CODE}"), ("Instruction", rf"instruction\s+(?:COBAC|CEMAC)?\s*(?:n°\s*)?{_CODE}"), ("Basel", r"(B(?:âle|asel)\s+[XVI]+|Accords?\s+de\s+Bâle)"),
    ("Treaty", r"(Traité\s+CEMAC|Convention\s+CEMAC|Acte\s+additionnel)"), ("Law", r"(Loi\s+n°\s*[^\n,]+|Code\s+[^\n,]+)"),
]


def regulatory_references(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, kind, reference, pos, context): the first mention of each typed reference, with its context, in order."""
    rows = each(texts.select("doc_id", F.col(c).alias("t")), F.concat(*[F.transform(located("t", "(?iu)" + p), _tag(k)) for k, p in TYPED]), "x")
    reference = F.lit(None)
    for k, p in TYPED:
        reference = F.when(F.col("x.kind") == k, F.regexp_extract(F.col("x.m"), "(?iu)" + p, 1)).otherwise(reference)
    one = rows.select("doc_id", F.col("x.kind").alias("kind"), reference.alias("reference"), F.col("x.at").alias("pos"), F.trim(context("t", F.col("x.at"), F.col("x.m")), F.lit(" \n\t")).alias("context"))
    first = F.row_number().over(Window.partitionBy("doc_id", "kind", "reference").orderBy("pos"))
    return one.withColumn("rn", first).where("rn = 1").drop("rn")


def _tag(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), x["at"].alias("at"))


def first_match(c: Column, patterns: list[str], group: int = 1) -> Column:
    """The group of the first pattern that matches; null where none does."""
    return F.coalesce(*[F.nullif(F.regexp_extract(c, p, group), F.lit("")) for p in patterns])


_KIND = "(?:Règlement|Instruction|Circulaire|Décision)"
_SIGNED = [r"Le\s+Secrétaire\s+Général\s*,?\s*([^\n]+)", r"Le\s+Président\s*,?\s*([^\n]+)", r"Pour\s+le\s+Secrétaire\s+Général\s*,?\s*([^\n]+)"]


def content_metadata(c: Column | str) -> dict[str, Column]:
    """Reference and date of the first 1,000 characters, subject of the first 2,000, signatory of the last 1,000."""
    x = col(c)
    head, more = F.substring(x, 1, 1000), F.substring(x, 1, 2000)
    tail = F.substring(x, F.greatest(F.length(x) - 999, F.lit(1)), F.lit(1000))
    i = lambda ps: ["(?iu)" + p for p in ps]
    return {
        "reference": first_match(head, i([rf"{_KIND}\s+(?:n°\s*)?{_CODE}", rf"n°\s*{_CODE}", _CODE])),
        "date_raw": first_match(head, i([r"du\s+[0-9]{1,2}\s+[\p{L}\p{N}_]+\s+[0-9]{4}", r"[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}", r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}"]), 0),
        "subject": F.trim(first_match(more, i([rf"{_KIND}[^\n]*?(?:relatif|relative)\s+(?:aux?|à)\s+([^.\n]+)", r"Objet\s*:\s*([^\n]+)", r"portant\s+([^.\n]+)"]))),
        "signatory": F.trim(first_match(tail, i(_SIGNED))),
    }


_UMAC = r"[0-9]{2}[-/][0-9]{2}[-/]CEMAC[-/]UMAC[-/]"
_YEAR = "([0-9]{4}[-/][0-9]{2})"
#: Forms of a reference; group 1 is the code.
REFERENCE_FORMS = [
    rf"Règlement\s+COBAC\s+R-{_YEAR}", rf"Règlement\s+n°\s*({_UMAC}COBAC)", rf"Règlement\s+n°\s*({_UMAC}CM)", rf"Instruction\s+COBAC\s+I-{_YEAR}", rf"Décision\s+COBAC\s+D-{_YEAR}", r"Décision\s+n°\s*([0-9]{2}[-/][0-9]{2}-FGD-CD)",
    rf"R-{_YEAR}", rf"I-{_YEAR}", rf"D-{_YEAR}", r"Convention[^\n]*?([0-9]{2}\s+[\p{L}\p{N}_]+\s+[0-9]{4})", "LC-(/[0-9]{2})",
]


def reference_of(file_name: Column | str, c: Column | str) -> Column:
    """From the first 2,000 characters, then the file name, else made of it; collections have a name of their own."""
    name, head = col(file_name), F.substring(col(c), 1, 2000)
    i = ["(?iu)" + p for p in REFERENCE_FORMS]
    named = first_match(head, i, 0)
    bare = first_match(head, i)
    inside = F.when(F.lower(named).rlike("règlement|convention|instruction|décision|lc-"), named).otherwise(F.concat(F.lit("Règlement COBAC "), bare))
    clean = F.replace(F.replace(name, F.lit(".pdf"), F.lit("")), F.lit("_"), F.lit(" "))
    made = F.concat(F.when(F.lower(clean).contains("cobac"), "Document COBAC - ").otherwise("Texte réglementaire - "), F.substring(clean, 1, 40))
    of_name = F.concat(F.lit("Règlement COBAC "), first_match(name, i))
    collection = F.when(F.lower(name).contains("cobac2021"), "Recueil des textes légaux et réglementaires COBAC (Edition 2021)")
    return F.coalesce(collection, inside, of_name, F.when(name != "", made), F.lit("Référence à identifier"))


TITLE_FORMS = [rf"Règlement\s+COBAC\s+R-{_YEAR[1:-1]}[^.]*", rf"Règlement\s+n°\s*{_UMAC}COBAC[^.]*", rf"Règlement\s+n°\s*{_UMAC}CM[^.]*", rf"Instruction\s+COBAC\s+I-{_YEAR[1:-1]}[^.]*", rf"Décision\s+COBAC\s+D-{_YEAR[1:-1]}[^.]*", r"Décision\s+n°\s*[0-9]{2}[-/][0-9]{2}-FGD-CD[^.]*", "LC-/[0-9]{2}[^.]*", "Convention[^.]{10,100}"]


def title_of(file_name: Column | str, c: Column | str) -> Column:
    """From the first 30 lines: by form, of 21 to 299 characters; then a descriptive line of 31 to 199; else from the file name."""
    name = col(file_name)
    lines = F.slice(F.split(col(c), "\n"), 1, 30)
    fit = lambda p: F.get(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_replace(F.regexp_extract(x, "(?iu)" + p, 0), r"\s+", " "))), lambda x: F.length(x).between(21, 299)), F.lit(0))
    plain = F.get(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: F.length(x).between(31, 199) & T.any_of(x, ["règlement", "instruction", "décision", "relatif", "portant"]) & ~T.any_of(x, ["article", "chapitre", "section", "page"])), F.lit(0))
    made = reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [(".pdf", ""), ("_", " "), ("-", " ")], name)
    made = F.trim(reduce(lambda x, r: F.replace(x, F.lit(r[0]), F.lit(r[1])), [("reglement", "Règlement"), ("cobac", "COBAC"), ("cemac", "CEMAC")], F.regexp_replace(made, "[0-9]{4}[-_][0-9]{2}", "")))
    collection = F.when(F.lower(name).contains("cobac2021"), "Recueil des textes légaux et réglementaires régissant l'activité des établissements de crédit dans l'UMAC")
    return F.coalesce(collection, *[F.substring(fit(p), 1, 200) for p in TITLE_FORMS], F.substring(plain, 1, 200), F.when(F.length(made) > 5, F.substring(made, 1, 150)), F.lit("Texte réglementaire COBAC"))


_MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"
_DAY = r"[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{4}"


def published_on(file_name: Column | str, c: Column | str) -> Column:
    """From the file name, else the first date of the first 2,000 characters, by form."""
    named = F.concat_ws("-", F.nullif(F.regexp_extract(col(file_name), "([0-9]{4})[-_]([0-9]{2})", 1), F.lit("")), F.nullif(F.regexp_extract(col(file_name), "([0-9]{4})[-_]([0-9]{2})", 2), F.lit("")))
    return F.coalesce(F.nullif(named, F.lit("")), first_match(F.substring(col(c), 1, 2000), [_DAY, r"[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}", rf"(?iu)[0-9]{{1,2}}\s+(?:{_MONTHS})\s+[0-9]{{4}}"], 0), F.lit("Date à identifier"))


def effective_on(file_name: Column | str, c: Column | str) -> Column:
    """The date after a cue of entry into force, else the publication date."""
    cues = [rf"(?iu){cue}[^0-9]*({_DAY})" for cue in ("entrée en vigueur", "applicable", "effet")]
    return F.coalesce(first_match(F.substring(col(c), 1, 2000), cues), published_on(file_name, c))


def document_parts(c: Column | str) -> dict[str, Column]:
    """The five parts of a document, of more than 10 characters: header, preamble, decision, articles and signature."""
    patterns = {
        "header": r"(?isu)^(.*?(?:COMMISSION\s+BANCAIRE|COBAC|CEMAC).*?)(?:\n\s*\n|\n(?:VU|CONSIDÉRANT|DECIDE|Article))",
        "preamble": r"(?isu)((?:\bVU\b|CONSIDÉRANT|AYANT\s+ÉGARD).*?)(?:\n\s*\n\s*DECIDE|Article\s+premier|Article\s+1)",
        "decide": r"(?isu)(DECIDE\s*:?\s*\n.*?)(?:Article\s+(?:premier|[0-9]+)|TITRE|CHAPITRE)",
        "articles": r"(?isu)(Article\s+(?:premier|[0-9]+).*?)\n\s*\n\s*(?:Fait|Le\s+Secrétaire|ANNEXE)",
        "signature": r"(?isu)((?:\bFait\b|Le\s+Secrétaire|Le\s+Président).*)$",
    }
    out = {}
    for name, p in patterns.items():
        text = F.trim(F.regexp_extract(col(c), p, 1), F.lit(" \n\t"))
        out[name] = let(text, lambda x: F.when(F.length(x) > 10, x))
    return out


_REGULATION = "|".join([rf"Règlement\s+(?:COBAC\s+)?R-{_YEAR[1:-1]}[^\n]*", rf"Règlement\s+n°\s*{_UMAC}(?:COBAC|CM)[^\n]*", rf"Instruction\s+(?:COBAC\s+)?I-{_YEAR[1:-1]}[^\n]*", rf"Décision\s+(?:COBAC\s+)?D-{_YEAR[1:-1]}[^\n]*", r"Décision\s+n°\s*[0-9]{2}[-/][0-9]{2}-FGD-CD[^\n]*", r"Convention\s+[^\n]{10,100}", r"LC-/[0-9]{2}[^\n]*"])
_ROMAN_HEAD = r"(?miu)^[ \t]*([XVI]+)\.?[ \t]+(\p{L}[^\n]{20,200})"


def regulations_of(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, seq, title, body): the regulations of a collection.

    Headings of a Roman numeral and 21 to 201 characters cut the text; where there is none, titles of regulations do; else the document is one regulation with a title of its own.
    """
    of = lambda kind, xs: F.transform(xs, lambda x: F.struct(F.lit(kind).alias("kind"), x["m"].alias("m"), x["rest"].alias("rest")))
    whole = F.array(F.struct(F.lit("whole").alias("kind"), F.lit("").alias("m"), F.col(c).alias("rest")))
    titled = let(pieces(c, "(?iu)(?:" + _REGULATION + ")"), lambda t: F.when(F.size(t) > 0, of("titled", t)).otherwise(whole))
    cut = let(pieces(c, _ROMAN_HEAD), lambda r: F.when(F.size(r) > 0, of("roman", r)).when(r.isNotNull(), titled))
    rows = each(texts, cut, "x", "seq")
    title = F.trim(F.regexp_replace(F.col("x.m"), r"\s+", " "))
    named = F.when(F.col("x.kind") == "roman", F.regexp_replace(title, r"(?iu)^([XVI]+)\.? ", "$1. ")).when(F.col("x.kind") == "titled", title).otherwise("Document réglementaire")
    return rows.select("doc_id", "seq", named.alias("title"), F.trim(F.concat("x.m", "x.rest"), F.lit(" \n\t")).alias("body"))


INDICATORS = [r"^\s*\|", r"^\s*[–—-]{3,}", r"^\s*[0-9]+\s*[).-]\s*[^\n]+\s+[0-9]+", r"^(?:Tableau|Table)\s*[0-9]*\s*:"]


def text_tables(texts: DataFrame, c: str = "txt") -> DataFrame:
    """(doc_id, indicator, n_lines, content): for each indicator, the lines from the first that has it to the next blank line, if they are more than two."""
    out = []
    lines = F.split(c, "\n")
    for i, p in enumerate(INDICATORS):
        first = lambda p=p: F.get(F.filter(F.transform(lines, lambda x, j: F.when(x.rlike(p), j)), lambda j: j.isNotNull()), F.lit(0))
        rest = F.slice(lines, first() + 1, F.greatest(F.size(lines) - first(), F.lit(0)))
        blank = F.get(F.filter(F.transform(rest, lambda x, j: F.when(F.trim(x) == "", j)), lambda j: j.isNotNull()), F.lit(0))
        block = F.slice(rest, F.lit(1), F.coalesce(blank, F.size(rest)))
        out.append(F.when(first().isNotNull(), F.struct(F.lit(i).alias("i"), block.alias("b"))))
    rows = texts.select("doc_id", F.explode(F.array_compact(F.array(*out))).alias("x")).where(F.size("x.b") > 2)
    return rows.select("doc_id", F.col("x.i").alias("indicator"), F.size("x.b").alias("n_lines"), F.array_join("x.b", "\n").alias("content"))
