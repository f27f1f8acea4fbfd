"""Column expressions over text; all run inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_words(c: Column | str) -> Column:
    """Words between white space."""
    return F.regexp_count(col(c), F.lit(r"(?U)\S+"))


def n_ends(c: Column | str) -> Column:
    """Full stops, exclamation and question marks."""
    return F.regexp_count(col(c), F.lit(r"[.!?]"))


def let(value: Column, fn) -> Column:
    """fn(value), with the value computed once for each row however often fn uses it."""
    # a default argument would count as a second parameter of the lambda
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def hits(c: Column | str, terms: list[str]) -> Column:
    """How many of the terms the lower-cased text contains."""
    return let(F.lower(col(c)), lambda low: hits_low(low, terms))


def hits_low(low: Column | str, terms: list[str]) -> Column:
    """How many of the terms a text in lower case contains; where many are sought, lower it once, in a column of its own.

    The terms are an array and not a sum of conditions: generated code of more than 8,000 bytes is never compiled.
    """
    return F.when(col(low).isNotNull(), F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: col(low).contains(t))))


def any_low(low: Column | str, terms: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, terms)), lambda t: col(low).contains(t))


def any_of(c: Column | str, terms: list[str]) -> Column:
    return let(F.lower(col(c)), lambda low: any_low(low, terms))


def clean_text(c: Column | str) -> Column:
    """White space to single spaces, long dot runs to three, joined hyphenation, no control characters."""
    x = F.regexp_replace(col(c), r"(?U)\s+", " ")
    x = F.regexp_replace(x, r"\.{3,}", "...")
    x = F.regexp_replace(x, r"(\p{L})- (\p{Ll})", "$1$2")
    return F.trim(F.regexp_replace(x, r"[\x00-\x1F\x7F-\x9F]", ""))


def document_type(name: Column | str) -> Column:
    low = F.lower(col(name))
    out = F.lit("OTHER")
    for kind, terms in reversed(L.DOCUMENT_TYPES):
        out = F.when(reduce(lambda a, b: a | b, [low.contains(t) for t in terms]), kind).otherwise(out)
    return out


def document_number(name: Column | str) -> Column:
    patterns = [r"R-(\d{4}_\d{1,2})", r"I-(\d{4}_\d{1,2})", r"LC-(\d{2,})", r"D-(\d{4}_\d{1,2})", r"(\d{4}_\d{1,2})"]
    return F.coalesce(*[F.nullif(F.regexp_extract(col(name), p, 1), F.lit("")) for p in patterns])


def human_size(n: Column | str) -> Column:
    n = col(n).cast("double")
    out = F.format_string("%.2f TB", F.round(n / 1024.0**4, 2))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", F.round(n / 1024.0**power, 2))).otherwise(out)
    return out


def truncate(c: Column | str, size: int, suffix: str = "...") -> Column:
    return F.when(F.length(col(c)) > size, F.concat(F.substring(col(c), 1, size - len(suffix)), F.lit(suffix))).otherwise(col(c))


def safe_cell(c: Column | str, size: int = 200) -> Column:
    return truncate(F.coalesce(col(c).cast("string"), F.lit("")), size)


def ocr_fix(c: Column | str) -> Column:
    return reduce(lambda x, r: F.regexp_replace(x, r[0], r[1]), L.OCR_RULES, col(c))


def article_text(c: Column | str) -> Column:
    x = F.regexp_replace(col(c), r"\n{2,}", "\n")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r" ?° ?", "° ")
    x = F.regexp_replace(x, r"([.;:])(\p{Lu})", "$1 $2")
    return F.trim(F.regexp_replace(x, r"\s*\n\s*", " "))


def canonical_number(c: Column | str) -> Column:
    """Lower case, French ordinals to digits, decimal comma to point."""
    x = F.trim(F.lower(col(c)))
    digits = F.create_map(*[F.lit(v) for i, word in enumerate(L.ORDINALS, 1) for v in (word, str(i))])
    x = F.coalesce(digits[x], x)
    return F.regexp_replace(F.regexp_replace(x, ",", "."), r"\s+", " ")


def number_key(c: Column | str) -> Column:
    """(main, sub, suffix) for sorting; 9999 where there's no number."""
    main = F.regexp_extract(col(c), r"^(\d+)", 1)
    return F.struct(
        F.when(main == "", 9999).otherwise(main.cast("int")).alias("main"),
        F.coalesce(F.nullif(F.regexp_extract(col(c), r"^\d+[.-](\d+)", 1), F.lit("")).cast("int"), F.lit(0)).alias("sub"),
        F.regexp_extract(col(c), r"(bis|ter|quater)$", 1).alias("suffix"),
    )


def alnum_ratio(c: Column | str) -> Column:
    x = col(c)
    return F.when(F.length(x) > 0, F.length(F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")) / F.length(x)).otherwise(0.0)


def measured(rows: DataFrame, c: str) -> DataFrame:
    """The rows with what the qualities of a text are made of, each found once: its lower case, words, ends, share of letters and digits, and mean line."""
    return rows.withColumns({"low": F.lower(c), "words": n_words(c), "ends": n_ends(c), "alnum": alnum_ratio(c), "mean_line": mean_line(c)})


def mean_line(c: Column | str) -> Column:
    """The mean length of the lines that aren't blank."""
    lines = F.filter(F.split(col(c), "\n"), lambda x: F.trim(x) != "")
    return let(lines, lambda ls: F.when(F.size(ls) > 0, F.aggregate(ls, F.lit(0), lambda a, x: a + F.length(x)) / F.size(ls)).otherwise(0.0))


def extraction_quality() -> Column:
    """Of measured rows."""
    w, e = F.col("words"), F.col("ends")
    words = F.when(w > 50, 0.3).when(w > 20, 0.2).when(w > 10, 0.1).otherwise(0.0)
    return words + F.least(F.lit(0.4) * F.col("alnum"), F.lit(0.4)) + F.when(e > 5, 0.2).when(e > 2, 0.1).otherwise(0.0) + F.when(hits_low("low", L.LEGAL_TERMS) >= 3, 0.1).otherwise(0.0)


def text_quality(c: Column | str | None = None) -> Column:
    """Of measured rows, or of a text."""
    words, alnum, ends, mean = map(F.col, ("words", "alnum", "ends", "mean_line")) if c is None else (n_words(c), alnum_ratio(c), n_ends(c), mean_line(c))
    return F.when(words > 10, 0.3).otherwise(0.0) + F.lit(0.3) * alnum + F.when(ends > 0, 0.2).otherwise(0.0) + F.when((mean > 20) & (mean < 100), 0.2).otherwise(0.0)


def ocr_confidence(c: Column | str, words: Column | None = None) -> Column:
    x, words = col(c), n_words(c) if words is None else words
    special = F.when(F.length(x) > 0, F.length(F.regexp_replace(x, r"[\p{L}\p{N}\s.,;:!?()'\"-]+", "")) / F.length(x)).otherwise(1.0)
    garbled = F.regexp_count(x, F.lit(r"\p{L}{10,}")) / F.greatest(words, F.lit(1))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - (F.lit(0.5) * special + F.lit(0.3) * garbled)))


def accepted(c: Column | str, quality: Column | str) -> Column:
    """Whether an extracted text, measured, is good enough."""
    q = col(quality)
    return (F.length(F.trim(col(c))) >= 100) & (F.col("words") >= 10) & ((q >= 0.6) | ((q >= 0.4) & (hits_low("low", L.ACCEPTANCE_TERMS) >= 2)))


def materiality(c: Column | str) -> Column:
    return F.when(any_of(c, L.CRITICAL), "CRITICAL").when(any_of(c, L.HIGH), "HIGH").when(F.length(col(c)) > 500, "MEDIUM").otherwise("LOW")


def export_materiality(c: Column | str) -> Column:
    high = hits(c, L.EXPORT_HIGH)
    return let(high, lambda n: F.when(n >= 2, "HIGH").when((n == 1) | (hits(c, L.EXPORT_MEDIUM) >= 2), "MEDIUM").otherwise("LOW"))


def themes(c: Column | str) -> Column:
    found = F.array(*[F.when(any_of(c, terms), theme) for theme, terms in L.THEMES.items()])
    return F.array_compact(found)


def impact(low: Column | str) -> Column:
    """Of a text in lower case."""
    high = hits_low(low, L.IMPACT_HIGH)
    return F.when(high >= 3, "ÉLEVÉ").when((high >= 1) | (hits_low(low, L.IMPACT_MEDIUM) >= 3), "MOYEN").otherwise("FAIBLE")


def category(low: Column | str) -> Column:
    """The category of a text in lower case: that of greatest weighted keyword count, at least 1; of equal ones the first; else II."""
    names = F.array(*[F.lit(name) for name, _, _ in L.CATEGORIES])
    scores = F.array(*[F.lit(weight) * hits_low(low, terms) for _, weight, terms in L.CATEGORIES])
    return let(scores, lambda s: F.when(F.array_max(s) >= 1.0, F.get(names, F.array_position(s, F.array_max(s)).cast("int") - 1)).otherwise("II"))


def _first(sentences: Column, term: str) -> Column:
    # a default argument would count as a second parameter of the lambda
    return F.get(F.filter(sentences, lambda s: F.lower(s).contains(term)), F.lit(0))


def keyword_sentence(c: Column | str, terms: list[str]) -> Column:
    """The first sentence that contains the first term present."""
    sentences = F.transform(F.split(col(c), r"\."), lambda x: F.trim(x, F.lit("\n ")))
    return F.coalesce(*[_first(sentences, t) for t in terms])


def band(c: Column | str, cuts: list[tuple[float, str]], rest: str) -> Column:
    """The label of the first bound that is reached."""
    out = F.lit(rest)
    for bound, label in reversed(cuts):
        out = F.when(col(c) >= bound, label).otherwise(out)
    return out
