"""Cell grids and damaged JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clean_grid(rows: DataFrame) -> DataFrame:
    """(id, header, cells): grids without empty rows and columns, trimmed; the first row becomes the header where no cell is a number.

    rows has (id, grid ARRAY<ARRAY<STRING>>).
    """
    tidy = lambda x: F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"\s+", " "))
    grid = F.filter(F.transform("grid", lambda r: F.transform(r, tidy)), lambda r: F.exists(r, lambda x: x != ""))
    g = rows.select("id", grid.alias("g")).where("size(g) > 0")
    used = F.filter(F.sequence(F.lit(0), F.size(F.col("g")[0]) - 1), lambda i: F.exists("g", lambda r: F.get(r, i) != ""))
    g = g.withColumn("u", used).withColumn("g", F.transform("g", lambda r: F.transform("u", lambda i: F.coalesce(F.get(r, i), F.lit("")))))
    named = F.forall(F.col("g")[0], lambda x: (x != "") & ~x.rlike(r"^[0-9.,]+$"))
    plain = F.transform(F.sequence(F.lit(1), F.size(F.col("g")[0])), lambda i: F.concat(F.lit("Column_"), i.cast("string")))
    return g.select("id", F.when(named, F.col("g")[0]).otherwise(plain).alias("header"), F.when(named, F.slice("g", F.lit(2), F.size("g"))).otherwise(F.col("g")).alias("cells"))


KINDS = [("ratios", ["ratio", "solv", "prix"]), ("penalties", ["amende", "sanction", "tax"]), ("thresholds", ["seuil", "limite", "qty"]), ("deadlines", ["délai", "date"])]


def table_kind(header: Column) -> Column:
    text = F.lower(F.array_join(header, " "))
    out = F.lit("other")
    for kind, terms in reversed(KINDS):
        hit = F.lit(False)
        for t in terms:
            hit = hit | text.contains(t)
        out = F.when(hit, kind).otherwise(out)
    return out


def table_summary(tables: DataFrame) -> DataFrame:
    """(id, kind, n_rows, n_columns, n_numeric, has_total)."""
    columns = F.sequence(F.lit(0), F.size("header") - 1)
    numeric = F.filter(columns, lambda i: F.forall("cells", lambda r: F.coalesce(F.get(r, i), F.lit("")).rlike(r"^[0-9.,]+$")))
    total = F.exists("cells", lambda r: F.exists(r, lambda x: F.lower(x).contains("total")))
    return tables.select("id", table_kind(F.col("header")).alias("kind"), F.size("cells").alias("n_rows"), F.size("header").alias("n_columns"), F.when(F.size("cells") > 0, F.size(numeric)).otherwise(0).alias("n_numeric"), total.alias("has_total"))


def repair_json(c: Column) -> Column:
    """A JSON object from a damaged answer: what a fence or braces hold, without comments and trailing commas, names quoted, braces balanced; null if none parses."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    raw = F.regexp_extract(c, r"(?s)(\{.*?\})", 1)
    open_ = F.regexp_extract(c, r"(?s)(\{[^}]*)$", 1)

    def tidy(x: Column) -> Column:
        x = F.regexp_replace(x, r"//[^\n]*", "")
        x = F.regexp_replace(x, r"([{,]\s*)([A-Za-z_][A-Za-z0-9_]*)\s*:", '$1"$2":')
        x = F.regexp_replace(x, r",\s*\}", "}")
        return F.regexp_replace(x, r"\s+", " ")

    good = lambda x: F.when(F.get_json_object(x, "$").isNotNull() & (x != ""), x)
    return F.coalesce(*[good(tidy(x)) for x in (fenced, raw, F.when(open_ != "", F.concat(F.regexp_replace(open_, r",\s*$", ""), F.lit("}"))).otherwise(""))])


def repaired_score(c: Column) -> tuple[Column, Column]:
    """The completeness score of an answer and how it was found.

    A truncated answer (short and about the score, or one that starts with its quoted name) counts 75; one that starts with another quote has no score of its kind. Else an object is repaired
    (a label before it doesn't matter), then values after names are read, and 50 is the last resort.
    """
    x = F.trim(c)
    about = x.contains("completeness_score")
    truncated = ((F.length(x) < 50) & about & ~x.contains("{")) | x.startswith('"completeness_score"')
    quoted = x.startswith('"')
    parsed = F.get_json_object(repair_json(x), "$.completeness_score").cast("double")
    named = F.nullif(F.regexp_extract(x, r"completeness_score\"?\s*[:=]\s*([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")
    method = F.when(truncated | (quoted & about), "truncated").when(quoted & x.contains("articles"), "articles").when(quoted & x.contains("materiality_level"), "materiality").when(parsed.isNotNull(), "parsed").when(named.isNotNull(), "key_values").otherwise("default")
    score = F.when(method == "truncated", 75.0).when(method == "parsed", parsed).when(method == "key_values", named).when(method == "default", 50.0)
    return score, method
