"""Where plan modules register queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexmill.sources.corpus import corpus_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REG = "WITH " + corpus_sql(True)
KINDS = "TITRE|CHAPITRE|SECTION|ANNEXE|Article"
NUMBER = rf"^(?:{KINDS}) ([IVX]+|[0-9]+(?:\.[0-9]+)?(?: (?:bis|ter|quater))?)"
#: The structural elements in DuckDB, after the corpus: a mark is put before each heading, then the text is split at marks.
ELEM = (
    REG
    + rf""",
parts AS (SELECT doc_id, file_name, string_split(regexp_replace(txt, '(?m)^({KINDS}) ', chr(1) || '\1 ', 'g'), chr(1)) AS p FROM reg),
segs AS (SELECT doc_id, file_name, generate_subscripts(p, 1) - 1 AS seq, unnest(p) AS seg FROM parts),
elem AS (SELECT doc_id, file_name, seq, sum(length(seg)) OVER (PARTITION BY doc_id ORDER BY seq) - length(seg) AS pos,
  CASE WHEN NOT regexp_matches(seg, '{NUMBER}') THEN 0 WHEN starts_with(seg, 'TITRE ') THEN 1 WHEN starts_with(seg, 'CHAPITRE ') THEN 2 WHEN starts_with(seg, 'SECTION ') THEN 3 WHEN starts_with(seg, 'ANNEXE ') THEN 4 ELSE 5 END AS level,
  regexp_extract(seg, '{NUMBER}', 1) AS number, regexp_extract(seg, '^[^\n]* - ([^\n]*)', 1) AS title,
  rtrim(regexp_replace(CASE WHEN instr(seg, chr(10)) > 0 THEN substring(seg, instr(seg, chr(10)) + 1) ELSE '' END, '\n+$', '')) AS body FROM segs),
arts AS (SELECT doc_id, file_name, seq, pos, number, title, body FROM elem WHERE level = 5 AND length(body) > 50 QUALIFY row_number() OVER (PARTITION BY doc_id, number ORDER BY seq) = 1)"""
)
REFS = (
    ELEM
    + r""",
cites AS (SELECT doc_id, number, 'conformity' AS kind, unnest(regexp_extract_all(body, '(?i)conformément (?:à l''article|aux articles) ([0-9]+(?: à [0-9]+)?)', 1)) AS cited FROM arts
  UNION ALL SELECT doc_id, number, 'modification', unnest(regexp_extract_all(body, '(?i)modifie l''article ([0-9]+)', 1)) FROM arts),
bounds AS (SELECT doc_id, CAST(regexp_extract(number, '^(\d+)', 1) AS INT) AS src, kind, CAST(regexp_extract(cited, '^(\d+)', 1) AS INT) AS lo, coalesce(try_cast(regexp_extract(cited, 'à (\d+)$', 1) AS INT), CAST(regexp_extract(cited, '^(\d+)', 1) AS INT)) AS hi FROM cites),
refs AS (SELECT doc_id, src, kind, unnest(range(lo, greatest(lo, hi) + 1))::INT AS dst FROM bounds)"""
)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and the SQL that gives its rows."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_hits(column: str, terms: list[str]) -> str:
    """The number of terms that a lower-cased column contains."""
    return "(" + " + ".join(f"contains(lower({column}), {quoted(t)})::INT" for t in terms) + ")"


def sql_any(column: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({column}), {quoted(t)})" for t in terms) + ")"


def sql_words(column: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({column}, '[\s\x{{00A0}}\x{{0085}}]+'), lambda x: x <> ''))"


def sql_ends(column: str) -> str:
    return f"len(regexp_extract_all({column}, '[.!?]'))"


def sql_alnum(column: str) -> str:
    return rf"(CASE WHEN length({column}) > 0 THEN length(regexp_replace({column}, '[^\p{{L}}\p{{N}}]', '', 'g'))::DOUBLE / length({column}) ELSE 0 END)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
