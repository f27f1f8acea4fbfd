"""A deterministic corpus of regulations, derived from orders and lineitem by one SQL text for Spark and DuckDB.

One document is one order; its articles are the order's line items, in a total order. Only integers and strings take part, so both
engines give the same characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_LINES = """
SELECT l_orderkey AS doc_id, rn,
  concat(
    CASE rn WHEN 1 THEN 'TITRE I - Dispositions générales\n' WHEN 4 THEN 'TITRE II - Surveillance prudentielle\n' ELSE '' END,
    CASE rn WHEN 1 THEN 'CHAPITRE 1 - Objet\n' WHEN 3 THEN 'CHAPITRE 2 - Capital\n' WHEN 5 THEN 'CHAPITRE 1 - Contrôle interne\n' ELSE '' END,
    CASE WHEN rn = 6 THEN 'SECTION 1 - Audit\n' ELSE '' END,
    'Article ', CAST(rn + CASE WHEN l_orderkey % 5 = 0 AND rn >= 3 THEN 6 ELSE 0 END AS STRING_T),
    CASE WHEN l_partkey % 11 = 0 THEN ' bis' ELSE '' END,
    CASE l_partkey % 4 WHEN 0 THEN ' - Définitions' WHEN 1 THEN ' - Fonds propres' WHEN 2 THEN ' - Sanctions' ELSE ' - Obligations de reporting' END, '\n',
    CASE l_returnflag
      WHEN 'R' THEN 'Les établissements de crédit doivent respecter en permanence le ratio de solvabilité. Toute interdiction est motivée.'
      WHEN 'A' THEN concat('Toute infraction est punie d''une amende de ', CAST(1000 * q AS STRING_T), ' FCFA. La sanction est notifiée.')
      ELSE 'La Commission bancaire publie un rapport annuel. Ce rapport peut être consulté.' END, '\n',
    CASE l_linestatus WHEN 'O' THEN 'Cette obligation s''applique au capital et aux fonds propres.' ELSE 'Le conseil délibère chaque trimestre.' END, '\n',
    CASE WHEN l_suppkey % 6 = 0 THEN concat('Conformément aux articles 1 à ', CAST(q % 3 + 2 AS STRING_T), ', le contrôle est permanent.\n')
         WHEN l_suppkey % 3 = 0 THEN concat('Conformément à l''article ', CAST(q % 6 + 1 AS STRING_T), ', le seuil est fixé.\n') ELSE '' END,
    CASE WHEN l_suppkey % 7 = 0 THEN concat('Le présent texte modifie l''article ', CAST(q % 4 + 1 AS STRING_T), '.\n') ELSE '' END,
    CASE WHEN l_partkey % 9 = 0 THEN concat('En application du règlement R-20', CAST(10 + q % 10 AS STRING_T), '/0', CAST(q % 9 + 1 AS STRING_T), ' du 15 mars 20', CAST(10 + q % 10 AS STRING_T), '.\n') ELSE '' END
  ) AS line
FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, CAST(l_quantity AS BIGINT) AS q,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS rn FROM lineitem) x"""

_CORPUS = """
SELECT o_orderkey AS doc_id,
  concat(CASE o_orderkey % 5 WHEN 0 THEN 'R-' WHEN 1 THEN 'Instruction_I-' WHEN 2 THEN 'LC-' WHEN 3 THEN 'decision_D-' ELSE 'notes-' END,
         CAST(year(o_orderdate) AS STRING_T), CASE o_orderkey % 5 WHEN 4 THEN '-' ELSE '_' END, CAST(month(o_orderdate) AS STRING_T), '.pdf') AS file_name,
  concat(CASE o_orderkey % 3 WHEN 0 THEN 'RÈGLEMENT COBAC R-' WHEN 1 THEN 'INSTRUCTION COBAC I-' ELSE 'DÉCISION COBAC D-' END, CAST(year(o_orderdate) AS STRING_T), '/0', CAST(month(o_orderdate) % 10 AS STRING_T), '\n',
         CASE o_orderkey % 4 WHEN 0 THEN 'relatif aux normes prudentielles\n' WHEN 1 THEN 'relatif au contrôle interne\n' WHEN 2 THEN 'relatif aux systèmes de paiement\n' ELSE 'relatif à l''agrément des dirigeants\n' END,
         'La Commission bancaire, vu la convention,\n', body,
         CASE WHEN o_orderkey % 2 = 0 THEN concat('Fait à Yaoundé, le ', CAST(day(o_orderdate) AS STRING_T), ' mars ', CAST(year(o_orderdate) AS STRING_T), '\nLe Président\n') ELSE '' END) AS txt
FROM orders JOIN (SELECT doc_id, JOINED AS body FROM lines GROUP BY doc_id) b ON o_orderkey = b.doc_id"""


def corpus_sql(duck: bool, lineitem: str = "lineitem", orders: str = "orders") -> str:
    """The CTEs ``lines`` and ``reg`` (doc_id, file_name, txt), after WITH."""
    joined = "string_agg(line, '' ORDER BY rn)" if duck else "listagg(line, '') WITHIN GROUP (ORDER BY rn)"
    text = f"lines AS ({_LINES}),\nreg AS ({_CORPUS})".replace("STRING_T", "VARCHAR" if duck else "STRING").replace("JOINED", joined)
    text = text.replace("FROM lineitem)", f"FROM {lineitem})").replace("FROM orders JOIN", f"FROM {orders} JOIN")
    return text


def reg_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file_name, txt): the corpus of a directory with orders.parquet and lineitem.parquet."""
    sql = corpus_sql(False, f"parquet.`{sf_dir}/lineitem.parquet`", f"parquet.`{sf_dir}/orders.parquet`")
    return spark.sql(f"WITH {sql} SELECT doc_id, file_name, txt FROM reg")
