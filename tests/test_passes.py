"""Each query reads its tables, and each text is searched, once: what the optimizer makes of the plan is counted."""

import time

import pytest
from pyspark.sql import functions as F

from lexmill import plans
from lexmill.operators import forms as O
from tests.conftest import SF

QUERIES = plans.queries()


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


#: Scans of tables: forms take orders, the corpus orders and lineitem.
SCANS = {"j8_j13_conflicts_of_forms": 1, "g21_cross_references_fr": 1, "g12_p4_article_forms": 1, "g22_regulation_split": 1} | dict.fromkeys(
    ["a28_compliance_report", "a29_network_view", "a29_w9_edge_list", "a24_top_referencing", "a24_top_referenced", "n9_degree_closeness", "n10_network_bundle", "a25_isolated", "c44_dependency_score", "j8_mutual_references"]
    + ["c3_c4_c5_c7_document_quality", "c13_c14_verdict", "w1_whole_documents"],
    2,
)


@pytest.mark.parametrize("name", SCANS)
def test_tables_are_read_once(spark, name):
    assert optimized(QUERIES[name](spark, SF)).count("Relation [") == SCANS[name]


def test_texts_are_split_once(spark):
    assert optimized(QUERIES["g22_regulation_split"](spark, SF)).count("regexp_extract_all(") == 2


def test_many_matches_of_one_text(spark):
    text = "a Règlement R-2016/04 b\n" * 4000
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "I. Une règle assez longue pour un titre\nx")], "doc_id bigint, txt string")
    start = time.monotonic()
    rows = O.regulations_of(df).orderBy("doc_id", "seq").collect()
    assert time.monotonic() - start < 20
    assert [r["doc_id"] for r in rows] == [1] * 4000 + [3, 4]
    assert rows[1]["title"] == "Règlement R-2016/04 b" and rows[1]["body"] == "Règlement R-2016/04 b\na"
    assert rows[-2]["title"] == "Document réglementaire" and rows[-1]["title"].startswith("I. Une")
    at = df.where("doc_id = 1").select(F.explode(O.located("txt", "Règlement")).alias("x")).select("x.at").collect()
    assert [r["at"] for r in at] == [2 + 24 * i for i in range(4000)]


def test_texts_are_measured_once(spark):
    plan = optimized(QUERIES["p1_c1_c2_acceptance"](spark, SF))
    # once for the corpus and once for the documents, where the union is pushed below
    assert plan.count("lower(") <= 2 and plan.count("regexp_extract_all(") <= 4
    assert optimized(QUERIES["g29_c26_c27_c28_c30_c32_c39_fields"](spark, SF)).count("lower(") == 1
