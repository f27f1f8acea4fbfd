"""Small cases worked out by hand."""

from pyspark.sql import functions as F

from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.operators import graph as G
from lexmill.operators import pages as P
from lexmill.operators import tables as TB


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr("x")).first()[0]


def test_clean_text(spark):
    assert one(spark, "a b\n\nc....d\x07", T.clean_text) == "a b c...d"


def test_file_names(spark):
    names = ["/x/R-2020_03.pdf", "/x/LC-131.pdf", "/x/notes.pdf"]
    got = [(one(spark, n, T.document_type), one(spark, n, T.document_number)) for n in names]
    assert got == [("REGLEMENT", "2020_03"), ("LETTRE_CIRCULAIRE", "131"), ("OTHER", None)]


def test_materiality(spark):
    assert [one(spark, x, T.materiality) for x in ("Une pénalité est prévue", "La limite est fixée", "x" * 501, "Texte")] == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_canonical_numbers(spark):
    assert [one(spark, x, T.canonical_number) for x in (" Premier", "3,1", "12  BIS")] == ["1", "3.1", "12 bis"]


def test_page_ranges(spark):
    specs = [(1, "1-3, 2-5, 7, 8-8", 10), (2, "", 10), (3, "a", 10), (4, "0", 10), (5, "5-2", 10), (6, "11", 10)]
    parsed = P.parse_ranges(spark.createDataFrame(specs, "doc_id bigint, spec string, total int")).cache()
    assert {r["doc_id"]: r["error"] for r in parsed.collect()} == {1: None, 2: "empty", 3: "bad character", 4: "below 1", 5: "start after end", 6: "beyond the last page"}
    merged = P.merge_ranges(parsed)
    assert sorted((r["a"], r["b"]) for r in merged.collect()) == [(1, 5), (7, 8)]
    assert [r["page"] for r in P.selected_pages(merged).orderBy("place").collect()] == [1, 2, 3, 4, 5, 7, 8]


def test_sentence_packing(spark):
    text = "Aaaa bbbb. Cccc dddd. Eeee."
    got = P.pack(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), 20, 5).orderBy("chunk").collect()
    assert [(r["text"], r["n_sentences"]) for r in got] == [("Aaaa bbbb.", 1), ("bbbb. Cccc dddd.", 1), ("dddd. Eeee.", 1)]
    long = "X" * 30 + ". Yy."
    assert [len(r["text"]) for r in P.pack(spark.createDataFrame([(1, long)], "doc_id bigint, text string"), 20, 5).orderBy("chunk").collect()] == [31, 9]


def test_hierarchy(spark):
    text = "Loi\nTITRE I - Un\nCHAPITRE 1 - Deux\nArticle 1 - Trois\nx\nArticle 2 - Quatre\ny\nTITRE II - Cinq\nArticle 3 - Six\nz\n"
    got = E.hierarchy(spark.createDataFrame([(1, "f", text)], "doc_id bigint, file_name string, txt string")).where("level = 5").orderBy("seq")
    assert [r["path"] for r in got.collect()] == ["TITLE I > CHAPTER 1 > ARTICLE 1", "TITLE I > CHAPTER 1 > ARTICLE 2", "TITLE II > ARTICLE 3"]


def graph(spark):
    refs = spark.createDataFrame([(1, a, b, "conformity") for a, b in ((1, 2), (2, 3), (3, 1), (4, 5))], "doc_id bigint, src int, dst int, kind string")
    return spark.createDataFrame([(1, v) for v in range(1, 7)], "doc_id bigint, v int"), refs


def test_graph(spark):
    v, refs = graph(spark)
    assert {r["v"]: r["root"] for r in G.components(v, refs).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}
    assert [r["cycle"] for r in G.cycles(refs).collect()] == ["1-2-3"]
    assert sorted(r["path"] for r in G.chains(refs).collect()) == ["1-2-3", "2-3-1", "3-1-2"]
    assert {(r["src"], r["dst"]): r["d"] for r in G.distances(refs).collect()} == {(1, 2): 1, (2, 3): 1, (3, 1): 1, (4, 5): 1, (1, 3): 2, (2, 1): 2, (3, 2): 2}
    assert {r["v"]: r["betweenness"] for r in G.betweenness(refs).collect()} == {1: 1.0, 2: 1.0, 3: 1.0, 4: 0.0, 5: 0.0}


def test_references_expand_ranges(spark):
    arts = spark.createDataFrame([(1, "9", "conformément aux articles 12 à 14"), (1, "10", "Conformément à l'article 9")], "doc_id bigint, number string, body string")
    assert sorted((r["src"], r["dst"]) for r in E.references(arts).collect()) == [(9, 12), (9, 13), (9, 14), (10, 9)]


def test_near_duplicates_depend_on_order(spark):
    arts = spark.createDataFrame([(1, 0, "1", "a b c"), (1, 1, "2", "c b a"), (1, 2, "3", "a b d")], "doc_id bigint, seq int, number string, body string")
    assert sorted(r["number"] for r in E.near_duplicates(arts).collect()) == ["1", "3"]


def test_json_repair(spark):
    text = "```json\n{completeness_score: 80, reliability_score: 70, }\n```"
    assert one(spark, text, lambda c: F.get_json_object(TB.repair_json(F.col(c)), "$.reliability_score")) == "70"
    assert one(spark, "nothing here", lambda c: TB.repair_json(F.col(c))) is None
