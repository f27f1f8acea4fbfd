import pytest

import corpus_pipeline
from lexmill.llm.minhash import near_duplicates
from lexmill.llm.token_planes import read_tokens


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages_have_the_columns_of_documents_and_take_effect(documents, stages):
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    for df in stages[:-1]:
        assert df.columns == documents.columns
    sets = [ids(documents), *map(ids, stages[:-1])]
    assert all(b < a for a, b in zip(sets[:3], sets[1:4], strict=True)), "the filters remove something"
    assert sets[4] == sets[3] and stages[3].count() > stages[2].count()
    assert near_duplicates(stages[1]).count() == 0
    back = read_tokens(stages[4]).select("doc_id").distinct().count()
    assert back == len(sets[4])


def test_run_equals_the_stages(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == stages[-1].columns
    total = lambda df: df.selectExpr("sum(n_ids)").first()[0]
    assert total(got) == total(stages[-1])


def test_entry_registers_all():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_odd_rows_pass_through_every_stage(spark, odd, labels, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = odd.select(*columns)
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of the kind"), (2, None)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, table, str(tmp_path)).columns == columns
            stage(spark, table, str(tmp_path)).collect()
        assert corpus_pipeline.STAGES[-1][1](spark, table, str(tmp_path)).collect() is not None
