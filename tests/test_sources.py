from pyspark.sql import functions as F

from lexmill.sources import files, sinks
from lexmill.streaming import windows as W


def test_scan_and_admit(spark, tmp_path):
    pdf = b"%PDF-1.4\nBT (Page \\(one\\)) Tj ET BT (Two) Tj ET"
    (tmp_path / "deep").mkdir()
    for name, content in (("a.pdf", pdf), ("b.PDF", b""), ("c.pdf", b"plain"), ("deep/d.pdf", pdf), ("e.txt", b"x")):
        (tmp_path / name).write_bytes(content)
    found = files.scan_directory(spark, str(tmp_path))
    # a file scan passes over empty files
    assert found.count() == 3 and files.scan_directory(spark, str(tmp_path), False).count() == 2
    good, bad = files.admit(found)
    assert good.count() == 2
    assert {r["path"].rsplit("/", 1)[1]: r["reason"] for r in bad.collect()} == {"c.pdf": "no PDF header"}
    rows = [("x.pdf", 0, b""), ("x.txt", 5, b"%PDF-"), ("y.pdf", 10**9, b"%PDF-1.7")]
    _, bad = files.admit(spark.createDataFrame(rows, "path string, length bigint, content binary"))
    assert {r["path"]: r["reason"] for r in bad.collect()} == {"x.pdf": "empty", "x.txt": "not a PDF name", "y.pdf": "too large"}
    meta = files.metadata(good).collect()
    assert {r["pdf_version"] for r in meta} == {"1.4"} and len({r["file_hash"] for r in meta}) == 1
    assert {(r["page"], r["text"]) for r in files.plain_pages(good).collect()} == {(1, "Page (one)"), (2, "Two")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "VI"), (2, "c", "II")], "doc_id bigint, text string, category string")
    at = lambda x: str(tmp_path / x)
    sinks.chunk_csv(df, at("csv"))
    assert {r["text"] for r in spark.read.option("header", True).csv(at("csv")).collect()} == {"a b", "c"}
    sinks.workbook({"Data": df, "Summary": df.groupBy("category").count()}, at("book"), 3)
    assert spark.read.parquet(at("book/Summary")).count() == 2
    sinks.by_category(df, at("map"))
    assert {r["category"] for r in spark.read.parquet(at("map")).collect()} == {"VI", "II"}
    sinks.by_category(df.limit(0), at("none"))
    assert [(r["doc_id"], r["category"]) for r in spark.read.parquet(at("none")).collect()] == [(None, "II")]
    sinks.error_report(df, at("errors"))
    assert spark.read.text(at("errors")).count() >= 2
    sinks.metrics_json(df, at("json"))
    for _ in range(2):
        sinks.append(df, at("log"))
    assert spark.read.parquet(at("log")).count() == 4 and spark.read.json(at("json")).count() == 2


def stream(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"select * from {name}")


def test_streams_equal_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        events.where(f"event_id % 3 = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = W.read_events(spark, str(tmp_path / "in"), 3)
    for name, fn in (("rate", W.error_rate), ("active", W.activity)):
        got = {tuple(r) for r in stream(spark, fn(source), name, "complete").collect()}
        assert got == {tuple(r) for r in fn(events).collect()}
    assert stream(spark, W.latest(source), "once", "append").count() == events.select("event_id").distinct().count()
    assert W.latest(events.union(events)).count() == events.select(F.countDistinct("event_id")).first()[0]
