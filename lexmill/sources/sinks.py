"""Reports as tables and text files. A workbook is one table for each sheet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import truncate


def chunk_csv(chunks: DataFrame, path: str) -> None:
    """Chunks as CSV with a header; line ends in a text become spaces."""
    chunks.withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ")).write.mode("overwrite").option("header", True).csv(path)


def workbook(sheets: dict[str, DataFrame], path: str, cell: int = 32767) -> None:
    """Each sheet as Parquet below the path; texts are cut to the most that a cell holds."""
    for name, df in sheets.items():
        fitted = [truncate(f"`{c}`", cell).alias(c) if kind == "string" else F.col(f"`{c}`") for c, kind in df.dtypes]
        df.select(*fitted).write.mode("overwrite").parquet(f"{path}/{name}")


def by_category(regulations: DataFrame, path: str) -> None:
    """The mapping workbook: one folder for each category; a single default row where there is none."""
    spare = regulations.sparkSession.createDataFrame([(None, "II")], "doc_id bigint, category string")
    some = regulations.limit(1).select(F.lit(1).alias("one"))
    default = spare.join(some, F.lit(True), "left_anti")
    regulations.unionByName(default, allowMissingColumns=True).write.mode("overwrite").partitionBy("category").parquet(path)


def error_report(errors: DataFrame, path: str) -> None:
    """Lines of text: file, kind and message."""
    errors.select(F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in errors.columns]).alias("value")).write.mode("overwrite").text(path)


def metrics_json(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Feedback and error logs only grow."""
    rows.write.mode("append").parquet(path)
