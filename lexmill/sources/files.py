"""Files as a source: directory and list scans, admission checks and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 200 * 1024 * 1024


def scan_directory(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of files that end in .pdf, in any case."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", str(recursive).lower()).load(path)


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(paths)


def admit(files: DataFrame, max_bytes: int = MAX_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files that are admitted, and (path, reason) of the others. Size and name are tested before any content is read."""
    reason = (
        F.when(~F.lower("path").endswith(".pdf"), "not a PDF name")
        .when(F.col("length") > max_bytes, "too large")
        .when(F.col("length") == 0, "empty")
        .when(F.substring(F.col("content"), 1, 5) != F.lit(b"%PDF-"), "no PDF header")
    )
    judged = files.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null").select("path", "reason")


def metadata(files: DataFrame) -> DataFrame:
    """(path, file_name, file_size, file_hash, pdf_version): what can be told without a PDF library."""
    head = F.substring(F.col("content"), 1, 8).cast("string")
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("file_size"), F.sha2(F.col("content"), 256).alias("file_hash"), F.regexp_extract(head, r"%PDF-(\d\.\d)", 1).alias("pdf_version"))


def plain_pages(files: DataFrame, extract=None) -> DataFrame:
    """(path, page, text). ``extract`` takes bytes and gives a list of page texts; by default literal strings of uncompressed text operators are read."""
    import re

    import pandas as pd

    def simple(content: bytes) -> list[str]:
        out = []
        for block in re.findall(rb"BT(.*?)ET", content, re.S):
            strings = re.findall(rb"\(((?:[^()\\]|\\.)*)\)\s*Tj", block)
            out.append(" ".join(re.sub(rb"\\(.)", rb"\1", s).decode("latin-1") for s in strings))
        return out

    take = extract or simple

    def run(batches):
        for pdf in batches:
            rows = [(p, i + 1, t) for p, c in zip(pdf["path"], pdf["content"], strict=True) for i, t in enumerate(take(c))]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")
