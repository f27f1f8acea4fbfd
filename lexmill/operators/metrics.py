"""Operational metrics: sessions, errors, cache entries and trends. ``now`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.text import band


def sessions(events: DataFrame) -> DataFrame:
    """Processing sessions from events: one for each event, with a time, a score and a status."""
    k = F.get_json_object("props", "$.k").cast("int")
    score = F.round(F.pmod(F.col("event_id") * 37, F.lit(101)) / 100.0, 2)
    return events.select(
        F.concat(F.lit("s"), F.pmod("event_id", F.lit(4000))).alias("session_id"),
        F.concat(F.lit("file"), F.pmod("user_id", F.lit(50)), F.lit(".pdf")).alias("file_name"),
        "event_type",
        F.col("ts").alias("ts"),
        F.pmod("event_id", F.lit(400)).cast("double").alias("processing_time"),
        score.alias("quality_score"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"),
        F.coalesce(k, F.lit(0)).alias("warnings"),
        "event_id",
    )


def upsert(rows: DataFrame, key: str = "session_id") -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return rows.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def _since(now: str, days: int) -> Column:
    return F.col("ts") > F.expr(f"timestamp'{now}' - interval {days} days")


def system_metrics(rows: DataFrame, now: str, days: int) -> DataFrame:
    """Counts and means of the trailing window, in one row."""
    return rows.where(_since(now, days)).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("status") == "success").alias("n_success"),
        F.round(F.coalesce(F.avg("processing_time"), F.lit(0.0)), 6).alias("mean_time"),
        F.round(F.coalesce(F.avg("quality_score"), F.lit(0.0)), 6).alias("mean_quality"),
        F.round(F.coalesce(F.avg("warnings"), F.lit(0.0)), 6).alias("mean_warnings"),
    )


def trends(rows: DataFrame, now: str, days: int) -> DataFrame:
    """Changes against the window before, in percent (success in points), in one pass; 0 where a mean is missing."""
    current = _since(now, days)
    previous = F.col("ts").between(F.expr(f"timestamp'{now}' - interval {2 * days} days"), F.expr(f"timestamp'{now}' - interval {days} days"))
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    ok = (F.col("status") == "success").cast("int")
    agg = rows.agg(*[mean(c, w).alias(f"{c}_{n}") for c in ("processing_time", "quality_score") for n, w in (("a", current), ("b", previous))], F.avg(F.when(current, ok)).alias("ok_a"), F.avg(F.when(previous, ok)).alias("ok_b"), F.count_if(current).alias("n_a"), F.count_if(previous).alias("n_b"))
    change = lambda a, b: F.round(F.when(F.col(b) > 0, (F.col(a) - F.col(b)) / F.col(b) * 100).otherwise(0.0), 6)
    return agg.select(change("processing_time_a", "processing_time_b").alias("time_change"), change("quality_score_a", "quality_score_b").alias("quality_change"), change("n_a", "n_b").alias("throughput_change"), F.round(F.coalesce((F.col("ok_a") - F.col("ok_b")) * 100, F.lit(0.0)), 6).alias("success_points"))


QUALITY_BANDS = [(0.9, "excellent"), (0.8, "good"), (0.7, "acceptable"), (0.5, "poor")]
TIME_BANDS = [(300.0, "very slow"), (120.0, "slow"), (60.0, "normal"), (30.0, "fast")]


def histogram(rows: DataFrame, column: str, cuts: list[tuple[float, str]], rest: str) -> DataFrame:
    return rows.groupBy(band(column, cuts, rest).alias("band")).agg(F.count("*").alias("n"))


def problem_files(rows: DataFrame, most: int = 5) -> DataFrame:
    """The files of most errors; ties by name."""
    e = rows.where("status = 'failed'").groupBy("file_name").agg(F.count("*").alias("n"), F.count_if(F.col("warnings") > 50).alias("n_critical"))
    return e.orderBy(F.desc("n_critical"), F.desc("n"), "file_name").limit(most)


def breaker(rows: DataFrame, most: int = 20, limit: int = 10) -> DataFrame:
    """For each error, whether more than ``limit`` of the last ``most`` errors of its user's group were severe: the circuit is open."""
    w = Window.partitionBy("file_name").orderBy("ts", "event_id").rowsBetween(-(most - 1), 0)
    e = rows.where("status = 'failed'")
    return e.withColumn("severe", F.sum(F.when(F.col("warnings") > 50, 1).otherwise(0)).over(w)).select("event_id", "file_name", "severe", (F.col("severe") > limit).alias("open"))


def model_breaker(errors: DataFrame, now: str, most: int = 20) -> DataFrame:
    """(n_recent, n_truncated, use_model) of errors (event_id, ts, fn, msg): of the last ``most`` errors those of the model count, by name; the five minutes bind the extraction of articles alone.

    More than ten of them, or more than five that mention a truncated answer, turn the model off.
    """
    last = errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(most)
    named = F.col("fn").contains("AI") | F.col("fn").contains("validate_chunk") | (F.col("fn").contains("extract_articles") & (F.col("ts") > F.expr(f"timestamp'{now}' - interval 300 seconds")))
    a = last.where(named).agg(F.count("*").alias("n_recent"), F.count_if(F.col("msg").rlike("completeness_score|articles")).alias("n_truncated"))
    return a.withColumn("use_model", ~((F.col("n_recent") > 10) | (F.col("n_truncated") > 5)))


def cache_entries(events: DataFrame) -> DataFrame:
    """Cache entries from events: a key, a kind, a size, an expiry and the last access."""
    return events.select(
        F.sha2(F.concat_ws(":", F.lit("doc"), F.pmod("event_id", F.lit(3000)), F.col("event_type")), 256).alias("key"),
        F.col("event_type").alias("data_type"),
        F.pmod(F.col("event_id") * 13, F.lit(5000)).alias("size"),
        F.col("ts").alias("last_accessed"),
        F.when(F.pmod("event_id", F.lit(4)) > 0, F.col("ts") + F.expr("make_dt_interval(cast(event_id % 20 as int))")).alias("expires_at"),
        "event_id",
    )


def valid_entries(entries: DataFrame, now: str) -> DataFrame:
    return entries.where(F.col("expires_at").isNull() | (F.lit(now).cast("timestamp") < F.col("expires_at")))


def cache_stats(entries: DataFrame, now: str) -> DataFrame:
    expired = F.col("expires_at").isNotNull() & (F.col("expires_at") <= F.lit(now).cast("timestamp"))
    return entries.groupBy("data_type").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.round(F.avg("size"), 6).alias("mean_size"), F.count_if(expired).alias("n_expired"))


def evicted(entries: DataFrame, share: int = 4) -> DataFrame:
    """The least recently used 1/share of the entries of each kind, one at least."""
    w = Window.partitionBy("data_type")
    order = w.orderBy("last_accessed", "event_id")
    e = entries.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(w))
    return e.where(F.col("place") <= F.greatest(F.floor(F.col("n") / share), F.lit(1))).select("data_type", "event_id")
