"""Sessions, errors, cache entries, tables and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import metrics as M
from lexmill.operators import tables as G
from lexmill.plans.registry import query, table

NOW = "2024-01-25 00:00:00"
_S = "s AS (SELECT 's' || (event_id % 4000) AS session_id, 'file' || (user_id % 50) || '.pdf' AS file_name, event_type, ts, (event_id % 400)::DOUBLE AS processing_time, round(((event_id * 37) % 101) / 100.0::DOUBLE, 2) AS quality_score, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, coalesce(CAST(json_extract_string(props, '$.k') AS INT), 0) AS warnings, event_id FROM events)"
_C = "c AS (SELECT sha256('doc:' || (event_id % 3000) || ':' || event_type) AS key, event_type AS data_type, (event_id * 13) % 5000 AS size, ts AS last_accessed, CASE WHEN event_id % 4 > 0 THEN ts + to_days((event_id % 20)::INT) END AS expires_at, event_id FROM events)"


def _s(spark, sf):
    return M.sessions(table(spark, sf, "events"))


def _c(spark, sf):
    return M.cache_entries(table(spark, sf, "events"))


@query("c45_w24_session_records", f"WITH {_S} SELECT status, file_name, count(*) AS n, sum(warnings)::BIGINT AS warnings, round(avg(quality_score), 6) AS mean_quality FROM s GROUP BY ALL")
def c45(spark, sf):
    return _s(spark, sf).groupBy("status", "file_name").agg(F.count("*").alias("n"), F.sum("warnings").alias("warnings"), F.round(F.avg("quality_score"), 6).alias("mean_quality"))


@query("k9_k10_keyed_upsert", f"WITH {_S} SELECT session_id, file_name, event_id, status FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1")
def k9(spark, sf):
    return M.upsert(_s(spark, sf)).select("session_id", "file_name", "event_id", "status")


@query("a10_a12_x10_system_metrics", f"WITH {_S} SELECT count(*) AS n, count(*) FILTER (status = 'success') AS n_success, round(coalesce(avg(processing_time), 0), 6) AS mean_time, round(coalesce(avg(quality_score), 0), 6) AS mean_quality, round(coalesce(avg(warnings), 0), 6) AS mean_warnings FROM s WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS")
def a10(spark, sf):
    return M.system_metrics(_s(spark, sf), NOW, 7)


@query("a11_top_errors", f"WITH {_S} SELECT file_name, warnings, count(*) AS n FROM s WHERE status = 'failed' GROUP BY ALL ORDER BY n DESC, file_name, warnings LIMIT 10")
def a11(spark, sf):
    return _s(spark, sf).where("status = 'failed'").groupBy("file_name", "warnings").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_name", "warnings").limit(10)


_CUR, _PRE = f"ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS", f"ts BETWEEN TIMESTAMP '{NOW}' - INTERVAL 14 DAYS AND TIMESTAMP '{NOW}' - INTERVAL 7 DAYS"


@query("a13_a14_j12_trends", f"WITH {_S}, m AS (SELECT avg(processing_time) FILTER ({_CUR}) AS ta, avg(processing_time) FILTER ({_PRE}) AS tb, avg(quality_score) FILTER ({_CUR}) AS qa, avg(quality_score) FILTER ({_PRE}) AS qb, avg((status = 'success')::INT) FILTER ({_CUR}) AS oa, avg((status = 'success')::INT) FILTER ({_PRE}) AS ob, count(*) FILTER ({_CUR}) AS na, count(*) FILTER ({_PRE}) AS nb FROM s) SELECT round(CASE WHEN tb > 0 THEN (ta - tb) / tb * 100 ELSE 0 END, 6) AS time_change, round(CASE WHEN qb > 0 THEN (qa - qb) / qb * 100 ELSE 0 END, 6) AS quality_change, round(CASE WHEN nb > 0 THEN (na - nb)::DOUBLE / nb * 100 ELSE 0 END, 6) AS throughput_change, round(coalesce((oa - ob) * 100, 0), 6) AS success_points FROM m")
def a13(spark, sf):
    return M.trends(_s(spark, sf), NOW, 7)


@query("a15_quality_histogram", f"WITH {_S} SELECT CASE WHEN quality_score >= 0.9 THEN 'excellent' WHEN quality_score >= 0.8 THEN 'good' WHEN quality_score >= 0.7 THEN 'acceptable' WHEN quality_score >= 0.5 THEN 'poor' ELSE 'failed' END AS band, count(*) AS n FROM s GROUP BY ALL")
def a15(spark, sf):
    return M.histogram(_s(spark, sf), "quality_score", M.QUALITY_BANDS, "failed")


@query("a16_time_histogram", f"WITH {_S} SELECT CASE WHEN processing_time >= 300 THEN 'very slow' WHEN processing_time >= 120 THEN 'slow' WHEN processing_time >= 60 THEN 'normal' WHEN processing_time >= 30 THEN 'fast' ELSE 'very fast' END AS band, count(*) AS n FROM s GROUP BY ALL")
def a16(spark, sf):
    return M.histogram(_s(spark, sf), "processing_time", M.TIME_BANDS, "very fast")


@query("a17_report", f"WITH {_S}, m AS (SELECT count(*) AS n, count(*) FILTER (status = 'failed') AS e, avg(processing_time) AS t, avg(quality_score) AS q FROM s WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 1 DAYS), h AS (SELECT *, 100 - CASE WHEN e > 10 THEN 20 WHEN e > 5 THEN 10 ELSE 0 END - CASE WHEN n > 0 AND e::DOUBLE / n > 0.15 THEN 15 ELSE 0 END AS health FROM m) SELECT n, e AS n_errors, health::INT AS health, CASE WHEN health >= 90 THEN 'excellent' WHEN health >= 75 THEN 'good' WHEN health >= 60 THEN 'fair' ELSE 'poor' END AS band, array_to_string(list_filter([CASE WHEN t > 120 THEN 'reduce processing time' END, CASE WHEN q < 0.7 THEN 'improve extraction quality' END, CASE WHEN e > 10 THEN 'look into errors' END], lambda x: x IS NOT NULL), '; ') AS advice FROM h")
def a21(spark, sf):
    m = _s(spark, sf).where(M._since(NOW, 1)).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "failed").alias("n_errors"), F.avg("processing_time").alias("t"), F.avg("quality_score").alias("q"))
    e = F.col("n_errors")
    health = (100 - F.when(e > 10, 20).when(e > 5, 10).otherwise(0) - F.when((F.col("n") > 0) & (e / F.col("n") > 0.15), 15).otherwise(0)).cast("int")
    h = m.withColumn("health", health)
    advice = F.array_compact(F.array(F.when(F.col("t") > 120, "reduce processing time"), F.when(F.col("q") < 0.7, "improve extraction quality"), F.when(e > 10, "look into errors")))
    return h.select("n", "n_errors", "health", F.when(F.col("health") >= 90, "excellent").when(F.col("health") >= 75, "good").when(F.col("health") >= 60, "fair").otherwise("poor").alias("band"), F.array_join(advice, "; ").alias("advice"))


@query("a18_cache_stats", f"WITH {_C} SELECT data_type, count(*) AS n, sum(size)::BIGINT AS size, round(avg(size), 6) AS mean_size, count(*) FILTER (expires_at IS NOT NULL AND expires_at <= TIMESTAMP '{NOW}') AS n_expired FROM c GROUP BY ALL")
def a18(spark, sf):
    return M.cache_stats(_c(spark, sf), NOW)


@query("a19_a20_error_summary", f"WITH {_S} SELECT event_type, count(*) AS n, count(DISTINCT file_name) AS n_files, round(count(*) FILTER (warnings < 50)::DOUBLE / count(*), 6) AS success_rate FROM s WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS GROUP BY ALL")
def a19(spark, sf):
    return _s(spark, sf).where(M._since(NOW, 1)).groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("file_name").alias("n_files"), F.round(F.count_if(F.col("warnings") < 50) / F.count("*"), 6).alias("success_rate"))


@query("a19_problem_files", f"WITH {_S} SELECT file_name, count(*) AS n, count(*) FILTER (warnings > 50) AS n_critical FROM s WHERE status = 'failed' GROUP BY ALL ORDER BY n_critical DESC, n DESC, file_name LIMIT 5")
def a19_files(spark, sf):
    return M.problem_files(_s(spark, sf))


@query("p7_circuit_breaker", f"WITH {_S}, e AS (SELECT event_id, file_name, sum((warnings > 50)::INT) OVER (PARTITION BY file_name ORDER BY ts, event_id ROWS 19 PRECEDING)::BIGINT AS severe FROM s WHERE status = 'failed') SELECT *, severe > 10 AS open FROM e")
def p7(spark, sf):
    return M.breaker(_s(spark, sf))


@query("p8_valid_entries", f"WITH {_C} SELECT key, data_type, event_id FROM c WHERE expires_at IS NULL OR TIMESTAMP '{NOW}' < expires_at")
def p8(spark, sf):
    return M.valid_entries(_c(spark, sf), NOW).select("key", "data_type", "event_id")


@query("p9_purge_errors", f"WITH {_S} SELECT event_id, file_name FROM s WHERE status = 'failed' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS")
def p9(spark, sf):
    return _s(spark, sf).where("status = 'failed'").where(F.col("ts") >= F.expr(f"timestamp'{NOW}' - interval 24 hours")).select("event_id", "file_name")


@query("x13_w23_lru_eviction", f"WITH {_C}, r AS (SELECT *, row_number() OVER (PARTITION BY data_type ORDER BY last_accessed, event_id) AS place, count(*) OVER (PARTITION BY data_type) AS n FROM c) SELECT data_type, event_id FROM r WHERE place <= greatest(n // 4, 1)")
def x13(spark, sf):
    return M.evicted(_c(spark, sf))


_GRID = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN [['Ratio', ' Seuil  min ', ''], ['a', '8,5', NULL], [NULL, ' ', ''], ['total', '12', '']] WHEN 1 THEN [['1', '2'], [o_orderstatus, '7']] ELSE [['Amende', 'x', 'Date'], ['10', o_orderstatus, '2020'], ['20', '', '2021']] END AS grid FROM orders"
_CLEAN = f"""g0 AS ({_GRID}), g1 AS (SELECT id, list_filter(list_transform(grid, lambda r: list_transform(r, lambda x: trim(regexp_replace(coalesce(x, ''), '\\s+', ' ', 'g')))), lambda r: len(list_filter(r, lambda x: x <> '')) > 0) AS g FROM g0),
g2 AS (SELECT id, g, list_filter(range(1, len(g[1]) + 1), lambda i: len(list_filter(g, lambda r: r[i] <> '')) > 0) AS u FROM g1), g3 AS (SELECT id, list_transform(g, lambda r: list_transform(u, lambda i: coalesce(r[i], ''))) AS g FROM g2),
g4 AS (SELECT *, len(list_filter(g[1], lambda x: x = '' OR regexp_matches(x, '^[0-9.,]+$'))) = 0 AS named FROM g3),
clean AS (SELECT id, CASE WHEN named THEN g[1] ELSE list_transform(range(1, len(g[1]) + 1), lambda i: 'Column_' || i) END AS header, CASE WHEN named THEN g[2:] ELSE g END AS cells FROM g4)"""


def _grids(spark, sf):
    spark_grid = _GRID.replace("[[", "array(array(").replace("]]", "))").replace("], [", "), array(").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`")
    return G.clean_grid(spark.sql(spark_grid))


@query("t20_t21_clean_grid", f"WITH {_CLEAN} SELECT id, array_to_string(header, '|') AS header, array_to_string(list_transform(cells, lambda r: array_to_string(r, '|')), '/') AS cells FROM clean")
def t20(spark, sf):
    return _grids(spark, sf).select("id", F.array_join("header", "|").alias("header"), F.array_join(F.transform("cells", lambda r: F.array_join(r, "|")), "/").alias("cells"))


_KIND = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(array_to_string(header, ' ')), '{t}')" for t in terms) + f" THEN '{k}'" for k, terms in G.KINDS) + " ELSE 'other' END"


@query("a30_table_summary", f"WITH {_CLEAN} SELECT id, {_KIND} AS kind, len(cells)::INT AS n_rows, len(header)::INT AS n_columns, len(list_filter(range(1, len(header) + 1), lambda i: len(list_filter(cells, lambda r: NOT regexp_matches(r[i], '^[0-9.,]+$'))) = 0))::INT AS n_numeric, len(list_filter(cells, lambda r: len(list_filter(r, lambda x: contains(lower(x), 'total'))) > 0)) > 0 AS has_total FROM clean")
def a30(spark, sf):
    return G.table_summary(_grids(spark, sf))


_ANSWER = "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN concat('Voici:', chr(10), '```json', chr(10), '{completeness_score: ', CAST(o_custkey % 100 AS STRING_T), ', \"note\": \"ok\", }', chr(10), '```') WHEN 1 THEN concat('{\"completeness_score\": ', CAST(o_custkey % 90 AS STRING_T), '} fin') WHEN 2 THEN concat('res {\"completeness_score\": ', CAST(o_custkey % 80 AS STRING_T), ',') WHEN 3 THEN 'aucun objet' ELSE concat('{\"completeness_score\": 7, // note', chr(10), '\"b\": ', CAST(o_custkey % 9 AS STRING_T), '}') END AS answer FROM orders"


@query("g32_json_objects", f"WITH a AS ({_ANSWER.replace('STRING_T', 'VARCHAR')}) SELECT id, CASE id % 5 WHEN 0 THEN CAST(regexp_extract(answer, 'score: ([0-9]+)', 1) AS INT) WHEN 3 THEN NULL ELSE CAST(regexp_extract(answer, 'score\": ([0-9]+)', 1) AS INT) END AS score, id % 5 <> 3 AS parsed FROM a")
def g32(spark, sf):
    a = spark.sql(_ANSWER.replace("STRING_T", "STRING").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))
    j = a.select("id", G.repair_json(F.col("answer")).alias("j"))
    return j.select("id", F.get_json_object("j", "$.completeness_score").cast("int").alias("score"), F.col("j").isNotNull().alias("parsed"))
