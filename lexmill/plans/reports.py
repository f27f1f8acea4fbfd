"""Reports: references, themes, tables, categories, errors, health, checklists, answers and workbooks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.functions import rules as R
from lexmill.functions import text as T
from lexmill.operators import elements as E
from lexmill.operators import forms as O
from lexmill.operators import graph as G
from lexmill.operators import metrics as M
from lexmill.operators import tables as TB
from lexmill.plans import forms as _forms  # noqa: F401  its queries are registered first
from lexmill.plans.graph import _BASE, _DEG, _REC, _links, _refs, _vertices
from lexmill.plans.legal import HIER
from lexmill.plans.metrics import _C, _S, NOW, _c, _s
from lexmill.plans.registry import ELEM, REFS, SQL, query, quoted, sql_any, table
from lexmill.plans.rules import _EVENT, _TYPES, FORMS, _C31, _error_log
from lexmill.plans.scores import _ART, _DOC, _measures, article_measures, document_quality, elements_of, graded
from lexmill.sources.corpus import reg_corpus
from lexmill.sources.forms import forms_corpus

# --- references


@query("a23_reference_lists", f"{REFS} SELECT doc_id, kind, count(*) AS n, string_agg(src || '-' || dst, ', ' ORDER BY src, dst) AS pairs FROM refs GROUP BY doc_id, kind")
def a23(spark, sf):
    r = _refs(spark, sf)[1]
    pairs = F.transform(F.array_sort(F.collect_list(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")))), lambda x: F.concat_ws("-", x["a"], x["b"]))
    return r.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.array_join(pairs, ", ").alias("pairs"))


@query("a24_top_referencing", f"{_BASE}, {_DEG} SELECT doc_id, v, n_out FROM deg ORDER BY n_out DESC, doc_id, v LIMIT 10")
def a24(spark, sf):
    return G.degrees(_links(spark, sf)).orderBy(F.desc("n_out"), "doc_id", "v").limit(10).select("doc_id", "v", "n_out")


@query("a29_w9_edge_list", f"{_BASE} SELECT doc_id, count(*) AS n_edges, string_agg(src || '-' || dst, ', ' ORDER BY src, dst) AS edges FROM pair GROUP BY doc_id")
def a29(spark, sf):
    own = F.transform(F.filter("refs", lambda x: x["dst"] != F.col("v")), lambda x: F.struct(F.col("v").alias("a"), x["dst"].alias("b")))
    e = _links(spark, sf).select("doc_id", own.alias("e")).groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("e"))).alias("e")).where(F.size("e") > 0)
    return e.select("doc_id", F.size("e").cast("bigint").alias("n_edges"), G.listed(F.col("e")).alias("edges"))


_CYC = "cyp AS (SELECT doc_id, [src, dst] AS p FROM pair WHERE dst > src UNION ALL SELECT cyp.doc_id, list_append(p, e.dst) FROM cyp JOIN pair e ON e.doc_id = cyp.doc_id AND e.src = p[len(p)] WHERE e.dst > p[1] AND NOT list_contains(p, e.dst)), cy AS (SELECT cyp.doc_id, count(*) AS cycles FROM cyp JOIN pair e ON e.doc_id = cyp.doc_id AND e.src = p[len(p)] AND e.dst = p[1] GROUP BY cyp.doc_id)"
_CHN = "chp AS (SELECT doc_id, [src, dst] AS p FROM pair UNION ALL SELECT chp.doc_id, list_append(p, e.dst) FROM chp JOIN pair e ON e.doc_id = chp.doc_id AND e.src = p[len(p)] WHERE len(p) < 6 AND NOT list_contains(p, e.dst)), ch AS (SELECT doc_id, count(*) AS chains FROM chp WHERE len(p) > 2 GROUP BY doc_id)"


@query("a28_n10_compliance_scores", f"""{_REC}, {_CYC}, {_CHN}, n AS (SELECT doc_id, count(*) AS n FROM vert GROUP BY doc_id), m AS (SELECT doc_id, count(DISTINCT x) AS touched FROM (SELECT doc_id, src AS x FROM refs UNION ALL SELECT doc_id, dst FROM refs) GROUP BY doc_id), k AS (SELECT doc_id, src, dst, count(DISTINCT kind) AS kinds FROM refs GROUP BY ALL), c AS (SELECT doc_id, avg((kinds = 1)::INT) * 100 AS consistency, count(*) FILTER (kinds > 1) AS conflicts FROM k GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS e FROM pair GROUP BY doc_id)
SELECT n.doc_id, coalesce(cycles, 0) AS cycles, coalesce(chains, 0) AS chains, coalesce(conflicts, 0) AS conflicts, round((coalesce(touched, 0) / n.n * 100)::DOUBLE, 6) AS completeness, round(coalesce(consistency, 100)::DOUBLE, 6) AS consistency, round(least(100, coalesce(e, 0) / n.n * 20 + coalesce(cycles, 0) * 10 + coalesce(chains, 0) * 5)::DOUBLE, 6) AS complexity FROM n LEFT JOIN m USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN cy USING (doc_id) LEFT JOIN ch USING (doc_id)""")
def a28(spark, sf):
    a, r = _refs(spark, sf)
    r = r.persist()
    e = G.pairs(r)
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    touched = r.select("doc_id", F.explode(F.array("src", "dst")).alias("x")).groupBy("doc_id").agg(F.countDistinct("x").alias("touched"))
    kinds = r.groupBy("doc_id", "src", "dst").agg(F.countDistinct("kind").alias("kinds")).groupBy("doc_id").agg((F.avg((F.col("kinds") == 1).cast("int")) * 100).alias("consistency"), F.count_if(F.col("kinds") > 1).alias("conflicts"))
    j = count(_vertices(a), "n")
    for part in (touched, kinds, count(e, "e"), count(G.cycles(r), "cycles"), count(G.chains(r), "chains")):
        j = j.join(part, "doc_id", "left")
    j = j.na.fill(0, ["touched", "e", "cycles", "chains", "conflicts"]).na.fill(100.0, ["consistency"])
    complexity = F.least(F.lit(100.0), F.col("e") / F.col("n") * 20 + F.col("cycles") * 10 + F.col("chains") * 5)
    return j.select("doc_id", "cycles", "chains", "conflicts", F.round(F.col("touched") / F.col("n") * 100, 6).alias("completeness"), F.round("consistency", 6).alias("consistency"), F.round(complexity, 6).alias("complexity"))


# --- sections, tables, structure
_TH = "list_sort(list_distinct(list_filter(flatten(list([" + ", ".join(f"CASE WHEN {sql_any('body', ts)} THEN {quoted(k)} END" for k, ts in L.THEMES.items()) + "])), lambda x: x IS NOT NULL)))"


@query("a26_section_themes", f"{HIER} SELECT doc_id, parent_seq::INT AS seq, array_to_string({_TH}, ',') AS themes FROM tree WHERE parent_seq IS NOT NULL GROUP BY doc_id, parent_seq")
def a26(spark, sf):
    h = E.hierarchy(reg_corpus(spark, sf)).where("parent_seq is not null")
    found = F.array_sort(F.array_distinct(F.flatten(F.collect_list(T.themes("body")))))
    return h.groupBy("doc_id", F.col("parent_seq").alias("seq")).agg(F.array_join(found, ",").alias("themes"))


@query("a30_table_flags", f"{FORMS}, l AS (SELECT doc_id, regexp_extract(txt, '((?:\\n\\|[^\\n]*)+)', 1) AS t FROM forms) SELECT doc_id, len(string_split(trim(t, chr(10)), chr(10)))::INT AS n_rows, contains(t, '%') AS has_percentages, regexp_matches(t, 'FCFA|EUR|USD') AS has_currency, regexp_matches(lower(t), 'total|somme') AS has_totals FROM l WHERE t <> ''")
def a30(spark, sf):
    t = O.text_tables(forms_corpus(spark, sf)).where("indicator = 0")
    has = lambda p: F.lower("content").rlike(p)
    return t.select("doc_id", F.col("n_lines").alias("n_rows"), has("%").alias("has_percentages"), F.col("content").rlike("FCFA|EUR|USD").alias("has_currency"), has("total|somme").alias("has_totals"))


_FIVE = ["header", "preamble", "decide", "articles", "signature"]


@query("a31_w8_structure_insight", f"WITH p AS ({SQL['g18_document_parts']}), g AS ({SQL['g20_typed_references']}), r AS (SELECT doc_id, list(reference ORDER BY pos, reference)[1:5] AS r FROM g GROUP BY doc_id) SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {x} IS NULL THEN '{x}' END" for x in _FIVE) + "], lambda x: x IS NOT NULL), ', ') AS missing, coalesce(array_to_string(r, '; '), '') AS \"references\" FROM p LEFT JOIN r USING (doc_id)")
def a31(spark, sf):
    """The first five references, and which of the five parts are missing."""
    f = forms_corpus(spark, sf)
    refs = O.regulatory_references(f).groupBy("doc_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "reference"))), lambda x: x["reference"]), 1, 5).alias("r"))
    parts = O.document_parts("txt")
    gone = F.array_except(F.array(*map(F.lit, parts)), F.array_compact(F.array(*[F.when(v.isNotNull(), k) for k, v in parts.items()])))
    return f.select("doc_id", F.array_join(gone, ", ").alias("missing")).join(refs, "doc_id", "left").select("doc_id", "missing", F.coalesce(F.array_join("r", "; "), F.lit("")).alias("references"))


_NUM34 = ["I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI"]


@query("a34_detected_categories", f"""{FORMS}, c AS (SELECT upper(title || ' ' || summary) AS x, {_C31} AS category FROM forms), d AS (SELECT {', '.join(rf"bool_or(regexp_matches(x, '\b{n}\b[\s.]')) AS {n}" for n in _NUM34)} FROM c), s AS (SELECT unnest([{', '.join(f"CASE WHEN {n} THEN '{n}' END" for n in _NUM34)}]) AS category, unnest(range(1, 12)) AS place FROM d), g AS (SELECT category, count(*) AS n FROM c GROUP BY category)
SELECT g.category, n, s.category IS NOT NULL AS detected FROM g LEFT JOIN s ON s.category = g.category""")
def a34(spark, sf):
    c = forms_corpus(spark, sf).select(F.upper(F.concat_ws(" ", "title", "summary")).alias("x"), R.numeral_category("title", "summary", F.lit("II")).alias("category"))
    found = c.agg(*[F.bool_or(F.col("x").rlike(rf"\b{n}\b[\s.]")).alias(n) for n in _NUM34]).select(F.explode(F.array_compact(F.array(*[F.when(F.col(n), n) for n in _NUM34]))).alias("category"), F.lit(True).alias("detected"))
    return c.groupBy("category").agg(F.count("*").alias("n")).join(F.broadcast(found), "category", "left").select("category", "n", F.coalesce("detected", F.lit(False)).alias("detected"))


# --- errors and health
_LOG = f"l AS (SELECT e.*, ts, CASE WHEN error_type IN ('FileNotFoundError', 'PermissionError') THEN 'HIGH' WHEN error_type = 'MemoryError' THEN 'CRITICAL' WHEN error_type IN ('JSONDecodeError', 'KeyError', 'ValueError') THEN 'LOW' ELSE 'MEDIUM' END AS severity, e.event_id % 3 = 0 AS recovered, 'file' || (user_id % 50) || '.pdf' AS file_name FROM ({_EVENT}) e JOIN events USING (event_id))"
_DAY = f"ts > TIMESTAMP '{NOW}' - INTERVAL 24 HOURS"


def _log(spark, sf):
    u = table(spark, sf, "events").select("event_id", F.concat(F.lit("file"), F.pmod("user_id", F.lit(50)), F.lit(".pdf")).alias("file_name"))
    return _error_log(spark, sf).join(u, "event_id").withColumn("severity", R.lookup("error_type", R.SEVERITIES, "MEDIUM")).withColumn("recovered", F.col("event_id") % 3 == 0)


@query("a19_severity_histogram", f"WITH {_LOG} SELECT severity, count(*) AS n FROM l WHERE {_DAY} GROUP BY severity")
def a19(spark, sf):
    return _log(spark, sf).where(M._since(NOW, 1)).groupBy("severity").agg(F.count("*").alias("n"))


_ADVICE19 = [("FileNotFoundError", 2, "check paths and permissions"), ("MemoryError", 0, "use smaller chunks or more memory"), ("ConnectionError", 3, "check the network and limits"), ("UnicodeDecodeError", 1, "use OCR for scanned documents"), ("TimeoutError", 2, "allow more time or use smaller batches")]


@query("a19_recommendations", f"WITH {_LOG}, a AS (SELECT " + ", ".join(f"count(*) FILTER (error_type = '{t}') > {n} AS x{i}" for i, (t, n, _) in enumerate(_ADVICE19)) + f", coalesce(avg(recovered::INT), 0) < 0.5 AS low FROM l WHERE {_DAY}) SELECT array_to_string(list_filter([" + ", ".join(f"CASE WHEN x{i} THEN '{m}' END" for i, (_, _, m) in enumerate(_ADVICE19)) + ", CASE WHEN low THEN 'review error handling' END], lambda x: x IS NOT NULL), '; ') AS advice FROM a")
def a19_advice(spark, sf):
    a = _log(spark, sf).where(M._since(NOW, 1)).agg(*[(F.count_if(F.col("error_type") == t) > n).alias(f"x{i}") for i, (t, n, _) in enumerate(_ADVICE19)], (F.coalesce(F.avg(F.col("recovered").cast("int")), F.lit(0.0)) < 0.5).alias("low"))
    return a.select(F.array_join(F.array_compact(F.array(*[F.when(F.col(f"x{i}"), m) for i, (_, _, m) in enumerate(_ADVICE19)], F.when(F.col("low"), "review error handling"))), "; ").alias("advice"))


@query("a20_last_errors", f"WITH {_LOG} SELECT event_id, error_type, severity FROM l ORDER BY ts DESC, event_id DESC LIMIT 5")
def a20(spark, sf):
    return _log(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(5).select("event_id", "error_type", "severity")


@query("a21_w20_health", f"""WITH {_LOG}, {_C}, d AS (SELECT * FROM l WHERE {_DAY}), t AS (SELECT error_type, avg(recovered::INT) AS r FROM d GROUP BY error_type), f AS (SELECT count(DISTINCT file_name) AS files, count(*) AS n FROM d), h AS (SELECT sum(event_id % 4)::DOUBLE / greatest(count(*), 1) AS hits FROM c),
s AS (SELECT n, 100 - CASE WHEN n > 10 THEN 20 WHEN n > 5 THEN 10 ELSE 0 END - CASE WHEN coalesce((SELECT avg(r) FROM t), 1) < 0.5 THEN 15 ELSE 0 END - CASE WHEN hits < 0.3 THEN 5 ELSE 0 END - CASE WHEN least(files, 5) > 3 THEN 10 ELSE 0 END AS score FROM f, h) SELECT n AS n_errors, score::INT AS score, CASE WHEN score >= 90 THEN 'EXCELLENT' WHEN score >= 75 THEN 'GOOD' WHEN score >= 60 THEN 'FAIR' ELSE 'POOR' END AS status FROM s""")
def a21(spark, sf):
    day = _log(spark, sf).where(M._since(NOW, 1))
    by_type = day.groupBy("error_type").agg(F.avg(F.col("recovered").cast("int")).alias("r"), F.count("*").alias("n"))
    # one row of errors, one of files, one of the cache
    rows = by_type.agg(F.coalesce(F.avg("r"), F.lit(1.0)).alias("rate"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_errors")).select(F.lit(1).alias("one"), "rate", "n_errors")
    files = day.agg(F.countDistinct("file_name").alias("files")).select(F.lit(1).alias("one"), "files")
    cache = _c(spark, sf).agg((F.sum(F.col("event_id") % 4) / F.greatest(F.count("*"), F.lit(1))).alias("hits")).select(F.lit(1).alias("one"), "hits")
    n = F.col("n_errors")
    score = 100 - F.when(n > 10, 20).when(n > 5, 10).otherwise(0) - F.when(F.col("rate") < 0.5, 15).otherwise(0) - F.when(F.col("hits") < 0.3, 5).otherwise(0) - F.when(F.least("files", F.lit(5)) > 3, 10).otherwise(0)
    s = rows.join(files, "one").join(cache, "one").withColumn("score", score.cast("int"))
    return s.select("n_errors", "score", T.band("score", [(90, "EXCELLENT"), (75, "GOOD"), (60, "FAIR")], "POOR").alias("status"))


@query("a22_daily_overview", f"WITH {_S} SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (status = 'success') AS n_success, round(avg(quality_score), 6) AS mean_quality, round(avg(processing_time), 6) AS mean_time FROM s WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS AND ts <= TIMESTAMP '{NOW}' GROUP BY ALL")
def a22(spark, sf):
    s = _s(spark, sf).where(M._since(NOW, 7) & (F.col("ts") <= F.lit(NOW).cast("timestamp")))
    return s.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success"), F.round(F.avg("quality_score"), 6).alias("mean_quality"), F.round(F.avg("processing_time"), 6).alias("mean_time"))


_FB = "f AS (SELECT 's' || (event_id % 4000) AS session_id, (event_id % 5 + 1)::INT AS rating FROM events WHERE event_type = 'purchase')"


def _feedback(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'purchase'")
    return e.select(F.concat(F.lit("s"), F.pmod("event_id", F.lit(4000))).alias("session_id"), (F.col("event_id") % 5 + 1).cast("int").alias("rating"))


@query("j11_feedback_of_sessions", f"WITH {_S}, {_FB} SELECT file_name, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM f JOIN (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id DESC) = 1) USING (session_id) GROUP BY file_name")
def j11(spark, sf):
    return _feedback(spark, sf).join(M.upsert(_s(spark, sf)).select("session_id", "file_name"), "session_id").groupBy("file_name").agg(F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("mean_rating"))


@query("a17_w27_benchmarks", f"WITH {_S}, {_FB}, m AS (SELECT avg(quality_score) AS q, avg((status = 'success')::INT) AS s, (SELECT coalesce(avg(rating), 0) / 5 FROM f) AS u FROM s WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 7 DAYS), r AS (SELECT 'ocr_quality' AS metric, q AS current, 0.95 AS target FROM m UNION ALL SELECT 'processing_success_rate', s, 0.92 FROM m UNION ALL SELECT 'user_satisfaction', u, 0.85 FROM m) SELECT metric, round(current::DOUBLE, 6) AS current, target::DOUBLE AS target, CASE WHEN current >= target THEN 'good' ELSE 'needs_improvement' END AS status FROM r")
def a17(spark, sf):
    m = _s(spark, sf).where(M._since(NOW, 7)).agg(F.avg("quality_score").alias("q"), F.avg((F.col("status") == "success").cast("int")).alias("s")).withColumn("one", F.lit(1))
    u = _feedback(spark, sf).agg((F.coalesce(F.avg("rating"), F.lit(0.0)) / 5).alias("u")).withColumn("one", F.lit(1))
    r = m.join(u, "one").select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(c).alias("current"), F.lit(t).alias("target")) for n, c, t in (("ocr_quality", "q", 0.95), ("processing_success_rate", "s", 0.92), ("user_satisfaction", "u", 0.85))])).alias("x")).select("x.*")
    return r.select("metric", F.round("current", 6).alias("current"), "target", F.when(F.col("current") >= F.col("target"), "good").otherwise("needs_improvement").alias("status"))


_FN = "CASE event_id % 4 WHEN 0 THEN 'AIValidator' WHEN 1 THEN 'validate_chunk' WHEN 2 THEN 'extract_articles' ELSE 'save' END"
_MSG = "CASE event_id % 3 WHEN 0 THEN 'bad completeness_score' WHEN 1 THEN 'articles missing' ELSE 'other' END"


@query("p7_model_breaker", f"WITH e AS (SELECT event_id, ts, {_FN} AS fn, {_MSG} AS msg FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '{NOW}'), k AS (SELECT * FROM e ORDER BY ts DESC, event_id DESC LIMIT 20), r AS (SELECT * FROM k WHERE contains(fn, 'AI') OR contains(fn, 'validate_chunk') OR (contains(fn, 'extract_articles') AND ts > TIMESTAMP '{NOW}' - INTERVAL 300 SECONDS)) SELECT count(*) AS n_recent, count(*) FILTER (regexp_matches(msg, 'completeness_score|articles')) AS n_truncated, NOT (count(*) > 10 OR count(*) FILTER (regexp_matches(msg, 'completeness_score|articles')) > 5) AS use_model FROM r")
def p7(spark, sf):
    e = table(spark, sf, "events").where(f"event_type = 'error' and ts <= timestamp'{NOW}'").selectExpr("event_id", "ts", f"{_FN} AS fn", f"{_MSG} AS msg")
    return M.model_breaker(e, NOW)


@query("p8_k11_valid_by_hash", f"WITH {_C}, v AS (SELECT key, event_id, CASE WHEN event_id % 7 = 0 THEN 'old' ELSE 'h' || (event_id % 9) END AS stored, 'h' || (event_id % 9) AS present, expires_at FROM c) SELECT key, event_id, (expires_at IS NULL OR TIMESTAMP '{NOW}' < expires_at) AND stored = present AS valid FROM v")
def p8(spark, sf):
    present = F.concat(F.lit("h"), F.col("event_id") % 9)
    v = _c(spark, sf).withColumn("present", present).withColumn("stored", F.when(F.col("event_id") % 7 == 0, "old").otherwise(present))
    fresh = F.col("expires_at").isNull() | (F.lit(NOW).cast("timestamp") < F.col("expires_at"))
    return v.select("key", "event_id", (fresh & (F.col("stored") == F.col("present"))).alias("valid"))


# --- checklist and verdict
_ARTS_ONLY = _ART[len(ELEM):]
_SIXTEEN = f"""{_DOC}{_ARTS_ONLY}, gaps AS (SELECT doc_id, count(*) AS n, count(*) FILTER (gap > 2) AS wide FROM (SELECT doc_id, n - lag(n) OVER (PARTITION BY doc_id ORDER BY n) AS gap FROM a) GROUP BY doc_id), rf AS (SELECT DISTINCT doc_id FROM arts WHERE regexp_matches(body, '(?i)conformément (?:à l''article|aux articles) [0-9]+|modifie l''article [0-9]+')),
ck AS (SELECT doc_id, coalesce(n, 0) > 0 AND wide <= 0.1 * n AS sequential, coalesce(n, 0) > 0 AS has_articles, rf.doc_id IS NOT NULL AS cites, (contains(lower(txt), 'ratio')::INT + contains(lower(txt), 'provisions')::INT + contains(lower(txt), 'capital')::INT + contains(lower(txt), 'solvabilité')::INT + contains(lower(txt), 'liquidité')::INT) >= 2 AS technical, (regexp_matches(lower(txt), 'article\\s+\\d+')::INT + contains(lower(txt), 'règlement')::INT + contains(lower(txt), 'instruction')::INT + contains(lower(txt), 'décision')::INT) >= 2 AS legal FROM reg LEFT JOIN gaps USING (doc_id) LEFT JOIN rf USING (doc_id)),
sc AS (SELECT doc_id, coalesce(sequential, false) AS sequential, has_articles, cites, technical, legal, (coalesce(sequential, false)::INT + 3 * has_articles::INT + cites::INT + technical::INT + legal::INT + 9) AS passed FROM ck), aq AS (SELECT doc_id, round(((c8 + c9 + c10 + c11) / 4 * 100)::DOUBLE, 4) AS quality FROM c8 JOIN c9 USING (doc_id)),
vd AS (SELECT doc_id, passed, round((0.4 * overall + 0.4 * quality / 100 + 0.2 * passed / 16)::DOUBLE, 6) AS score, overall, quality FROM sc JOIN o USING (doc_id) JOIN aq USING (doc_id))"""


@query("c13_c14_verdict", f"{_SIXTEEN} SELECT doc_id, passed::INT AS passed, score, score >= 0.7 AND overall >= 0.7 AND quality >= 60 AS valid FROM vd")
def c14(spark, sf):
    r = _measures(reg_corpus(spark, sf))
    language = sum((F.col("low").rlike(p).cast("int") for p in (r"article\s+[0-9]+", "règlement", "instruction", "décision")), F.lit(0))
    r = r.withColumns({"technical": (T.hits_low("low", L.TECHNICAL) >= 2).cast("int"), "legal": (language >= 2).cast("int")})
    # what is said of articles is null for the other elements, and doesn't count
    e = elements_of(r, "technical", "legal").withColumn("low", F.when(F.col("kept"), F.lower("body"))).withColumns(article_measures() | {"cites": F.size(E.cited("body")) > 0})
    kept = lambda c: F.when(F.col("kept"), F.col(c))
    order = Window.partitionBy("doc_id", "kept").orderBy("main")
    e = e.select("doc_id", "seq", "level", "main", "kept", "c3", "c5", "c6", "technical", "legal", *[kept(c).alias(c) for c in ("c9", "c10", "c11", "cites")], F.when(F.col("kept"), F.col("main") - F.lag("main").over(order)).alias("step"))
    d = graded(e, wide_steps=F.count_if(F.col("step") > 2), cites_any=F.bool_or("cites"), lo=F.min(kept("main")), hi=F.max(kept("main")), m9=F.avg("c9"), m10=F.avg("c10"), m11=F.avg("c11")).where("n_articles > 0")
    n = F.col("n_articles")
    continuity = F.greatest(F.lit(0.0), 1 - (F.col("hi") - F.col("lo") - (n - 1)) / n)
    d = d.withColumn("quality", F.round((continuity + F.col("m9") + F.col("m10") + F.col("m11")) / 4 * 100, 4))
    # hierarchy, justified levels and data structure hold where there are articles; nine checks always do
    d = d.withColumn("passed", (F.col("wide_steps") <= 0.1 * n).cast("int") + 3 + F.coalesce(F.col("cites_any").cast("int"), F.lit(0)) + F.col("technical") + F.col("legal") + 9)
    score = F.round(0.4 * F.col("overall") + 0.4 * F.col("quality") / 100 + 0.2 * F.col("passed") / 16, 6)
    return d.select("doc_id", "passed", score.alias("score"), ((score >= 0.7) & (F.col("overall") >= 0.7) & (F.col("quality") >= 60)).alias("valid"))


_MAIN = "CAST(regexp_extract(number, '^([0-9]+)', 1) AS INT)"


@query("c12_issue_list", f"{ELEM}, a AS (SELECT doc_id, {_MAIN} AS n, body FROM arts), g AS (SELECT doc_id, count(*) - count(DISTINCT n) AS repeated, min(n) AS lo, max(n) AS hi, list(DISTINCT n) AS ns, count(*) FILTER (length(trim(body)) < 100) AS short FROM a GROUP BY doc_id) SELECT doc_id, array_to_string(list_concat(CASE WHEN repeated > 0 THEN ['repeated numbers: ' || repeated] ELSE [] END, CASE WHEN len(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(ns, x))) > 0 THEN ['missing: ' || array_to_string(list_filter(range(lo, hi + 1), lambda x: NOT list_contains(ns, x))[1:5], ', ')] ELSE [] END, CASE WHEN short > 0 THEN ['short: ' || short] ELSE [] END), '; ') AS issues FROM g")
def c12(spark, sf):
    a = E.articles(reg_corpus(spark, sf)).select("doc_id", T.number_key("number")["main"].alias("n"), "body")
    g = a.groupBy("doc_id").agg((F.count("*") - F.countDistinct("n")).alias("repeated"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.collect_set("n").alias("ns"), F.count_if(F.length(F.trim("body")) < 100).alias("short"))
    gone = F.slice(F.array_except(F.sequence("lo", "hi"), "ns"), 1, 5)
    found = F.array_compact(F.array(F.when(F.col("repeated") > 0, F.concat(F.lit("repeated numbers: "), "repeated")), F.when(F.size(gone) > 0, F.concat(F.lit("missing: "), F.array_join(gone.cast("array<string>"), ", "))), F.when(F.col("short") > 0, F.concat(F.lit("short: "), "short"))))
    return g.select("doc_id", F.array_join(found, "; ").alias("issues"))


# --- answers
_REPLIES = ['"completeness_score"', "short completeness_score", '"articles": [ 1, 2', '"materiality_level": "HI', '{"completeness_score": 81, "reliability_score": 70}', "JSON: {completeness_score: 64,}", "the completeness_score: 42.5 and reliability_score = 30 as judged by a reader of the whole text", "nothing of the kind was said by anyone in this long answer of the model"]
_REPLY_WANT = [(75.0, "truncated"), (75.0, "truncated"), (None, "articles"), (None, "materiality"), (81.0, "parsed"), (64.0, "parsed"), (42.5, "key_values"), (50.0, "default")]


@query("g32_p10_answer_repair", "SELECT event_id, " + ", ".join(f"CASE event_id % 8 {' '.join(f'WHEN {i} THEN {(quoted(w[j]) if j else w[j]) if w[j] is not None else chr(78) + "ULL"}' for i, w in enumerate(_REPLY_WANT))} END AS {n}" for j, n in enumerate(("score", "method"))) + " FROM (SELECT event_id FROM events)")
def g32(spark, sf):
    a = table(spark, sf, "events").select("event_id", F.get(F.array(*map(F.lit, _REPLIES)), (F.col("event_id") % 8).cast("int")).alias("answer"))
    score, method = TB.repaired_score(F.col("answer"))
    return a.select("event_id", score.alias("score"), method.alias("method"))


# --- workbooks


@query("k1_w17_technical_workbook", f"{ELEM} SELECT 'Document_Metadata' AS sheet, count(*) AS n FROM reg UNION ALL SELECT 'Data', (SELECT count(*) FROM arts) + (SELECT count(DISTINCT doc_id) FROM arts) UNION ALL SELECT 'Validation_Results', count(*) FROM reg UNION ALL SELECT 'Statistics', 3 + count(DISTINCT CASE WHEN regexp_matches(lower(file_name), 'instruction|i-20|cbi-') THEN 1 WHEN regexp_matches(lower(file_name), 'r-20|reglement') THEN 2 WHEN regexp_matches(lower(file_name), 'code') THEN 3 WHEN regexp_matches(lower(file_name), 'decision|dec-|dcobac') THEN 4 WHEN regexp_matches(lower(file_name), 'lc-|lettre|circulaire') THEN 5 ELSE 6 END) FROM reg UNION ALL SELECT 'Summary', 1")
def k1(spark, sf):
    from lexmill.operators.workbooks import technical

    return _sizes(technical(reg_corpus(spark, sf)))


@query("k3_client_workbook", f"{ELEM} SELECT 'Executive Summary' AS sheet, 6 AS n UNION ALL SELECT 'Document Overview', (SELECT count(DISTINCT doc_id) FROM arts) UNION ALL SELECT 'Compliance Articles', (SELECT count(*) FROM arts) UNION ALL SELECT 'Priority Actions', (SELECT sum(least(n, 10))::BIGINT FROM (SELECT count(*) AS n FROM arts GROUP BY CASE WHEN {sql_any('body', L.CRITICAL)} THEN 1 WHEN {sql_any('body', L.HIGH)} THEN 2 WHEN length(body) > 500 THEN 3 ELSE 4 END)) UNION ALL SELECT 'Glossary', 6")
def k3(spark, sf):
    from lexmill.operators.workbooks import client

    return _sizes(client(reg_corpus(spark, sf)))


def _sizes(sheets):
    out = None
    for name, df in sheets.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("sheet"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("k12_k13_plain_sheets", f"{ELEM} SELECT 'articles' AS sheet, doc_id, number AS item, md5(body) AS content_hash FROM arts UNION ALL SELECT 'texts', doc_id, file_name, md5(txt) FROM reg")
def k12(spark, sf):
    r = reg_corpus(spark, sf)
    a = E.articles(r).select(F.lit("articles").alias("sheet"), "doc_id", F.col("number").alias("item"), F.md5("body").alias("content_hash"))
    return a.unionByName(r.select(F.lit("texts").alias("sheet"), "doc_id", F.col("file_name").alias("item"), F.md5("txt").alias("content_hash")))


@query("w1_whole_documents", f"{_DOC}, k AS (SELECT doc_id, count(*) AS n_articles FROM arts GROUP BY doc_id) SELECT doc_id, CASE WHEN length(txt) < 800 THEN 'rejected' ELSE 'processed' END AS state, CASE WHEN length(txt) < 800 THEN NULL ELSE coalesce(n_articles, 0) END AS n_articles, CASE WHEN length(txt) < 800 THEN NULL ELSE overall END AS quality FROM reg JOIN o USING (doc_id) LEFT JOIN k USING (doc_id)")
def w1(spark, sf):
    d = document_quality(reg_corpus(spark, sf).withColumn("fits", F.length("txt") >= 800), "fits")
    return d.select("doc_id", F.when(F.col("fits"), "processed").otherwise("rejected").alias("state"), F.when(F.col("fits"), F.col("n_articles")).alias("n_articles"), F.when(F.col("fits"), F.col("overall")).alias("quality"))
