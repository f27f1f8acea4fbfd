"""Cross-references and the graph they make."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.functions import lexicons as L
from lexmill.operators import elements as E
from lexmill.operators import graph as G
from lexmill.plans.registry import REFS, query
from lexmill.sources.corpus import reg_corpus

_V = ", vert AS (SELECT DISTINCT doc_id, CAST(regexp_extract(number, '^([0-9]+)', 1) AS INT) AS v FROM arts), pair AS (SELECT DISTINCT doc_id, src, dst FROM refs WHERE src <> dst)"
_BASE = REFS + _V
_REC = _BASE.replace("WITH ", "WITH RECURSIVE ", 1)
_DIST = _REC + ", walk AS (SELECT doc_id, src, dst, 1 AS d FROM pair UNION SELECT w.doc_id, w.src, p.dst, d + 1 FROM walk w JOIN pair p ON p.doc_id = w.doc_id AND p.src = w.dst WHERE d < 30 AND w.src <> p.dst), dist AS (SELECT doc_id, src, dst, min(d)::INT AS d FROM walk GROUP BY ALL)"
_DEG = "deg AS (SELECT v.doc_id, v.v, (SELECT count(*) FROM pair p WHERE p.doc_id = v.doc_id AND p.dst = v.v) AS n_in, (SELECT count(*) FROM pair p WHERE p.doc_id = v.doc_id AND p.src = v.v) AS n_out FROM vert v)"


def _refs(spark, sf):
    a = E.articles(reg_corpus(spark, sf))
    return a, E.references(a)


def _links(spark, sf):
    return E.links(E.articles(reg_corpus(spark, sf)))


def _vertices(a):
    return a.select("doc_id", F.regexp_extract("number", "^([0-9]+)", 1).cast("int").alias("v")).distinct()


@query("g21_cross_references", f"{REFS} SELECT doc_id, src, dst, kind FROM refs")
def g21(spark, sf):
    return _refs(spark, sf)[1]


@query("j7_missing_targets", f"{_BASE} SELECT DISTINCT doc_id, dst FROM refs r WHERE NOT EXISTS (SELECT 1 FROM vert v WHERE v.doc_id = r.doc_id AND v.v = r.dst)")
def j7(spark, sf):
    a, r = _refs(spark, sf)
    return r.select("doc_id", "dst").distinct().join(_vertices(a).withColumnRenamed("v", "dst"), ["doc_id", "dst"], "left_anti")


@query("j8_mutual_references", f"{_BASE} SELECT a.doc_id, a.src, a.dst FROM pair a JOIN pair b ON a.doc_id = b.doc_id AND a.src = b.dst AND a.dst = b.src")
def j8(spark, sf):
    r = _refs(spark, sf)[1].where("src <> dst")
    up = F.col("src") < F.col("dst")
    both = r.groupBy("doc_id", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi")).agg((F.bool_or(up) & F.bool_or(~up)).alias("both")).where("both")
    ways = F.array(F.struct(F.col("lo").alias("src"), F.col("hi").alias("dst")), F.struct(F.col("hi").alias("src"), F.col("lo").alias("dst")))
    return both.select("doc_id", F.explode(ways).alias("x")).select("doc_id", "x.src", "x.dst")


@query("j13_conflicts", f"{REFS}, k AS (SELECT doc_id, src, dst, list(DISTINCT kind) AS kinds FROM refs GROUP BY ALL) SELECT doc_id, src, dst, c.a AS kind_a, c.b AS kind_b FROM k JOIN (VALUES {', '.join(str(c) for c in L.CONFLICTS)}) c(a, b) ON list_contains(kinds, c.a) AND list_contains(kinds, c.b)")
def j13(spark, sf):
    k = _refs(spark, sf)[1].groupBy("doc_id", "src", "dst").agg(F.collect_set("kind").alias("kinds"))
    c = F.broadcast(spark.createDataFrame(L.CONFLICTS, "kind_a string, kind_b string"))
    return k.join(c, F.array_contains("kinds", F.col("kind_a")) & F.array_contains("kinds", F.col("kind_b"))).drop("kinds")


@query("a23_reference_report", f"{REFS} SELECT kind, count(*) AS n, count(DISTINCT doc_id) AS n_documents, min(src)::INT AS least_src, max(dst)::INT AS greatest_dst FROM refs GROUP BY kind")
def a23(spark, sf):
    return _refs(spark, sf)[1].groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_documents"), F.min("src").alias("least_src"), F.max("dst").alias("greatest_dst"))


@query("a24_degrees", f"{_BASE}, {_DEG} SELECT * FROM deg")
def a24(spark, sf):
    return G.degrees(_links(spark, sf)).select("doc_id", "v", "n_in", "n_out")


@query("a24_top_referenced", f"{_BASE}, {_DEG} SELECT doc_id, v, n_in FROM deg ORDER BY n_in DESC, doc_id, v LIMIT 10")
def a24_top(spark, sf):
    return G.degrees(_links(spark, sf)).orderBy(F.desc("n_in"), "doc_id", "v").limit(10).select("doc_id", "v", "n_in")


@query("a25_isolated", f"{_BASE}, {_DEG} SELECT doc_id, v FROM deg WHERE n_in = 0 AND n_out = 0")
def a25(spark, sf):
    return G.degrees(_links(spark, sf)).where("n_in = 0 and n_out = 0").select("doc_id", "v")


_COMP = _REC + ", both_ AS (SELECT doc_id, src, dst FROM pair UNION SELECT doc_id, dst, src FROM pair), reach AS (SELECT doc_id, v, v AS u FROM vert UNION SELECT r.doc_id, r.v, b.dst FROM reach r JOIN both_ b ON b.doc_id = r.doc_id AND b.src = r.u), comp AS (SELECT doc_id, v, min(u)::INT AS root FROM reach GROUP BY ALL)"


@query("n5_components", f"{_COMP} SELECT doc_id, v, root FROM comp")
def n5(spark, sf):
    a, r = _refs(spark, sf)
    return G.components(_vertices(a), r)


@query("n6_cycles", f"{_REC}, p AS (SELECT doc_id, [src, dst] AS p FROM pair WHERE dst > src UNION ALL SELECT p.doc_id, list_append(p, e.dst) FROM p JOIN pair e ON e.doc_id = p.doc_id AND e.src = p[len(p)] WHERE e.dst > p[1] AND NOT list_contains(p, e.dst)) SELECT p.doc_id, array_to_string(p, '-') AS cycle, len(p)::INT AS n_vertices FROM p JOIN pair e ON e.doc_id = p.doc_id AND e.src = p[len(p)] AND e.dst = p[1]")
def n6(spark, sf):
    return G.cycles(_refs(spark, sf)[1])


@query("n7_chains", f"{_REC}, p AS (SELECT doc_id, [src, dst] AS p FROM pair UNION ALL SELECT p.doc_id, list_append(p, e.dst) FROM p JOIN pair e ON e.doc_id = p.doc_id AND e.src = p[len(p)] WHERE len(p) < 6 AND NOT list_contains(p, e.dst)) SELECT doc_id, array_to_string(p, '-') AS path, len(p)::INT AS n_vertices FROM p WHERE len(p) > 2")
def n7(spark, sf):
    return G.chains(_refs(spark, sf)[1])


@query("n8_dependencies", f"{_DIST} SELECT doc_id, src, dst, d FROM dist")
def n8(spark, sf):
    return G.distances(_refs(spark, sf)[1])


_LEVELS = 14
_SP = ["sp1 AS (SELECT doc_id, src, dst, 1::DOUBLE AS c FROM pair)", "seen1 AS (SELECT doc_id, src, dst FROM sp1)"]
for _k in range(2, _LEVELS + 1):
    _SP.append(f"sp{_k} AS (SELECT s.doc_id, s.src, p.dst, sum(c) AS c FROM sp{_k - 1} s JOIN pair p ON p.doc_id = s.doc_id AND p.src = s.dst WHERE s.src <> p.dst AND NOT EXISTS (SELECT 1 FROM seen{_k - 1} q WHERE q.doc_id = s.doc_id AND q.src = s.src AND q.dst = p.dst) GROUP BY ALL)")
    _SP.append(f"seen{_k} AS (SELECT * FROM seen{_k - 1} UNION ALL SELECT doc_id, src, dst FROM sp{_k})")
_SP.append("sp AS (" + " UNION ALL ".join(f"SELECT doc_id, src, dst, {k} AS d, c FROM sp{k}" for k in range(1, _LEVELS + 1)) + ")")
_BETWEEN = f"{_BASE}, {', '.join(_SP).replace(' AS (', ' AS MATERIALIZED (')}, bt AS (SELECT a.doc_id, a.dst AS v, sum(a.c * b.c / t.c) AS x FROM sp a JOIN sp b ON b.doc_id = a.doc_id AND b.src = a.dst JOIN sp t ON t.doc_id = a.doc_id AND t.src = a.src AND t.dst = b.dst WHERE a.d + b.d = t.d GROUP BY ALL), u AS (SELECT doc_id, src AS v FROM pair UNION SELECT doc_id, dst FROM pair)"


@query("n9_betweenness", f"{_BETWEEN} SELECT doc_id, v, round(coalesce(x, 0), 6) AS betweenness FROM u LEFT JOIN bt USING (doc_id, v)")
def n9_betweenness(spark, sf):
    return G.betweenness(_refs(spark, sf)[1])


@query("n9_degree_closeness", f"{_DIST}, n AS (SELECT doc_id, count(*) AS n FROM vert GROUP BY doc_id), c AS (SELECT doc_id, dst AS v, sum(d) AS s, count(*) AS k FROM dist GROUP BY ALL), {_DEG} SELECT g.doc_id, g.v, round(CASE WHEN n > 1 THEN (n_in + n_out)::DOUBLE / (n - 1) ELSE 0 END, 6) AS degree, round(CASE WHEN s > 0 THEN k::DOUBLE / s ELSE 0 END, 6) AS closeness FROM deg g JOIN n ON n.doc_id = g.doc_id LEFT JOIN c ON c.doc_id = g.doc_id AND c.v = g.v")
def n9(spark, sf):
    n, s = F.col("n"), F.col("s")
    return G.nearness(_links(spark, sf)).select("doc_id", "v", F.round(F.when(n > 1, (F.col("n_in") + F.col("n_out")) / (n - 1)).otherwise(0.0), 6).alias("degree"), F.round(F.when(s > 0, (F.col("n_in") + F.col("far_in")) / s).otherwise(0.0), 6).alias("closeness"))


@query("c44_dependency_score", f"{_DIST} SELECT v.doc_id, v.v, round(least(100.0, 3 * count(*) FILTER (dst = v AND d = 1) + 1 * count(*) FILTER (dst = v AND d > 1) + 0.5 * count(*) FILTER (src = v AND d = 1) + 0.2 * count(*) FILTER (src = v AND d > 1))::DOUBLE, 6) AS score FROM vert v LEFT JOIN dist ON dist.doc_id = v.doc_id AND (dist.src = v.v OR dist.dst = v.v) GROUP BY ALL")
def c44(spark, sf):
    total = 3.0 * F.col("n_in") + 1.0 * F.col("far_in") + 0.5 * F.col("n_out") + 0.2 * F.col("far_out")
    return G.nearness(_links(spark, sf)).select("doc_id", "v", F.round(F.least(F.lit(100.0), total), 6).alias("score"))


@query("a28_compliance_report", f"{_BASE}, {_DEG}, n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (n_in > 2) AS hubs, count(*) FILTER (n_in = 0 AND n_out = 0) AS isolated FROM deg GROUP BY doc_id), e AS (SELECT doc_id, count(*) AS e FROM pair GROUP BY doc_id), k AS (SELECT doc_id, count(*) FILTER (kind = 'conformity') AS conformity, count(*) FILTER (kind = 'modification') AS modification FROM refs GROUP BY doc_id) SELECT n.doc_id, n AS n_articles, coalesce(e, 0) AS n_edges, round(CASE WHEN n > 1 THEN coalesce(e, 0)::DOUBLE / (n * (n - 1)) ELSE 0 END, 6) AS density, hubs, isolated, coalesce(conformity, 0) AS conformity, coalesce(modification, 0) AS modification, round((n - isolated)::DOUBLE / n * 100, 6) AS connected FROM n LEFT JOIN e USING (doc_id) LEFT JOIN k USING (doc_id)")
def a28(spark, sf):
    d, n = G.degrees(_links(spark, sf)), F.col("n_articles")
    sums = [F.sum(c).alias(k) for c, k in (("n_out", "n_edges"), ("conformity", "conformity"), ("modification", "modification"))]
    j = d.groupBy("doc_id").agg(F.count("*").alias("n_articles"), F.count_if(F.col("n_in") > 2).alias("hubs"), F.count_if((F.col("n_in") == 0) & (F.col("n_out") == 0)).alias("isolated"), *sums)
    j = j.select("doc_id", "n_articles", "hubs", "isolated", "n_edges", "conformity", "modification")
    return j.withColumn("density", F.round(F.when(n > 1, F.col("n_edges") / (n * (n - 1))).otherwise(0.0), 6)).withColumn("connected", F.round((n - F.col("isolated")) / n * 100, 6))


@query("a29_network_view", f"{_BASE}, {_DEG} SELECT doc_id, count(*) AS n_nodes, sum(n_out)::BIGINT AS n_edges, round(avg(n_in + n_out), 6) AS mean_degree, max(n_in + n_out) AS max_degree FROM deg GROUP BY doc_id")
def a29(spark, sf):
    both = F.col("n_in") + F.col("n_out")
    return G.degrees(_links(spark, sf)).groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.sum("n_out").alias("n_edges"), F.round(F.avg(both), 6).alias("mean_degree"), F.max(both).alias("max_degree"))


@query("n10_network_bundle", f"{_COMP}, {_DEG}, c AS (SELECT doc_id, count(*) AS n_components, max(n) AS largest FROM (SELECT doc_id, root, count(*) AS n FROM comp GROUP BY ALL) GROUP BY doc_id), d AS (SELECT doc_id, count(*) AS n_vertices, sum(n_out)::BIGINT AS n_edges, max(n_in) AS most_referenced FROM deg GROUP BY doc_id) SELECT * FROM c JOIN d USING (doc_id)")
def n10(spark, sf):
    return G.bundles(_links(spark, sf))
