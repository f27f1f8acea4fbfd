"""Page selection, page merging and chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.operators import elements as E
from lexmill.operators import pages as P
from lexmill.plans.registry import ELEM, query, sql_alnum, sql_ends, sql_words, table
from lexmill.sources.corpus import reg_corpus

_SPECS = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN concat(CAST(o_orderkey % 5 + 1 AS STRING_T), '-', CAST(o_orderkey % 5 + 4 AS STRING_T), ', 2, 12-13') WHEN 2 THEN 'a-3' WHEN 3 THEN '0-2' WHEN 4 THEN '9-5' WHEN 5 THEN concat('1 - 3,,', CAST(o_orderkey % 40 AS STRING_T)) ELSE concat(CAST(o_orderkey % 7 + 1 AS STRING_T), ', 3, 4-6, 8-8, ', CAST(o_orderkey % 11 + 1 AS STRING_T)) END AS spec, CAST(20 AS INT) AS total FROM orders"
_PARSED = r"""specs AS (""" + _SPECS.replace("STRING_T", "VARCHAR") + r"""), items AS (SELECT *, list_filter(list_transform(string_split(spec, ','), lambda x: trim(x)), lambda x: x <> '') AS items FROM specs),
tried AS (SELECT *, len(list_filter(items, lambda x: NOT regexp_matches(x, '^\d+(\s*-\s*\d+)?$'))) AS bad, list_transform(items, lambda x: {'a': try_cast(regexp_extract(x, '^(\d+)', 1) AS INT), 'b': coalesce(try_cast(nullif(regexp_extract(x, '-\s*(\d+)$', 1), '') AS INT), try_cast(regexp_extract(x, '^(\d+)', 1) AS INT))}) AS ranges FROM items),
parsed AS (SELECT doc_id, spec, total, ranges, CASE WHEN len(items) = 0 THEN 'empty' WHEN bad > 0 THEN 'bad character' WHEN len(list_filter(ranges, lambda r: r.a < 1 OR r.b < 1)) > 0 THEN 'below 1' WHEN len(list_filter(ranges, lambda r: r.a > r.b)) > 0 THEN 'start after end' WHEN len(list_filter(ranges, lambda r: r.b > total)) > 0 THEN 'beyond the last page' END AS error FROM tried)"""
_MERGED = _PARSED + """, flat AS (SELECT DISTINCT doc_id, r.a AS a, r.b AS b FROM (SELECT doc_id, unnest(ranges) AS r FROM parsed WHERE error IS NULL)),
marked AS (SELECT *, max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM flat),
isl AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS k FROM marked),
merged AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM isl GROUP BY doc_id, k)"""
_PAGES = _MERGED + ", sel AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1 AS place FROM (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS page FROM merged))"


def _specs(spark, sf):
    return spark.sql(_SPECS.replace("STRING_T", "STRING").replace("FROM orders", f"FROM parquet.`{sf}/orders.parquet`"))


@query("g7_p6_parse_ranges", f"WITH {_PARSED} SELECT doc_id, error, CASE WHEN error IS NULL THEN list_aggregate(list_transform(ranges, lambda r: r.a || '-' || r.b), 'string_agg', ',') END AS ranges FROM parsed")
def g7(spark, sf):
    return P.parse_ranges(_specs(spark, sf)).select("doc_id", "error", F.array_join(F.transform("ranges", lambda r: F.concat_ws("-", r["a"], r["b"])), ",").alias("ranges"))


@query("g8_merge_ranges", f"WITH {_MERGED} SELECT doc_id, a, b FROM merged")
def g8(spark, sf):
    return P.merge_ranges(P.parse_ranges(_specs(spark, sf)))


@query("g9_w12_selected_pages", f"WITH {_PAGES} SELECT doc_id, page::INT AS page, place::INT AS place FROM sel")
def g9(spark, sf):
    return P.selected_pages(P.merge_ranges(P.parse_ranges(_specs(spark, sf))))


@query("g10_selection_display", f"""WITH {_PAGES}, n AS (SELECT doc_id, count(*) AS n FROM sel GROUP BY doc_id) SELECT m.doc_id, string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '-' || b END, ', ' ORDER BY a) || ' (' || any_value(n) || '/20 pages, ' || printf('%.1f', round(any_value(n) * 100 / 20.0::DOUBLE, 1)) || '%)' AS display FROM merged m JOIN n USING (doc_id) GROUP BY m.doc_id""")
def g10(spark, sf):
    m = P.merge_ranges(P.parse_ranges(_specs(spark, sf)))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    g = m.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", label.alias("s")))), lambda x: x["s"]), ", ").alias("d"), F.sum(F.col("b") - F.col("a") + 1).alias("n"))
    return g.select("doc_id", F.concat("d", F.lit(" ("), F.col("n"), F.lit("/20 pages, "), F.format_string("%.1f", F.round(F.col("n") * 100 / 20.0, 1)), F.lit("%)")).alias("display"))


@query("g11_range_suggestions", f"WITH {_PARSED} SELECT doc_id, CASE error WHEN 'empty' THEN 'give a page or a range' WHEN 'bad character' THEN 'use digits, hyphens and commas' WHEN 'below 1' THEN 'pages start at 1' WHEN 'start after end' THEN 'put the lower page first' ELSE 'the last page is ' || total END AS advice FROM parsed WHERE error IS NOT NULL")
def g11(spark, sf):
    return P.suggestions(P.parse_ranges(_specs(spark, sf)))


def _two(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")
    return c.where("page % 5 <> 1"), c.where("page % 3 <> 2").withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.substring("text", 1, 80)).otherwise(F.concat(F.lit("# "), "text")))


_TWO = "c AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations), a AS (SELECT * FROM c WHERE page % 5 <> 1), b AS (SELECT doc_id, page, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 80) ELSE '# ' || text END AS text FROM c WHERE page % 3 <> 2)"


def _q(c):
    lines = f"list_filter(string_split({c}, chr(10)), lambda x: trim(x) <> '')"
    mean = f"(CASE WHEN len({lines}) > 0 THEN list_sum(list_transform({lines}, lambda x: length(x)))::DOUBLE / len({lines}) ELSE 0 END)"
    return f"round((CASE WHEN {sql_words(c)} > 10 THEN 0.3 ELSE 0.0 END + 0.3 * {sql_alnum(c)} + CASE WHEN {sql_ends(c)} > 0 THEN 0.2 ELSE 0.0 END + CASE WHEN {mean} > 20 AND {mean} < 100 THEN 0.2 ELSE 0.0 END)::DOUBLE, 9)"


@query("j1_merge_pages", f"WITH {_TWO}, j AS (SELECT doc_id, page, a.text AS ta, b.text AS tb FROM a FULL JOIN b USING (doc_id, page)), p AS (SELECT *, CASE WHEN tb IS NULL THEN 'a' WHEN ta IS NULL THEN 'b' WHEN length(ta) > 1.5 * length(tb) THEN 'a' WHEN length(tb) > 1.5 * length(ta) THEN 'b' WHEN {_q('tb')} > {_q('ta')} THEN 'b' ELSE 'a' END AS source FROM j) SELECT doc_id, page, source, CASE source WHEN 'a' THEN ta ELSE tb END AS text FROM p")
def j1(spark, sf):
    return P.merge_pages(*_two(spark, sf))


@query("j2_s6_filter_pages", f"WITH {_PAGES}, c AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations) SELECT doc_id, string_agg('--- PAGE ' || page || ' ---' || chr(10) || text, chr(10) ORDER BY page) AS text FROM c SEMI JOIN sel USING (doc_id, page) GROUP BY doc_id")
def j2(spark, sf):
    sel = P.selected_pages(P.merge_ranges(P.parse_ranges(_specs(spark, sf))))
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text").join(sel, ["doc_id", "page"], "left_semi")
    return c.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: F.concat(F.lit("--- PAGE "), x["page"], F.lit(" ---\n"), x["text"])), "\n").alias("text"))


@query("j3_p3_missing_pages", f"WITH {_TWO}, m AS (SELECT doc_id, unnest(range(0, max(page) + 1)) AS page FROM c GROUP BY doc_id) SELECT doc_id, page FROM m ANTI JOIN a USING (doc_id, page)")
def j3(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.max("turn").alias("last"))
    return P.missing_pages(c.select("doc_id", F.explode(F.sequence(F.lit(0).cast("bigint"), "last")).alias("page")), _two(spark, sf)[0])


@query("p2_needs_ocr", f"WITH {_TWO}, p AS (SELECT doc_id, page + 1 AS page, text FROM a), g AS (SELECT doc_id, max(page) AS last, count(DISTINCT page) AS n, sum(length(text)) AS chars FROM p GROUP BY doc_id) SELECT doc_id, last, n, (chars / last < 100 OR chars < 500 OR CASE WHEN last < 50 THEN last - n > 0 WHEN last < 500 THEN last - n > 0.1 * last ELSE last - n > 0.2 * last END) AS needs_ocr FROM g")
def p2(spark, sf):
    return P.needs_ocr(_two(spark, sf)[0].withColumn("page", F.col("page") + 1))


_SENT = r"""parts AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents), sent AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS sentence FROM parts)"""


@query("g1_sentences", f"WITH {_SENT} SELECT doc_id, i::INT AS i, sentence FROM sent WHERE sentence <> ''")
def g1(spark, sf):
    return P.sentences(table(spark, sf, "documents"))


@query("g2_g6_sentence_packing", f"""WITH RECURSIVE {_SENT}, s AS MATERIALIZED (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sentence FROM sent WHERE sentence <> ''),
fold AS (SELECT doc_id, k, 0 AS chunk, sentence AS cur, 1 AS n FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, CASE WHEN length(cur) + length(sentence) + 1 <= 1000 THEN chunk ELSE chunk + 1 END, CASE WHEN length(cur) + length(sentence) + 1 <= 1000 THEN cur || ' ' || sentence ELSE trim(trim(right(cur, 200)) || ' ' || sentence) END, CASE WHEN length(cur) + length(sentence) + 1 <= 1000 THEN n + 1 ELSE 1 END
  FROM fold JOIN s ON s.doc_id = fold.doc_id AND s.k = fold.k + 1)
SELECT doc_id, chunk::INT AS chunk, max_by(md5(cur), k) AS chunk_hash, max_by(length(cur), k)::INT AS n_chars, max_by(n, k)::INT AS n_sentences FROM fold GROUP BY doc_id, chunk""")
def g2(spark, sf):
    return P.pack(table(spark, sf, "documents")).select("doc_id", "chunk", F.md5("text").alias("chunk_hash"), F.length("text").alias("n_chars"), "n_sentences")


@query("g4_token_windows", r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\s\x{00A0}\x{0085}]+'), lambda x: x <> '') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 150)) AS start FROM w) SELECT doc_id, start::INT AS start, md5(array_to_string(w[start + 1 : start + 200], ' ')) AS chunk_hash, len(w[start + 1 : start + 200])::INT AS n_words FROM s""")
def g4(spark, sf):
    return P.token_windows(table(spark, sf, "documents")).select("doc_id", "start", F.md5("text").alias("chunk_hash"), "n_words")


@query("g3_g5_section_chunks", ELEM.replace("WITH ", "WITH RECURSIVE ", 1) + r""", tx AS (SELECT doc_id, seq, CASE WHEN number <> '' THEN number || ' ' || title || ' ' ELSE '' END || regexp_replace(body, '\s+', ' ', 'g') AS text FROM elem), ps AS (SELECT doc_id, seq, string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)) AS p FROM tx),
se AS (SELECT doc_id, seq, generate_subscripts(p, 1) AS i, unnest(p) AS sentence FROM ps), s AS MATERIALIZED (SELECT doc_id, seq, row_number() OVER (PARTITION BY doc_id, seq ORDER BY i) AS k, sentence FROM se WHERE sentence <> ''),
fold AS (SELECT doc_id, seq, k, 0 AS chunk, sentence AS cur FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.seq, s.k, CASE WHEN length(cur) + length(sentence) + 1 <= 400 THEN chunk ELSE chunk + 1 END, CASE WHEN length(cur) + length(sentence) + 1 <= 400 THEN cur || ' ' || sentence ELSE trim(trim(right(cur, 60)) || ' ' || sentence) END FROM fold JOIN s ON s.doc_id = fold.doc_id AND s.seq = fold.seq AND s.k = fold.k + 1),
g AS (SELECT doc_id, seq, chunk, max_by(cur, k) AS text FROM fold GROUP BY doc_id, seq, chunk)
SELECT doc_id, seq::INT AS seq, (row_number() OVER (PARTITION BY doc_id ORDER BY seq, chunk) - 1)::INT AS chunk, md5(text) AS chunk_hash FROM g""")
def g5(spark, sf):
    return P.section_chunks(E.elements(reg_corpus(spark, sf))).select("doc_id", "seq", "chunk", "chunk_hash")
