"""Counts, gaps, breakdowns, heat map and the health report over the star schema and text tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import percent
from ..operators import quality
from ..operators.search import page_view as page_rows
from .base import query, table


@query("SELECT c_custkey AS item, o_orderpriority AS source, count(*) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def def_source_counts(spark, sf_dir):
    return quality.per_source_counts(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), "c_custkey", "o_custkey", "o_orderpriority")


@query("SELECT n_name, count(c_custkey) AS n, count(DISTINCT c_mktsegment) AS distinct_n FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY 1")
def dict_source_counts(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    return quality.detail_counts(nation, customer, nation["n_nationkey"] == customer["c_nationkey"], ["n_name"], "c_custkey", "c_mktsegment")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unlabelled_documents(spark, sf_dir):
    return quality.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(l_returnflag = 'R')")
def sourced_only(spark, sf_dir):
    return quality.only_value(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "R")


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def dup_keys(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT 'labels' AS table_name, CAST(quality AS VARCHAR) AS value, count(*) AS n FROM labels GROUP BY 1, 2 UNION ALL SELECT 'toxic', CAST(toxic AS VARCHAR), count(*) FROM labels GROUP BY 1, 2")
def union_breakdown(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return quality.union_breakdown({"labels": labels.select("quality"), "toxic": labels.select(F.col("toxic").alias("quality"))}, "quality")


_HEAT = """flags AS (SELECT user_id % 100 AS word_id FROM events WHERE event_type = 'purchase'),
    heat AS (SELECT l_orderkey % 1430 + 1 AS ang, count(*) AS weight FROM flags JOIN lineitem ON l_suppkey = word_id GROUP BY 1)"""


def _heat(spark, sf_dir):
    flags = table(spark, sf_dir, "events").filter("event_type = 'purchase'").select((F.col("user_id") % 100).alias("word_id"), F.lit("open").alias("status"))
    items = table(spark, sf_dir, "lineitem")
    occ = items.select(F.col("l_suppkey").alias("word_id"), F.col("l_orderkey").alias("line_id"))
    lines = items.select(F.col("l_orderkey").alias("id"), (F.col("l_orderkey") % 1430 + 1).alias("ang")).distinct()
    return quality.heatmap(flags, occ, lines)


@query(f"WITH {_HEAT} SELECT ang, CAST(weight AS BIGINT) AS weight FROM heat")
def flag_heatmap(spark, sf_dir):
    return _heat(spark, sf_dir)


@query(
    f"""WITH {_HEAT}, b AS (SELECT CAST(floor((ang - 1) / 10) AS INTEGER) AS bucket, sum(weight) AS w FROM heat GROUP BY 1), f AS (SELECT CAST(r AS INTEGER) AS bucket, coalesce(w, 0) AS weight FROM range(143) t(r) LEFT JOIN b ON b.bucket = r)
    SELECT bucket, CAST(weight AS BIGINT) AS weight, round(weight / (SELECT greatest(max(weight), 1) FROM f), 6) AS ratio FROM f"""
)
def heatmap_buckets(spark, sf_dir):
    return quality.heat_buckets(_heat(spark, sf_dir))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE lang IS DISTINCT FROM 'en') AS stale FROM documents")
def parse_staleness(spark, sf_dir):
    return quality.staleness(table(spark, sf_dir, "documents").select(F.col("lang").alias("parser_version")), "en")


@query("SELECT o_custkey, printf('%.1f%%', round(100.0 * count(*) FILTER (WHERE o_orderstatus = 'F') / count(*), 1)) AS share FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'n/a' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def percent_labels(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy(F.col("c_custkey").alias("o_custkey")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.count("o_orderkey").alias("n"))
    return counts.select("o_custkey", percent(F.col("f"), F.col("n")).alias("share"))


# the report's tables, from orders (lines), parts (words), line items (occurrences) and others
_HEALTH = """
    lines AS (SELECT o_orderkey AS id, CAST(o_custkey % 3 AS BIGINT) AS source_fk, o_orderkey % 1430 + 1 AS ang, o_custkey AS shabad_id FROM orders),
    words AS (SELECT p_partkey AS id, p_size % 2 = 0 AS in_corpus FROM part),
    occ AS (SELECT l_partkey AS word_id, l_orderkey + CASE WHEN l_linenumber = 7 THEN 100000000 ELSE 0 END AS line_id FROM lineitem),
    defs AS (SELECT o_custkey AS word_id, CAST(o_orderkey % 6 AS BIGINT) AS dict_source_id FROM orders),
    grammar AS (SELECT l_partkey AS word_id, CASE WHEN l_returnflag = 'R' THEN 'imported' WHEN l_returnflag = 'A' THEN 'rule_derived' END AS provenance FROM lineitem),
    tr AS (SELECT l_orderkey AS line_id, l_shipmode_ AS source_code, CASE WHEN l_suppkey % 50 = 0 THEN '  ' ELSE 'x' END AS body FROM (SELECT *, l_linestatus AS l_shipmode_ FROM lineitem)),
    ds AS (SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS code FROM region),
    flags AS (SELECT CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status, event_type AS flag_type FROM events)
"""
_METRICS = [
    ("lines", "''", "SELECT '' AS g, count(*) AS v FROM lines"),
    ("pages", "", "SELECT '', count(DISTINCT ang) FROM lines"),
    ("hymns", "", "SELECT '', count(DISTINCT shabad_id) FROM lines"),
    ("lines_per_source", "", "SELECT CAST(source_fk AS VARCHAR), count(*) FROM lines GROUP BY 1"),
    ("words", "", "SELECT '', count(*) FROM words"),
    ("words_in_corpus", "", "SELECT '', count(*) FROM words WHERE in_corpus"),
    ("occurrences", "", "SELECT '', count(*) FROM occ"),
    ("words_with_occurrences", "", "SELECT '', count(DISTINCT word_id) FROM occ"),
    ("uncommented_lines", "", "SELECT '', count(*) FROM lines WHERE id NOT IN (SELECT line_id FROM tr)"),
    ("translations", "", "SELECT '', count(*) FROM tr"),
    ("translated_lines", "", "SELECT '', count(DISTINCT line_id) FROM tr"),
    ("blank_translations", "", "SELECT '', count(*) FROM tr WHERE trim(body) = ''"),
    ("duplicate_translations", "", "SELECT '', count(*) FROM (SELECT line_id, source_code FROM tr GROUP BY 1, 2 HAVING count(*) > 1)"),
    ("undefined_words", "", "SELECT '', count(*) FROM words WHERE id NOT IN (SELECT word_id FROM defs)"),
    ("definitions_per_source", "", "SELECT code, count(word_id) FROM ds LEFT JOIN defs ON ds.id = dict_source_id GROUP BY 1"),
    ("words_per_source", "", "SELECT code, count(DISTINCT word_id) FROM ds LEFT JOIN defs ON ds.id = dict_source_id GROUP BY 1"),
    ("defined_without_grammar", "", "SELECT '', count(DISTINCT word_id) FROM defs WHERE word_id NOT IN (SELECT word_id FROM grammar)"),
    ("imported_only_words", "", "SELECT '', count(*) FROM (SELECT word_id FROM grammar GROUP BY 1 HAVING count(*) FILTER (WHERE provenance = 'imported') > 0 AND count(*) FILTER (WHERE provenance <> 'imported') = 0)"),
    ("grammar_provenance", "", "SELECT coalesce(provenance, ''), count(*) FROM grammar GROUP BY 1"),
    ("orphan_occurrences", "", "SELECT '', count(*) FROM occ WHERE line_id NOT IN (SELECT id FROM lines)"),
    ("orphan_definitions", "", "SELECT '', count(*) FROM defs WHERE word_id NOT IN (SELECT id FROM words)"),
    ("flags_by_status", "", "SELECT status, count(*) FROM flags GROUP BY 1"),
    ("open_flags_by_type", "", "SELECT flag_type, count(*) FROM flags WHERE status = 'open' GROUP BY 1"),
]
_HEALTH_SQL = f"""WITH {_HEALTH.strip()}, m AS ({" UNION ALL ".join(f"SELECT '{name}' AS metric, * FROM ({sql}) AS t(group_key, value)" for name, _, sql in _METRICS)})
    SELECT metric, group_key, value, CASE WHEN metric = 'pages' THEN CASE WHEN value = 1430 THEN 'ok' ELSE 'warn' END WHEN metric = 'uncommented_lines' THEN CASE WHEN value > 60 THEN 'warn' ELSE 'ok' END
        WHEN metric IN ('blank_translations', 'duplicate_translations', 'orphan_occurrences', 'orphan_definitions') THEN CASE WHEN value = 0 THEN 'ok' ELSE 'warn' END ELSE 'info' END AS status FROM m"""


@query(_HEALTH_SQL)
def health_metrics(spark, sf_dir):
    c = F.col
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    provenance = F.when(c("l_returnflag") == "R", "imported").when(c("l_returnflag") == "A", "rule_derived")
    return quality.health_report(
        lines=orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 3).alias("source_fk"), (c("o_orderkey") % 1430 + 1).alias("ang"), c("o_custkey").alias("shabad_id")),
        words=table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), (c("p_size") % 2 == 0).alias("in_corpus")),
        occ=items.select(c("l_partkey").alias("word_id"), (c("l_orderkey") + F.when(c("l_linenumber") == 7, 100_000_000).otherwise(0)).alias("line_id")),
        definitions=orders.select(c("o_custkey").alias("word_id"), (c("o_orderkey") % 6).alias("dict_source_id")),
        grammar=items.select(c("l_partkey").alias("word_id"), provenance.alias("provenance")),
        translations=items.select(c("l_orderkey").alias("line_id"), c("l_linestatus").alias("source_code"), F.when(c("l_suppkey") % 50 == 0, "  ").otherwise("x").alias("body")),
        dict_sources=table(spark, sf_dir, "region").select(c("r_regionkey").cast("bigint").alias("id"), c("r_name").alias("code")),
        flags=table(spark, sf_dir, "events").select(F.when(c("event_id") % 3 == 0, "closed").otherwise("open").alias("status"), c("event_type").alias("flag_type")),
    )


@query("SELECT o_orderkey AS id, o_custkey AS shabad_id, o_orderpriority AS gurmukhi, c_mktsegment AS raag_english, c_name AS writer_english FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 40 + 1 = 7 AND o_custkey % 3 = 1")
def page_view(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("id"), (c("o_custkey") % 3).alias("source_fk"), (c("o_orderkey") % 40 + 1).alias("ang"), c("o_custkey").alias("shabad_id"), c("o_orderpriority").alias("gurmukhi"), c("o_orderkey").alias("line_no"))
    shabads = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), c("c_mktsegment").alias("raag_english"), c("c_name").alias("writer_english"))
    return page_rows(lines, shabads, source=1, ang=7).select("id", "shabad_id", "gurmukhi", "raag_english", "writer_english")
