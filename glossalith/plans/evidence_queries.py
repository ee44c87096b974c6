"""Evidence merge, conflicts, flags over grammar rows derived from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evidence
from .base import literal, query, table, values

# A grammar row per line item: the part is the word, flags and numbers choose provenance, source, rule and values.
ROWS_SQL = """
    g AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS word_id, CASE WHEN l_returnflag = 'R' THEN 'imported' ELSE 'rule_derived' END AS provenance,
        CASE WHEN l_returnflag = 'R' THEN CASE l_suppkey % 3 WHEN 0 THEN 'shackle' WHEN 1 THEN 'ss_padarth' END END AS source_code,
        CASE WHEN l_linenumber % 4 = 0 THEN NULL WHEN l_suppkey % 2 = 0 THEN 'MUKTA_OBL_SG' ELSE 'AUNKAR_NOM_SG' END AS rule_code,
        CASE WHEN l_linenumber % 5 = 0 THEN 'POS inherited from lemma x.' END AS notes,
        CASE WHEN l_partkey % 3 = 0 THEN 'noun' WHEN l_linestatus = 'O' THEN 'adjective' WHEN l_linenumber = 2 THEN '' ELSE 'verb' END AS pos,
        CASE WHEN l_partkey % 2 = 0 THEN 'masculine' WHEN l_linenumber = 1 THEN 'feminine' END AS gender,
        CASE WHEN l_suppkey % 5 = 0 THEN 'plural' WHEN l_suppkey % 5 < 3 THEN 'singular' END AS number,
        CASE WHEN l_linenumber = 3 THEN 'direct' END AS gram_case, CAST(NULL AS VARCHAR) AS verb_form FROM lineitem)
"""
FACTS_SQL = f"""{ROWS_SQL.strip()},
    u AS (SELECT g.*, 0 AS k, 'pos' AS attribute, pos AS value FROM g UNION ALL SELECT g.*, 1, 'gender', gender FROM g UNION ALL SELECT g.*, 2, 'number', number FROM g UNION ALL SELECT g.*, 3, 'gram_case', gram_case FROM g),
    facts AS (SELECT word_id, id, k, attribute, value,
        CASE WHEN provenance = 'imported' THEN 4 WHEN k > 0 THEN 2 WHEN notes IS NOT NULL THEN 1 ELSE 3 END AS authority,
        CASE WHEN provenance = 'imported' THEN 'src:' || coalesce(source_code, 'unknown') WHEN k > 0 THEN 'rule:' || coalesce(rule_code, 'unknown') WHEN notes IS NOT NULL THEN 'heuristic:inherited' ELSE 'src:mahan_kosh' END AS source_id,
        CASE WHEN provenance = 'imported' OR k > 0 THEN rule_code END AS rule_code FROM u WHERE value <> ''),
    att AS (SELECT word_id, k, attribute, value, source_id, rule_code, min(id) AS id, any_value(authority) AS authority FROM facts GROUP BY 1, 2, 3, 4, 5, 6),
    vals AS (SELECT word_id, k, attribute, value, max(authority) AS authority, CAST(count(*) AS INTEGER) AS attestation_count, arg_min(source_id, struct_pack(a := -authority, i := id)) AS lead_source, min(id) AS first_id FROM att GROUP BY 1, 2, 3, 4),
    readings AS (SELECT *, CAST(row_number() OVER (PARTITION BY word_id, attribute ORDER BY authority DESC, attestation_count DESC, first_id, value) AS INTEGER) AS rank,
        count(*) OVER (PARTITION BY word_id, attribute) AS n, min(lead_source) OVER (PARTITION BY word_id, attribute) <> max(lead_source) OVER (PARTITION BY word_id, attribute) AS differ FROM vals)
"""


def grammar_rows(spark, sf_dir) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    c = F.col
    imported = c("l_returnflag") == "R"
    return items.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("id"),
        c("l_partkey").alias("word_id"),
        F.when(imported, "imported").otherwise("rule_derived").alias("provenance"),
        F.when(imported, F.when(c("l_suppkey") % 3 == 0, "shackle").when(c("l_suppkey") % 3 == 1, "ss_padarth")).alias("source_code"),
        F.when(c("l_linenumber") % 4 == 0, None).when(c("l_suppkey") % 2 == 0, "MUKTA_OBL_SG").otherwise("AUNKAR_NOM_SG").alias("rule_code"),
        F.when(c("l_linenumber") % 5 == 0, "POS inherited from lemma x.").alias("notes"),
        F.when(c("l_partkey") % 3 == 0, "noun").when(c("l_linestatus") == "O", "adjective").when(c("l_linenumber") == 2, "").otherwise("verb").alias("pos"),
        F.when(c("l_partkey") % 2 == 0, "masculine").when(c("l_linenumber") == 1, "feminine").alias("gender"),
        F.when(c("l_suppkey") % 5 == 0, "plural").when(c("l_suppkey") % 5 < 3, "singular").alias("number"),
        F.when(c("l_linenumber") == 3, "direct").alias("gram_case"),
        F.lit(None).cast("string").alias("verb_form"),
        F.lit(0.7).alias("confidence"),
        F.lit(None).cast("bigint").alias("source_line_id"),
    )


@query(f"WITH {FACTS_SQL} SELECT word_id, attribute, value, authority, attestation_count, lead_source, rank, n > 1 AND differ AS conflict, n > 1 AND NOT differ AS polysemy FROM readings")
def evidence_merge(spark, sf_dir):
    return evidence.readings(evidence.facts(grammar_rows(spark, sf_dir))).drop("k")


@query(f"WITH {FACTS_SQL}, w AS (SELECT word_id, bool_or(n > 1 AND differ) AS c, bool_or(n > 1 AND NOT differ) AS p FROM readings GROUP BY 1) SELECT count(*) FILTER (WHERE c) AS conflict_words, count(*) FILTER (WHERE p) AS polysemy_words FROM w")
def conflict_counts(spark, sf_dir):
    return evidence.conflict_counts(evidence.readings(evidence.facts(grammar_rows(spark, sf_dir))))


@query(
    f"""WITH {FACTS_SQL}, old AS (SELECT id AS target_id FROM g WHERE id % 7 = 0),
    doubt AS (SELECT word_id, 'word_grammar' AS target_table, id AS target_id, 'doubt' AS flag_type, 'Reading derived from unverified rule ' || rule_code AS message FROM g WHERE provenance = 'rule_derived' AND rule_code = 'MUKTA_OBL_SG' AND id % 7 <> 0),
    c AS (SELECT DISTINCT word_id, k, attribute FROM readings WHERE n > 1 AND differ)
    SELECT * FROM doubt UNION ALL SELECT word_id, NULL, NULL, 'conflict', 'Sources disagree on ' || string_agg(attribute, ', ' ORDER BY k) FROM c WHERE word_id % 11 <> 0 GROUP BY word_id"""
)
def auto_flags(spark, sf_dir):
    rows = grammar_rows(spark, sf_dir)
    rules = literal(spark, [("MUKTA_OBL_SG", False), ("AUNKAR_NOM_SG", True)], "rule_code string, verified boolean")
    doubts = rows.filter("id % 7 = 0").select("word_id", F.lit("word_grammar").alias("target_table"), F.col("id").alias("target_id"), F.lit("doubt").alias("flag_type"))
    conflicts = rows.filter("word_id % 11 = 0").select("word_id", F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("bigint").alias("target_id"), F.lit("conflict").alias("flag_type")).distinct()
    opened = doubts.unionByName(conflicts).withColumns({"status": F.lit("open"), "reporter": F.lit("auto")})
    return evidence.auto_flags(rows, rules, evidence.readings(evidence.facts(rows)), opened)


_FLAGS = "flags AS (SELECT event_id AS id, user_id AS word_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN event_id % 4 = 0 THEN 'doubt' ELSE 'incorrect' END AS flag_type FROM events)"


def flag_rows(spark, sf_dir) -> DataFrame:
    status = F.when(F.col("event_id") % 3 == 0, "closed").otherwise("open")
    kind = F.when(F.col("event_id") % 4 == 0, "doubt").otherwise("incorrect")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("word_id"), status.alias("status"), kind.alias("flag_type"), F.lit(None).cast("string").alias("resolution_note"))


@query(
    f"""WITH {_FLAGS}, w AS (SELECT c_custkey AS id, c_name AS word, CAST(c_custkey * 37 % 101 AS INTEGER) AS frequency FROM customer), n AS (SELECT word_id, count(*) AS flags FROM flags WHERE status = 'open' AND flag_type <> 'doubt' GROUP BY 1),
    j AS (SELECT word, frequency, flags FROM n JOIN w ON w.id = n.word_id), r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, word) AS word_rank FROM j)
    SELECT CAST(word_rank AS INTEGER) AS word_rank, word, frequency, flags, greatest((SELECT count(*) FROM j) - 150, 0) AS hidden_words FROM r WHERE word_rank <= 150"""
)
def flag_queue(spark, sf_dir):
    words = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("gurmukhi"), (F.col("c_custkey") * 37 % 101).cast("int").alias("frequency"))
    return evidence.flag_queue(flag_rows(spark, sf_dir), words)


@query(f"WITH {_FLAGS} SELECT id, CASE WHEN id % 5 = 0 THEN 'resolved' ELSE status END AS status, CASE WHEN id % 5 = 0 THEN 'done' END AS resolution_note FROM flags")
def flag_resolution(spark, sf_dir):
    flags = flag_rows(spark, sf_dir)
    decisions = flags.filter("id % 5 = 0").select("id", F.lit("resolved").alias("status"), F.lit("done").alias("note"))
    return evidence.resolve_flags(flags, decisions).select("id", "status", "resolution_note")


# Golden rows: (case, provenance, source_code, rule_code, notes, pos, gender, number) and what must come of them.
_CASES = [
    ("corroborated", "imported", "ss_padarth", "SS_PADARTH_GENDER", None, None, "masculine", None),
    ("corroborated", "rule_derived", None, "AUNKAR_NOM_SG", None, None, "masculine", None),
    ("scholar_vs_rule", "imported", "ss_padarth", "SS_PADARTH_NUMBER", None, None, None, "plural"),
    ("scholar_vs_rule", "rule_derived", None, "MUKTA_OBL_SG", None, "pronoun", None, "singular"),
    ("two_senses", "rule_derived", None, "MUKTA_OBL_SG", None, "noun", None, None),
    ("two_senses", "rule_derived", None, "MUKTA_OBL_SG", None, "adjective", None, None),
    ("two_scholars", "imported", "shackle", None, None, None, "feminine", None),
    ("two_scholars", "imported", "ss_padarth", "SS_PADARTH_GENDER", None, None, "masculine", None),
    ("inherited", "rule_derived", None, None, "POS inherited from lemma ਹੁਕਮ.", "noun", None, None),
    ("unknown_source", "imported", None, None, None, None, "feminine", None),
    ("nothing", "rule_derived", None, "X", None, None, None, None),
]
_EXPECTED = [
    ("corroborated", "gender", "masculine", 4, 2, "src:ss_padarth", False, False),
    ("scholar_vs_rule", "number", "plural", 4, 1, "src:ss_padarth", True, False),
    ("scholar_vs_rule", "number", "singular", 2, 1, "rule:MUKTA_OBL_SG", True, False),
    ("scholar_vs_rule", "pos", "pronoun", 3, 1, "src:mahan_kosh", False, False),
    ("two_senses", "pos", "noun", 3, 1, "src:mahan_kosh", False, True),
    ("two_senses", "pos", "adjective", 3, 1, "src:mahan_kosh", False, True),
    ("two_scholars", "gender", "feminine", 4, 1, "src:shackle", True, False),
    ("two_scholars", "gender", "masculine", 4, 1, "src:ss_padarth", True, False),
    ("inherited", "pos", "noun", 1, 1, "heuristic:inherited", False, False),
    ("unknown_source", "gender", "feminine", 4, 1, "src:unknown", False, False),
]


@query(values(_EXPECTED, "word_id, attribute, value, authority, attestation_count, lead_source, conflict, polysemy"))
def evidence_cases(spark, sf_dir):
    rows = literal(spark, [(i, *r) for i, r in enumerate(_CASES)], "id bigint, word_id string, provenance string, source_code string, rule_code string, notes string, pos string, gender string, number string")
    full = rows.withColumns({"gram_case": F.lit(None).cast("string"), "verb_form": F.lit(None).cast("string"), "confidence": F.lit(0.6), "source_line_id": F.lit(None).cast("bigint")})
    return evidence.readings(evidence.facts(full)).drop("k", "rank")
