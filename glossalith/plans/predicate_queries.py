"""Filters, null rules, orders and pages as single queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.legend import EVIDENCED
from ..functions.sense_parser import parsed_sense
from ..operators import dictionary, evidence, morph
from .base import VOCABULARY_SQL, literal, query, table, values, vocabulary
from .form_queries import FOLD_SQL


@query(
    """SELECT o_orderkey, o_orderpriority LIKE '1%' AS prefix, lower(o_orderpriority) LIKE '%not%' AS inside, o_totalprice BETWEEN 1000 AND 50000 AS in_range, o_orderstatus IN ('F', 'P') AS listed,
    (o_custkey = 7 OR o_orderkey % 10 = 7) AS either FROM orders WHERE o_orderstatus = 'F' AND o_totalprice IS NOT NULL"""
)
def filters(spark, sf_dir):
    """Equality, conjunction, null test, prefix, substring without case, range, list, or."""
    c = F.col
    kept = table(spark, sf_dir, "orders").filter((c("o_orderstatus") == "F") & c("o_totalprice").isNotNull())
    return kept.select("o_orderkey", c("o_orderpriority").startswith("1").alias("prefix"), c("o_orderpriority").ilike("%NOT%").alias("inside"), c("o_totalprice").between(1000, 50000).alias("in_range"), c("o_orderstatus").isin("F", "P").alias("listed"), ((c("o_custkey") == 7) | (c("o_orderkey") % 10 == 7)).alias("either"))


@query(
    """WITH v AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS a, CASE WHEN event_id % 4 = 0 THEN '' WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS b FROM events)
    SELECT event_id, a <> 'click' AS differs, a IS DISTINCT FROM b AS distinct_from, coalesce(a, 'none') AS or_default, coalesce(nullif(b, ''), 'none') AS or_text, coalesce(a, b) AS chain, replace(b, 'click', 'tap') AS renamed, trim(b) = '' AS blank FROM v"""
)
def null_rules(spark, sf_dir):
    """What <>, IS DISTINCT FROM, the two kinds of default, fallbacks and blank tests do with nulls."""
    a, b = F.when(F.col("event_id") % 3 != 0, F.col("event_type")), F.when(F.col("event_id") % 4 == 0, "").when(F.col("event_id") % 5 != 0, F.col("event_type"))
    return table(spark, sf_dir, "events").select(
        "event_id", (a != "click").alias("differs"), (~a.eqNullSafe(b)).alias("distinct_from"), F.coalesce(a, F.lit("none")).alias("or_default"), F.coalesce(F.nullif(b, F.lit("")), F.lit("none")).alias("or_text"), F.coalesce(a, b).alias("chain"), F.replace(b, F.lit("click"), F.lit("tap")).alias("renamed"), (F.trim(b) == "").alias("blank"),
    )


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '5-LOW' THEN 2 ELSE 99 END, o_totalprice DESC NULLS LAST, o_orderkey) AS n FROM orders)
    SELECT o_custkey, o_orderkey, o_orderpriority, CAST(n AS INTEGER) AS n FROM o WHERE n <= 3"""
)
def ranked_by_list(spark, sf_dir):
    """Top three per key by a given order of values, unknown ones last, then by several keys with nulls last."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(F.lit("2-HIGH"), F.lit("5-LOW")), F.col("o_orderpriority")), F.lit(0)), F.lit(99))
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(rank, F.col("o_totalprice").desc_nulls_last(), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("n", n).filter("n <= 3").select("o_custkey", "o_orderkey", "o_orderpriority", "n")


@query(
    """WITH p AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders), page AS (SELECT * FROM p WHERE r BETWEEN 51 AND 100), g AS (SELECT coalesce(o_orderpriority, 'Unknown') AS grp, min(r) AS first, count(*) AS n FROM page GROUP BY 1)
    SELECT grp, n, CAST(row_number() OVER (ORDER BY first) AS INTEGER) AS place FROM g"""
)
def grouped_page(spark, sf_dir):
    """Groups of one page in order of first appearance."""
    page = table(spark, sf_dir, "orders").orderBy("o_orderkey").offset(50).limit(50)
    groups = page.groupBy(F.coalesce("o_orderpriority", F.lit("Unknown")).alias("grp")).agg(F.min("o_orderkey").alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.select("grp", "n", F.row_number().over(Window.orderBy("first")).alias("place"))  # a page's groups


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS pos, CASE l_returnflag WHEN 'N' THEN 'noun' WHEN 'R' THEN 'verb' ELSE l_returnflag END AS pos_norm FROM lineitem")
def normalised_pos(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("pos"))
    return evidence.normalised_pos(rows, literal(spark, [("N", "noun"), ("R", "verb")], "raw string, norm string"))


@query(f"WITH {VOCABULARY_SQL} SELECT gurmukhi, nullif({FOLD_SQL}, '') AS search_fold FROM vocabulary")
def populated_folds(spark, sf_dir):
    return morph.populate(vocabulary(spark, sf_dir).select("gurmukhi")).select("gurmukhi", "search_fold")


_LABELS = [("noun", "Noun"), ("verbal_root", "Verbal root"), ("khalsa_argot", "Khalsa argot")]


@query(values(_LABELS, "pos, label"))
def pos_labels(spark, sf_dir):
    return literal(spark, [(p,) for p, _ in _LABELS], "pos string").select("pos", text.pos_label(F.col("pos")).alias("label"))


_SHOWN = [("Title", "T", "raw", 3, 4, "Kabir", "Title 3.4 (Kabir)"), (None, "T", "raw", 3, None, None, "T 3"), (None, None, "raw", None, None, None, "raw")]


@query(values(_SHOWN, "title, siglum, raw, hymn, verse, author, shown"))
def citation_labels(spark, sf_dir):
    rows = literal(spark, [r[:6] for r in _SHOWN], "title string, siglum string, raw string, hymn int, verse int, author string")
    return rows.select("*", text.citation_display(*(F.col(c) for c in ("title", "siglum", "raw", "hymn", "verse", "author"))).alias("shown"))


@query(values([("Krishna Avtar (Dasam Granth); Asa, Mahala 5",)], "cited"))
def distinct_citations(spark, sf_dir):
    rows = literal(spark, [("(ਕ੍ਰਿਸਨਾਵ) (ਕ੍ਰਿਸਨਾਵ) (ਆਸਾ ਮਃ ੫)",)], "sense string").select(text.as_parsed(parsed_sense("sense")).alias("p"))
    return rows.select(F.array_join(text.distinct_citations(F.col("p.citations"), EVIDENCED.raags, EVIDENCED.sections, EVIDENCED.bhagats), "; ").alias("cited"))


@query(values([(0, "ਨਾਮ"), (1, "ਮਯ")], "place, target"))
def xref_targets(spark, sf_dir):
    rows = literal(spark, [("ਦੇਖੋ, ਨਾਮ.",), ("ਸਾਥ. ਦੇਖੋ, ਮਯ ੭.",), ("ਦੇਖੋ, ਨਾਮ.",)], "sense string").select(parsed_sense("sense").alias("p"))
    # in the order of the senses: the first two differ
    senses = F.concat(F.array_sort(F.collect_list("p"), lambda a, b: F.length(a["residue"]) - F.length(b["residue"])), F.array(F.lit(None).cast(rows.schema["p"].dataType)))
    return rows.agg(senses.alias("s")).select(F.posexplode(text.xref_targets(F.col("s"))).alias("place", "target"))


_REPORT = [
    ("enumerator", "", 1), ("numeric", "", 1), ("source:sggs_raags", "", 2), ("unrecognized", "", 3), ("unrecognized_body", "ਹੱਥ", 2), ("unrecognized_body", "ਪੈਰ", 1),
    ("head", "prose", 3), ("head", "language", 1), ("head", "xref", 1), ("head", "pos", 1), ("language_head", "ਸੰ", 1), ("language_script", "ਸੰ", 2), ("pos_marker", "ਧਾ", 1), ("pos_marker", "ਕ੍ਰਿ. ਵਿ", 1), ("pos_marker", "ਸੰਗ੍ਯਾ", 1),
    ("sign", "hash", 1), ("sign", "quote_pair", 1), ("sign", "visarga", 1), ("sign", "footnote", 1), ("unknown_head", "ਬੱਸ", 1),
]


@query(values(_REPORT, "kind, key, n"))
def shorthand_report(spark, sf_dir):
    senses = literal(spark, [("x (ੳ) (ਹੱਥ) (ਆਸਾ ਮਃ ੫)",), ("(ਹੱਥ) (ਪੈਰ) (੧੨) (ਮਾਝ)",), (None,), ("",), ('ਸੰ. गुर ਧਾ- ਯਤਨ "ਕ ਖ"# ਸੰ. गुरु¹',), ("ਦੇਖੋ, ਨਾਮ. ਕ੍ਰਿ. ਵਿ- ਛੇਤੀ",), ("ਸੰਗ੍ਯਾ- ਨਾਮ",), ("ਬੱਸ. ਹੋਰ",)], "sense string")
    return dictionary.shorthand_report(senses, "sense", EVIDENCED)


_SOUND = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in phonetics.SOUNDS.items()) + "}"
_NASAL = "MAP {" + ", ".join(f"'{c}': '{sound}'" for sound, letters in phonetics.NASAL_BEFORE.items() for c in letters) + "}"
#: A word's characters c read one by one: what a character sounds like depends on the next one only.
_IPA = f"""regexp_replace(array_to_string(list_transform(range(1, len(c) + 1), lambda i: CASE
        WHEN c[i] = '{phonetics.ADDAK}' THEN coalesce(({_SOUND})[c[i + 1]], '') WHEN c[i] = '{phonetics.VIRAMA}' THEN ''
        WHEN contains('{phonetics.NASALS}', c[i]) THEN coalesce(({_NASAL})[c[i + 1]], '{phonetics.DENTAL}') WHEN contains('{phonetics.SIGNS}', c[i]) THEN ({_SOUND})[c[i]]
        WHEN ({_SOUND})[c[i]] IS NULL THEN '' WHEN c[i + 1] IS NOT NULL AND contains('{phonetics.SIGNS}{phonetics.VIRAMA}', c[i + 1]) THEN ({_SOUND})[c[i]] ELSE ({_SOUND})[c[i]] || '{phonetics.SCHWA}' END), ''), '{phonetics.SCHWA}$', '')"""


@query(f"WITH {VOCABULARY_SQL}, spelt AS (SELECT gurmukhi, regexp_extract_all(gurmukhi, '.') AS c FROM vocabulary) SELECT gurmukhi, {_IPA} AS ipa_display, nullif({FOLD_SQL}, '') AS search_fold FROM spelt")
def populated_words(spark, sf_dir):
    """Display IPA and folded key of every word."""
    return morph.populate(vocabulary(spark, sf_dir).select("gurmukhi"))


@query("SELECT p_partkey AS id, p_brand AS gurmukhi, 0 AS n FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT p_partkey, p_brand, CAST(count(*) AS INTEGER) FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2")
def refreshed_frequencies(spark, sf_dir):
    from ..operators.corpus import word_frequency

    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("word_id"), F.col("p_brand").alias("gurmukhi"))
    occ = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("word_id"))
    return word_frequency(words, occ, "word_id").select(F.col("word_id").alias("id"), "gurmukhi", F.col("frequency").alias("n"))
