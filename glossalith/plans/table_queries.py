"""Numbering, dedupe, page text and sinks over conversations, pages and small tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.script import SPACE
from ..operators import dictionary
from ..sources import readers, sinks
from .base import query, table

@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) + CASE WHEN conv_id % 2 = 0 THEN 10 ELSE 0 END AS order_index FROM conversations")
def sense_numbering(spark, sf_dir):
    """Numbers run on above those that even conversations have already."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    existing = rows.filter("conv_id % 2 = 0").select("conv_id", F.lit(10).alias("order_index")).distinct()
    return dictionary.number_above(rows, existing, "conv_id", ["turn"])


@query("SELECT conv_id, role, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations GROUP BY 1, 2")
def keep_last(spark, sf_dir):
    return dictionary.keep_last(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn").select("conv_id", "role", "turn", "text")


@query("WITH f AS (SELECT conv_id, text AS meaning, min(turn) AS turn FROM conversations GROUP BY 1, 2) SELECT conv_id, meaning, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS sense_number FROM f")
def distinct_meaning(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("meaning"))
    return dictionary.distinct_senses(rows, "conv_id", "meaning", ["turn"])


_CLEAN = f"trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&nbsp;', ' '), '[{SPACE}]+', ' ', 'g'), '[{SPACE}]+([.,;:)])', '\\1', 'g'))"


@query(f"SELECT page_id, md5({_CLEAN}) AS text_md5, length({_CLEAN}) AS n FROM pages")
def tag_strip(spark, sf_dir):
    clean = text.strip_tags(F.col("html"), numeric=False)
    return table(spark, sf_dir, "pages").select("page_id", F.md5(clean.cast("binary")).alias("text_md5"), F.length(clean).cast("long").alias("n"))


@query(r"""WITH b AS (SELECT page_id, unnest(string_split_regex(html, '<li>')[2:]) AS block, unnest(range(len(string_split_regex(html, '<li>')) - 1)) AS block_no FROM pages)
    SELECT page_id, block_no, regexp_extract(block, '<a href="([^"]*)">([^<]*)</a>', 1) AS href, regexp_extract(block, '<a href="([^"]*)">([^<]*)</a>', 2) AS title FROM b""")
def html_entries(spark, sf_dir):
    blocks = readers.html_blocks(table(spark, sf_dir, "pages"), "html", "<li>")
    link = '<a href="([^"]*)">([^<]*)</a>'
    return blocks.select("page_id", F.col("block_no").cast("long").alias("block_no"), F.regexp_extract("block", link, 1).alias("href"), F.regexp_extract("block", link, 2).alias("title"))


@query("SELECT doc_id, CAST(doc_id AS VARCHAR) AS wn FROM documents")
def base64_decode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.decode_wn(F.base64(F.col("doc_id").cast("string").cast("binary"))).alias("wn"))


@query("SELECT event_id, 't' AS key, event_type AS value FROM events UNION ALL SELECT event_id, 'u', CAST(user_id AS VARCHAR) FROM events")
def unpivot_props(spark, sf_dir):
    """An object of objects per event: hidden keys and values that aren't text are skipped."""
    body = F.format_string('{"%s":{"t":"%s","u":"%s","n":%s,"_h":"x"},"_meta":{"t":"x"}}', F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), F.get_json_object("props", "$.k"))
    return readers.unpivot_maps(table(spark, sf_dir, "events").select(body.alias("j")), "j").select(F.col("category").cast("bigint").alias("event_id"), "key", "value")


_OLD, _NEW = "SELECT n_nationkey AS id, n_name AS name, n_regionkey AS scope FROM nation", "SELECT n_nationkey + 10 AS id, lower(n_name) AS name, 1 AS scope FROM nation WHERE n_regionkey = 1"


def _old_new(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    old = nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("scope"))
    new = nation.filter("n_regionkey = 1").select((F.col("n_nationkey") + 10).alias("id"), F.lower("n_name").alias("name"), F.lit(1).alias("scope"))
    return old, new


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT * FROM new")
def upsert_merge(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.merge_rows(sinks.merge_rows(old, new, ["id"]), new, ["id"])


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old UNION ALL SELECT * FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_absent(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return old.unionByName(sinks.insert_absent(old, new, ["id"]))


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT * FROM old WHERE scope <> 1 UNION ALL SELECT * FROM new")
def scoped_replace(spark, sf_dir):
    """Applied twice: the table is the same as after once."""
    old, new = _old_new(spark, sf_dir)
    return sinks.scoped_rows(sinks.scoped_rows(old, new, {"scope": 1}), new, {"scope": 1})


@query(f"WITH old AS ({_OLD}), new AS ({_NEW}) SELECT new.* FROM new JOIN old USING (id) WHERE new.name IS DISTINCT FROM old.name")
def changed_rows(spark, sf_dir):
    old, new = _old_new(spark, sf_dir)
    return sinks.changed_rows(old, new, "id", "name")


@query("SELECT 'documents' AS table_name, count(*) AS n FROM documents WHERE source = 'src3' UNION ALL SELECT 'english', count(*) FROM documents WHERE lang = 'en' AND source = 'src3'")
def teardown_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sinks.teardown_counts({"documents": docs, "english": docs.filter("lang = 'en'")}, "source", "src3")


@query(
    """WITH c AS (SELECT p_partkey AS ord, p_name AS headword FROM part), q AS (SELECT DISTINCT p_name || CASE WHEN p_partkey % 2 = 0 THEN 'aa' ELSE '' END AS word FROM part),
    e AS (SELECT word, headword, ord, 'exact' AS match FROM q JOIN c ON word = headword UNION ALL SELECT word, headword, ord, 'normalised' FROM q JOIN c ON regexp_replace(word, '[ae]+$', '') = regexp_replace(headword, '[ae]+$', '') WHERE word NOT IN (SELECT headword FROM c)),
    r AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY ord) AS n FROM e) SELECT word, headword, ord, match FROM r WHERE n = 1"""
)
def fallback_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    catalogue = part.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("headword"))
    asked = part.select(F.concat("p_name", F.when(F.col("p_partkey") % 2 == 0, "aa").otherwise("")).alias("word")).distinct()
    return dictionary.fallback_lookup(asked, catalogue, "ae")
