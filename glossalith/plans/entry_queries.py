"""What a reader opens and a curator decides: word pages, dictionary ingests, landed files, spellings, the stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.script import LATIN
from ..functions.sense_parser import SENSE_SCHEMA
from ..operators import corpus, dictionary, quality, search
from ..sources import readers
from ..sources.workspace import Workspace
from .base import CORPUS_SQL, literal, query, table, values

# ---- word pages ---------------------------------------------------------------------------------------------------

_PROFILE = """
    WITH grammar AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS word_id, l_returnflag AS pos, 'R' || l_linenumber AS rule_code FROM lineitem),
    ruled AS (SELECT word_id, id, pos, rule_code, CAST(substring(rule_code, 2) AS INTEGER) % 2 = 0 AS verified FROM grammar),
    g AS (SELECT word_id, string_agg(id || pos || rule_code, ',' ORDER BY id, pos, rule_code) AS grammar, array_to_string(list_sort(list_distinct(list(rule_code) FILTER (WHERE NOT verified))), ',') AS caveats FROM ruled GROUP BY 1),
    d AS (SELECT o_custkey AS word_id, string_agg(o_orderstatus || o_orderkey, ',' ORDER BY o_orderstatus, o_orderkey) AS definitions FROM orders GROUP BY 1),
    forms AS (SELECT CAST(floor(p_partkey / 3) AS BIGINT) AS lexeme_id, p_partkey AS word_id, p_type AS d FROM part UNION ALL SELECT 1000000000 + CAST(floor(p_partkey / 4) AS BIGINT), p_partkey, p_type FROM part),
    v AS (SELECT word_id, string_agg(variant_id || d, ',' ORDER BY variant_id) AS variants FROM (SELECT DISTINCT x.word_id, y.word_id AS variant_id, y.d FROM forms x JOIN forms y USING (lexeme_id) WHERE x.word_id <> y.word_id) GROUP BY 1),
    pairs AS (SELECT l_partkey AS a, l_suppkey AS b, count(*) AS n, max(l_extendedprice) AS pmi FROM lineitem GROUP BY 1, 2),
    sides AS (SELECT a AS word_id, b AS partner_id, n, pmi FROM pairs UNION ALL SELECT b, a, n, pmi FROM pairs WHERE a <> b),
    p AS (SELECT word_id, string_agg(partner_id || ':' || n, ',' ORDER BY r) AS phrases FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY n DESC, partner_id) AS r FROM sides) WHERE r <= 15 GROUP BY 1),
    c AS (SELECT word_id, string_agg(CAST(partner_id AS VARCHAR), ',' ORDER BY r) AS collocations FROM (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY pmi DESC, partner_id) AS r FROM sides) WHERE r <= 15 GROUP BY 1),
    w AS (SELECT word_id, string_agg(writer_id || ':' || f, ',' ORDER BY r) AS writers FROM (SELECT l_partkey AS word_id, l_suppkey AS writer_id, count(*) AS f, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS r FROM lineitem GROUP BY 1, 2) WHERE r <= 10 GROUP BY 1)
    SELECT p_partkey AS word_id, p_name AS gurmukhi, grammar, CASE WHEN caveats <> '' THEN caveats END AS caveats, definitions, variants, phrases, collocations, writers
    FROM part LEFT JOIN g ON g.word_id = p_partkey LEFT JOIN d ON d.word_id = p_partkey LEFT JOIN v ON v.word_id = p_partkey LEFT JOIN p ON p.word_id = p_partkey LEFT JOIN c ON c.word_id = p_partkey LEFT JOIN w ON w.word_id = p_partkey
"""


@query(_PROFILE)
def word_profiles(spark, sf_dir):
    """The whole entry of every word, its nested parts written out: grammar with rules, caveats, definitions, variants from
    all lexemes, phrases, collocations, writers."""
    c = F.col
    part, items, orders = (table(spark, sf_dir, t) for t in ("part", "lineitem", "orders"))
    words = part.select(c("p_partkey").alias("id"), c("p_name").alias("gurmukhi"))
    nothing = F.lit(None).cast("string")
    grammar = items.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_partkey").alias("word_id"), c("l_returnflag").alias("pos"), nothing.alias("gender"), c("l_linestatus").alias("number"), nothing.alias("gram_case"), F.concat(F.lit("R"), "l_linenumber").alias("rule_code"))
    rules = spark.range(1, 8).select(F.concat(F.lit("R"), "id").alias("rule_code"), F.concat(F.lit("rule "), "id").alias("title"), (c("id") % 2 == 0).alias("verified"))
    definitions = orders.select(c("o_custkey").alias("word_id"), c("o_orderstatus").alias("dict_source_id"), c("o_orderkey").alias("sense_number"), c("o_orderpriority").alias("definition_text"))
    etymology = part.limit(0).select(c("p_partkey").alias("word_id"), F.lit(1).alias("order_index"), c("p_name").alias("origin_language"))
    family = lambda size, base: part.select((F.floor(c("p_partkey") / size) + base).alias("lexeme_id"), c("p_partkey").alias("word_id"), c("p_type").alias("inflection_desc"))
    pairs = items.groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_extendedprice").alias("pmi"))
    bigrams = pairs.select(c("l_partkey").alias("w1_id"), c("l_suppkey").alias("w2_id"), c("n").alias("pair_count"))
    collocations = pairs.select(c("l_partkey").alias("word_a_id"), c("l_suppkey").alias("word_b_id"), "pmi")
    writers = pairs.select(c("l_partkey").alias("word_id"), c("l_suppkey").alias("writer_id"), F.lit("w").alias("writer"), c("n").alias("frequency"))
    rows = search.word_profiles(words, grammar, rules, definitions, etymology, family(3, 0).unionByName(family(4, 1_000_000_000)), bigrams, collocations, writers)
    listed = lambda column, cell: F.array_join(F.transform(column, cell), ",").alias(column)
    return rows.select(
        "word_id", "gurmukhi", listed("grammar", lambda x: F.concat(x["id"], x["pos"], x["rule_code"])), F.array_join("caveats", ",").alias("caveats"), listed("definitions", lambda x: F.concat(x["dict_source_id"], x["sense_number"])),
        listed("variants", lambda x: F.concat(x["variant_id"], x["inflection_desc"])), listed("phrases", lambda x: F.concat(x["partner_id"], F.lit(":"), x["pair_count"])), listed("collocations", lambda x: x["partner_id"].cast("string")), listed("writers", lambda x: F.concat(x["writer_id"], F.lit(":"), x["frequency"])),
    )


@query(
    """WITH page AS (SELECT l_orderkey AS line_id, l_linenumber AS position FROM lineitem WHERE l_suppkey = 7 ORDER BY 1, 2 LIMIT 50 OFFSET 50),
    notes AS (SELECT o_orderkey AS line_id, o_orderstatus AS source_code, o_orderpriority AS body FROM orders UNION ALL SELECT o_orderkey, 'x', 'second' FROM orders WHERE o_orderkey % 2 = 0),
    told AS (SELECT line_id, string_agg(source_code || '=' || body, ',' ORDER BY CASE source_code WHEN 'x' THEN 1 WHEN 'P' THEN 2 ELSE 99 END, source_code) AS commentaries FROM notes GROUP BY 1),
    j AS (SELECT page.*, o_orderkey % 1430 AS ang, 's' || (o_custkey % 3) AS source, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN c_mktsegment END, 'Unknown') AS raag, commentaries FROM page JOIN orders ON o_orderkey = line_id LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN told USING (line_id)),
    f AS (SELECT *, min(struct_pack(l := line_id, p := position)) OVER (PARTITION BY raag) AS first FROM j)
    SELECT line_id, position, ang, source, raag, commentaries, CAST(dense_rank() OVER (ORDER BY first) AS INTEGER) AS group_no FROM f"""
)
def occurrence_pages(spark, sf_dir):
    """The second page of a word's occurrences: lines, sources, hymns and commentaries joined, grouped by first appearance."""
    c = F.col
    orders = table(spark, sf_dir, "orders")
    occ = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("word_id"), c("l_orderkey").alias("line_id"), c("l_linenumber").alias("position"))
    lines = orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 3).alias("source_fk"), c("o_custkey").alias("shabad_id"), (c("o_orderkey") % 1430).alias("ang"), c("o_orderpriority").alias("gurmukhi"))
    sources = spark.range(3).select("id", F.concat(F.lit("s"), "id").alias("code"), F.lit("n").alias("name"))
    shabads = table(spark, sf_dir, "customer").select(c("c_custkey").alias("id"), F.when(c("c_custkey") % 4 != 0, c("c_mktsegment")).alias("raag_english"), c("c_name").alias("writer_english"))
    notes = orders.select(c("o_orderkey").alias("line_id"), c("o_orderstatus").alias("source_code"), c("o_orderpriority").alias("body"))
    notes = notes.unionByName(orders.filter("o_orderkey % 2 = 0").select(c("o_orderkey").alias("line_id"), F.lit("x").alias("source_code"), F.lit("second").alias("body")))
    page = search.occurrence_page(occ, lines, sources, shabads, notes, 7, page=2, order=("x", "P"))
    return page.select("line_id", "position", "ang", c("source.code").alias("source"), "raag", F.array_join(F.transform("commentaries", lambda x: F.concat(x["source_code"], F.lit("="), x["body"])), ",").alias("commentaries"), "group_no")


# ---- dictionary ingests -------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT conv_id, turn, text FROM conversations WHERE conv_id % 5 <> 0 AND conv_id % 3 <> 0)
    SELECT conv_id AS word_id, 'w' || conv_id AS entry_gurmukhi, CAST(turn + 1 AS INTEGER) AS sense_number, md5(CASE WHEN conv_id % 7 = 0 THEN text || ' later' ELSE text END) AS text_md5, CASE WHEN conv_id % 2 = 0 THEN 'v' || turn END AS parser_version,
        CASE WHEN conv_id % 4 = 0 THEN 'sa' END AS origin_lang FROM s"""
)
def dictionary_entries(spark, sf_dir):
    """Entries and parsed senses written as JSON lines, malformed ones among them, and read back: unknown words and entries
    not found are left out, later repeats win, parsed senses give the cross-references."""
    c, ws = F.col, Workspace(spark, "entries")
    turns = table(spark, sf_dir, "conversations").withColumn("gurmukhi", F.concat(F.lit("w"), "conv_id")).withColumn("sense_number", (c("turn") + 1).cast("int"))
    said = lambda body: F.collect_list(F.struct("sense_number", body.alias("definition_text")))
    entry = lambda seq, body: turns.groupBy("conv_id", "gurmukhi").agg(said(body).alias("senses")).select(F.lit(seq).alias("seq"), "conv_id", "gurmukhi", (c("conv_id") % 5 != 0).alias("found"), c("gurmukhi").alias("entry_gurmukhi"), F.lit("u").alias("source_url"), "senses")
    lines = entry(0, c("text")).unionByName(entry(1, F.concat("text", F.lit(" later"))).filter("conv_id % 7 = 0")).drop("conv_id").select(F.to_json(F.struct("*")).alias("value"))
    lines.unionByName(literal(spark, [("",), ("not json",), ('{"seq": 3, "gurm',)], "value string")).write.text(ws.path("entries"))
    origin = F.struct(F.lit("Sanskrit").alias("language"), F.lit("sa").alias("iso639"), F.lit("s.").alias("marker"))
    parsed = F.struct(F.concat(F.lit("v"), "turn").alias("parser_version"), F.when(c("conv_id") % 4 == 0, F.array(origin)).alias("language_origins"))
    told = turns.filter("conv_id % 2 = 0").groupBy("gurmukhi").agg(F.collect_list(F.struct("sense_number", parsed.alias("parsed"))).alias("senses"))
    told.select(F.to_json(F.struct("gurmukhi", F.lit(0).alias("seq"), "senses")).alias("value")).write.text(ws.path("parsed"))
    entries = readers.json_lines(spark, ws.path("entries"), "seq int, gurmukhi string, found boolean, entry_gurmukhi string, source_url string, senses array<struct<sense_number: int, definition_text: string>>")
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in _top_level(SENSE_SCHEMA.replace("\n", " ")))
    senses = readers.json_lines(spark, ws.path("parsed"), f"gurmukhi string, seq int, senses array<struct<sense_number: int, parsed: struct<{fields}>>>")
    words = turns.filter("conv_id % 3 <> 0").select(c("conv_id").alias("id"), "gurmukhi").distinct()
    made = dictionary.ingest_senses(entries, readers.side_map(senses).withColumn("seq", F.lit(0)), words)
    return made.select("word_id", "entry_gurmukhi", "sense_number", F.md5("definition_text").alias("text_md5"), text.as_parsed(c("parsed"))["parser_version"].alias("parser_version"), c("cross_refs")["origin_lang"].alias("origin_lang"))


def _top_level(fields: str) -> list[str]:
    """A schema's fields, cut at the commas outside brackets."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(fields):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            out.append(fields[start:i])
            start = i + 1
    return [*out, fields[start:]]


@query(
    """WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN text END AS meaning FROM conversations WHERE conv_id % 3 <> 0 AND turn % 5 <> 4),
    f AS (SELECT conv_id, meaning, min(9 - turn) AS wn FROM e WHERE meaning IS NOT NULL GROUP BY 1, 2)
    SELECT conv_id AS word_id, md5(meaning) AS meaning_md5, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY wn) AS INTEGER) AS sense_number FROM f"""
)
def glossary_senses(spark, sf_dir):
    """Pages of a second dictionary: found ones with a meaning, repeats dropped, numbered by the page's number."""
    c = F.col
    turns = table(spark, sf_dir, "conversations").withColumn("gurmukhi", F.concat(F.lit("w"), "conv_id"))
    pages = turns.select("gurmukhi", (9 - c("turn")).cast("string").alias("wn_id"), F.when(c("turn") % 4 != 3, c("text")).alias("meaning"), (c("turn") % 5 != 4).alias("found"))
    words = turns.filter("conv_id % 3 <> 0").select(c("conv_id").alias("id"), "gurmukhi").distinct()
    return dictionary.glossary_senses(pages, words).select("word_id", F.md5("meaning").alias("meaning_md5"), "sense_number")


@query("SELECT p_name AS term, p_partkey AS wn, min(r) AS roman FROM (SELECT p.*, o.c_name AS r FROM part p LEFT JOIN customer o ON o.c_custkey = p.p_partkey) WHERE p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#7') GROUP BY 1, 2")
def paired_editions(spark, sf_dir):
    """Catalogue terms with their romanisation in the other edition, by the entry's number."""
    c = F.col
    part = table(spark, sf_dir, "part")
    other = table(spark, sf_dir, "customer").select(c("c_custkey").alias("wn"), c("c_name").alias("term"), F.lit(0).alias("ord"))
    later = other.withColumn("term", F.lit("later")).withColumn("ord", F.lit(1))
    return dictionary.pair_editions(part.select(c("p_name").alias("term"), c("p_partkey").alias("wn")), other.unionByName(later), part.filter("p_brand = 'Brand#7'").select(c("p_name").alias("gurmukhi")).distinct())


def _glossary(spark):
    schema = "key int, gurmukhi string, printed boolean, gloss string, doublet_of array<string>, homonym_index int, parts_of_speech array<string>, cdial string, inflections string, usage string, frequency string, reference_only boolean, second_member boolean, derived boolean"
    rows = [
        (1, "ਕ", True, " ", ["x", "y"], None, ["noun", "Masculine"], None, None, None, None, False, False, False), (2, "ਖ", None, None, None, 2, [], "1", None, None, None, False, False, False), (3, "ਖ", False, "g", [], None, [], None, "i", "", None, True, False, False),
        (4, "ਗ", True, "h", ["z"], 1, ["verb", "feminine"], "12", None, None, None, False, False, False), (5, "ਗ", False, "j", [], 0, [], "7", None, None, None, False, False, True),
    ]
    return dictionary.ingest_glossary(literal(spark, rows, schema), literal(spark, [(1, "ਕ")], "id int, gurmukhi string"))


@query(values([("ਖ", "derived_transliteration"), ("ਗ", "unverified_ocr")], "gurmukhi, spelling_status"))
def glossary_words(spark, sf_dir):
    return _glossary(spark)["words"]


@query(values([("ਕ", 1, "unknown", None, "x, y"), ("ਖ", 1, "Indo-Aryan", "1", None), ("ਗ", 1, "Indo-Aryan", "7", ""), ("ਗ", 2, "Indo-Aryan", "12", "z")], "gurmukhi, order_index, origin_language, cdial, doublet_of"))
def glossary_etymologies(spark, sf_dir):
    return _glossary(spark)["etymology"]


@query(values([("ਕ", "noun; Masculine", "masculine"), ("ਗ", "verb; feminine", "feminine")], "gurmukhi, pos, gender"))
def glossary_grammar(spark, sf_dir):
    return _glossary(spark)["grammar"]


@query(values([("ਨਾਮ",), ("ਮਯ",)], "target"))
def xref_existence(spark, sf_dir):
    """Targets of cross-references that are words, in decomposed form."""
    senses = literal(spark, [("ਦੇਖੋ, ਨਾਮ.",), ("ਸਾਥ. ਦੇਖੋ, ਮਯ ੭.",), ("ਦੇਖੋ, ਹੋਰ.",), ("ਦੇਖੋ, ਨਾਮ.",)], "definition_text string")
    words = literal(spark, [("ਨਾਮ",), ("ਮਯ",), ("ਘਰ",)], "gurmukhi string")
    return dictionary.existing_targets(dictionary.parse_definitions(senses), words)


# ---- spellings ----------------------------------------------------------------------------------------------------


@query(
    """WITH q AS (SELECT p_partkey AS id, p_name AS gurmukhi, upper(p_brand) AS spelling_candidate, CASE WHEN p_size % 7 <> 0 THEN p_size END AS printed_page FROM part WHERE p_size % 4 = 0 AND p_size % 8 <> 0),
    r AS (SELECT *, row_number() OVER (ORDER BY printed_page NULLS LAST, gurmukhi, id) AS rank FROM q)
    SELECT CAST(rank AS INTEGER) AS rank, id, gurmukhi, spelling_candidate, printed_page, CAST((SELECT ceil(count(*) / 20.0) FROM q) AS INTEGER) AS total_pages FROM r WHERE rank BETWEEN 21 AND 40"""
)
def spelling_queue(spark, sf_dir):
    c = F.col
    part = table(spark, sf_dir, "part")
    words = part.select(c("p_partkey").alias("id"), c("p_name").alias("gurmukhi"), F.when(c("p_size") % 4 == 0, F.upper("p_brand")).alias("spelling_candidate"), F.when(c("p_size") % 8 == 0, True).alias("spelling_reviewed"), F.when(c("p_size") % 7 != 0, c("p_size")).alias("printed_page"))
    return dictionary.spelling_queue(words, page=2, size=20)


_DECISIONS = [(3, "correct", "NATION_4"), (5, "correct", "NATION_4"), (6, "correct", "NEW"), (7, "keep", "NATION_8"), (8, "correct", "NATION_8")]


def _merged(spark, sf_dir):
    c = F.col
    words = table(spark, sf_dir, "nation").select(c("n_nationkey").alias("id"), c("n_name").alias("gurmukhi"))
    senses = table(spark, sf_dir, "customer").select(c("c_nationkey").alias("word_id"), c("c_custkey").cast("int").alias("sense_number"), c("c_name").alias("definition_text"))
    return dictionary.merge_spelling(words, senses, literal(spark, _DECISIONS, "word_id int, action string, spelling string"))


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey = 6 THEN 'NEW' WHEN n_nationkey = 8 THEN 'NATION_8' ELSE n_name END AS gurmukhi, n_nationkey IN (6, 7, 8) AS spelling_reviewed FROM nation WHERE n_nationkey NOT IN (3, 5)")
def spelling_merge_words(spark, sf_dir):
    """Decided spellings: words renamed, kept, or gone into the word that has the spelling."""
    return _merged(spark, sf_dir)[0]


@query(
    """WITH s AS (SELECT c_nationkey AS word_id, CAST(c_custkey AS INTEGER) AS sense_number, c_name AS definition_text FROM customer),
    m AS (SELECT 4 AS word_id, (SELECT max(sense_number) FROM s WHERE word_id = 4) + CAST(row_number() OVER (ORDER BY word_id, sense_number) AS INTEGER) AS sense_number, definition_text FROM s WHERE word_id IN (3, 5))
    SELECT * FROM s WHERE word_id NOT IN (3, 5) UNION ALL SELECT * FROM m"""
)
def spelling_merge_senses(spark, sf_dir):
    """The senses of words that went into another, numbered above its own."""
    return _merged(spark, sf_dir)[1]


# ---- landed files -------------------------------------------------------------------------------------------------


@query("SELECT 's' || (doc_id % 2) AS source_code, doc_id AS verse_id, doc_id % 40 AS shabad_id, CAST(doc_id % 1430 + 1 AS INTEGER) AS ang, CAST(doc_id % 19 AS INTEGER) AS line_no, md5(text) AS text_md5, CASE WHEN doc_id % 3 <> 0 THEN source END AS english, lang AS raag_english FROM documents")
def landed_pages(spark, sf_dir):
    """Corpus pages, each response a JSON document of up to 20 verses, written and read back."""
    c, ws = F.col, Workspace(spark, "pages")
    docs = table(spark, sf_dir, "documents")
    raag = F.struct(c("lang").alias("english"), F.lit(None).cast("string").alias("unicode"))
    verse = F.struct(
        c("doc_id").alias("verseId"), (c("doc_id") % 40).alias("shabadId"), F.struct(c("text").alias("unicode")).alias("verse"), (c("doc_id") % 1430 + 1).alias("pageNo"), (c("doc_id") % 19).alias("lineNo"),
        F.struct(F.struct(F.when(c("doc_id") % 3 != 0, c("source")).alias("bdb")).alias("en")).alias("translation"), raag.alias("raag"),
    )
    pages = docs.groupBy((c("doc_id") % 2).alias("s"), F.floor(c("doc_id") / 40).alias("p")).agg(F.collect_list(verse).alias("page"), F.count(F.lit(1)).alias("count"))
    pages.select(F.to_json(F.struct(F.struct(F.concat(F.lit("s"), "s").alias("sourceId"), c("p").alias("pageNo")).alias("source"), "count", "page")).alias("value")).write.text(ws.path("pages"))
    read = readers.corpus_pages(spark, ws.path("pages"))
    return read.select("source_code", "verse_id", "shabad_id", "ang", "line_no", F.md5("gurmukhi").alias("text_md5"), c("translations.bdb").alias("english"), "raag_english")


@query(
    """WITH n AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS ord FROM conversations)
    SELECT conv_id AS group_id, ord, conv_id * 1000 + turn AS verse_id, CAST(turn AS INTEGER) AS line_no, kind FROM n, (SELECT unnest(['hymn', 'composition']) AS kind) WHERE turn % 3 <> 1"""
)
def landed_hymns(spark, sf_dir):
    """Hymns and compositions as responses, written and read back in order; verses without an id are skipped."""
    c, ws = F.col, Workspace(spark, "hymns")
    turns = table(spark, sf_dir, "conversations")
    verse_id = F.when(c("turn") % 3 != 1, c("conv_id") * 1000 + c("turn"))
    ordered = lambda cell: F.transform(F.array_sort(F.collect_list(F.struct("turn", cell.alias("v")))), lambda x: x["v"])
    hymn = F.struct(verse_id.alias("verseId"), F.lit(1).alias("pageNo"), c("turn").alias("lineNo"), F.struct(c("text").alias("unicode")).alias("verse"))
    turns.groupBy("conv_id").agg(ordered(hymn).alias("verses")).select(F.to_json(F.struct(F.struct(c("conv_id").alias("shabadId")).alias("shabadInfo"), "verses")).alias("value")).write.text(ws.path("hymns"))
    verse = F.struct(F.struct(verse_id.alias("verseId"), F.lit(1).alias("pageNo"), c("turn").alias("lineNo")).alias("verse"))
    turns.groupBy("conv_id").agg(ordered(verse).alias("verses")).select(F.to_json(F.struct(F.struct(c("conv_id").alias("baniID")).alias("baniInfo"), "verses")).alias("value")).write.text(ws.path("compositions"))
    hymns = readers.shabad_verses(spark, ws.path("hymns")).select(c("shabad_id").alias("group_id"), "ord", "verse_id", "line_no", F.lit("hymn").alias("kind"))
    return hymns.unionByName(readers.bani_verses(spark, ws.path("compositions")).select(c("bani_id").cast("bigint").alias("group_id"), "ord", "verse_id", "line_no", F.lit("composition").alias("kind")))


@query(
    """WITH l AS (SELECT event_type || '-' || user_id AS key, max(event_id) AS last FROM events GROUP BY 1)
    SELECT key, CASE WHEN last % 7 <> 0 THEN CAST(last AS VARCHAR) END AS value FROM l"""
)
def lookup_cache(spark, sf_dir):
    """An append-only cache, one file, lines in order of arrival and a torn one at the end: the last of a key counts."""
    c, ws = F.col, Workspace(spark, "cache")
    line = F.to_json(F.struct(F.concat_ws("-", "event_type", "user_id").alias("key"), F.when(c("event_id") % 7 != 0, c("event_id")).alias("value")), {"ignoreNullFields": "false"})
    lines = table(spark, sf_dir, "events").select("event_id", line.alias("value")).unionByName(literal(spark, [(1 << 60, '{"key": "torn", "val')], "event_id bigint, value string"))
    lines.repartition(1).sortWithinPartitions("event_id").select("value").write.text(ws.path("cache"))
    return readers.lookup_cache(spark, ws.path("cache"))


@query("SELECT event_type || '-' || user_id AS key FROM events WHERE event_id % 2 = 0 EXCEPT SELECT event_type || '-' || user_id FROM events WHERE event_id % 3 = 0")
def cache_misses(spark, sf_dir):
    keyed = table(spark, sf_dir, "events").select("event_id", F.concat_ws("-", "event_type", "user_id").alias("key"))
    return readers.cache_misses(keyed.filter("event_id % 2 = 0"), keyed.filter("event_id % 3 = 0").select("key").distinct())


@query("SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag IN ('A', 'N') AND l_partkey IS NOT NULL)")
def pending_keys(spark, sf_dir):
    """What a scrape has left: keys without a landed row, or only with failures (R) that pass."""
    landed = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), "l_returnflag")
    return readers.pending(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), landed, "id", F.col("l_returnflag").isin("A", "N"))


@query("SELECT o_orderkey AS id, CAST(floor((row_number() OVER (ORDER BY o_orderkey) - 1) / 200) AS BIGINT) AS batch FROM orders")
def write_batches(spark, sf_dir):
    from ..sources import sinks

    return sinks.batches(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "id", 200)


_SCRIPTS = [
    ("1.sql", "CREATE TABLE IF NOT EXISTS public.words (\n id int);\n-- create table ghost (id int);\ncreate table \"Lines\" (id int);"),
    ("2.sql", "alter table only words enable row level security;\n-- alter table lines enable row level security;\ncreate table lines (id int); create table flags (id int);"),
    ("3.sql", "ALTER TABLE flags\n ENABLE ROW LEVEL SECURITY; create table audit (id int);"),
]


@query(values([("lines", "1.sql"), ("audit", "3.sql")], "table_name, file"))
def tables_without_policy(spark, sf_dir):
    return quality.tables_without_policy(literal(spark, _SCRIPTS, "file string, body string"))


@query(
    """SELECT l_partkey AS word_id, c_nationkey AS writer_id, min(c_name) AS writer, CAST(count(*) AS INTEGER) AS frequency
    FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey <> 3 GROUP BY 1, 2"""
)
def joined_writer_stats(spark, sf_dir):
    """Words, occurrences, lines and hymns joined, counted by word and writer; hymns without a writer are left out."""
    c = F.col
    words = table(spark, sf_dir, "part").select(c("p_partkey").alias("word_id"))
    occ = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("word_id"), c("l_orderkey").alias("line_id"))
    lines = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("line_id"), c("o_custkey").alias("shabad_id"))
    shabads = table(spark, sf_dir, "customer").select(c("c_custkey").alias("shabad_id"), F.when(c("c_nationkey") != 3, c("c_nationkey")).alias("writer_id"), c("c_name").alias("writer"))
    return corpus.writer_stats(words.join(occ, "word_id").join(lines, "line_id").join(shabads, "shabad_id"), "word_id")


@query("SELECT event_id, CASE WHEN event_id % 101 = 0 THEN 'var(--bg-alt)' ELSE printf('hsl(28, 45%%, %.2f%%)', 88 - (event_id % 101) / 100 * 55) END AS colour FROM events")
def heat_colours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", text.heat_colour(F.col("event_id") % 101 / 100).alias("colour"))


# ---- JSON paths, confidence, SQL functions, the stream --------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL)
    SELECT event_id, k, CASE WHEN k >= 85 THEN 'Very high' WHEN k >= 70 THEN 'High' WHEN k >= 55 THEN 'Moderate' WHEN k >= 40 THEN 'Low' ELSE 'Very low' END AS band, CASE WHEN k % 2 = 0 THEN 'v' || k END AS version FROM e WHERE k <> 13"""
)
def json_paths(spark, sf_dir):
    """Filters on JSON paths; a confidence's band; a parsed value only where it carries its parser's version."""
    c = F.col
    rows = table(spark, sf_dir, "events").filter(F.get_json_object("props", "$.k").isNotNull() & (F.get_json_object("props", "$.k") != "13")).select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))
    parsed = F.struct(F.when(c("k") % 2 == 0, F.concat(F.lit("v"), "k")).alias("parser_version"), c("k").alias("other"))
    kept = rows.withColumn("parsed", text.as_parsed(parsed))
    return kept.select("event_id", "k", text.confidence_band(c("k") / 100).alias("band"), F.when(c("parsed").isNotNull(), c("parsed.parser_version")).alias("version"))


@query(values([("display_ipa", "sət̪ɪ"), ("match_fold", "karm"), ("devanagari_iast", "dharma"), ("devanagari_slp1", "Darma"), ("grammar_facts", "ਕੋਟੁ:singular"), ("grammar_facts", "ਕੋਟੁ:noun"), ("sense_parts", "language:Sanskrit"), ("sense_parts", "pos:verbal_root"), ("sense_parts", "residue:ਯਤਨ.")], "function, value"))
def sql_functions(spark, sf_dir):
    """The functions that SQL can call."""
    from ..functions.register import register

    register(spark)
    return spark.sql(
        """SELECT 'display_ipa' AS function, display_ipa('ਸਤਿ') AS value UNION ALL SELECT 'match_fold', match_fold('kərm') UNION ALL SELECT 'devanagari_iast', devanagari_iast('धर्म') UNION ALL SELECT 'devanagari_slp1', devanagari_slp1('धर्म')
        UNION ALL SELECT 'grammar_facts', headword || ':' || value FROM grammar_facts('ਕੋਟੁ = ਕਿਲ੍ਹਾ (ਨਾਂਵ ਇਕ-ਵਚਨ) ।') UNION ALL SELECT 'sense_parts', part || ':' || value FROM sense_parts('ਸੰ. गुर ਧਾ- ਯਤਨ.')"""
    )


@query(f"WITH {CORPUS_SQL} SELECT word, source, CAST(count(*) AS BIGINT) AS frequency FROM occ GROUP BY 1, 2")
def stream_frequencies(spark, sf_dir):
    """All documents' lines arrive in two deliveries; the stream runs after each and counts both once."""
    from ..streaming import lines as stream

    ws = Workspace(spark, "stream")
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", F.explode(F.split("text", "\n")).alias("line")).select(F.col("doc_id").alias("line_id"), "source", "line", F.to_timestamp(F.lit("2024-01-01")).alias("at"))
    for part in (0, 1):
        rows.filter(F.pmod("line_id", F.lit(2)) == part).write.mode("append").parquet(ws.path("inbox"))
        stream.append_occurrences(stream.line_stream(spark, ws.path("inbox")), ws.path("out"), ws.path("checkpoint"), LATIN).awaitTermination()
    return stream.frequencies(spark, ws.path("out"))


_STATS = """SELECT 'word_corpus_stats' AS name, count(*) AS n, CAST(sum(f) AS BIGINT) AS total FROM (SELECT l_partkey, o_custkey % 3, count(*) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
    UNION ALL SELECT 'word_writer_stats', count(*), CAST(sum(f) AS BIGINT) FROM (SELECT l_partkey, o_custkey % 5, count(*) AS f FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 5 <> 0 GROUP BY 1, 2)
    UNION ALL SELECT 'word_source_stats', count(*), CAST(sum(f) AS BIGINT) FROM (SELECT p_partkey, o_orderstatus, count(*) AS f FROM part LEFT JOIN orders ON o_custkey = p_partkey GROUP BY 1, 2)
    UNION ALL SELECT 'words', count(*), CAST(sum(f) AS BIGINT) FROM (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey) AS f FROM part)"""


@query(_STATS)
def refreshed_tables(spark, sf_dir):
    """The summary tables, refreshed twice and read back: rows and totals."""
    from .refresh import refresh

    c, root = F.col, Workspace(spark, "refresh").path("tables")
    words = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_name").alias("gurmukhi"))
    occ = table(spark, sf_dir, "lineitem").select(c("l_partkey").alias("word_id"), c("l_orderkey").alias("line_id"))
    orders = table(spark, sf_dir, "orders")
    lines = orders.select(c("o_orderkey").alias("id"), (c("o_custkey") % 3).alias("source_fk"), F.when(c("o_custkey") % 5 != 0, c("o_custkey") % 5).alias("writer_id"), F.lit("w").alias("writer"))
    definitions = orders.select(c("o_custkey").alias("word_id"), c("o_orderstatus").alias("dict_source_id"))
    for _ in range(2):
        refresh(spark, root, words, occ, lines, definitions)
    out = None
    for name, n in (("word_corpus_stats", "frequency"), ("word_writer_stats", "frequency"), ("word_source_stats", "n"), ("words", "frequency")):
        row = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n"), F.sum(n).cast("bigint").alias("total")).select(F.lit(name).alias("name"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out
