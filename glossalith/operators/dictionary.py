"""Dictionary sources to definitions, etymologies and glossary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.grammar_notes import grammar_facts_column
from ..functions.legend import Legend, nfd_text
from ..functions.script import GURMUKHI, nfd
from ..functions.sense_parser import parsed_sense


def keep_last(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows that repeat the keys the one with the largest order value."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return rows.withColumn("n__", n).filter("n__ = 1").drop("n__")


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that repeat the keys the first by order."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("n__", n).filter("n__ = 1").drop("n__")


def distinct_senses(rows: DataFrame, key: str, meaning: str, order: list[str]) -> DataFrame:
    """Senses of a key without repeated meanings, numbered from 1 after that: adds sense_number."""
    kept = keep_first(rows, [key, meaning], order)
    return kept.withColumn("sense_number", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def number_above(new: DataFrame, existing: DataFrame, key: str, order: list[str], index: str = "order_index") -> DataFrame:
    """new with index running on from the largest that the key's existing rows have."""
    base = existing.groupBy(key).agg(F.max(index).alias("base__"))
    numbered = new.withColumn("n__", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return numbered.join(base, key, "left").withColumn(index, (F.coalesce("base__", F.lit(0)) + F.col("n__")).cast("int")).drop("n__", "base__")


def parse_definitions(definitions: DataFrame, column: str = "definition_text") -> DataFrame:
    """definitions with parsed, each distinct text parsed once."""
    return phonetics.over_distinct(definitions, column, parsed_sense, "parsed")


def ingest_senses(entries: DataFrame, parsed: DataFrame, words: DataFrame) -> DataFrame:
    """Definitions from landed entries (seq, gurmukhi, found, entry_gurmukhi, source_url, senses array) and parsed senses
    (seq, gurmukhi, sense_number, parsed): words not in the dictionary of words are left out, later repeats win."""
    senses = entries.filter("found").select("seq", "gurmukhi", "entry_gurmukhi", "source_url", F.explode("senses").alias("s")).select("seq", "gurmukhi", "entry_gurmukhi", "source_url", "s.*")
    latest = keep_last(parsed, ["gurmukhi", "sense_number"], "seq").select("gurmukhi", "sense_number", "parsed")
    known = senses.join(words.select(F.col("id").alias("word_id"), "gurmukhi"), "gurmukhi")
    joined = keep_last(known, ["word_id", "sense_number"], "seq").join(latest, ["gurmukhi", "sense_number"], "left")
    refs = F.coalesce(text.cross_refs_from_parsed(F.col("parsed.language_origins")), text.legacy_cross_refs(F.col("definition_text")))
    return joined.select("word_id", "entry_gurmukhi", "sense_number", "definition_text", refs.alias("cross_refs"), "parsed", "source_url")


def ingest_glossary(entries: DataFrame, words: DataFrame) -> dict[str, DataFrame]:
    """A printed glossary (key, gurmukhi, printed flag, gloss, doublet_of, homonym_index, parts_of_speech, cdial,
    inflections, usage, frequency, reference_only, second_member, derived): new words, definitions, etymologies, grammar.

    Words beyond the corpus are new: unverified when any of their entries is printed, else derived. Senses are numbered
    by homonym and key. A bare comparative number makes the origin Indo-Aryan, else unknown.
    """
    known = words.select(F.col("id").alias("word_id"), "gurmukhi")
    new = entries.join(known, "gurmukhi", "left_anti").groupBy("gurmukhi").agg(F.when(F.bool_or(F.coalesce("printed", F.lit(False))), "unverified_ocr").otherwise("derived_transliteration").alias("spelling_status"))
    order = Window.partitionBy("gurmukhi").orderBy(F.coalesce("homonym_index", F.lit(0)), "key")
    notes = text.entry_notes(*(F.col(c) for c in ("inflections", "usage", "frequency", "reference_only", "second_member", "derived")))
    definitions = entries.select("gurmukhi", F.row_number().over(order).alias("sense_number"), text.entry_text(F.col("gloss"), F.col("doublet_of")).alias("definition_text"), notes.alias("notes"))
    origin = F.when(F.col("cdial").isNotNull(), "Indo-Aryan").otherwise("unknown")
    etymology = entries.filter("cdial is not null or size(doublet_of) > 0").select("gurmukhi", F.row_number().over(order).alias("order_index"), origin.alias("origin_language"), "cdial", F.array_join("doublet_of", ", ").alias("doublet_of"))
    gender = text.gender_from_pos(F.col("parts_of_speech"))
    grammar = entries.filter(F.size("parts_of_speech") > 0).select("gurmukhi", F.array_join("parts_of_speech", "; ").alias("pos"), gender.alias("gender"))
    return {"words": new, "definitions": definitions, "etymology": etymology, "grammar": grammar}


def glossary_senses(entries: DataFrame, words: DataFrame) -> DataFrame:
    """Landed glossary pages (gurmukhi, wn_id, meaning, ...) to numbered senses of known words, repeats dropped."""
    found = entries.filter("found and meaning is not null").withColumn("wn__", F.col("wn_id").try_cast("bigint"))
    known = found.join(words.select(F.col("id").alias("word_id"), "gurmukhi"), "gurmukhi")
    return distinct_senses(known, "word_id", "meaning", ["wn__", "wn_id"]).drop("wn__")


def pair_editions(primary: DataFrame, other: DataFrame, words: DataFrame) -> DataFrame:
    """Catalogue terms of known words with their first romanisation in the other edition, joined on the entry's id."""
    roman = other.groupBy("wn").agg(F.min_by("term", "ord").alias("roman"))
    return primary.join(words.select(F.col("gurmukhi").alias("term")), "term", "left_semi").join(roman, "wn", "left")


def fallback_lookup(queries: DataFrame, catalogue: DataFrame, trailing: str) -> DataFrame:
    """Queries (word) joined to catalogue rows (headword, ord): the exact headword, else the first whose form without
    trailing characters agrees. Adds headword and match."""
    exact = keep_first(queries.join(catalogue, F.col("word") == F.col("headword")), ["word"], ["ord"]).withColumn("match", F.lit("exact"))
    bare = lambda c: F.regexp_replace(c, f"[{trailing}]+$", "")
    rest = queries.join(exact.select("word"), "word", "left_anti").withColumn("k__", bare(F.col("word")))
    loose = rest.join(catalogue.withColumn("k__", bare(F.col("headword"))), "k__").filter("k__ <> ''").drop("k__")
    return exact.unionByName(keep_first(loose, ["word"], ["ord"]).withColumn("match", F.lit("normalised")).select(*exact.columns))


def build_etymology(definitions: DataFrame, words: DataFrame, sanskrit: DataFrame, persian: DataFrame, existing: DataFrame) -> DataFrame:
    """Etymologies from parsed definitions (word_id, sense_number, definition_text, language_origins).

    Sanskrit roots in Devanagari look up `sanskrit` (headword in SLP1, gloss); Persian, Arabic and Urdu roots in
    Perso-Arabic look up `persian` (dictionary, headword, ord, roman, gloss) under every spelling, in both dictionaries
    (Arabic: platts after steingass as for Persian; Urdu: platts first), pooled without repeats; the homograph that
    sounds most like the word is taken. Rows are numbered above those that exist.
    """
    exploded = definitions.select("word_id", "sense_number", "definition_text", F.posexplode(text.etymology_candidates(F.col("language_origins"))).alias("k", "c")).select("word_id", "sense_number", "k", F.col("definition_text").alias("source_text"), "c.*")
    rows = exploded.withColumn("row__", F.xxhash64("word_id", "sense_number", "k"))
    devanagari = phonetics.over_distinct(rows.filter("origin_language = 'Sanskrit' and root_script = 'devanagari'"), "root_form", lambda c: phonetics.devanagari_column(c, "slp1"), "slp1")
    indic = devanagari.join(keep_first(sanskrit, ["headword"], ["ord"]), devanagari["slp1"] == sanskrit["headword"]).select("row__", F.col("headword").alias("root_roman"), "gloss")
    arabic = rows.filter("origin_language in ('Persian', 'Arabic', 'Urdu') and root_script = 'perso_arabic'")
    spelled = arabic.select("row__", "word_id", "origin_language", F.posexplode(text.headword_variants(F.col("root_form"))).alias("spelling", "headword"))
    first_book = F.when(F.col("origin_language") == "Urdu", "platts").otherwise("steingass")
    hits = spelled.join(persian, "headword").withColumn("place", F.struct((F.col("dictionary") != first_book).alias("later"), "spelling", "ord"))
    pooled = keep_first(hits, ["row__", "dictionary", "roman", "gloss"], ["place"])
    sounded = phonetics.over_distinct(pooled.join(words.select(F.col("id").alias("word_id"), "gurmukhi"), "word_id"), "gurmukhi", phonetics.ipa_column, "ipa")
    chosen = phonetics.best_by_sound(sounded.select("row__", "place", "roman", "gloss", "ipa"), ["row__"], "ipa", order="place").select("row__", F.col("roman").alias("root_roman"), "gloss")
    resolved = rows.join(indic.unionByName(chosen), "row__", "left")
    out = number_above(resolved, existing, "word_id", ["sense_number", "k"])
    return out.select("word_id", "order_index", "origin_language", "root_form", F.col("root_roman").alias("root_form_roman"), F.col("gloss").alias("derivation_note"), "source_text")


def mine_grammar(commentaries: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts from commentaries (line_id, body): one row per word, attribute and value, from its first line; and the
    number of facts by headword that no word matches."""
    parsed = phonetics.over_distinct(commentaries, "body", grammar_facts_column, "facts")
    found = parsed.select("line_id", F.posexplode("facts").alias("n", "f")).select("line_id", "n", "f.*")
    joined = found.join(words.select(F.col("id").alias("word_id"), F.col("gurmukhi").alias("headword")), "headword", "left")
    facts = keep_first(joined.filter("word_id is not null"), ["word_id", "attribute", "value"], ["line_id", "n"]).drop("n")
    return facts, joined.filter("word_id is null").groupBy("headword").count()


def existing_targets(definitions: DataFrame, words: DataFrame, parsed: str = "parsed") -> DataFrame:
    """Distinct cross-reference targets that are words, compared in decomposed form."""
    targets = definitions.select(F.explode(f"{parsed}.xrefs.target").alias("target")).select(nfd(F.col("target")).alias("target")).distinct()
    return targets.join(words.select(nfd(F.col("gurmukhi")).alias("target")).distinct(), "target", "left_semi")


def merge_spelling(words: DataFrame, dependents: DataFrame, decisions: DataFrame, index: str = "sense_number") -> tuple[DataFrame, DataFrame]:
    """Applies spelling decisions (word_id, action correct or keep, spelling). Correcting renames the word, or merges it
    into the word that has that spelling already: its dependent rows (word_id, index) move there, numbered above its own.
    Keeping marks it reviewed. Returns words and dependents."""
    taken = words.select(F.col("id").alias("into"), F.col("gurmukhi").alias("spelling"))
    planned = decisions.join(taken, "spelling", "left").select("word_id", "action", "spelling", F.when((F.col("action") == "correct") & (F.col("into") != F.col("word_id")), F.col("into")).alias("into"))
    joined = words.join(planned, words["id"] == planned["word_id"], "left")
    renamed = F.when((F.col("action") == "correct") & F.col("into").isNull(), F.col("spelling")).otherwise(F.col("gurmukhi"))
    kept = joined.filter("into is null").withColumn("gurmukhi", renamed).withColumn("spelling_reviewed", F.col("action").isNotNull()).select(*words.columns, "spelling_reviewed")
    moves = planned.filter("into is not null").select("word_id", "into")
    staying = dependents.join(moves, "word_id", "left_anti")
    moved = dependents.join(moves, "word_id").withColumn("from__", F.col("word_id")).withColumn("word_id", F.col("into")).drop("into")
    numbered = number_above(moved.withColumn("old__", F.col(index)).drop(index), staying, "word_id", ["from__", "old__"], index)
    return kept, staying.unionByName(numbered.select(*dependents.columns))


def spelling_check(rows: DataFrame, printed: str = "printed", candidates: str = "candidates") -> DataFrame:
    """Printed spellings against reverse transliterations (array, best first): exact, candidate or divergent, with counts."""
    same = lambda c: nfd(c) == nfd(F.col(printed))
    verdict = F.when(same(F.get(candidates, F.lit(0))), "exact").when(F.exists(candidates, same), "candidate").otherwise("divergent")
    return rows.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def parser_coverage(parsed: DataFrame, column: str = "parsed") -> DataFrame:
    """(metric, key, n): senses with each kind of part, parts, quotes paired with a citation, and tallies by language and
    part of speech, in one pass."""
    p = F.col(column)
    has = lambda part: F.when(F.size(p[part]) > 0, 1).otherwise(0)
    etymon = F.when(F.exists(p["language_origins"], lambda o: o["etymon"].isNotNull()), 1).otherwise(0)
    paired = F.size(F.filter(p["quotes"], lambda q: q["citation_index"].isNotNull()))
    one = lambda metric, key, n: F.struct(F.lit(metric).alias("metric"), key.cast("string").alias("key"), n.cast("long").alias("n"))
    nothing = F.lit("")
    fixed = F.array(
        one("senses", nothing, F.lit(1)), one("with_language", nothing, has("language_origins")), one("with_etymon", nothing, etymon), one("with_pos", nothing, has("pos")), one("with_citation", nothing, has("citations")),
        one("with_xref", nothing, has("xrefs")), one("quotes", nothing, F.size(p["quotes"])), one("paired_quotes", nothing, paired),
    )
    languages = F.transform(p["language_origins"], lambda o: one("language", o["language"], F.lit(1)))
    kinds = F.transform(p["pos"], lambda x: one("pos", x["pos"], F.lit(1)))
    return parsed.select(F.explode(F.concat(fixed, languages, kinds)).alias("x")).groupBy("x.metric", "x.key").agg(F.sum("x.n").alias("n"))


def shorthand_report(senses: DataFrame, column: str, legend: Legend, top: int = 20) -> DataFrame:
    """(kind, key, n) over the senses that have text: kinds of bracketed texts and the `top` most frequent unrecognised
    ones; how senses begin (head: xref, language, pos or prose); markers of speech and of language by place (pos_marker,
    language_head, language_script); words with a full stop at a head that the legend doesn't know (unknown_head, `top`);
    counts of signs (sign). One pass gathers all but the bracketed texts."""
    sources = {token: group for token, (group, _) in legend.works.items() if " " not in token} | dict.fromkeys(legend.raags, "sggs_raags")
    told = senses.select(nfd(F.col(column)).alias("t")).filter("t <> ''")
    bodies = told.select(F.explode(F.regexp_extract_all("t", F.lit(r"\(([^()]{1,70})\)"), F.lit(1))).alias("body"))
    kinds = bodies.withColumn("kind", text.classify_citation(F.col("body"), sources, list(legend.bhagats)))
    tally = kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).select("kind", F.lit("").alias("key"), "n")
    unknown = _most(kinds.filter("kind = 'unrecognized'").select("body"), "body", "unrecognized_body", top)

    gur = GURMUKHI.block
    one = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), (F.lit(key) if isinstance(key, str) else key).alias("key"), n.cast("long").alias("n"))
    count = lambda pattern: F.regexp_count("t", F.lit(pattern))
    head = F.regexp_extract("t", rf"^\s*([{gur}]+)", 1)
    after = F.regexp_extract("t", rf"^\s*[{gur}]+(-|[.]|)", 1)
    second = F.regexp_extract("t", rf"^\s*[{gur}]+[.,]?\s+([{gur}]+)", 1)
    of = lambda words: F.array(*(F.lit(w) for w in words)).cast("array<string>")
    marked = F.array_contains(of(legend.pos), head) & ((after != "") | F.array_contains(of(legend.pos), second))
    begins = F.when(head == nfd(F.lit("ਦੇਖੋ")), "xref").when(F.array_contains(of(legend.languages), head), "language").when(marked, "pos").otherwise("prose")
    adverb = rf"(?<![{gur}])ਕ੍ਰਿ[.]?\s*ਵਿ-"
    verbs = rf"(?<![{gur}])(?<!ਕ੍ਰਿ[.]?\s{{0,3}})"
    signs = {"nukta": "\u0a3c", "visarga": f"[{gur}]\u0a03", "footnote": "[¹²³⁴⁵]", "quote_pair": '"[^"]*"', "devanagari_quote": "''[^']*''", "arabic_bracket": r"\[[^\]]*[\x{0600}-\x{06FF}][^\]]*\]", "hash": "#"}
    found = [
        one("head", begins, F.lit(1)),
        one("pos_marker", "ਕ੍ਰਿ. ਵਿ", count(adverb)),
        *(one("pos_marker", m, count(f"{verbs}{m}-")) for m in legend.pos),
        *(one("language_head", m, (head == m).cast("int")) for m in legend.languages),
        *(one("language_script", m, count(rf"(?<![{gur}]){m}[.]\s*(?=\[|[\x{{0900}}-\x{{097F}}])")) for m in legend.languages),
        *(one("sign", name, count(pattern)) for name, pattern in signs.items()),
    ]
    counted = told.select(F.explode(F.filter(F.array(*found), lambda x: x["n"] > 0)).alias("x")).groupBy("x.kind", "x.key").agg(F.sum("x.n").alias("n"))
    known = [nfd_text(w) for w in (*legend.languages, *legend.pos, *sources, "ਦੇਖੋ", "ਸੰਬੋਧਨ", "ਲੋਕੋ")]
    strange = told.select(head.alias("head"), after.alias("after")).filter((F.col("after") == ".") & ~F.col("head").isin(known) & ~F.col("head").rlike(f"^[{GURMUKHI.digits}]+$"))
    return tally.unionByName(unknown).unionByName(counted).unionByName(_most(strange, "head", "unknown_head", top))


def _most(rows: DataFrame, column: str, kind: str, top: int) -> DataFrame:
    counts = rows.groupBy(F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return counts.select(F.lit(kind).alias("kind"), "key", "n")


def spelling_queue(words: DataFrame, page: int = 1, size: int = 50) -> DataFrame:
    """One page of the spellings to decide: words (id, gurmukhi, spelling_candidate, spelling_reviewed, printed_page) that
    have a candidate and no review, in the order of the printed page, unpaged ones last; rank and total_pages added."""
    waiting = words.filter("spelling_candidate is not null and not coalesce(spelling_reviewed, false)")
    order = (F.col("printed_page").asc_nulls_last(), "gurmukhi", "id")
    total = waiting.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("total_pages"))
    rows = waiting.orderBy(*order).offset((page - 1) * size).limit(size)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(*order)) + (page - 1) * size)  # one page
    return ranked.crossJoin(F.broadcast(total)).select("rank", "id", "gurmukhi", "spelling_candidate", "printed_page", "total_pages")  # one row
