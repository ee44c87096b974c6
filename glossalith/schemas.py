"""Tables and closed vocabularies of a corpus dictionary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies.
PROVENANCE = ["scraped", "imported", "rule_derived", "computed", "ai_draft", "human_verified"]
REVIEW_STATUS = ["unreviewed", "approved", "needs_work", "rejected"]
RULE_TIER = ["codified_rule", "source_extraction", "heuristic"]
SPELLING_STATUS = ["corpus_matched", "unverified_ocr", "derived_transliteration"]
DOUBTFUL = ["no", "doubtful", "very-doubtful"]
TRANSLATION_KIND = ["translation", "teeka", "padarth"]
FLAG_TYPES = ["incorrect", "doubt", "missing", "conflict", "other"]
FLAG_TARGETS = ["definitions", "etymology", "word_grammar", "word_forms", "lines", "words"]
FLAG_STATUS = ["open", "accepted", "rejected", "resolved"]
ATTRIBUTES = ["pos", "gender", "number", "gram_case", "verb_form"]

CURATION = "provenance string, review_status string, reviewed_by string, reviewed_at timestamp, curation_note string"
TABLES = {
    "sources": "id bigint, code string, name string, version string, description string, ingested_at timestamp",
    "words": "id bigint, gurmukhi string, frequency int, in_corpus boolean, origin_source string, spelling_status string, spelling_candidate string, ipa_display string, search_fold string",
    "shabads": "id bigint, raag_english string, raag_gurmukhi string, writer_english string, writer_id bigint, ang_start int, source_fk bigint",
    "lines": "id bigint, source_fk bigint, verse_id bigint, shabad_id bigint, ang int, line_no int, gurmukhi string, translation_en string, transliteration_en string",
    "word_occurrences": "word_id bigint, line_id bigint, position int",
    "word_corpus_stats": "word_id bigint, source_fk bigint, frequency int",
    "definitions": f"id bigint, word_id bigint, dict_source_id bigint, entry_gurmukhi string, sense_number int, definition_text string, definition_en string, cross_refs map<string,string>, source_url string, notes string, {CURATION}",
    "etymology": f"word_id bigint, order_index int, origin_language string, root_form string, root_form_roman string, derivation_note string, source_text string, source_code string, {CURATION}",
    "word_grammar": f"id bigint, word_id bigint, definition_id bigint, pos string, gender string, number string, gram_case string, verb_form string, rule_code string, confidence double, notes string, source_code string, source_line_id bigint, {CURATION}",
    "grammar_rules": "rule_code string, title string, explanation string, citation string, tier string, verified boolean",
    "line_translations": "line_id bigint, source_code string, body string",
    "bigrams": "w1_id bigint, w2_id bigint, pair_count int",
    "collocations": "word_a_id bigint, word_b_id bigint, window_size int, pair_count int, pmi double",
    "flags": "id bigint, word_id bigint, target_table string, target_id bigint, flag_type string, message string, suggested_source string, reporter string, status string, resolution_note string",
}


def in_vocabulary(column: Column, values: list[str], default: str | None = None) -> Column:
    """The value if the vocabulary has it, else the default (null if none is given)."""
    return F.when(column.isin(values), column).otherwise(F.lit(default))


def valid_flag(word_id: Column, flag_type: Column, target: Column, message: Column, source: Column, reporter: Column, trap: Column, filled_ms: Column) -> Column:
    """struct(ok, flag_type, target_table, message, suggested_source, reporter) of a submitted flag.

    Unknown types become `incorrect`, unknown targets null; texts are cut at 2000, 500 and 200 characters. Not ok: a
    filled trap field, a form filled in under 1.2 s, an id that is no positive whole number, an empty message.
    """
    id_ = word_id.cast("string").try_cast("bigint")
    text = F.substring(F.trim(F.coalesce(message, F.lit(""))), 1, 2000)
    ok = (F.coalesce(trap, F.lit("")) == "") & (F.coalesce(filled_ms, F.lit(0)) >= 1200) & F.coalesce(id_ > 0, F.lit(False)) & (text != "")
    return F.struct(ok.alias("ok"), in_vocabulary(flag_type, FLAG_TYPES, "incorrect").alias("flag_type"), in_vocabulary(target, FLAG_TARGETS).alias("target_table"), text.alias("message"), F.substring(F.trim(source), 1, 500).alias("suggested_source"), F.substring(F.trim(reporter), 1, 200).alias("reporter"))
