"""Golden values of scripts, forms and parsers, with the cases where a plain reading would go wrong."""

import pytest
from pyspark.sql import functions as F

from glossalith.functions import phonetics, text
from glossalith.functions.script import GURMUKHI, LATIN, fold_key, group_stem, stem, to_int, tokenize
from glossalith.functions.grammar_notes import grammar_facts_column
from glossalith.functions.sense_parser import SenseParser, parsed_sense


def column(spark, values, function, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_tokenize_splits_at_any_white_space_and_keeps_letters(spark):
    got = column(spark, ["॥ ਸਤਿ ਨਾਮੁ। ॥੧॥ |ਕਰਤਾ~", "  ਕ ਖ", "abc 12", "", None], tokenize)
    assert got == [["ਸਤਿ", "ਨਾਮੁ", "ਕਰਤਾ"], ["ਕ", "ਖ"], [], [], None]


def test_latin_tokens(spark):
    assert column(spark, ['"The end," - (été) 12'], lambda c: tokenize(c, LATIN)) == [["The", "end", "été"]]


@pytest.mark.parametrize("a,b", [("ਸਭ", "ਸਭੁ"), ("ਗੁਰੂ", "ਗੁਰੁ"), ("ਸੰਤ", "ਸਂਤ"), ("ਨਾਮੁ", "ਨਾਮ")])
def test_folds_that_meet(spark, a, b):
    assert len(set(column(spark, [a, b], fold_key))) == 1


@pytest.mark.parametrize("a,b", [("ਕਾਲ", "ਕਲ"), ("ਘਰ", "ਗਰ"), ("ਪਰ", "ਪੁਰ")])
def test_folds_that_differ(spark, a, b):
    assert len(set(column(spark, [a, b], fold_key))) == 2


def test_fold_of_other_scripts_is_empty(spark):
    assert column(spark, ["abc123!"], fold_key) == [""]


def test_final_long_vowel_folds_first_and_then_drops(spark):
    assert column(spark, ["ਗੁਰੂ"], fold_key) == ["ਗੁਰ"]


def test_two_stems_differ(spark):
    """stem() takes one vowel sign; the groups' stem takes a run, and letters besides."""
    assert column(spark, ["ਨਾਮੁ", "ਗੱਲਾਂ"], stem) == ["ਨਾਮ", "ਗੱਲ"]
    assert column(spark, ["ਲੋਕ"], stem) == ["ਲੋਕ"]
    assert column(spark, ["ਲੋਕ", "ਲੋਕੋ"], group_stem) == ["ਲੋ", "ਲੋਕੋ"]


def test_numerals(spark):
    assert column(spark, ["੧੨", "7", "ਕ", "", None], to_int) == [12, 7, None, None, None]


def test_numeric_entities(spark):
    got = column(spark, ["a&#2581;b&#x0A15;", "&#1114112;", "plain"], text.decode_numeric_entities)
    assert got == ["aਕbਕ", "&#1114112;", "plain"]


def test_pos_reader_of_definitions_and_of_senses_differ_on_the_adverb(spark):
    marker = "ਕ੍ਰਿ. ਵਿ- ਬੇਮੌਕਾ."
    assert column(spark, [marker], text.pos_of_definition)[0]["pos"] == "adjective"
    assert [p["pos"] for p in SenseParser().parse(marker)["pos"]] == ["adverb"]


def test_composed_input_is_parsed_alike():
    import unicodedata

    sense = "ਫ਼ਾ. [نام] ਸੰਗ੍ਯਾ- ਨਾਉਂ."
    assert SenseParser().parse(unicodedata.normalize("NFC", sense)) == SenseParser().parse(unicodedata.normalize("NFD", sense))


def test_quotes_pair_with_the_citation_that_follows():
    got = SenseParser().parse('ਸੰਗ੍ਯਾ- ਧਰਮ. "ਨਹਿ ਬਿਲੰਬ ਧਰਮੰ." (ਸਹਸ ਮਃ ੫) "ਸਾਧ ਕੈ ਸੰਗਿ." (ਸੁਖਮਨੀ)')
    assert [q["citation_index"] for q in got["quotes"]] == [0, 1]
    assert got["citations"][1]["work"] == "Sukhmani Sahib (Gauri M5)"


@pytest.mark.parametrize("clause", ["ਸੂਰਤ ਬਕਰ ਦੀ ਆਯਤ", "ਆਸਾ ਮਃ ੫", "ਸਗਰ ਸ਼ਬਦ ਵਿੱਚ"])
def test_prose_is_no_pointer(clause):
    assert SenseParser().targets(clause) == []


def test_pointer_qualifiers_and_joiners_are_stripped():
    assert SenseParser().targets("ਰਮ੍‌ ਧਾ") == [{"target": "ਰਮ੍", "sense_number": None}]
    assert [t["target"] for t in SenseParser().targets("ਸਤ ਅਤੇ ਸਤ੍ਯ ਸ਼ਬਦ")] == ["ਸਤ", "ਸਤ੍ਯ"]


def test_gloss_is_no_etymon():
    origins = SenseParser().parse("ਸਿੰਧੀ. ਬੱਸ. ਹੋਰ ਨਹੀਂ.")["language_origins"]
    assert origins[0]["etymon"] is None


def test_enumerators_and_hashes_in_the_residue(spark):
    residue = column(spark, ["ਪਹਿਲਾ ਭਾਗ.#(ੳ) ਦੂਜਾ ਭਾਗ.", "", "ਸੰ. गुर ਧਾ- . , -", "ਸੰ. गुर , ਯਤਨ . . ਹੋਰ"], lambda c: parsed_sense(c)["residue"])
    assert "#" not in residue[0] and "(ੳ)" in residue[0] and residue[1:] == ["", "", "ਯਤਨ.. ਹੋਰ"]


def test_genitive_and_terms_decline(spark):
    bodies = ["ਸੋ 'ਸੁਰਤੀ' ਇਸਤ੍ਰੀ-ਲਿੰਗ ਹੈ, ਤੇ 'ਸੁਰਤਿ' ਦਾ ਬਹੁ-ਵਚਨ ਹੈ", "", None, "'ਹਾਥ' ਪੁਲਿੰਗ ਹੈ। 'ਹਾਥ' ਪੁਲਿੰਗ। 'ਕ' " + "x" * 40 + " ਪੁਲਿੰਗ"]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").select("i", grammar_facts_column("body").alias("f")).orderBy("i").collect()
    assert [[(f["headword"], f["value"]) for f in r.f] for r in rows] == [[("ਸੁਰਤੀ", "feminine")], [], [], [("ਹਾਥ", "masculine")]]
    assert rows[0].f[0]["snippet"] == "ਸੋ 'ਸੁਰਤੀ' ਇਸਤ੍ਰੀ-ਲਿੰਗ ਹੈ, ਤੇ"


def test_ipa_keeps_its_literal_readings():
    assert phonetics.display_ipa("ਸਤਿ") == "sət̪ɪ"
    assert phonetics.display_ipa("ਆਸ") == "aːəs"  # a whole vowel also gets a schwa
    assert phonetics.display_ipa(None) is None


def test_sound_distance_counts_letters(spark):
    """Folding to ASCII first: one letter is one edit."""
    sounds = ["kərm", "karm", "Kārm", "ʃeːx", "tʃʰai", "", None, "Ṣ́ñ\u0303 1"]
    rows = spark.createDataFrame(list(enumerate(sounds)), "i int, sound string").select("i", phonetics.match_fold_column("sound").alias("fold")).orderBy("i").collect()
    assert [r.fold for r in rows] == ["karm", "karm", "karm", "sex", "che", "", None, "sn"]


def test_catalogue_plus_signs_stay(spark):
    html = '<a href="/dictionary/english/ms/a+b?wn=MQ==">'
    assert column(spark, [html], text.glossary_catalogue)[0][0]["term"] == "a+b"


def test_bad_base64_is_null(spark):
    assert column(spark, ["MQ==", "%%%"], text.decode_wn) == ["1", None]


def test_script_profiles_are_data():
    assert GURMUKHI.digits[3] == "੩" and LATIN.matras == ""
