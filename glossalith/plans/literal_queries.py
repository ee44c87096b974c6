"""Operators on golden inputs: each query's SQL is a list of expected rows, written by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import phonetics, text
from ..functions.legend import EVIDENCED
from ..functions.grammar_notes import grammar_facts_column
from ..functions.sense_parser import parsed_sense
from ..operators import dictionary
from ..schemas import valid_flag
from .base import literal, query, values

# ---- Perso-Arabic spellings, sounds ------------------------------------------------------------------------------

_HEADWORDS = [("حُكم", ["حكم", "حکم"]), ("كتاب", ["كتاب", "کتاب"]), ("زور", ["زور"]), ("ہے", ["ہے", "هی", "هي"])]


@query(values([(w, k, v) for w, vs in _HEADWORDS for k, v in enumerate(vs)], "word, place, variant"))
def headword_variants(spark, sf_dir):
    rows = literal(spark, [(w,) for w, _ in _HEADWORDS], "word string")
    return rows.select("word", F.posexplode(text.headword_variants(F.col("word"))).alias("place", "variant"))


_MARKED = [("حُكْم", "حكم"), ("ـكتاب", "كتاب"), ("زور", "زور"), ("", "")]


@query(values(_MARKED, "word, bare"))
def arabic_strip(spark, sf_dir):
    return literal(spark, [(w,) for w, _ in _MARKED], "word string").select("word", text.strip_arabic_marks(F.col("word")).alias("bare"))


_FOLDS = [("seːkʰ", "sex"), ("shaiḵẖ", "sex"), ("shīḵẖ", "six"), ("ɦʊkəm", "hukam"), ("ḥukm", "hukm"), ("t͡ʃaːr", "car"), ("123", "")]


@query(values(_FOLDS, "sound, fold"))
def sound_fold(spark, sf_dir):
    return literal(spark, [(w,) for w, _ in _FOLDS], "sound string").select("sound", phonetics.match_fold_column("sound").alias("fold"))


_HOMOGRAPHS = [
    ("sheikh", "seːkʰ", 0, "shīḵẖ", "a"), ("sheikh", "seːkʰ", 1, "shaiḵẖ", "b"), ("tie", "kərm", 0, "karm", "c"), ("tie", "kərm", 1, "karm", "d"),
    ("none", "k", 0, None, "e"), ("none", "k", 1, None, "f"), ("list", "d̪əm", 0, "zor", "g"), ("list", "d̪əm", 1, "dum, dam", "h"),
]


@query(values([("sheikh", "shaiḵẖ", "b"), ("tie", "karm", "c"), ("none", None, "e"), ("list", "dum, dam", "h")], "word, roman, gloss"))
def dsal_select(spark, sf_dir):
    rows = literal(spark, _HOMOGRAPHS, "word string, ipa string, ord int, roman string, gloss string")
    return phonetics.best_by_sound(rows, ["word"], "ipa").select("word", "roman", "gloss")


_IPA = [("ਸਤਿ", False, "sət̪ɪ"), ("ਕ", False, "k"), ("ਕ", True, "kə"), ("ਨਾਮੁ", False, "n̪aːmʊ"), ("ਆਸ", False, "aːəs"), ("ਸ਼ਾ", False, "səaː"), ("ਸੰਤ", False, "sən̪t̪"), ("ਅੰਗ", False, "əəŋg"), ("", False, "")]


@query(values(_IPA, "word, final_schwa, ipa"))
def ipa_display(spark, sf_dir):
    rows = literal(spark, [r[:2] for r in _IPA], "word string, final_schwa boolean")
    return rows.select("word", "final_schwa", F.when(F.col("final_schwa"), phonetics.ipa_column("word", True)).otherwise(phonetics.ipa_column("word")).alias("ipa"))


_DEVANAGARI = [("गुर", "gura", "gura"), ("धर्म", "dharma", "Darma"), ("पानीय", "pānīya", "pAnIya"), ("संस्कृत", "saṃskṛta", "saMskfta"), ("ऋषि", "ṛṣi", "fzi")]


@query(values(_DEVANAGARI, "word, iast, slp1"))
def transliteration(spark, sf_dir):
    rows = literal(spark, [(r[0],) for r in _DEVANAGARI], "word string")
    return rows.select("word", phonetics.devanagari_column("word").alias("iast"), phonetics.devanagari_column("word", "slp1").alias("slp1"))


# ---- pages -------------------------------------------------------------------------------------------------------

_OLD = "<div class='hw_result'>1) <a href='x'>حکم</a> ḥukm (p. 427)<blockquote>ḥukm [v.n. of x], <i>Order</i> , decree ( law ); — ḥukm-andāz, an archer</blockquote></div>"
_TWO = "<div class='container mb-3 rounded border shadow-sm py-3'>1) <a h='1'>شیخ</a> shaiḵẖ <br><div class='px-4'>An elder &amp; chief : — shaiḵẖī, rank</div></div><div class='container mb-3 rounded border shadow-sm py-3'>2) <a h='2'>شیخ</a>\n<p>no body</p></div>"
_PAGES = [("steingass", _OLD), ("platts", _TWO), ("platts", "No results for search term <div class='hw_result'>1) <a x='y'>z</a>"), ("steingass", "<div class='hw_result'>no head line</div>")]


@query(values([("steingass", "حکم", "ḥukm", "ḥukm, Order, decree (law)"), ("platts", "شیخ", "shaiḵẖ", "An elder & chief"), ("platts", "شیخ", None, None)], "dictionary, headword, roman, gloss"))
def dictionary_pages(spark, sf_dir):
    rows = literal(spark, _PAGES, "dictionary string, html string")
    read = F.when(F.col("dictionary") == "steingass", text.dictionary_results(F.col("html"), "steingass")).otherwise(text.dictionary_results(F.col("html"), "platts"))
    return rows.select("dictionary", F.explode(read).alias("r")).select("dictionary", "r.*")


_TEI = [
    (1, "<entry><sense n='1'>a <i>dog</i> , <note>p. 3</note>hound ( big )</sense><sense>second</sense></entry>", "a dog, hound (big)"),
    (2, "<entry>no sense</entry>", None),
    (3, "<sense><note>only</note></sense>", None),
    (4, "<sense>x &lt;y&gt; &amp; z</sense>", "x <y> & z"),
]


@query(values([(i, g) for i, _, g in _TEI], "id, gloss"))
def tei_gloss(spark, sf_dir):
    return literal(spark, [r[:2] for r in _TEI], "id int, xml string").select("id", text.tei_gloss(F.col("xml")).alias("gloss"))


_CATALOGUE = '<a href="/dictionary/panjabi/ms/%E0%A8%95?wn=Mjk4Mw==">x</a><a href="/dictionary/english/ms/a%20b?wn=MQ==">y</a><a href="/dictionary/panjabi/ms/%E0%A8%95?wn=Mjk4Mw==">again</a><a href="/dictionary/english/ms/100%?wn=Mg==">bad</a><a href="/other/ms/q?wn=Mw==">no</a>'


@query(values([(0, "ਕ", "Mjk4Mw==", "2983"), (1, "a b", "MQ==", "1"), (2, "100%", "Mg==", "2")], "place, term, wn, id"))
def url_catalog(spark, sf_dir):
    rows = literal(spark, [(_CATALOGUE,)], "html string").select(F.posexplode(text.glossary_catalogue(F.col("html"))).alias("place", "e"))
    return rows.select("place", "e.term", "e.wn", text.decode_wn(F.col("e.wn")).alias("id"))


_ENTRY = '<h5 class="a"><a href="#">kaliāṇā</a></h5><p>welfare , <b>bliss</b> &#2581; &#x0A15;</p><p>second</p><p><i class="dictHeading">Grammar:</i> noun, nominative case; masculine.</p><p><i class="dictHeading">Etymology :</i> Sanskrit - x;</p>'


@query(values([("kaliāṇā", "welfare, bliss ਕ ਕ", "noun, nominative case; masculine", "Sanskrit - x"), (None, None, None, None)], "headword_roman, meaning, grammar, etymology"))
def glossary_pages(spark, sf_dir):
    return literal(spark, [(_ENTRY,), ("<p> </p>",)], "html string").select(text.glossary_entry(F.col("html")).alias("e")).select("e.*")


# ---- definitions -------------------------------------------------------------------------------------------------

_DESCRIPTIONS = [
    (1, "ਸੰ. ਸੰਗ੍ਯਾ- ਵਰ੍ਹਾ. ਸਾਲ। ੨. ਰੁੱਤ. ਮੌਸਮ। ੩. ਅੱਧਾ ਸਾਲ.", [(1, "ਸੰ. ਸੰਗ੍ਯਾ- ਵਰ੍ਹਾ. ਸਾਲ"), (2, "ਰੁੱਤ. ਮੌਸਮ"), (3, "ਅੱਧਾ ਸਾਲ.")]),
    (2, "ਇੱਕ।", [(1, "ਇੱਕ")]),
    (3, "।੧੨. ਬਾਰਾਂ", [(12, "ਬਾਰਾਂ")]),
    (4, "", []),
]


@query(values([(i, n, t) for i, _, senses in _DESCRIPTIONS for n, t in senses], "id, sense_number, definition_text"))
def sense_split(spark, sf_dir):
    rows = literal(spark, [r[:2] for r in _DESCRIPTIONS], "id int, description string")
    return rows.select("id", F.explode(text.split_senses(F.col("description"))).alias("s")).select("id", "s.*")


_REFS = [("ਸੰ. ਜਲ", None, "sa"), ("ਫ਼ਾ. [زور] ਬਲ", "زور", "fa"), ("[abc] ਜਲ", None, None), ("[سما] ਅਸਮਾਨ", "سما", None), ("ਭਾਉ. ਅਸਰ", None, None)]


@query(values(_REFS, "definition, ar_fa, origin_lang"))
def cross_refs(spark, sf_dir):
    rows = literal(spark, [(r[0],) for r in _REFS], "definition string").select("definition", text.legacy_cross_refs(F.col("definition")).alias("m"))
    return rows.select("definition", F.col("m")["ar_fa"].alias("ar_fa"), F.col("m")["origin_lang"].alias("origin_lang"))


_SENSES = [
    (1, 'ਸੰ. ਪਾਨੀਯ. ਸੰਗ੍ਯਾ- ਜਲ. "ਪਾਣੀ ਅੰਦਿਰ ਲੀਕ ਜਿਉ." (ਵਾਰ ਆਸਾ ਮਃ ੨)'), (2, "ਫ਼ਾ. [زور] ਜ਼ੋਰ. ਸੰਗ੍ਯਾ- ਬਲ."), (3, "ਸੰ. गुर ਧਾ- ਯਤਨ ਕਰਨਾ."), (4, "ਕ੍ਰਿ. ਵਿ- ਬੇਮੌਕਾ."), (5, "ਸਮੇਤ. ਸਾਥ. ਦੇਖੋ, ਮਯ ੭."),
    (6, "ਦੇਖੋ, ਸਤ ਅਤੇ ਸਤ੍ਯ ਸ਼ਬਦ. ਸਤ੍ਯ ਰੂਪ."), (7, "ਇਸ ਦੀ ਉਤਪੱਤੀ ਦਾ ਨਿਰਣਾ ਦੇਖੋ, ਸਗਰ ਸ਼ਬਦ ਵਿੱਚ."), (8, "ਸਰਵ- ਉਹ ਦਾ ਬਹੁ ਵਚਨ. ਵੇ."), (9, "ਵ੍ਯ- ਸੰਬੋਧਨ. ਹੇ ਸ਼ਾਹ!"), (10, "ਕਰ (ਹੱਥ) ਵਿੱਚ."), (11, "ਅਸਥਾਨ. ਦੇਸ਼. ਮੁਲਕ."), (12, None),
]
_PARSED = [
    (1, "sa", "gurmukhi", "noun", None, None, "ਜਲ."), (2, "fa", "perso_arabic", "noun", None, None, "ਜ਼ੋਰ. ਬਲ."), (3, "sa", "devanagari", "verbal_root", None, None, "ਯਤਨ ਕਰਨਾ."), (4, None, None, "adverb", None, None, "ਬੇਮੌਕਾ."),
    (5, None, None, None, "ਮਯ", None, "ਸਮੇਤ. ਸਾਥ."), (6, None, None, None, "ਸਤ,ਸਤ੍ਯ", None, "ਸਤ੍ਯ ਰੂਪ."), (7, None, None, None, None, None, "ਇਸ ਦੀ ਉਤਪੱਤੀ ਦਾ ਨਿਰਣਾ ਦੇਖੋ, ਸਗਰ ਸ਼ਬਦ ਵਿੱਚ."),
    (8, None, None, "pronoun", None, "number=plural", "ਉਹ ਦਾ ਬਹੁ ਵਚਨ. ਵੇ."), (9, None, None, "particle", None, "case=vocative", "ਸੰਬੋਧਨ. ਹੇ ਸ਼ਾਹ!"), (10, None, None, None, None, None, "ਕਰ (ਹੱਥ) ਵਿੱਚ."), (11, None, None, None, None, None, "ਅਸਥਾਨ. ਦੇਸ਼. ਮੁਲਕ."), (12, None, None, None, None, None, ""),
]


def _parsed(spark):
    rows = literal(spark, _SENSES, "id int, sense string")
    return rows.select("id", parsed_sense("sense").alias("p"))


@query(values(_PARSED, "id, iso639, etymon_script, pos, xrefs, frame, residue"))
def parse_sense(spark, sf_dir):
    nothing = lambda c: F.nullif(c, F.lit(""))
    origin, frame = F.get("p.language_origins", F.lit(0)), F.get("p.grammar", F.lit(0))
    return _parsed(spark).select(
        "id", origin["iso639"].alias("iso639"), origin["etymon"]["script"].alias("etymon_script"), F.get("p.pos", F.lit(0))["pos"].alias("pos"), nothing(F.array_join("p.xrefs.target", ",")).alias("xrefs"), nothing(F.concat_ws("=", frame["attribute"], frame["value"])).alias("frame"), F.col("p.residue").alias("residue"),
    )


_CANDIDATES = [(1, 0, "Sanskrit", None, None), (2, 0, "Persian", "زور", "perso_arabic"), (3, 0, "Sanskrit", "गुर", "devanagari")]


@query(values(_CANDIDATES, "id, place, origin_language, root_form, root_script"))
def etymology_candidates(spark, sf_dir):
    rows = _parsed(spark).select("id", F.posexplode(text.etymology_candidates(F.col("p.language_origins"))).alias("place", "c"))
    return rows.select("id", "place", "c.*")


@query(values([(1, "sa", None), (2, "fa", "زور"), (3, "sa", None)], "id, origin_lang, ar_fa"))
def parsed_cross_refs(spark, sf_dir):
    rows = _parsed(spark).select("id", text.cross_refs_from_parsed(F.col("p.language_origins")).alias("m")).filter("m is not null")
    return rows.select("id", F.col("m")["origin_lang"].alias("origin_lang"), F.col("m")["ar_fa"].alias("ar_fa"))


_COVERAGE = [("senses", "", 12), ("with_language", "", 3), ("with_etymon", "", 3), ("with_pos", "", 6), ("with_citation", "", 1), ("with_xref", "", 2), ("quotes", "", 1), ("paired_quotes", "", 1), ("language", "Sanskrit", 2), ("language", "Persian", 1), ("pos", "noun", 2), ("pos", "verbal_root", 1), ("pos", "adverb", 1), ("pos", "pronoun", 1), ("pos", "particle", 1)]


@query(values(_COVERAGE, "metric, key, n"))
def parser_coverage(spark, sf_dir):
    return dictionary.parser_coverage(_parsed(spark), "p")


_CITED = [
    ("ਬਿਲਾ ਮਃ ੩", "Bilaval, Mahala 3"), ("ਵਾਰ ਰਾਮ ੨. ਮਃ ੫", "Vaar of Ramkali 2, Mahala 5"), ("ਵਾਰ ਮਾਝ ਮਃ ੧", "Vaar of Majh, Mahala 1"), ("ਸ. ਕਬੀਰ", "Salok Kabir"), ("ਆਸਾ ਕਬੀਰ", "Asa, Kabir"), ("ਕ੍ਰਿਸਨਾਵ", "Krishna Avtar (Dasam Granth)"),
    ("ਚਰਿਤ੍ਰ ੧੦੮", "Charitropakhyan 108 (Dasam Granth)"), ("ਸਵੈਯੇ ਮਃ ੫. ਕੇ", "Bhatt Savaiye (praise of Mahala 5), Mahala 5"), ("ਭਾਗੁ ਕ", "Bhai Gurdas Kabitt"),
]


@query(values(_CITED, "raw, decoded"))
def citation_decode(spark, sf_dir):
    rows = literal(spark, [(f"x ({raw})",) for raw, _ in _CITED] + [("x (ਹੱਥ) (ੳ) (੧੨)",)], "sense string").select(F.explode(parsed_sense("sense")["citations"]).alias("c"))
    return rows.select("c.raw", text.citation_text(F.col("c"), EVIDENCED.raags, EVIDENCED.sections, EVIDENCED.bhagats).alias("decoded"))


_BODIES = [("ੳ", "enumerator"), (" . ", "empty"), ("੧ ੨", "numeric"), ("ਲੋਕੋ", "proverb"), ("ਦੇਖੋ ਨਾਮ", "xref_paren"), ("ਆਸਾ ਮਃ ੫", "source:sggs_raags"), ("ਕਬੀਰ ਜੀ", "bhagat_only"), ("ਮਃ ੫", "grammar_only"), ("ਹੱਥ", "unrecognized")]


@query(values(_BODIES, "body, kind"))
def citation_kinds(spark, sf_dir):
    sources = dict.fromkeys(EVIDENCED.raags, "sggs_raags")
    return literal(spark, [(b,) for b, _ in _BODIES], "body string").select("body", text.classify_citation(F.col("body"), sources, list(EVIDENCED.bhagats)).alias("kind"))


_FRAMES = [("number", "plural", "ਉਹ", "Plural of ਉਹ"), ("number", "plural", None, "Plural"), ("mood", "imperative", "ਕਰ", "Imperative of ਕਰ"), ("gender", "masculine", None, "Masculine"), ("tense", "past", None, "Past tense"), ("lexical", "short_form_of", "ਸਤਿਗੁਰੂ", "Short form of ਸਤਿਗੁਰੂ"), ("voice", "passive", None, "voice: passive")]


@query(values(_FRAMES, "attribute, value, referent, label"))
def grammar_frames(spark, sf_dir):
    return literal(spark, [r[:3] for r in _FRAMES], "attribute string, value string, referent string").select("*", text.grammar_frame(F.col("attribute"), F.col("value"), F.col("referent")).alias("label"))


_NOTES = [
    (1, "ਹਾਥ = ਸ਼ਬਦ 'ਹਾਥ' ਇਸਤ੍ਰੀ-ਲਿੰਗ ਹੈ।"), (2, "'ਸਾਹਿਬੁ' ਪੁਲਿੰਗ ਹੈ, ਇਸ ਕਰ ਕੇ 'ਸਾਚਾ' ਭੀ ਪੁਲਿੰਗ ਹੈ।"), (3, "ਸੋ 'ਸੁਰਤੀ' ਇਸਤ੍ਰੀ-ਲਿੰਗ ਹੈ, ਤੇ 'ਸੁਰਤਿ' ਦਾ ਬਹੁ-ਵਚਨ ਹੈ"), (4, "ਕੋਟੁ = ਕਿਲ੍ਹਾ (ਨਾਂਵ ਇਕ-ਵਚਨ) । ਕੋਟ = ਕਿਲ੍ਹੇ (ਨਾਂਵ, ਬਹੁ ਵਚਨ) ।"),
    (5, "ਕਿਸੇ 'ਨਾਂਵ' ਦੇ ਵਿਸ਼ੇਸ਼ਣ ਦਾ ਉਹੀ ਲਿੰਗ ਹੁੰਦਾ ਹੈ"), (6, "ਨਾਨਕ = ਹੇ ਨਾਨਕ! ਹੋਸੀ = ਹੋਵੇਗਾ, ਰਹੇਗਾ। 1।"), (7, ""), (8, "'ਹਾਥ' ਇਸਤ੍ਰੀ ਲਿੰਗ ਹੈ।"),
]
_FACTS = [
    (1, "ਹਾਥ", "gender", "feminine"), (2, "ਸਾਹਿਬੁ", "gender", "masculine"), (2, "ਸਾਚਾ", "gender", "masculine"), (3, "ਸੁਰਤੀ", "gender", "feminine"), (4, "ਕੋਟੁ", "number", "singular"), (4, "ਕੋਟੁ", "pos", "noun"), (4, "ਕੋਟ", "number", "plural"), (4, "ਕੋਟ", "pos", "noun"), (8, "ਹਾਥ", "gender", "feminine"),
]


@query(values(_FACTS, "line_id, headword, attribute, value"))
def padarth_facts(spark, sf_dir):
    rows = literal(spark, _NOTES, "line_id int, body string").select("line_id", F.explode(grammar_facts_column("body")).alias("f"))
    return rows.select("line_id", "f.headword", "f.attribute", "f.value")


@query(values([(1, 1, "ਹਾਥ", "gender", "feminine"), (2, 2, "ਸਾਚਾ", "gender", "masculine")], "word_id, line_id, headword, attribute, value"))
def padarth_words(spark, sf_dir):
    """The first line of a fact counts; headwords that are no words are left out."""
    words = literal(spark, [(1, "ਹਾਥ"), (2, "ਸਾਚਾ")], "id int, gurmukhi string")
    facts, _ = dictionary.mine_grammar(literal(spark, _NOTES, "line_id int, body string"), words)
    return facts.select("word_id", "line_id", "headword", "attribute", "value")


# ---- entries, spellings, etymologies, flags ----------------------------------------------------------------------

_ETYMOLOGIES = [(1, 3, "Sanskrit", "गुर", "gura", "root"), (2, 1, "Persian", "زور", "zor", "force"), (2, 2, "Sanskrit", None, None, None)]


@query(values(_ETYMOLOGIES, "word_id, order_index, origin_language, root_form, root_form_roman, derivation_note"))
def etymology_build(spark, sf_dir):
    parsed = _parsed(spark).filter("id in (1, 2, 3)").select(F.when(F.col("id") == 3, 1).otherwise(2).alias("word_id"), F.when(F.col("id") == 1, 2).otherwise(1).alias("sense_number"), F.lit("d").alias("definition_text"), F.col("p.language_origins").alias("language_origins"))
    words = literal(spark, [(1, "ਗੁਰ"), (2, "ਜੋਰ")], "id int, gurmukhi string")
    sanskrit = literal(spark, [("gura", 0, "root"), ("gura", 1, "later")], "headword string, ord int, gloss string")
    persian = literal(spark, [("steingass", "زور", 0, "zūr", "lie"), ("platts", "زور", 0, "zor", "force"), ("steingass", "زور", 1, "zūr", "lie")], "dictionary string, headword string, ord int, roman string, gloss string")
    existing = literal(spark, [(1, 2)], "word_id int, order_index int")
    built = dictionary.build_etymology(parsed, words, sanskrit, persian, existing)
    return built.select("word_id", "order_index", "origin_language", "root_form", "root_form_roman", "derivation_note")


@query(values([("exact", 1), ("candidate", 1), ("divergent", 2)], "verdict, n"))
def spelling_check(spark, sf_dir):
    rows = literal(spark, [("ਸ਼ਾ", ["ਸ਼ਾ"]), ("ਕ", ["ਖ", "ਕ"]), ("ਕ", ["ਖ"]), ("ਕ", None)], "printed string, candidates array<string>")
    return dictionary.spelling_check(rows)


_SUBMITTED = [
    (1, "7", "doubt", "words", " wrong ", "", 2000, True, "doubt", "words"), (2, "7", "nonsense", "nowhere", "wrong", "", 2000, True, "incorrect", None), (3, "7", "doubt", "words", "wrong", "bot", 2000, False, "doubt", "words"),
    (4, "7", "doubt", "words", "wrong", "", 300, False, "doubt", "words"), (5, "-1", "doubt", "words", "wrong", "", 2000, False, "doubt", "words"), (6, "x", "doubt", "words", "wrong", "", 2000, False, "doubt", "words"), (7, "7", "doubt", "words", "  ", "", 2000, False, "doubt", "words"),
]


@query(values([(r[0], *r[7:]) for r in _SUBMITTED], "id, ok, flag_type, target_table"))
def flag_validation(spark, sf_dir):
    rows = literal(spark, [r[:7] for r in _SUBMITTED], "id int, word_id string, flag_type string, target string, message string, trap string, filled int")
    checked = valid_flag(F.col("word_id"), F.col("flag_type"), F.col("target"), F.col("message"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("trap"), F.col("filled"))
    return rows.select("id", checked.alias("v")).select("id", "v.ok", "v.flag_type", "v.target_table")


@query(values([("ਕ", 1, "see x, y", None), ("ਖ", 1, "g", "inflections: i | cross-reference-only"), ("ਖ", 2, "(cross-reference)", None)], "gurmukhi, sense_number, definition_text, notes"))
def glossary_ingest(spark, sf_dir):
    schema = "key int, gurmukhi string, printed boolean, gloss string, doublet_of array<string>, homonym_index int, parts_of_speech array<string>, cdial string, inflections string, usage string, frequency string, reference_only boolean, second_member boolean, derived boolean"
    rows = [(1, "ਕ", True, " ", ["x", "y"], None, ["noun"], None, None, None, None, False, False, False), (2, "ਖ", None, None, None, 2, [], "1", None, None, None, False, False, False), (3, "ਖ", False, "g", [], None, [], None, "i", "", None, True, False, False)]
    made = dictionary.ingest_glossary(literal(spark, rows, schema), literal(spark, [(1, "ਕ")], "id int, gurmukhi string"))
    return made["definitions"]


@query(values([("ab cd ab", "ab", "<mark>ab</mark> cd ab"), ("x", "y", "x"), ("", "a", "")], "line, word, marked"))
def highlight(spark, sf_dir):
    rows = literal(spark, [("ab cd ab", "ab"), ("x", "y"), ("", "a")], "line string, word string")
    return rows.select("line", "word", text.highlight(F.col("line"), F.col("word")).alias("marked"))
