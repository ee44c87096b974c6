"""Column functions over words, definitions and pages that regular expressions can express."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import GURMUKHI, Script, _trimmed, final_vowel, nfd
from .script import SPACE as SPACES

# ---- forms -------------------------------------------------------------------------------------------------------

# What a final vowel says of a nominal form (case, number, gender, rule, confidence, note).
NOUN_RULES = {
    "ੁ": ("direct", "singular", "masculine", "AUNKAR_NOM_SG", 0.85, "Final aunkar marks the direct-case singular of a masculine noun."),
    "ਿ": ("oblique", "singular", None, "SIHARI_OBL_SG", 0.8, "Final sihari marks an oblique singular (instrumental/locative sense)."),
    None: ("oblique", "singular", None, "MUKTA_OBL_SG", 0.7, "Mukta (bare) form is oblique singular, often preceding a sambandhak."),
}
NO_NOUN_RULE = (None, None, None, None, 0.2, "No high-confidence Viakaran rule matched this ending.")
# Verb endings (pattern, form, rule, confidence, note).
VERB_RULES = [
    ("(ਣਾ|ਨਾ)$", "infinitive", "VERB_INFINITIVE", 0.8, 'The -ਣਾ/-ਨਾ ending marks the infinitive (the "to ___" form of the verb).'),
    ("(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$", "verbal noun", "VERB_VERBAL_NOUN", 0.7, "The -ਣੁ/-ਨੁ (and oblique -ਣੇ/-ਣੈ) ending marks a verbal noun (the act of the verb)."),
]
NO_VERB_RULE = (None, None, 0.2, "No high-confidence non-finite verb ending matched.")
# Dictionary markers of parts of speech.
POS_MARKERS = {"ਸੰਗ੍ਯਾ": "noun", "ਸੰਗਯਾ": "noun", "ਵਿ": "adjective", "ਸਰਵ": "pronoun", "ਵ੍ਯ": "particle", "ਵਯ": "particle", "ਕ੍ਰਿ": "verb", "ਕ੍ਰਿਯਾ": "verb"}
POS_CONFIDENCE = 0.9
NOUN_FIELDS = ["gram_case", "number", "gender", "rule_code", "confidence", "notes"]
VERB_FIELDS = ["verb_form", "rule_code", "confidence", "notes"]


def _record(values: tuple, names: list[str]) -> Column:
    return F.struct(*(F.lit(v).cast("double" if n == "confidence" else "string").alias(n) for v, n in zip(values, names, strict=True)))


def analyze_noun(form: Column, script: Script = GURMUKHI) -> Column:
    """struct(gram_case, number, gender, rule_code, confidence, notes) of a nominal form by its final vowel."""
    vowel = final_vowel(form, script)
    case = F.when(vowel.isNull(), _record(NOUN_RULES[None], NOUN_FIELDS))
    for sign, values in NOUN_RULES.items():
        if sign is not None:
            case = case.when(vowel == sign, _record(values, NOUN_FIELDS))
    return case.otherwise(_record(NO_NOUN_RULE, NOUN_FIELDS))


def analyze_verb(form: Column) -> Column:
    """struct(verb_form, rule_code, confidence, notes) of a non-finite verb form by its ending."""
    case = F
    for pattern, *values in VERB_RULES:
        case = case.when(_trimmed(form).rlike(pattern), _record(tuple(values), VERB_FIELDS))
    return case.otherwise(_record(NO_VERB_RULE, VERB_FIELDS))


def pos_of_definition(definition: Column, script: Script = GURMUKHI) -> Column:
    """struct(pos, marker) of the earliest part-of-speech marker (followed by a dash, not preceded by the script), or
    null. Longer markers are tried first at one place; the dash makes them exclusive."""
    markers = sorted(POS_MARKERS, key=len, reverse=True)
    found = F.regexp_extract(definition, rf"(?:^|[^{script.block}])({'|'.join(markers)})-", 1)
    pos = F.element_at(F.create_map(*(F.lit(x) for pair in POS_MARKERS.items() for x in pair)), found)
    return F.when(found != "", F.struct(pos.alias("pos"), found.alias("marker")))


def inflection_desc(gram_case: Column, number: Column) -> Column:
    """`case number`; null when both are missing."""
    return F.nullif(F.concat_ws(" ", F.nullif(gram_case, F.lit("")), F.nullif(number, F.lit(""))), F.lit(""))


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "Very high").when(confidence >= 0.7, "High").when(confidence >= 0.55, "Moderate").when(confidence >= 0.4, "Low").when(confidence.isNotNull(), "Very low")


# ---- Perso-Arabic headwords --------------------------------------------------------------------------------------

# Code points that one letter has in Persian and in Arabic spelling.
TO_PERSIAN = ("كيہے", "کیهی")
TO_ARABIC = ("کیہے", "كيهي")


def strip_arabic_marks(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{0640}\x{064B}-\x{065F}\x{0670}]", "")


def headword_variants(text: Column) -> Column:
    """Distinct spellings to look up, in order: as printed without vowel marks, Persian and Arabic code points."""
    bare = _trimmed(strip_arabic_marks(text))
    return F.array_distinct(F.array(bare, F.translate(bare, *TO_PERSIAN), F.translate(bare, *TO_ARABIC)))


# ---- pages -------------------------------------------------------------------------------------------------------


def decode_entities(text: Column) -> Column:
    """The four named entities, in the order that leaves `&amp;lt;` decoded twice, as the sites' readers do."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " ")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def decode_numeric_entities(text: Column) -> Column:
    """&#N; and &#xH; as characters, by splitting the text at them. Code points beyond Unicode stay as they are."""
    pattern = r"&#(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def char(entity: Column) -> Column:
        body = F.regexp_replace(entity, "[&#;]", "")
        code = F.when(F.lower(body).startswith("x"), F.conv(F.substring(body, 2, 10), 16, 10)).otherwise(body).cast("long")
        # UTF-32 bytes of the code point
        return F.when((code > 0x10FFFF) | code.between(0xD800, 0xDFFF), entity).otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))

    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(char(F.get(found, i)), F.lit("")))), "")


def tidy(text: Column, closing: str = ".,;:)", opening: bool = True) -> Column:
    """White space collapsed, none before closing marks nor after an opening bracket, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(text, rf"[{SPACES}]+", " "), rf"[{SPACES}]+([{closing}])", "$1")
    return F.trim(F.regexp_replace(text, rf"\([{SPACES}]+", "(") if opening else text)


def strip_tags(html: Column, closing: str = ".,;:)", opening: bool = False, numeric: bool = True) -> Column:
    """Text of a fragment: tags to blanks, entities decoded, tidied."""
    text = F.regexp_replace(html, "<[^>]+>", " ")
    if numeric:
        for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
            text = F.replace(text, F.lit(entity), F.lit(char))
        text = decode_numeric_entities(text)
    else:
        text = decode_entities(text)
    return tidy(text, closing, opening)


def tei_gloss(xml: Column) -> Column:
    """Text of the first sense without its notes; null when there is none or it is empty."""
    body = F.regexp_extract(xml, r"(?s)<sense[^>]*>(.*?)</sense>", 1)
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<note[^>]*>.*?</note>", ""), "<[^>]+>", " ")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.nullif(tidy(text, ".,;)"), F.lit(""))


def dictionary_results(html: Column, dictionary: str) -> Column:
    """array<struct(headword, roman, gloss)> of a result page, both markup eras; blocks without a head line are left
    out. `steingass` glosses lose their bracketed parts and end at `; —`, `platts` ones end at `: —`."""
    blocks = F.slice(F.split(html, "<div class='(?:hw_result|container mb-3 rounded border shadow-sm py-3)'>", -1), 2, 1_000_000)
    head = r"\d+\)\s*<a [^>]*>([^<]+)</a>[ \t]*([^\n<(]*)"
    body = r"(?s)<blockquote>(.*?)</blockquote>|<div class='px-4'>(.*?)</div>"

    def entry(block: Column) -> Column:
        raw = F.concat(F.regexp_extract(block, body, 1), F.regexp_extract(block, body, 2))
        raw = F.regexp_replace(raw, r"(?s)\[.*?\]", "") if dictionary == "steingass" else raw
        text = decode_entities(F.trim(F.regexp_replace(F.regexp_replace(raw, "<[^>]+>", " "), rf"[{SPACES}]+", " ")))
        cut = "; —" if dictionary == "steingass" else ": —"
        text = F.substring_index(text, cut, 1)
        text = F.regexp_replace(F.regexp_replace(text, rf"[{SPACES}]+([.,;:)])", "$1"), rf"\([{SPACES}]+", "(")
        gloss = F.nullif(F.trim(F.regexp_replace(text, rf"[;:,{SPACES}]+$", "")), F.lit(""))
        has_body = block.rlike(body)
        return F.struct(_trimmed(F.regexp_extract(block, head, 1)).alias("headword"), F.nullif(_trimmed(F.regexp_extract(block, head, 2)), F.lit("")).alias("roman"), F.when(has_body, gloss).alias("gloss"))

    none = F.array().cast("array<struct<headword:string,roman:string,gloss:string>>")
    return F.when(html.contains("No results for search term"), none).otherwise(F.transform(F.filter(blocks, lambda b: b.rlike(head)), entry))


def glossary_catalogue(html: Column) -> Column:
    """Distinct array<struct(term, wn)> of a catalogue's links, in order. A term that can't be decoded stays as it is."""
    pattern = r'href="/dictionary/(?:panjabi|english)/ms/([^"?]+)\?wn=([A-Za-z0-9+/=]+)'
    # try_url_decode also turns + into a blank, which a path's + is not
    decoded = lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t)
    pairs = F.arrays_zip(F.regexp_extract_all(html, F.lit(pattern), F.lit(1)).alias("t"), F.regexp_extract_all(html, F.lit(pattern), F.lit(2)).alias("w"))
    named = F.transform(pairs, lambda p: F.struct(_trimmed(decoded(p["t"])).alias("term"), p["w"].alias("wn")))
    return F.array_distinct(F.filter(named, lambda p: p["term"] != ""))


def glossary_entry(html: Column) -> Column:
    """struct(headword_roman, meaning, grammar, etymology) of an entry page. The first paragraph without a label that
    has text is the meaning; of labelled ones the last counts."""
    head = F.regexp_extract(html, r"(?s)<h5[^>]*>.*?<a[^>]*>(.*?)</a>", 1)
    blocks = F.regexp_extract_all(html, F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    label = lambda b: F.lower(_trimmed(F.regexp_extract(b, r'class="dictHeading"[^>]*>\s*([^<:]+)\s*:?\s*</i>', 1)))
    clean = lambda t: strip_tags(t)
    value = lambda b: F.regexp_replace(clean(F.regexp_replace(b, r"(?s)^.*?</i>", "")), rf"[.;:,{SPACES}]+$", "")
    of = lambda word: F.nullif(F.element_at(F.transform(F.filter(blocks, lambda b: label(b).startswith(word)), value), -1), F.lit(""))
    labelled = lambda b: label(b).startswith("grammar") | label(b).startswith("etymolog")
    plain = F.filter(F.transform(F.filter(blocks, lambda b: ~labelled(b)), clean), lambda t: t != "")
    last = lambda word: F.when(F.size(F.filter(blocks, lambda b: label(b).startswith(word))) > 0, of(word))
    return F.struct(F.nullif(clean(head), F.lit("")).alias("headword_roman"), F.get(plain, F.lit(0)).alias("meaning"), last("grammar").alias("grammar"), last("etymolog").alias("etymology"))


def decode_wn(token: Column) -> Column:
    """A base64 id as text; null when it isn't base64."""
    return F.decode(F.try_to_binary(token, F.lit("base64")), "UTF-8")


# ---- definitions -------------------------------------------------------------------------------------------------

# Language markers that the plain cross-reference reader knows, and display names by ISO code.
LEGACY_MARKERS = [("ਸੰ.", "sa"), ("ਅ਼.", "ar"), ("ਫ਼ਾ.", "fa"), ("ਹਿੰ.", "hi")]
LANGUAGE_NAMES = {
    "sa": "Sanskrit", "ar": "Arabic", "fa": "Persian", "hi": "Hindi", "tr": "Turkish", "sd": "Sindhi", "pra": "Prakrit", "pi": "Pali", "en": "English",
    "mr": "Marathi", "el": "Greek", "he": "Hebrew", "fr": "French", "la": "Latin", "pt": "Portuguese", "gu": "Gujarati", "ks": "Kashmiri", "mag": "Magadhi",
    "mwr": "Marwari", "skr": "Multani (Saraiki)", "phr": "Pothohari", "bgc": "Bangru", "dcc": "Dakhani", "cdh": "Chambeali", "bra": "Braj",
}
PRINTED_SCRIPTS = ["devanagari", "perso_arabic", "latin"]


def split_senses(description: Column, script: Script = GURMUKHI) -> Column:
    """array<struct(sense_number, definition_text)>: the text up to the first `danda numeral.` is sense 1, each later
    part has its numeral. Empty parts are left out."""
    mark = rf"\x{{0964}}\s*([{script.digits}]+)[.]\s*"
    tidy_ = lambda t: _trimmed(F.regexp_replace(_trimmed(t), r"\x{0964}+$", ""))
    parts, numbers = F.split(description, mark, -1), F.regexp_extract_all(description, F.lit(mark), F.lit(1))
    number = lambda i: F.when(i == 0, 1).otherwise(F.translate(F.get(numbers, i - 1), script.digits, "0123456789").try_cast("int"))
    senses = F.transform(parts, lambda t, i: F.struct(number(i).alias("sense_number"), tidy_(t).alias("definition_text")))
    return F.filter(senses, lambda s: s["definition_text"] != "")


def legacy_cross_refs(text: Column) -> Column:
    """map of ar_fa (first bracket with Arabic letters) and origin_lang (first marker present, in the markers' order);
    null when empty."""
    brackets = F.filter(F.regexp_extract_all(text, F.lit(r"\[([^\]]+)\]"), F.lit(1)), lambda b: b.rlike(r"[\x{0600}-\x{06FF}]"))
    language = F.coalesce(*(F.when(nfd(text).contains(nfd(F.lit(marker))), F.lit(code)) for marker, code in LEGACY_MARKERS))
    return _map_or_null([("ar_fa", F.get(brackets, F.lit(0))), ("origin_lang", language)])


def _map_or_null(pairs: list[tuple[str, Column]]) -> Column:
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs)), lambda e: e["value"].isNotNull())
    return F.when(F.size(entries) > 0, F.map_from_entries(entries))


def cross_refs_from_parsed(origins: Column) -> Column:
    """origin_lang: the first origin's ISO code; ar_fa: the first Perso-Arabic etymon; null when empty."""
    arabic = F.filter(origins, lambda o: o["etymon"]["script"] == "perso_arabic")
    return _map_or_null([("origin_lang", F.get(origins, F.lit(0))["iso639"]), ("ar_fa", F.get(arabic, F.lit(0))["etymon"]["text"])])


def etymology_candidates(origins: Column) -> Column:
    """array<struct(origin_language, root_form, root_script)> in print order; a root counts only if printed in a
    script of its own and not inferred. Null origins give an empty array."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGE_NAMES.items() for x in pair))

    def candidate(o: Column) -> Column:
        printed = ~F.coalesce(o["etymon"]["inferred"], F.lit(False)) & o["etymon"]["script"].isin(PRINTED_SCRIPTS)
        name = F.coalesce(F.try_element_at(names, F.coalesce(o["iso639"], F.lit(""))), F.nullif(o["language"], F.lit("")))
        return F.struct(name.alias("origin_language"), F.when(printed, o["etymon"]["text"]).alias("root_form"), F.when(printed, o["etymon"]["script"]).alias("root_script"))

    empty = F.array().cast("array<struct<origin_language:string,root_form:string,root_script:string>>")
    return F.coalesce(F.filter(F.transform(origins, candidate), lambda c: c["origin_language"].isNotNull()), empty)


def gender_from_pos(labels: Column) -> Column:
    """masculine or feminine when an array of part-of-speech labels names it; masculine first."""
    joined = F.lower(F.array_join(labels, " "))
    return F.when(joined.contains("masculine"), "masculine").when(joined.contains("feminine"), "feminine")


def entry_text(gloss: Column, doublet_of: Column) -> Column:
    """The gloss, else a pointer to the entries that this one doubles, else a fixed remark."""
    return F.coalesce(F.nullif(_trimmed(gloss), F.lit("")), F.when(F.size(doublet_of) > 0, F.concat(F.lit("see "), F.array_join(doublet_of, ", "))), F.lit("(cross-reference)"))


def entry_notes(inflections: Column, usage: Column, frequency: Column, reference_only: Column, second_member: Column, derived: Column) -> Column:
    """What an entry says beyond its gloss, joined by ` | `; null when nothing."""
    tagged = lambda tag, c: F.when(F.nullif(c, F.lit("")).isNotNull(), F.concat(F.lit(tag + ": "), c))
    parts = [tagged("inflections", inflections), tagged("usage", usage), tagged("shackle-freq", frequency), F.when(reference_only, "cross-reference-only"), F.when(second_member, "second-member-only"), F.when(derived, "gurmukhi-derived (reverse-translit)")]
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


# ---- display -----------------------------------------------------------------------------------------------------


def pos_label(pos: Column) -> Column:
    """verbal_root -> Verbal root."""
    words = F.replace(pos, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substring(words, 2, 1_000_000))


def grammar_frame(attribute: Column, value: Column, referent: Column) -> Column:
    of = F.when(referent != "", F.concat(F.lit(" of "), referent)).otherwise("")
    key = F.concat_ws("=", attribute, value)
    return (
        F.when(key == "number=plural", F.concat(F.lit("Plural"), of))
        .when(key == "case=vocative", "Vocative")
        .when(key == "mood=imperative", F.concat(F.lit("Imperative"), of))
        .when(key == "tense=past", "Past tense")
        .when(key == "tense=present", "Present tense")
        .when(key == "gender=feminine", "Feminine")
        .when(key == "gender=masculine", "Masculine")
        .when(key == "lexical=short_form_of", F.concat(F.lit("Short form"), of))
        .otherwise(F.concat(attribute, F.lit(": "), value, of))
    )


def citation_text(c: Column, raags: dict[str, str], sections: dict[str, str], bhagats: dict[str, str]) -> Column:
    """A citation struct in words: work, raag or vaar, section with its author, mahala; the raw text if nothing is known.
    Names are translated by the given tables, keyed in decomposed form."""

    def named(value: Column, names: dict[str, str]) -> Column:
        return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), nfd(value)), value) if names else value

    number = lambda n: F.when(n.isNotNull(), F.concat(F.lit(" "), n.cast("string"))).otherwise("")
    work = F.when(F.nullif(c["work"], F.lit("")).isNotNull(), F.concat(c["work"], F.when(F.coalesce(c["work_number"], F.lit(0)) != 0, number(c["work_number"])).otherwise("")))
    raag = F.regexp_replace(named(c["raag"], raags), r"\s*\(.*\)$", "")
    tune = F.when(F.nullif(c["raag"], F.lit("")).isNotNull(), F.concat(F.when(c["is_vaar"], "Vaar of ").otherwise(""), raag, number(c["vaar_number"]))).when(c["is_vaar"], F.concat(F.lit("Vaar"), number(c["vaar_number"])))
    author, section = named(c["bhagat"], bhagats), named(c["section"], sections)
    part = F.when((section == "Salok") & c["bhagat"].isNotNull(), F.concat(F.lit("Salok "), author)).otherwise(F.concat_ws(", ", section, author))
    mahala = F.when(c["mahala"].isNotNull(), F.concat(F.lit("Mahala "), c["mahala"].cast("string")))
    text = F.concat_ws(", ", work, tune, F.nullif(part, F.lit("")), mahala)
    return F.when(text == "", c["raw"]).when(c["work_type"] == "dasam_granth", F.concat(text, F.lit(" (Dasam Granth)"))).otherwise(text)


def as_parsed(parsed: Column) -> Column:
    """The parsed struct if it carries a parser version, else null."""
    return F.when(parsed["parser_version"].isNotNull(), parsed)


def xref_targets(senses: Column) -> Column:
    """Distinct targets, decomposed, over an array of parsed senses; null senses count as none."""
    lists = F.transform(senses, lambda s: F.coalesce(F.transform(s["xrefs"], lambda x: nfd(x["target"])), F.array().cast("array<string>")))
    return F.array_distinct(F.flatten(lists))


def distinct_citations(citations: Column, raags: dict[str, str], sections: dict[str, str], bhagats: dict[str, str]) -> Column:
    """Citations in words, repeats left out, in order of first appearance."""
    return F.array_distinct(F.transform(citations, lambda c: citation_text(c, raags, sections, bhagats)))


def highlight(line: Column, word: Column, left: str = "<mark>", right: str = "</mark>") -> Column:
    """The line with its first occurrence of the word wrapped."""
    at = F.position(word, line)
    n = F.length(word)
    return F.when(at > 0, F.concat(F.substring(line, F.lit(1), at - 1), F.lit(left), word, F.lit(right), F.substring(line, at + n, F.length(line)))).otherwise(line)


def citation_display(title: Column, siglum: Column, raw: Column, hymn: Column, verse: Column, author: Column) -> Column:
    """Title, else siglum, else the raw text; then hymn.verse; then the author in brackets."""
    place = F.nullif(F.concat_ws(".", hymn.cast("string"), verse.cast("string")), F.lit(""))
    return F.concat_ws(" ", F.coalesce(title, siglum, raw), place, F.when(author.isNotNull(), F.concat(F.lit("("), author, F.lit(")"))))


# Tokens that structure a citation without naming a source.
CITATION_TOKENS = ["ਮਃ", "ਅਃ", "ਸਃ", "ਸ", "ਵਾਰ", "ਛੰਤ", "ਸੋਲਹੇ", "ਕੇ", "ਸਵੈਯੇ", "ਬਾਰਹਮਾਹਾ", "ਥਿਤੀ", "ਪਟੀ", "ਪੈਪਾਇ"]
ENUMERATORS = ["ੳ", "ਅ", "ੲ", "ਸ", "ਹ", "ਕ", "ਖ", "ਗ", "ਘ"]


def classify_citation(body: Column, sources: dict[str, str], bhagats: list[str]) -> Column:
    """Kind of a bracketed text, by the first rule that fits: enumerator, empty, numeric, proverb, khalsa_argot,
    xref_paren, source:<group>, bhagat_only, grammar_only, unrecognized. sources: group by token."""
    bare = F.regexp_replace(_trimmed(body), "^[.,]+|[.,]+$", "")
    tokens = F.filter(F.transform(F.split(bare, rf"[{SPACES}]+"), lambda t: F.regexp_replace(t, "^[.,]+|[.,]+$", "")), lambda t: t != "")
    first = F.get(tokens, F.lit(0))
    overlap = lambda words: F.arrays_overlap(tokens, F.array(*(nfd(F.lit(w)) for w in words)))
    known = F.filter(F.transform(tokens, lambda t: F.try_element_at(F.create_map(*(F.lit(x) for pair in sources.items() for x in pair)), t)), lambda g: g.isNotNull()) if sources else F.array().cast("array<string>")
    return (
        F.when(bare.isin(ENUMERATORS), "enumerator")
        .when(F.size(tokens) == 0, "empty")
        .when(F.forall(tokens, lambda t: t.rlike(rf"^[{GURMUKHI.digits}]+$")), "numeric")
        .when(first == "ਲੋਕੋ", "proverb")
        .when(first == nfd(F.lit("ਖ਼ਾ")), "khalsa_argot")
        .when(first == "ਦੇਖੋ", "xref_paren")
        .when(F.size(known) > 0, F.concat(F.lit("source:"), F.get(known, F.lit(0))))
        .when(overlap(bhagats), "bhagat_only")
        .when(overlap(CITATION_TOKENS), "grammar_only")
        .otherwise("unrecognized")
    )


def percent(part: Column, whole: Column) -> Column:
    """One decimal and a percent sign; n/a when there is no whole."""
    return F.when(whole == 0, "n/a").otherwise(F.format_string("%.1f%%", 100.0 * part / whole))


def heat_colour(ratio: Column) -> Column:
    """A style's background where nothing is flagged, else a shade that darkens with the ratio."""
    return F.when(ratio <= 0, "var(--bg-alt)").otherwise(F.format_string("hsl(28, 45%%, %.2f%%)", 88 - ratio * 55))
