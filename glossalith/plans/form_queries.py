"""Folds, stems, form rules, lexemes and search over the pseudo-vocabulary."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.script import DECOMPOSED, GURMUKHI, final_vowel, fold_key, stem
from ..operators import morph, search
from ..sources.workspace import Workspace
from .base import VOCABULARY_SQL, query, vocabulary

G = GURMUKHI
_NFD = "gurmukhi"
for _whole, _parts in DECOMPOSED.items():
    _NFD = f"replace({_NFD}, '{_whole}', '{_parts}')"
FOLD_SQL = f"regexp_replace(translate(trim(regexp_replace(regexp_replace({_NFD}, '[{G.fold_drop}]', '', 'g'), '[^{G.block} ]', '', 'g')), '{G.fold_from}', '{G.fold_to}'), '[{G.fold_final}]$', '')"
STEM_SQL = f"regexp_replace(regexp_replace(gurmukhi, '[{G.marks}]+$', ''), '[{G.matras}]$', '')"
VOWEL_SQL = f"nullif(regexp_extract(gurmukhi, '([{G.matras}])[{G.marks}]*$', 1), '')"


@query(f"WITH {VOCABULARY_SQL} SELECT gurmukhi, {FOLD_SQL} AS search_fold FROM vocabulary")
def fold_keys(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("gurmukhi", fold_key(F.col("gurmukhi")).alias("search_fold"))


@query(f"WITH {VOCABULARY_SQL} SELECT gurmukhi, {STEM_SQL} AS stem, {VOWEL_SQL} AS final_vowel FROM vocabulary")
def stem_lexeme(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("gurmukhi", stem(F.col("gurmukhi")).alias("stem"), final_vowel(F.col("gurmukhi")).alias("final_vowel"))


@query(f"WITH {VOCABULARY_SQL}, s AS (SELECT gurmukhi, regexp_replace(gurmukhi, '[{G.group_tail}]+$', '') AS stem FROM vocabulary) SELECT gurmukhi, stem, count(*) OVER (PARTITION BY stem) AS stem_group_size FROM s WHERE stem <> '' AND stem <> gurmukhi")
def stem_groups_matview(spark, sf_dir):
    return morph.stem_groups(vocabulary(spark, sf_dir).select("gurmukhi"))


_CASE = "CASE WHEN v IS NULL OR v = 'ਿ' THEN 'oblique' WHEN v = 'ੁ' THEN 'direct' END"
_NUMBER = "CASE WHEN v IS NULL OR v IN ('ਿ', 'ੁ') THEN 'singular' END"
_CONF = "CASE WHEN v IS NULL THEN 0.7::DOUBLE WHEN v = 'ਿ' THEN 0.8 WHEN v = 'ੁ' THEN 0.85 ELSE 0.2 END"
_NOUN = f"WITH {VOCABULARY_SQL}, f AS (SELECT gurmukhi, {VOWEL_SQL} AS v, {STEM_SQL} AS stem FROM vocabulary)"
_BAND = lambda c: f"CASE WHEN {c} >= 0.85 THEN 'Very high' WHEN {c} >= 0.7 THEN 'High' WHEN {c} >= 0.55 THEN 'Moderate' WHEN {c} >= 0.4 THEN 'Low' ELSE 'Very low' END"


@query(
    f"""{_NOUN} SELECT gurmukhi, {_CASE} AS gram_case, {_NUMBER} AS number, CASE WHEN v = 'ੁ' THEN 'masculine' END AS gender,
    CASE WHEN v IS NULL THEN 'MUKTA_OBL_SG' WHEN v = 'ਿ' THEN 'SIHARI_OBL_SG' WHEN v = 'ੁ' THEN 'AUNKAR_NOM_SG' END AS rule_code, {_CONF} AS confidence,
    {_CASE} || ' ' || {_NUMBER} AS inflection_desc, {_BAND(_CONF)} AS band FROM f"""
)
def noun_analysis(spark, sf_dir):
    words = vocabulary(spark, sf_dir).select("gurmukhi", text.analyze_noun(F.col("gurmukhi")).alias("n"))
    return words.select("gurmukhi", "n.gram_case", "n.number", "n.gender", "n.rule_code", "n.confidence", text.inflection_desc(F.col("n.gram_case"), F.col("n.number")).alias("inflection_desc"), text.confidence_band(F.col("n.confidence")).alias("band"))


@query(
    f"""WITH {VOCABULARY_SQL} SELECT gurmukhi, CASE WHEN regexp_matches(gurmukhi, '(ਣਾ|ਨਾ)$') THEN 'infinitive' WHEN regexp_matches(gurmukhi, '(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$') THEN 'verbal noun' END AS verb_form,
    CASE WHEN regexp_matches(gurmukhi, '(ਣਾ|ਨਾ)$') THEN 0.8::DOUBLE WHEN regexp_matches(gurmukhi, '(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$') THEN 0.7 ELSE 0.2 END AS confidence FROM vocabulary"""
)
def verb_analysis(spark, sf_dir):
    return vocabulary(spark, sf_dir).select("gurmukhi", text.analyze_verb(F.col("gurmukhi")).alias("v")).select("gurmukhi", "v.verb_form", "v.confidence")


@query(f"{_NOUN} SELECT stem, gurmukhi AS form, {_CASE} || ' ' || {_NUMBER} AS inflection_desc FROM f WHERE stem <> '' AND stem IN (SELECT stem FROM f GROUP BY 1 HAVING count(*) > 1)")
def lexeme_groups(spark, sf_dir):
    return morph.lexeme_groups(vocabulary(spark, sf_dir))


_POS = "CASE length(gurmukhi) % 5 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' WHEN 2 THEN 'particle' END"


@query(
    f"""{_NOUN}, m AS (SELECT f.gurmukhi, stem, v, frequency, {_POS.replace("gurmukhi", "f.gurmukhi")} AS own FROM f JOIN vocabulary USING (gurmukhi) WHERE stem <> ''),
    o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY gurmukhi <> stem, -frequency, gurmukhi) AS n FROM m),
    g AS (SELECT stem, count(*) AS members, arg_min(own, n) FILTER (WHERE own IS NOT NULL) AS pos, arg_min(gurmukhi, n) AS lemma FROM o GROUP BY 1)
    SELECT o.gurmukhi, lemma, pos, CASE WHEN pos = 'noun' THEN {_CASE} END AS gram_case, CASE WHEN pos = 'noun' THEN round(0.6 * {_CONF}, 3)
           WHEN pos = 'verb' AND regexp_matches(o.gurmukhi, '(ਣਾ|ਨਾ)$') THEN 0.48::DOUBLE WHEN pos = 'verb' AND regexp_matches(o.gurmukhi, '(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$') THEN 0.42 ELSE 0.6 END AS confidence
    FROM o JOIN g USING (stem) WHERE own IS NULL AND members > 1 AND pos IS NOT NULL"""
)
def pos_inheritance(spark, sf_dir):
    words = Workspace(spark, "vocabulary").save(vocabulary(spark, sf_dir), "words")  # used more than once
    kind = F.length("gurmukhi") % 5
    direct = words.select("gurmukhi", F.when(kind == 0, "noun").when(kind == 1, "verb").when(kind == 2, "particle").alias("pos"), F.lit(1).alias("sense_number")).filter("pos is not null")
    members = words.select("gurmukhi", (-F.col("frequency")).alias("rank"))
    return morph.inherited_grammar(members, direct).select("gurmukhi", "lemma", "pos", "gram_case", "confidence")


_MARKS = ["ਸੰਗ੍ਯਾ- ", "ਵਿ- ", "ਭਾਵ- ", "ਕ੍ਰਿਯਾ- ", "੨. ਸਰਵ- ", "ਵ੍ਯ- ", "ਕ੍ਰਿ- "]
_MARK_SQL = f"list_value({', '.join(repr(m) for m in _MARKS)})"
_SENSES_SQL = f"""senses AS (SELECT gurmukhi, n AS sense_number, ({_MARK_SQL})[(length(gurmukhi) * 3 + frequency * n) % 7 + 1] || gurmukhi || ' ਸੰਗਯਾ- x' AS definition_text FROM vocabulary, (SELECT unnest([1, 2, 3]) AS n)),
    marked AS (SELECT gurmukhi, sense_number, regexp_extract(definition_text, '(?:^|[^{G.block}])(ਸੰਗ੍ਯਾ|ਸੰਗਯਾ|ਵਿ|ਸਰਵ|ਵ੍ਯ|ਵਯ|ਕ੍ਰਿਯਾ|ਕ੍ਰਿ)-', 1) AS marker FROM senses),
    tagged AS (SELECT gurmukhi, sense_number, marker, CASE WHEN marker IN ('ਸੰਗ੍ਯਾ', 'ਸੰਗਯਾ') THEN 'noun' WHEN marker = 'ਵਿ' THEN 'adjective' WHEN marker = 'ਸਰਵ' THEN 'pronoun' WHEN marker IN ('ਵ੍ਯ', 'ਵਯ') THEN 'particle' WHEN marker IN ('ਕ੍ਰਿ', 'ਕ੍ਰਿਯਾ') THEN 'verb' END AS pos FROM marked)"""


def _senses(spark, sf_dir):
    marks = F.array(*(F.lit(m) for m in _MARKS))
    rows = vocabulary(spark, sf_dir).select("gurmukhi", "frequency", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("sense_number"))
    return rows.select("gurmukhi", "sense_number", F.concat(F.get(marks, (F.length("gurmukhi") * 3 + F.col("frequency") * F.col("sense_number")) % 7), "gurmukhi", F.lit(" ਸੰਗਯਾ- x")).alias("definition_text"))


@query(f"WITH {VOCABULARY_SQL}, {_SENSES_SQL} SELECT gurmukhi, sense_number, marker, pos FROM tagged")
def pos_markers(spark, sf_dir):
    marked = _senses(spark, sf_dir).select("gurmukhi", "sense_number", text.pos_of_definition(F.col("definition_text")).alias("p"))
    return marked.select("gurmukhi", "sense_number", "p.marker", "p.pos")


@query(
    f"""WITH {VOCABULARY_SQL}, {_SENSES_SQL}, first AS (SELECT gurmukhi, pos, min(sense_number) AS sense_number, {VOWEL_SQL} AS v FROM tagged WHERE pos IS NOT NULL GROUP BY gurmukhi, pos)
    SELECT gurmukhi, sense_number, pos, CASE WHEN pos IN ('noun', 'adjective', 'pronoun') THEN {_CASE} END AS gram_case,
           CASE WHEN pos = 'verb' THEN CASE WHEN regexp_matches(gurmukhi, '(ਣਾ|ਨਾ)$') THEN 'infinitive' WHEN regexp_matches(gurmukhi, '(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$') THEN 'verbal noun' END END AS verb_form,
           CASE WHEN pos IN ('noun', 'adjective', 'pronoun') THEN round(0.9 * {_CONF}, 3) WHEN pos = 'verb' AND regexp_matches(gurmukhi, '(ਣਾ|ਨਾ)$') THEN 0.72::DOUBLE
                WHEN pos = 'verb' AND regexp_matches(gurmukhi, '(ਣੁ|ਨੁ|ਣੇ|ਨੇ|ਣੈ|ਨੈ)$') THEN 0.63 ELSE 0.9 END AS confidence FROM first"""
)
def rule_grammar(spark, sf_dir):
    return morph.rule_grammar(_senses(spark, sf_dir)).select("gurmukhi", "sense_number", "pos", "gram_case", "verb_form", "confidence")


# the last: no prefix, no folded prefix, a substring; the one before: a wild card taken literally
_ASKED = ["ਤਹ", "ਗਹ", "ਤੋ", "ਸਾ", "ਣ", "ਨਿ", "ਹੇ%", "ੇਰ", "ਹੇਰੇ", "ਜ਼"]


@query(
    f"""WITH {VOCABULARY_SQL}, q AS (SELECT unnest([{", ".join(repr(a) for a in _ASKED)}]) AS q), qf AS (SELECT q, {FOLD_SQL.replace("gurmukhi", "q")} AS qfold FROM q),
    w AS (SELECT gurmukhi, frequency, {FOLD_SQL} AS fold FROM vocabulary),
    hits AS (SELECT q, gurmukhi, frequency, CASE WHEN starts_with(gurmukhi, q) THEN 1 WHEN qfold <> '' AND starts_with(fold, qfold) THEN 2 WHEN contains(gurmukhi, q) THEN 3 END AS tier FROM qf, w),
    best AS (SELECT *, min(tier) OVER (PARTITION BY q) AS best FROM hits WHERE tier IS NOT NULL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY tier, frequency DESC, gurmukhi) AS rank FROM best WHERE tier < 3 OR best = 3)
    SELECT q, gurmukhi, frequency, CASE tier WHEN 1 THEN 'prefix' WHEN 2 THEN 'fold' ELSE 'contains' END AS match, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 20"""
)
def search_tiers(spark, sf_dir):
    words = vocabulary(spark, sf_dir).select(F.col("gurmukhi").alias("id"), "gurmukhi", "frequency", fold_key(F.col("gurmukhi")).alias("search_fold"))
    asked = spark.createDataFrame([(a,) for a in _ASKED], "q string")
    return search.search(asked, words).drop("id")


@query(f"WITH {VOCABULARY_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, gurmukhi) AS rank FROM vocabulary) SELECT CAST(rank AS INTEGER) AS rank, gurmukhi AS word, frequency, CAST((SELECT ceil(count(*) / 50.0) FROM vocabulary) AS INTEGER) AS total_pages FROM r WHERE rank BETWEEN 51 AND 100")
def browse_page(spark, sf_dir):
    return search.browse(vocabulary(spark, sf_dir), page=2)
