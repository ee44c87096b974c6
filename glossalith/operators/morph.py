"""Stems, lexemes and rule grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phonetics import ipa_column, over_distinct
from ..functions.script import GURMUKHI, Script, fold_key, group_stem, stem
from ..functions.text import POS_CONFIDENCE, analyze_noun, analyze_verb, inflection_desc, pos_of_definition

NOMINAL = ["noun", "adjective", "pronoun"]
INHERITED_CONFIDENCE = 0.6


def populate(words: DataFrame, word: str = "gurmukhi", script: Script = GURMUKHI) -> DataFrame:
    """words with ipa_display and search_fold computed anew, each distinct spelling once; an empty fold is null."""
    spelled = over_distinct(words.drop("ipa_display"), word, ipa_column, "ipa_display")
    return spelled.withColumn("search_fold", F.nullif(fold_key(F.col(word), script), F.lit("")))


def stem_groups(words: DataFrame, word: str = "gurmukhi", script: Script = GURMUKHI) -> DataFrame:
    """words with stem and stem_group_size. Bare stems are left out before counting, so they don't add to the size."""
    stemmed = words.withColumn("stem", group_stem(F.col(word), script)).filter(f"stem <> '' and stem <> {word}")
    return stemmed.withColumn("stem_group_size", F.count(F.lit(1)).over(Window.partitionBy("stem")))


def lexeme_groups(forms: DataFrame, word: str = "gurmukhi", script: Script = GURMUKHI) -> DataFrame:
    """(stem, form, inflection_desc) of stems with at least two distinct forms."""
    distinct = forms.select(F.col(word).alias("form")).distinct().withColumn("stem", stem(F.col("form"), script)).filter("stem <> ''")
    sizes = distinct.groupBy("stem").count().filter("count > 1").select("stem")
    noun = analyze_noun(F.col("form"), script)
    return distinct.join(sizes, "stem").select("stem", "form", inflection_desc(noun["gram_case"], noun["number"]).alias("inflection_desc"))


def grammar_columns(form: Column, pos: Column, pos_confidence: Column, extra: Column | None = None, script: Script = GURMUKHI) -> Column:
    """struct of one grammar row: nominal forms by their final vowel, verbs by their ending, others the part of speech
    alone. Confidence is the product, rounded to 3 places; a verb without a known ending keeps the POS's."""
    noun, verb, nominal = analyze_noun(form, script), analyze_verb(form), pos.isin(NOMINAL)
    is_verb = (pos == "verb") & verb["verb_form"].isNotNull()
    extra = F.lit(None).cast("string") if extra is None else extra
    product = lambda c: F.round(pos_confidence * c, 3)
    notes = F.when(nominal, F.concat_ws(" ", noun["notes"], extra)).when(is_verb, F.concat_ws(" ", verb["notes"], extra)).otherwise(extra)
    return F.struct(
        pos.alias("pos"),
        F.when(nominal, noun["gender"]).alias("gender"),
        F.when(nominal, noun["number"]).alias("number"),
        F.when(nominal, noun["gram_case"]).alias("gram_case"),
        F.when(is_verb, verb["verb_form"]).alias("verb_form"),
        F.when(nominal, noun["rule_code"]).when(is_verb, verb["rule_code"]).alias("rule_code"),
        F.when(nominal, product(noun["confidence"])).when(is_verb, product(verb["confidence"])).otherwise(pos_confidence).alias("confidence"),
        F.nullif(notes, F.lit("")).alias("notes"),
    )


def rule_grammar(senses: DataFrame, word: str = "gurmukhi", order: str = "sense_number", definition: str = "definition_text", script: Script = GURMUKHI) -> DataFrame:
    """One grammar row per word and distinct part of speech of its senses: word, sense order of its first sense, fields."""
    marked = senses.select(word, order, pos_of_definition(F.col(definition), script).alias("p")).filter("p is not null")
    first = marked.groupBy(word, F.col("p.pos").alias("pos")).agg(F.min(order).alias(order))
    row = grammar_columns(F.col(word), F.col("pos"), F.lit(POS_CONFIDENCE), script=script)
    return first.select(word, order, row.alias("g")).select(word, order, "g.*")


def inherited_grammar(members: DataFrame, direct: DataFrame, word: str = "gurmukhi", rank: str = "rank", script: Script = GURMUKHI) -> DataFrame:
    """Grammar rows for members of a stem group that have no part of speech of their own.

    members (word, rank) is one set of words; direct (word, pos) has their own readings, the first of each by order of
    rows given as `sense_number`. The group's POS is that of the form equal to the stem, else of the first member by
    rank that has one; its lemma is the stem form, else the first member.
    """
    stemmed = members.dropDuplicates([word]).withColumn("stem", stem(F.col(word), script)).filter("stem <> ''")
    own = direct.groupBy(word).agg(F.min_by("pos", "sense_number").alias("own_pos"))
    placed = stemmed.join(own, word, "left")
    preferred = F.struct((F.col(word) != F.col("stem")).alias("not_stem"), rank, word)
    groups = placed.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.min_by("own_pos", F.when(F.col("own_pos").isNotNull(), preferred)).alias("group_pos"), F.min_by(word, preferred).alias("lemma")).filter("n > 1 and group_pos is not null")
    heirs = placed.filter("own_pos is null").join(groups, "stem")
    note = F.concat(F.lit("POS inherited from lemma "), F.col("lemma"), F.lit("."))
    row = grammar_columns(F.col(word), F.col("group_pos"), F.lit(INHERITED_CONFIDENCE), note, script)
    return heirs.select(word, "lemma", row.alias("g")).select(word, "lemma", "g.*")
