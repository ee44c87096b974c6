"""Evidence merge: grammar rows to readings per attribute, conflict told apart from polysemy; flags and their queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import confidence_band
from ..schemas import ATTRIBUTES

AUTHORITY = {"scholar": 4, "dictionary": 3, "rule": 2, "heuristic": 1}
# Imported sources by code.
IMPORTED_LABELS = {"ss_padarth": "Sahib Singh's Darpan pad-arth", "shackle": "Shackle, A Guru Nanak Glossary"}


def facts(rows: DataFrame, order: str = "id") -> DataFrame:
    """Unpivots grammar rows to one fact per attribute and value: word_id, attribute, value, source_kind, source_id,
    source_label, authority, rule_code, confidence_label, line_id, ord.

    Imported rows speak for the source they name. Of the others the part of speech is the dictionary's, or a heuristic
    when the notes say that it was inherited; the remaining attributes are the rule's.
    """
    sourced = F.coalesce(F.col("provenance") == "imported", F.lit(False))
    inherited = F.coalesce(F.col("notes"), F.lit("")).contains("inherited from lemma")
    labels = F.create_map(*(F.lit(x) for pair in IMPORTED_LABELS.items() for x in pair))
    band = confidence_band(F.col("confidence"))

    def fact(attribute: str, k: int) -> Column:
        pos = attribute == "pos"
        kind = F.when(sourced, "scholar").otherwise(F.when(inherited, "heuristic").otherwise("dictionary") if pos else F.lit("rule"))
        own = F.when(inherited, "heuristic:inherited").otherwise("src:mahan_kosh") if pos else F.concat(F.lit("rule:"), F.coalesce("rule_code", F.lit("unknown")))
        label = F.when(inherited, "Inherited from a related form").otherwise("Mahan Kosh marker") if pos else F.lit("Viakaran rule")
        return F.struct(
            F.lit(attribute).alias("attribute"),
            F.col(attribute).alias("value"),
            kind.alias("source_kind"),
            F.when(sourced, F.concat(F.lit("src:"), F.coalesce("source_code", F.lit("unknown")))).otherwise(own).alias("source_id"),
            F.when(sourced, F.coalesce(F.try_element_at(labels, F.coalesce("source_code", F.lit(""))), F.lit("Cited source (unattributed)"))).otherwise(label).alias("source_label"),
            F.when(sourced | (F.lit(False) if pos else F.lit(True)), F.col("rule_code")).alias("rule_code"),
            F.when(~sourced & (inherited if pos else F.lit(True)), band).alias("confidence_label"),
            F.when(sourced, F.col("source_line_id")).alias("line_id"),
            F.lit(k).alias("k"),
        )

    listed = rows.select("word_id", F.col(order).alias("ord"), F.explode(F.array(*(fact(a, k) for k, a in enumerate(ATTRIBUTES)))).alias("f")).select("word_id", "ord", "f.*").filter("value <> ''")
    return listed.withColumn("authority", F.element_at(F.create_map(*(F.lit(x) for pair in AUTHORITY.items() for x in pair)), F.col("source_kind")))


def attestations(fact_rows: DataFrame) -> DataFrame:
    """Facts without repeats: of one value each source and rule counts once, by its first row (those without ord last)."""
    first = F.row_number().over(Window.partitionBy("word_id", "attribute", "value", "source_id", "rule_code").orderBy(F.asc_nulls_last("ord")))
    return fact_rows.withColumn("n__", first).filter("n__ = 1").drop("n__")


def readings(fact_rows: DataFrame) -> DataFrame:
    """word_id, attribute, value, authority, attestation_count, lead_source, rank, conflict, polysemy.

    Readings rank by their highest authority, then by the number of attestations, then by first appearance. Several
    values conflict when their lead attestations come from different sources, else the word has several meanings. Facts
    without ord come last; of facts with equal authority and ord, the smallest source_id leads.
    """
    lead = F.min(F.struct((-F.col("authority")).alias("minus"), F.col("ord").isNull().alias("late"), "ord", "source_id"))
    values = attestations(fact_rows).groupBy("word_id", "attribute", "k", "value").agg(F.max("authority").alias("authority"), F.count(F.lit(1)).cast("int").alias("attestation_count"), lead.alias("lead"), F.min("ord").alias("first_ord"))
    group = Window.partitionBy("word_id", "attribute")
    ranked = values.withColumn("rank", F.row_number().over(group.orderBy(F.desc("authority"), F.desc("attestation_count"), F.asc_nulls_last("first_ord"), "value")))
    several = F.count(F.lit(1)).over(group) > 1
    disagree = F.size(F.collect_set("lead.source_id").over(group)) > 1
    return ranked.select("word_id", "attribute", "k", "value", "authority", "attestation_count", F.col("lead.source_id").alias("lead_source"), "rank", (several & disagree).alias("conflict"), (several & ~disagree).alias("polysemy"))


def conflict_counts(reading_rows: DataFrame) -> DataFrame:
    """One row: words with a conflicting attribute, words with one of several meanings."""
    by_word = reading_rows.groupBy("word_id").agg(F.bool_or("conflict").alias("c"), F.bool_or("polysemy").alias("p"))
    return by_word.agg(F.count_if("c").alias("conflict_words"), F.count_if("p").alias("polysemy_words"))


def auto_flags(rows: DataFrame, rules: DataFrame, reading_rows: DataFrame, open_flags: DataFrame, reporter: str = "auto") -> DataFrame:
    """New flags: doubt for each rule-derived row whose rule exists and is unverified, conflict for each word with a
    conflicting attribute, unless the reporter has the same one open already."""
    unverified = rules.filter("verified = false").select("rule_code")
    doubt = rows.filter("provenance = 'rule_derived'").join(unverified, "rule_code").select("word_id", F.lit("word_grammar").alias("target_table"), F.col("id").alias("target_id"), F.lit("doubt").alias("flag_type"), F.format_string("Reading derived from unverified rule %s", F.col("rule_code")).alias("message"))
    attributes = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("k", "attribute"))), lambda x: x["attribute"]), ", ")
    conflict = reading_rows.filter("conflict").groupBy("word_id").agg(attributes.alias("a")).select("word_id", F.lit(None).cast("string").alias("target_table"), F.lit(None).cast("bigint").alias("target_id"), F.lit("conflict").alias("flag_type"), F.concat(F.lit("Sources disagree on "), F.col("a")).alias("message"))
    new, old = doubt.unionByName(conflict).alias("n"), open_flags.filter((F.col("status") == "open") & (F.col("reporter") == reporter)).alias("o")
    same = (F.col("n.word_id") == F.col("o.word_id")) & (F.col("n.flag_type") == F.col("o.flag_type")) & F.col("n.target_table").eqNullSafe(F.col("o.target_table")) & F.col("n.target_id").eqNullSafe(F.col("o.target_id"))
    return new.join(old, same, "left_anti")


def normalised_pos(rows: DataFrame, mappings: DataFrame, column: str = "pos") -> DataFrame:
    """rows with pos_norm: the mapped part of speech (raw, norm), or the raw one when the mapping lacks it."""
    joined = rows.join(mappings.select(F.col("raw").alias(column), "norm"), column, "left")
    return joined.withColumn("pos_norm", F.coalesce("norm", column)).drop("norm")


def flag_queue(flags: DataFrame, words: DataFrame, view: str = "review", cap: int = 150) -> DataFrame:
    """Open flags of the `cap` most frequent words of a view (doubt: automatic doubts; review: the rest), grouped by
    word in order of frequency: word_rank, word, frequency, flags, hidden_words (the number beyond the cap)."""
    wanted = F.col("flag_type") == "doubt" if view == "doubt" else F.col("flag_type") != "doubt"
    by_word = flags.filter((F.col("status") == "open") & wanted).groupBy("word_id").agg(F.count(F.lit(1)).alias("flags"))
    named = by_word.join(words.select(F.col("id").alias("word_id"), F.col("gurmukhi").alias("word"), "frequency"), "word_id")
    total = named.agg(F.count(F.lit(1)).alias("words"))
    top = named.orderBy(F.desc("frequency"), "word").limit(cap)
    ranked = top.withColumn("word_rank", F.row_number().over(Window.orderBy(F.desc("frequency"), "word")))  # at most cap rows
    return ranked.crossJoin(F.broadcast(total)).select("word_rank", "word", "frequency", "flags", F.greatest(F.col("words") - cap, F.lit(0)).alias("hidden_words"))


def resolve_flags(flags: DataFrame, decisions: DataFrame) -> DataFrame:
    """flags with the decisions (id, status, note) applied."""
    joined = flags.join(decisions.select(F.col("id"), F.col("status").alias("s__"), F.col("note").alias("n__")), "id", "left")
    return joined.withColumn("status", F.coalesce("s__", "status")).withColumn("resolution_note", F.coalesce("n__", "resolution_note")).drop("s__", "n__")


def curate(target: DataFrame, flags: DataFrame, decisions: DataFrame, table: str) -> DataFrame:
    """The target table with review_status and curation_note of decisions that carry them (review_status, note) to it."""
    pushed = decisions.filter("review_status is not null").join(flags.filter(F.col("target_table") == table).select("id", "target_id"), "id").groupBy("target_id").agg(F.max_by("review_status", "id").alias("r__"), F.max_by("note", "id").alias("n__"))
    joined = target.join(pushed, target["id"] == pushed["target_id"], "left")
    return joined.withColumn("review_status", F.coalesce("r__", "review_status")).withColumn("curation_note", F.coalesce("n__", "curation_note")).drop("r__", "n__", "target_id")
