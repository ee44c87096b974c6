"""Quality metrics: counts, breakdowns, heat map, staleness, and the health report in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent


def per_source_counts(items: DataFrame, details: DataFrame, item_key: str, detail_key: str, detail_source: str) -> DataFrame:
    """item, source, count of a left join grouped by both: an item without details gives one row, source null, count 1,
    since the padded row is counted."""
    joined = items.select(F.col(item_key).alias("item")).join(details.select(F.col(detail_key).alias("item"), F.col(detail_source).alias("source")), "item", "left")
    return joined.groupBy("item", "source").agg(F.count(F.lit(1)).alias("n"))


def detail_counts(items: DataFrame, details: DataFrame, on: Column, key: list[str], detail_id: str, of: str) -> DataFrame:
    """For every item the number of its details and of distinct `of` among them, 0 when there are none."""
    return items.join(details, on, "left").groupBy(*key).agg(F.count(detail_id).alias("n"), F.countDistinct(of).alias("distinct_n"))


def without(items: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no other row refers to."""
    return items.join(others.select(*keys).filter(" and ".join(f"{k} is not null" for k in keys)).distinct(), keys, "left_anti")


def only_value(rows: DataFrame, key: str, column: str, value: str) -> DataFrame:
    """Keys all of whose rows have the value. Rows without a value don't count against it, as <> drops nulls."""
    return rows.groupBy(key).agg(F.count_if(F.col(column) == value).alias("n"), F.count_if(F.col(column) != value).alias("other")).filter("n > 0 and other = 0").select(key)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def union_breakdown(tables: dict[str, DataFrame], column: str) -> DataFrame:
    """table, value, n over several tables."""
    tagged = [df.select(F.lit(name).alias("table_name"), F.col(column).cast("string").alias("value")) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, tagged).groupBy("table_name", "value").agg(F.count(F.lit(1)).alias("n"))


def heatmap(flags: DataFrame, occ: DataFrame, lines: DataFrame) -> DataFrame:
    """ang, weight: occurrences of flagged words by page. Each open flag of a word adds its occurrences again. Flags are
    counted by word first, so the fan-out is a product, not rows."""
    weights = flags.filter("status = 'open' and word_id is not null").groupBy("word_id").agg(F.count(F.lit(1)).alias("w"))
    return occ.join(weights, "word_id").join(lines.select(F.col("id").alias("line_id"), "ang"), "line_id").groupBy("ang").agg(F.sum("w").alias("weight"))


def heat_buckets(weights: DataFrame, last: int = 1430, width: int = 10, ang: str = "ang", weight: str = "weight") -> DataFrame:
    """bucket (from 0), weight, ratio to the largest (or 1): every bucket of 1..last, zero-filled."""
    spine = weights.sparkSession.range(-(-last // width)).select(F.col("id").cast("int").alias("bucket"))
    sums = weights.filter(F.col(ang).between(1, last)).groupBy(F.floor((F.col(ang) - 1) / width).cast("int").alias("bucket")).agg(F.sum(weight).alias("w"))
    filled = spine.join(sums, "bucket", "left").select("bucket", F.coalesce("w", F.lit(0)).alias("weight"))
    most = filled.agg(F.greatest(F.max("weight"), F.lit(1)).alias("most"))
    return filled.crossJoin(F.broadcast(most)).select("bucket", "weight", F.round(F.col("weight") / F.col("most"), 6).alias("ratio"))  # one row


def staleness(definitions: DataFrame, current: str, version: str = "parser_version") -> DataFrame:
    """One row: total, stale. A row without a stamp is stale."""
    return definitions.agg(F.count(F.lit(1)).alias("total"), F.count_if(~F.col(version).eqNullSafe(F.lit(current))).alias("stale"))


# Statuses of metrics (metric: ok when, else).
def status(metric: Column, value: Column, pages: int = 1430, uncommented: int = 60) -> Column:
    zero = metric.isin("blank_translations", "duplicate_translations", "orphan_occurrences", "orphan_definitions", "stale_parses")
    return F.when(metric == "pages", F.when(value == pages, "ok").otherwise("warn")).when(metric == "uncommented_lines", F.when(value > uncommented, "warn").otherwise("ok")).when(zero, F.when(value == 0, "ok").otherwise("warn")).otherwise("info")


def health_report(lines: DataFrame, words: DataFrame, occ: DataFrame, definitions: DataFrame, grammar: DataFrame, translations: DataFrame, dict_sources: DataFrame, flags: DataFrame, pages: int = 1430, parser_version: str | None = None) -> DataFrame:
    """The whole report in long form: metric, group_key, value, status. Counts of one table share its scan; the branches
    are independent and run in one job."""

    def single(df: DataFrame, **aggregates: Column) -> DataFrame:
        row = df.agg(*(c.cast("long").alias(k) for k, c in aggregates.items()))
        return row.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.lit("").alias("group_key"), F.col(k).alias("value")) for k in aggregates))).alias("m")).select("m.*")

    def grouped(df: DataFrame, metric: str, key: Column, value: Column) -> DataFrame:
        return df.groupBy(F.coalesce(key.cast("string"), F.lit("")).alias("group_key")).agg(value.cast("long").alias("value")).select(F.lit(metric).alias("metric"), "group_key", "value")

    one = F.count(F.lit(1))
    named = dict_sources.join(definitions, dict_sources["id"] == definitions["dict_source_id"], "left").select(dict_sources["code"], definitions["word_id"])
    parts = [
        single(lines, lines=one, pages=F.countDistinct("ang"), hymns=F.countDistinct("shabad_id")),
        grouped(lines, "lines_per_source", F.col("source_fk"), one),
        single(words, words=one, words_in_corpus=F.count_if("in_corpus")),
        single(occ, occurrences=one, words_with_occurrences=F.countDistinct("word_id")),
        single(without(lines.select(F.col("id").alias("line_id")), translations, ["line_id"]), uncommented_lines=one),
        single(translations, translations=one, translated_lines=F.countDistinct("line_id"), blank_translations=F.count_if(F.trim("body") == "")),
        single(duplicates(translations, ["line_id", "source_code"]), duplicate_translations=one),
        single(without(words.select(F.col("id").alias("word_id")), definitions, ["word_id"]), undefined_words=one),
        grouped(named, "definitions_per_source", F.col("code"), F.count("word_id")),
        grouped(named, "words_per_source", F.col("code"), F.countDistinct("word_id")),
        single(without(definitions.select("word_id").distinct(), grammar, ["word_id"]), defined_without_grammar=one),
        single(only_value(grammar, "word_id", "provenance", "imported"), imported_only_words=one),
        grouped(grammar, "grammar_provenance", F.col("provenance"), one),
        single(occ.join(lines.select(F.col("id").alias("line_id")), "line_id", "left_anti"), orphan_occurrences=one),
        single(definitions.join(words.select(F.col("id").alias("word_id")), "word_id", "left_anti"), orphan_definitions=one),
        grouped(flags, "flags_by_status", F.col("status"), one),
        grouped(flags.filter("status = 'open'"), "open_flags_by_type", F.col("flag_type"), one),
    ]
    if parser_version:
        parts.append(single(definitions, stale_parses=F.count_if(~F.col("parser_version").eqNullSafe(F.lit(parser_version)))))
    report = reduce(DataFrame.unionByName, parts)
    return report.withColumn("status", status(F.col("metric"), F.col("value"), pages))


def share(part: Column, whole: Column) -> Column:
    return percent(part, whole)


def tables_without_policy(scripts: DataFrame) -> DataFrame:
    """(table_name, file): tables that migration scripts (file, body) create and none of them puts under row-level
    security, with the first file that creates each. Commented lines don't count, names do without schema and quotes."""
    code = scripts.select("file", F.array_join(F.filter(F.split("body", "\n"), lambda x: ~F.ltrim(x).startswith("--")), "\n").alias("code"))
    name = lambda c: F.lower(F.replace(F.regexp_replace(c, "^public[.]", ""), F.lit('"'), F.lit("")))
    found = lambda pattern: code.select("file", F.explode(F.regexp_extract_all("code", F.lit(pattern), F.lit(1))).alias("t")).select("file", name(F.col("t")).alias("table_name"))
    made = found(r"(?i)create\s+table\s+(?:if\s+not\s+exists\s+)?([a-z_.\"]+)").groupBy("table_name").agg(F.min("file").alias("file"))
    kept = found(r"(?i)alter\s+table\s+(?:only\s+)?([a-z_.\"]+)\s+enable\s+row\s+level\s+security").select("table_name").distinct()
    return made.join(kept, "table_name", "left_anti")
