"""Landed files to rows: corpus pages, JSON lines, lookup caches, dictionaries of dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Layout of a corpus page response.
PAGE = """source struct<sourceId: string, pageNo: int>, count int, page array<struct<verseId: bigint, shabadId: bigint,
verse: struct<unicode: string>, pageNo: int, lineNo: int, translation: struct<en: struct<bdb: string, ms: string>>,
writer: struct<writerId: bigint, english: string>, raag: struct<english: string, unicode: string>>>"""


def corpus_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page responses to verses: source, verse_id, shabad_id, ang, line_no, gurmukhi, translations, writer, raag."""
    rows = spark.read.schema(PAGE).json(path)
    return rows.select(F.col("source.sourceId").alias("source_code"), F.explode("page").alias("v")).select(
        "source_code", F.col("v.verseId").alias("verse_id"), F.col("v.shabadId").alias("shabad_id"), F.col("v.pageNo").alias("ang"), F.col("v.lineNo").alias("line_no"), F.col("v.verse.unicode").alias("gurmukhi"),
        F.col("v.translation.en").alias("translations"), F.col("v.writer.english").alias("writer_english"), F.col("v.writer.writerId").alias("writer_id"), F.col("v.raag.english").alias("raag_english"),
    )


def bani_verses(spark: SparkSession, path: str) -> DataFrame:
    """Landed compositions (baniInfo, verses) to (bani_id, ord, verse_id, ang, line_no); verses without an id are skipped."""
    schema = "baniInfo struct<baniID: int>, verses array<struct<verse: struct<verseId: bigint, pageNo: int, lineNo: int>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("baniInfo.baniID").alias("bani_id"), F.posexplode("verses.verse").alias("ord", "v"))
    return rows.select("bani_id", "ord", F.col("v.verseId").alias("verse_id"), F.col("v.pageNo").alias("ang"), F.col("v.lineNo").alias("line_no")).filter("verse_id is not null")


def shabad_verses(spark: SparkSession, path: str) -> DataFrame:
    """Landed hymns (shabadInfo, verses) to (shabad_id, ord, verse_id, ang, line_no, gurmukhi); verses without an id are
    skipped."""
    schema = "shabadInfo struct<shabadId: bigint>, verses array<struct<verseId: bigint, pageNo: int, lineNo: int, verse: struct<unicode: string>>>"
    rows = spark.read.schema(schema).json(path).select(F.col("shabadInfo.shabadId").alias("shabad_id"), F.posexplode("verses").alias("ord", "v"))
    return rows.select("shabad_id", "ord", F.col("v.verseId").alias("verse_id"), F.col("v.pageNo").alias("ang"), F.col("v.lineNo").alias("line_no"), F.col("v.verse.unicode").alias("gurmukhi")).filter("verse_id is not null")


def json_lines(spark: SparkSession, path: str, schema: str, keep_bad: bool = False) -> DataFrame:
    """JSON lines with a given schema. Blank lines are skipped; malformed ones go to _bad, dropped unless keep_bad."""
    rows = spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    return rows if keep_bad else rows.filter(F.col("_bad").isNull()).drop("_bad")


def lookup_cache(spark: SparkSession, path: str) -> DataFrame:
    """An append-only cache of {key, value} lines: the last line of a key wins, a torn last line is dropped. value is the
    JSON text, null for a lookup that found nothing."""
    raw = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("seq"))
    parsed = raw.select(F.get_json_object("value", "$.key").alias("key"), F.get_json_object("value", "$.value").alias("found"), F.struct("file", "seq").alias("seq"), F.col("value").alias("line"))
    return parsed.filter("key is not null and try_parse_json(line) is not null").groupBy("key").agg(F.max_by("found", "seq").alias("value"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Keys still to look up."""
    return wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


def pending(wanted: DataFrame, landed: DataFrame, key: str, settled: Column | None = None) -> DataFrame:
    """What a checkpointed scrape has left: wanted keys without a landed row, or with none that is settled (transient
    failures are tried again)."""
    done = landed if settled is None else landed.filter(settled)
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def side_map(parsed: DataFrame) -> DataFrame:
    """Rows (gurmukhi, senses array, seq) to one row per word and sense; later repeats overwrite."""
    senses = parsed.select("gurmukhi", "seq", F.posexplode("senses").alias("n", "s")).select("gurmukhi", "seq", "n", "s.*")
    last = F.row_number().over(Window.partitionBy("gurmukhi", "sense_number").orderBy(F.desc("seq"), F.desc("n")))
    return senses.withColumn("r__", last).filter("r__ = 1").drop("r__", "n", "seq")


def unpivot_maps(docs: DataFrame, column: str, category: str = "category") -> DataFrame:
    """JSON objects of objects to (category, key, value); keys starting with _ and values that aren't text are skipped."""
    outer = docs.select(F.explode(F.from_json(column, "map<string,string>")).alias(category, "inner")).filter(~F.col(category).startswith("_"))
    pairs = outer.select(category, F.explode(F.from_json("inner", "map<string,variant>")).alias("key", "v"))
    return pairs.filter(~F.col("key").startswith("_") & (F.schema_of_variant("v") == "STRING")).select(category, "key", F.try_variant_get("v", "$", "string").alias("value"))


def html_blocks(pages: DataFrame, html: str, marker: str) -> DataFrame:
    """A page's blocks that start at the marker, numbered from 0, without what stands before the first."""
    parts = F.split(html, marker, -1)
    return pages.select("*", F.posexplode(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))).alias("block_no", "block"))
