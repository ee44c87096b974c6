"""From texts to lines, words, occurrences and frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.script import GURMUKHI, Script, tokenize
from ..sources.workspace import Workspace


def lines_of(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per newline-separated line: keys, line_no (from 0), line. Narrow: no shuffle."""
    return docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def line_tokens(lines: DataFrame, script: Script = GURMUKHI, line: str = "line") -> DataFrame:
    """Adds tokens, the array of a line's tokens; their index is their position."""
    return lines.withColumn("tokens", tokenize(F.col(line), script))


def occurrences(lines: DataFrame, keys: tuple[str, ...] = ("line_id",), script: Script = GURMUKHI, line: str = "line") -> DataFrame:
    """One row per kept token: keys, position (numbered after the filter, from 0), word."""
    return lines.select(*keys, F.posexplode(tokenize(F.col(line), script)).alias("position", "word"))


def word_dimension(words: DataFrame, word: str = "word", order: tuple[str, ...] | None = None) -> DataFrame:
    """(word_id, word): distinct words with dense ids from 1, by first occurrence if order columns are given, else by
    the word. Ids come from a range sort and per-partition counts, not from a window over one partition. The sorted words
    are written once, as ids must not change when a lost task is run again."""
    seen = words.groupBy(word).agg(F.min(F.struct(*order)).alias("first__")) if order else words.select(word).distinct()
    ws = Workspace(words.sparkSession, "word-ids")
    placed = ws.save(seen.orderBy(*(["first__", word] if order else [word])).select(word, F.monotonically_increasing_id().alias("m__")), "sorted")
    parts = placed.select(F.shiftright("m__", 33).alias("p__")).groupBy("p__").count()
    before = Window.orderBy("p__").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = parts.select("p__", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("s__"))
    return placed.withColumn("p__", F.shiftright("m__", 33)).join(F.broadcast(starts), "p__").select((F.col("s__") + F.col("m__").bitwiseAND((1 << 33) - 1) + 1).alias("word_id"), word)


def word_counts(occ: DataFrame, key: str = "word") -> DataFrame:
    """(word, frequency) of the words that occur."""
    return occ.groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("frequency"))


def with_counts(words: DataFrame, counts: DataFrame, key: str = "word") -> DataFrame:
    """words with their frequency from counts, 0 for those that never occur."""
    return words.join(counts, key, "left").withColumn("frequency", F.coalesce("frequency", F.lit(0)))


def word_frequency(words: DataFrame, occ: DataFrame, key: str = "word") -> DataFrame:
    """words with frequency: a left join to counts made before it."""
    return with_counts(words, word_counts(occ, key), key)


def corpus_stats(occ: DataFrame, key: str = "word", source: str = "source") -> DataFrame:
    """Occurrences by word and source."""
    return occ.groupBy(key, source).agg(F.count(F.lit(1)).cast("int").alias("frequency"))


def writer_stats(occ: DataFrame, key: str = "word", writer_id: str = "writer_id", writer: str = "writer") -> DataFrame:
    """Occurrences by word and writer, with the first of the writer's names; occurrences without a writer are left out."""
    return occ.filter(F.col(writer_id).isNotNull()).groupBy(key, writer_id).agg(F.min(writer).alias(writer), F.count(F.lit(1)).cast("int").alias("frequency"))


def in_corpus(words: DataFrame, occ: DataFrame, key: str = "word") -> DataFrame:
    """words with in_corpus: whether any occurrence exists."""
    present = occ.select(key).distinct().withColumn("in_corpus", F.lit(True))
    return words.join(present, key, "left").withColumn("in_corpus", F.coalesce("in_corpus", F.lit(False)))


def set_members(occ: DataFrame, lines: DataFrame, key: str = "word", line_keys: tuple[str, ...] = ("line_id",)) -> DataFrame:
    """Words of a set of lines with their occurrence counts there."""
    return occ.join(lines.select(*line_keys).distinct(), list(line_keys), "left_semi").groupBy(key).agg(F.count(F.lit(1)).cast("int").alias("occurrence_count"))


def resolve_set(lines: DataFrame, definition: dict, ang: str = "ang", verse: str = "verse_id", shabad: str = "shabad_id", bani: DataFrame | None = None) -> DataFrame:
    """Lines of a set definition: {type: bani} (verses given by bani), {type: range, start, end}, {type: shabads, ids}."""
    kind = definition["type"]
    if kind == "range":
        return lines.filter(F.col(ang).between(definition["start"], definition["end"]))
    if kind == "shabads":
        return lines.filter(F.col(shabad).isin(definition["ids"]))
    if kind == "bani" and bani is not None:
        return lines.join(bani.select(verse).filter(F.col(verse).isNotNull()).distinct(), verse, "left_semi")
    raise ValueError(f"unknown set {definition}")


def strict_lookup(rows: DataFrame, dimension: DataFrame, on: list[str], id_col: str, what: str = "row") -> DataFrame:
    """Left join that fails the job on the first row without a match."""
    joined = rows.join(dimension, on, "left")
    known = F.when(F.col(id_col).isNull(), F.raise_error(F.concat(F.lit(f"unresolved {what}: "), *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in on))).cast(dict(joined.dtypes)[id_col])).otherwise(F.col(id_col))
    return joined.withColumn(id_col, known)


def missing_occurrences(expected: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("line_id", "position")) -> DataFrame:
    """Tokens that re-tokenising expects and the stored occurrences lack."""
    return expected.join(stored.select(*keys), list(keys), "left_anti")


def occurrence_audit(expected: DataFrame, stored: DataFrame, line_keys: tuple[str, ...], source: str = "source") -> DataFrame:
    """By source: missing_tokens and short_lines (lines with any missing token)."""
    missing = missing_occurrences(expected, stored, (*line_keys, "position"))
    by_line = missing.groupBy(source, *line_keys).agg(F.count(F.lit(1)).alias("n"))
    return by_line.groupBy(source).agg(F.sum("n").cast("long").alias("missing_tokens"), F.count(F.lit(1)).alias("short_lines"))


def ingest(verses: DataFrame, script: Script = GURMUKHI) -> dict[str, DataFrame]:
    """Verses (source_fk, verse_id, shabad_id, ang, line_no, gurmukhi, translations struct of bdb and ms, writer and raag
    columns) -> shabads, lines, words, word_occurrences, word_corpus_stats. A shabad is its first row by verse, a verse the
    least of the rows that repeat it."""
    first = F.row_number().over(Window.partitionBy("shabad_id").orderBy("source_fk", "verse_id"))
    shabads = verses.filter("shabad_id is not null").withColumn("n__", first).filter("n__ = 1").select(F.col("shabad_id").alias("id"), "raag_english", "writer_english", "writer_id", F.col("ang").alias("ang_start"), "source_fk")
    # of rows that repeat a verse the least by its columns stays, so a rerun keeps the same
    told = verses.groupBy("source_fk", "verse_id").agg(F.min(F.struct("shabad_id", "ang", "line_no", "gurmukhi", "translations")).alias("v")).select("source_fk", "verse_id", "v.*")
    lines = told.select(F.xxhash64("source_fk", "verse_id").alias("id"), "source_fk", "verse_id", "shabad_id", "ang", "line_no", "gurmukhi", F.coalesce("translations.bdb", "translations.ms").alias("translation_en"))
    occ = lines.select(F.col("id").alias("line_id"), "source_fk", F.posexplode(tokenize(F.col("gurmukhi"), script)).alias("position", "word"))
    words = word_dimension(occ)
    stored = strict_lookup(occ, words, ["word"], "word_id", "token").select("word_id", "line_id", "position", "source_fk")
    frequency = stored.groupBy("word_id").agg(F.count(F.lit(1)).cast("int").alias("frequency"))
    return {
        "shabads": shabads,
        "lines": lines,
        "words": words.join(frequency, "word_id").select(F.col("word_id").alias("id"), F.col("word").alias("gurmukhi"), "frequency", F.lit(True).alias("in_corpus")),
        "word_occurrences": stored.select("word_id", "line_id", "position"),
        "word_corpus_stats": corpus_stats(stored, "word_id", "source_fk"),
    }


def backfill_raags(shabads: DataFrame, verses: DataFrame) -> DataFrame:
    """shabads with a missing raag filled by that of their first verse that has one, and ang_start by the lowest ang."""
    facts = verses.groupBy(F.col("shabad_id").alias("id")).agg(F.min_by("raag_english", F.when(F.col("raag_english").isNotNull(), F.col("verse_id"))).alias("raag__"), F.min("ang").alias("ang__"))
    return shabads.join(facts, "id", "left").withColumn("raag_english", F.coalesce("raag_english", "raag__")).withColumn("ang_start", F.coalesce("ang_start", "ang__")).drop("raag__", "ang__")


def translations(lines: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Unpivots a verse's translation fields {source_code: column} to (line_id, source_code, body); blank ones go, the
    rest are trimmed. Columns may be strings or structs with a `unicode` field."""
    body = lambda c: F.col(c)["unicode"] if dict(lines.dtypes)[c.split(".")[0]].startswith("struct<unicode") else F.col(c)
    pairs = F.array(*(F.struct(F.lit(code).alias("source_code"), F.trim(body(c)).alias("body")) for code, c in fields.items()))
    return lines.select("line_id", F.explode(pairs).alias("t")).select("line_id", "t.*").filter("body <> ''")


