"""Summary tables of a corpus rebuilt and swapped in: the counterpart of refreshed materialised views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import corpus, morph, quality
from ..sources.sinks import replace_table


def summaries(words: DataFrame, occ: DataFrame, lines: DataFrame, definitions: DataFrame) -> dict[str, DataFrame]:
    """word_corpus_stats, word_writer_stats, word_source_stats, word_stem_groups. words (id, gurmukhi), occ (word_id,
    line_id), lines (id, source_fk, writer_id, writer), definitions (word_id, dict_source_id)."""
    placed = occ.join(lines.withColumnRenamed("id", "line_id"), "line_id")
    return {
        "word_corpus_stats": corpus.corpus_stats(placed, "word_id", "source_fk"),
        "word_writer_stats": corpus.writer_stats(placed, "word_id"),
        "word_source_stats": quality.per_source_counts(words, definitions, "id", "word_id", "dict_source_id"),
        "word_stem_groups": morph.stem_groups(words.select("id", "gurmukhi")),
    }


def refresh(spark: SparkSession, root: str, words: DataFrame, occ: DataFrame, lines: DataFrame, definitions: DataFrame) -> None:
    """Writes the summaries under root, and words with their frequency and in_corpus; running it twice changes nothing."""
    for name, table in summaries(words, occ, lines, definitions).items():
        replace_table(table, f"{root}/{name}")
    keyed = words.withColumnRenamed("id", "word_id").drop("frequency", "in_corpus")
    counted = corpus.in_corpus(corpus.word_frequency(keyed, occ, "word_id"), occ, "word_id").withColumnRenamed("word_id", "id")
    replace_table(counted, f"{root}/words")
