"""Tiered search, browsing, page and word views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.script import GURMUKHI, Script, fold_key


def search(queries: DataFrame, words: DataFrame, limit: int = 20, raw_pattern: bool = False, script: Script = GURMUKHI) -> DataFrame:
    """For each query (q) its hits among words (id, gurmukhi, frequency, search_fold): q, id, gurmukhi, frequency, match,
    rank. The limit is at most 50.

    Tiers: prefix of the spelling without regard to case; prefix of the folded key, without repeats; substring, only
    when the others found nothing. Within a tier by frequency, then id. % and _ are literal unless raw_pattern.

    Literal tiers are equi-joins: a word is there under its beginnings (or parts) of the lengths that are asked for.
    Patterns with wild cards have no such key and are held against all words. A question's hits are cut to the limit in
    shares before they meet, so that no question gathers the vocabulary.
    """
    limit = max(0, min(limit, 50))
    asked = queries.select(F.trim("q").alias("q")).filter("q <> ''").distinct().select("q", F.lower("q").alias("low"), fold_key(F.col("q"), script).alias("fold"))
    spelt = words.select("id", "gurmukhi", "frequency", "search_fold", F.lower("gurmukhi").alias("low"))
    if raw_pattern:
        by_prefix = _like(asked, spelt, F.concat(F.col("asked"), F.lit("%")))
    else:
        by_prefix = _keyed(asked, "low", spelt, _beginnings("low", _lengths(asked, "low")))
    by_fold = _keyed(asked.filter("fold <> ''"), "fold", spelt, _beginnings("search_fold", _lengths(asked, "fold")))
    near = by_prefix.withColumn("tier", F.lit(1)).unionByName(by_fold.withColumn("tier", F.lit(2))).groupBy("q", "id", "gurmukhi", "frequency").agg(F.min("tier").alias("tier"))
    first = _ranked(near, limit)
    rest = asked.join(near.select("q").distinct(), "q", "left_anti")
    if raw_pattern:
        parts = _like(rest, spelt, F.concat(F.lit("%"), F.col("asked"), F.lit("%")))
    else:
        parts = _keyed(rest, "low", spelt, _parts("low", _lengths(rest, "low")))
    found = first.unionByName(_ranked(parts.withColumn("tier", F.lit(3)), limit))
    names = F.element_at(F.array(F.lit("prefix"), F.lit("fold"), F.lit("contains")), F.col("tier"))
    return found.select("q", "id", "gurmukhi", "frequency", names.alias("match"), "rank")


def _lengths(asked: DataFrame, column: str) -> list[int]:
    """The different lengths of the questions: a handful, however many they are."""
    return sorted(r[0] for r in asked.select(F.length(column)).distinct().collect() if r[0])


def _beginnings(column: str, lengths: list[int]):
    return F.array(*(F.when(F.length(column) >= n, F.left(column, F.lit(n))) for n in lengths)) if lengths else F.array().cast("array<string>")


def _parts(column: str, lengths: list[int]):
    """The distinct substrings of these lengths."""

    def cuts_of(n: int):
        starts = F.sequence(F.lit(1), F.greatest(F.length(column) - n + 1, F.lit(1)))
        return F.when(F.length(column) >= n, F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    cuts = [cuts_of(n) for n in lengths]
    return F.array_distinct(F.flatten(F.array(*cuts))) if cuts else F.array().cast("array<string>")


def _keyed(asked: DataFrame, by: str, words: DataFrame, keys) -> DataFrame:
    """(q, id, gurmukhi, frequency) of words that have a question's key among theirs."""
    there = words.select("id", "gurmukhi", "frequency", F.explode(keys).alias("key__"))
    return asked.select("q", F.col(by).alias("key__")).join(there, "key__").drop("key__")


def _like(asked: DataFrame, words: DataFrame, pattern) -> DataFrame:
    held = asked.select("q", F.col("low").alias("asked")).join(words.select("id", "gurmukhi", "frequency", "low"), F.like(F.col("low"), pattern))
    return held.drop("asked", "low")


def _ranked(hits: DataFrame, limit: int, shares: int = 64) -> DataFrame:
    order = ("tier", F.desc("frequency"), "id")
    share = F.row_number().over(Window.partitionBy("q", F.pmod(F.xxhash64("id"), F.lit(shares))).orderBy(*order))
    cut = hits.withColumn("rank", share).filter(F.col("rank") <= limit)
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= limit)


def browse(words: DataFrame, page: int = 1, size: int = 50, word: str = "gurmukhi") -> DataFrame:
    """One page of corpus words by frequency: rank, word, frequency, total_pages."""
    listed = words.filter("in_corpus") if "in_corpus" in words.columns else words
    total = listed.agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("total_pages"))
    rows = listed.orderBy(F.desc("frequency"), word).offset((page - 1) * size).limit(size)
    ranked = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("frequency"), word)) + (page - 1) * size)  # one page
    return ranked.crossJoin(F.broadcast(total)).select("rank", F.col(word).alias("word"), "frequency", "total_pages")


def page_view(lines: DataFrame, shabads: DataFrame, source: int, ang: int, last: int = 1430) -> DataFrame:
    """Lines of one page of one corpus in order, with their hymn; no rows for a page out of bounds."""
    if not 1 <= ang <= last:
        return lines.limit(0).join(shabads.withColumnRenamed("id", "shabad_id"), "shabad_id", "left")
    return lines.filter((F.col("source_fk") == source) & (F.col("ang") == ang)).join(shabads.select(F.col("id").alias("shabad_id"), "raag_english", "writer_english"), "shabad_id", "left").orderBy("line_no", "id")


def word_profiles(words: DataFrame, grammar: DataFrame, rules: DataFrame, definitions: DataFrame, etymology: DataFrame, forms: DataFrame, bigrams: DataFrame, collocations: DataFrame, writers: DataFrame, top: int = 15, top_writers: int = 10) -> DataFrame:
    """One wide row per word: nested grammar with rules, caveats (distinct unverified rules), definitions, etymology,
    variants from all its lexemes, phrases, collocations and writers. Built for all words at once, so a profile is a
    lookup; each branch is cut to its top rows before it is gathered."""
    from .ngrams import top_partners

    def nested(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
        fields = [c for c in rows.columns if c != "word_id"]
        packed = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o__"), F.struct(*fields).alias("v"))))
        return rows.groupBy("word_id").agg(F.transform(packed, lambda x: x["v"]).alias(name))

    ruled = grammar.join(rules.select("rule_code", "title", "verified"), "rule_code", "left").select("word_id", "id", "pos", "gender", "number", "gram_case", "rule_code", "title", "verified")
    caveats = ruled.filter("verified = false").groupBy("word_id").agg(F.array_sort(F.collect_set("rule_code")).alias("caveats"))
    siblings = forms.alias("x").join(forms.alias("y"), "lexeme_id").filter("x.word_id <> y.word_id").select(F.col("x.word_id").alias("word_id"), F.col("y.word_id").alias("variant_id"), F.col("y.inflection_desc").alias("inflection_desc")).distinct()
    pair = lambda rows, a, b, by: top_partners(rows.select(F.col(a).alias("word_a"), F.col(b).alias("word_b"), by), by, top).select(F.col("word").alias("word_id"), F.col("partner").alias("partner_id"), by, "rank")
    ranked_writers = writers.withColumn("rank", F.row_number().over(Window.partitionBy("word_id").orderBy(F.desc("frequency"), "writer_id"))).filter(F.col("rank") <= top_writers)
    out = words.withColumnRenamed("id", "word_id")
    for part in (
        nested(ruled, "grammar", ["id"]), caveats, nested(definitions, "definitions", ["dict_source_id", "sense_number"]), nested(etymology, "etymology", ["order_index"]), nested(siblings, "variants", ["variant_id"]),
        nested(pair(bigrams, "w1_id", "w2_id", "pair_count"), "phrases", ["rank"]), nested(pair(collocations, "word_a_id", "word_b_id", "pmi"), "collocations", ["rank"]), nested(ranked_writers, "writers", ["rank"]),
    ):
        out = out.join(part, "word_id", "left")
    return out


def occurrence_page(occ: DataFrame, lines: DataFrame, sources: DataFrame, shabads: DataFrame, commentaries: DataFrame, word_id: int, page: int = 1, size: int = 50, order: tuple[str, ...] = ()) -> DataFrame:
    """One page of a word's occurrences with nested source, hymn and commentaries; commentaries by the given order of
    source codes, others last. group_no numbers raags (Unknown when missing) by first appearance on the page."""
    hits = occ.filter(F.col("word_id") == word_id).orderBy("line_id", "position").offset((page - 1) * size).limit(size)
    rank = F.coalesce(F.nullif(F.array_position(F.array(*(F.lit(c) for c in order)), F.col("source_code")), F.lit(0)), F.lit(99)) if order else F.lit(99)
    notes = commentaries.join(hits.select("line_id").distinct(), "line_id", "left_semi").groupBy("line_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), "source_code", "body"))), lambda x: F.struct(x["source_code"].alias("source_code"), x["body"].alias("body"))).alias("commentaries"))
    joined = hits.join(lines.select(F.col("id").alias("line_id"), "source_fk", "shabad_id", "ang", "gurmukhi"), "line_id").join(sources.select(F.col("id").alias("source_fk"), F.struct("code", "name").alias("source")), "source_fk", "left").join(shabads.select(F.col("id").alias("shabad_id"), F.coalesce("raag_english", F.lit("Unknown")).alias("raag"), "writer_english"), "shabad_id", "left").join(notes, "line_id", "left")
    named = joined.withColumn("raag", F.coalesce("raag", F.lit("Unknown")))
    first = F.min(F.struct("line_id", "position")).over(Window.partitionBy("raag"))
    return named.withColumn("first__", first).withColumn("group_no", F.dense_rank().over(Window.orderBy("first__"))).drop("first__")  # one page
