"""Tokens, frequencies, bigrams, collocations, word sets and audits over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.script import LATIN, tokenize
from ..operators import corpus, ngrams
from ..sources.workspace import Workspace
from .base import CORPUS_SQL, corpus_lines, corpus_tokens, corpus_words, query, table


@query(f"WITH {CORPUS_SQL} SELECT doc_id, line_no, len(tokens) AS n_tokens, array_to_string(tokens, ' ') AS joined FROM toks")
def tokenize_lines(spark, sf_dir):
    return corpus_lines(spark, sf_dir).select("doc_id", "line_no", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("joined"))


def _bench_sql() -> str:
    from .base import TOKENS_SQL

    return f"blines AS (SELECT item_id, text AS line FROM benchmark), bench AS (SELECT DISTINCT unnest({TOKENS_SQL}) AS word FROM blines), {CORPUS_SQL.strip()}"


def _bench_words(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.explode(tokenize(F.col("text"), LATIN)).alias("word")).distinct()


@query(f"WITH {_bench_sql()}, words AS (SELECT word FROM bench UNION SELECT word FROM occ), n AS (SELECT word, CAST(count(*) AS INTEGER) AS n FROM occ GROUP BY 1) SELECT word, coalesce(n, 0) AS frequency FROM words LEFT JOIN n USING (word)")
def word_frequency(spark, sf_dir):
    counts = Workspace(spark, "frequencies").save(corpus.word_counts(corpus_tokens(spark, sf_dir)), "counts")  # a row a word, read twice
    words = _bench_words(spark, sf_dir).unionByName(counts.select("word")).distinct()
    return corpus.with_counts(words, counts)


@query(f"WITH {CORPUS_SQL} SELECT word, source, CAST(count(*) AS INTEGER) AS frequency FROM occ GROUP BY 1, 2")
def word_corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(corpus_words(spark, sf_dir))


@query(f"WITH {CORPUS_SQL} SELECT word, lang AS writer_id, min(lang) AS writer, CAST(count(*) AS INTEGER) AS frequency FROM occ WHERE lang IS NOT NULL GROUP BY 1, 2")
def word_writer_stats(spark, sf_dir):
    return corpus.writer_stats(corpus_words(spark, sf_dir).select("word", F.col("lang").alias("writer_id"), F.col("lang").alias("writer")))


@query(f"WITH {CORPUS_SQL}, n AS (SELECT word, lead(word) OVER (PARTITION BY doc_id, line_no ORDER BY position) AS w2 FROM occ) SELECT word AS w1, w2, CAST(count(*) AS INTEGER) AS pair_count FROM n WHERE w2 IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 3")
def bigrams_min3(spark, sf_dir):
    return ngrams.bigrams(corpus_lines(spark, sf_dir))


_COLLOCATIONS = f"""
    WITH {CORPUS_SQL},
    pairs AS (SELECT least(a.word, b.word) AS word_a, greatest(a.word, b.word) AS word_b, count(*) AS pair_count
              FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.position > a.position AND b.position - a.position <= 3 GROUP BY 1, 2 HAVING count(*) >= 5),
    uni AS (SELECT word, count(*) AS n FROM occ GROUP BY 1), total AS (SELECT count(*) AS total FROM occ),
    scored AS (SELECT word_a, word_b, 3 AS window_size, CAST(pair_count AS INTEGER) AS pair_count, round(log2(pair_count::DOUBLE * total / (ua.n::DOUBLE * ub.n)), 6) AS pmi
               FROM pairs JOIN uni ua ON ua.word = word_a JOIN uni ub ON ub.word = word_b CROSS JOIN total),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY word_a ORDER BY pmi DESC, pair_count DESC, word_b) AS rank FROM scored)
"""


@query(f"{_COLLOCATIONS} SELECT word_a, word_b, window_size, pair_count, pmi FROM ranked WHERE rank <= 50")
def collocations_pmi_top50(spark, sf_dir):
    return ngrams.collocations(corpus_lines(spark, sf_dir))


@query(
    f"""{_COLLOCATIONS}, kept AS (SELECT * FROM ranked WHERE rank <= 50),
    sides AS (SELECT word_a AS word, word_b AS partner, pmi FROM kept UNION ALL SELECT word_b, word_a, pmi FROM kept WHERE word_a <> word_b),
    top AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY pmi DESC NULLS LAST, partner) AS rank FROM sides)
    SELECT word, partner, pmi, CAST(rank AS INTEGER) AS rank FROM top WHERE rank <= 15"""
)
def collocation_partners_top15(spark, sf_dir):
    kept = ngrams.collocations(corpus_lines(spark, sf_dir)).select("word_a", "word_b", "pmi")
    return ngrams.top_partners(kept, "pmi", 15).select("word", "partner", "pmi", "rank")


@query(
    f"""WITH {CORPUS_SQL}, o AS (SELECT doc_id, line_no, word, position * 3 + (position % 2) AS position FROM occ)
    SELECT least(a.word, b.word) AS a, greatest(a.word, b.word) AS b, count(*) AS n FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.line_no = b.line_no AND b.position > a.position AND b.position - a.position <= 5
    GROUP BY 1, 2 HAVING count(*) >= 5"""
)
def band_pairs_with_gaps(spark, sf_dir):
    """Stored positions with gaps: the window is in positions, not in places."""
    occ = corpus_words(spark, sf_dir).select("doc_id", "line_no", "word", (F.col("position") * 3 + F.col("position") % 2).alias("position"))
    return ngrams.band_pairs(occ, 5, ("doc_id", "line_no"), "word").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).filter("n >= 5")


_SETS = [("range", {"type": "range", "start": 100, "end": 300}), ("shabads", {"type": "shabads", "ids": [3, 5, 8, 13, 21, 34, 55, 89]}), ("bani", {"type": "bani"})]


@query(
    f"""WITH {CORPUS_SQL}, s AS (SELECT 'range' AS set_name, doc_id FROM documents WHERE doc_id BETWEEN 100 AND 300 UNION ALL SELECT 'shabads', doc_id FROM documents WHERE doc_id IN (3, 5, 8, 13, 21, 34, 55, 89)
        UNION ALL SELECT 'bani', doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark))
    SELECT set_name, word, CAST(count(*) AS INTEGER) AS occurrence_count FROM s JOIN occ USING (doc_id) GROUP BY 1, 2"""
)
def word_set_members(spark, sf_dir):
    occ = corpus_words(spark, sf_dir)
    lines = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("ang"), F.col("doc_id").alias("shabad_id"), F.col("doc_id").alias("verse_id"))
    bani = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("verse_id"))
    out = None
    for name, definition in _SETS:
        members = corpus.set_members(occ, corpus.resolve_set(lines, definition, bani=bani), line_keys=("doc_id",)).select(F.lit(name).alias("set_name"), "word", "occurrence_count")
        out = members if out is None else out.unionByName(members)
    return out


@query(
    f"""WITH {CORPUS_SQL}, missing AS (SELECT source, doc_id, line_no, count(*) AS n FROM occ WHERE (doc_id * 31 + line_no * 7 + position) % 97 = 0 GROUP BY 1, 2, 3)
    SELECT source, CAST(sum(n) AS BIGINT) AS missing_tokens, count(*) AS short_lines FROM missing GROUP BY 1"""
)
def occurrence_audit(spark, sf_dir):
    """Stored occurrences lack a fixed slice of positions; the audit finds it by re-tokenising."""
    expected = corpus_words(spark, sf_dir)
    stored = expected.filter("(doc_id * 31 + line_no * 7 + position) % 97 <> 0").select("doc_id", "line_no", "position")
    return corpus.occurrence_audit(expected, stored, ("doc_id", "line_no"))


@query(f"WITH {_bench_sql()} SELECT word, word IN (SELECT word FROM occ) AS in_corpus FROM bench")
def in_corpus_flip(spark, sf_dir):
    return corpus.in_corpus(_bench_words(spark, sf_dir), corpus_tokens(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, w AS (SELECT DISTINCT word FROM occ) SELECT word, row_number() OVER (ORDER BY word) AS word_id FROM w")
def word_ids(spark, sf_dir):
    return corpus.word_dimension(corpus_tokens(spark, sf_dir))


@query(
    f"""WITH {CORPUS_SQL}, f AS (SELECT word, min(struct_pack(doc_id := doc_id, line_no := line_no, position := position)) AS first FROM occ GROUP BY 1)
    SELECT word, row_number() OVER (ORDER BY first, word) AS word_id FROM f"""
)
def word_ids_first_seen(spark, sf_dir):
    return corpus.word_dimension(corpus_words(spark, sf_dir), order=("doc_id", "line_no", "position"))


@query(
    f"""WITH {CORPUS_SQL}, verses AS (SELECT doc_id, count(DISTINCT line_no) AS lines, count(*) AS occurrences, count(DISTINCT word) AS words FROM occ GROUP BY 1)
    SELECT doc_id % 1430 + 1 AS ang, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(occurrences) AS BIGINT) AS occurrences FROM verses GROUP BY 1"""
)
def ingest_counts(spark, sf_dir):
    """The whole ingest, counted by page: verses to lines and occurrences with strict lookups of word ids."""
    lines = corpus_lines(spark, sf_dir)
    verses = lines.select(
        F.lit(1).cast("bigint").alias("source_fk"), (F.col("doc_id") * 100_000 + F.col("line_no")).alias("verse_id"), F.col("doc_id").alias("shabad_id"), (F.col("doc_id") % 1430 + 1).alias("ang"), "line_no", F.col("line").alias("gurmukhi"),
        F.struct(F.lit(None).cast("string").alias("bdb"), F.lit(None).cast("string").alias("ms")).alias("translations"), F.col("source").alias("raag_english"), F.col("lang").alias("writer_english"), F.lit(0).cast("bigint").alias("writer_id"),
    )
    made = corpus.ingest(verses, LATIN)
    placed = made["word_occurrences"].join(made["lines"].select(F.col("id").alias("line_id"), "ang"), "line_id")
    return placed.groupBy("ang").agg(F.countDistinct("line_id").alias("lines"), F.count(F.lit(1)).alias("occurrences"))


@query(
    """WITH v AS (SELECT doc_id % 40 AS shabad_id, doc_id AS verse_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS raag, doc_id % 1430 + 1 AS ang FROM documents)
    SELECT shabad_id AS id, arg_min(raag, verse_id) FILTER (WHERE raag IS NOT NULL) AS raag_english, min(ang) AS ang_start FROM v GROUP BY 1"""
)
def raag_backfill(spark, sf_dir):
    verses = table(spark, sf_dir, "documents").select((F.col("doc_id") % 40).alias("shabad_id"), F.col("doc_id").alias("verse_id"), F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("raag_english"), (F.col("doc_id") % 1430 + 1).alias("ang"))
    shabads = verses.select(F.col("shabad_id").alias("id"), F.lit(None).cast("string").alias("raag_english"), F.lit(None).cast("bigint").alias("ang_start")).distinct()
    return corpus.backfill_raags(shabads, verses)


@query(
    """SELECT doc_id AS line_id, 'lang' AS source_code, trim(lang) AS body FROM documents WHERE trim(lang) <> '' UNION ALL SELECT doc_id, 'source', trim(source) FROM documents WHERE trim(source) <> ''
    UNION ALL SELECT doc_id, 'text', trim(text) FROM documents WHERE trim(text) <> ''"""
)
def translation_unpivot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_id"), "lang", F.struct(F.col("source").alias("unicode")).alias("source"), "text")
    return corpus.translations(docs, {"lang": "lang", "source": "source", "text": "text"})
