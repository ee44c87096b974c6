"""Registration of queries with their SQL, and the inputs that several of them share."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.script import LATIN, SPACE, tokenize
from ..operators.corpus import line_tokens, lines_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLES[key] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], names: str) -> str:
    """A SELECT over literal rows; None is NULL."""
    cell = lambda v: "NULL" if v is None else quoted(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names})"


def literal(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# ---- documents as a corpus: sources, hymns (documents), writers (languages), lines ------------------------------

_EDGES = quoted(LATIN.edges)[1:-1]
TOKENS_SQL = f"list_filter(list_transform(string_split_regex(line, '[{SPACE}]+'), lambda t: regexp_replace(t, '^[{_EDGES}]+|[{_EDGES}]+$', '', 'g')), lambda t: regexp_matches(t, '[{LATIN.letters}]'))"
CORPUS_SQL = f"""
    lines AS (SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM documents),
    toks AS (SELECT doc_id, line_no, source, lang, {TOKENS_SQL} AS tokens FROM lines),
    occ AS (SELECT doc_id, line_no, source, lang, unnest(tokens) AS word, unnest(range(len(tokens))) AS position FROM toks)
"""


def spread(df: DataFrame, limit: int = 256 << 20) -> DataFrame:
    """A small input (below limit bytes, which may be one row group and so one task) dealt over all cores; a large one as
    it is, since its files make enough tasks and its texts had better not be shuffled. Only the plan differs: no query
    over it depends on how rows are dealt."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size < limit else df


def corpus_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line_no, line, tokens."""
    return line_tokens(lines_of(spread(table(spark, sf_dir, "documents")), keys=("doc_id", "source", "lang")), LATIN)


def corpus_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, line_no, position, word."""
    return corpus_lines(spark, sf_dir).select("doc_id", "source", "lang", "line_no", F.posexplode("tokens").alias("position", "word"))


def corpus_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """word: every token, without its place."""
    return spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(tokenize(F.col("text"), LATIN)).alias("word"))


# ---- a vocabulary in another script: the documents' words, letter by letter, accents left out ---------------------------------

LETTERS, SIGNS = "abcdefghijklmnopqrstuvwxyz", "ਾਬਚਦੇਫਗਹਿਜਕਲਮਨੋਪਖਰਸਤੁਵੰਣੀ਼"
#: Composed letters that decompose to one of LETTERS, as Unicode has it.
COMPOSED = {chr(i): base for i in range(0x80, 0x250) if (base := unicodedata.normalize("NFD", chr(i).lower())[0]) in LETTERS and chr(i) == chr(i).lower()}
_BARE = f"regexp_replace(translate(lower(word), '{''.join(COMPOSED)}', '{''.join(COMPOSED.values())}'), '[^a-z]', ''"
VOCABULARY_SQL = f"""{CORPUS_SQL.strip()},
    vocabulary AS (SELECT translate({_BARE}, 'g'), '{LETTERS}', '{SIGNS}') AS gurmukhi, CAST(count(*) AS INTEGER) AS frequency FROM occ WHERE {_BARE}, 'g') <> '' GROUP BY 1)
"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gurmukhi, frequency."""
    counted = corpus_tokens(spark, sf_dir).groupBy("word").agg(F.count(F.lit(1)).alias("n"))  # a row a word from here on
    spelt = counted.select(F.translate(F.expr(f"{_BARE})"), LETTERS, SIGNS).alias("gurmukhi"), "n").filter("gurmukhi <> ''")
    return spelt.groupBy("gurmukhi").agg(F.sum("n").cast("int").alias("frequency"))
