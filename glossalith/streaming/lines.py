"""New line files as a stream: tokens appended, counts kept up to date. Beyond the batch operators' parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.script import GURMUKHI, Script
from ..operators.corpus import occurrences
from ..sources.sinks import replace_table

LINES = "line_id bigint, source string, line string, at timestamp"


def line_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(LINES).parquet(path)


def windowed_counts(lines: DataFrame, window: str = "10 minutes", late: str = "1 hour", script: Script = GURMUKHI) -> DataFrame:
    """Occurrences by word, source and window; lines later than the watermark are left out."""
    words = occurrences(lines.withWatermark("at", late), ("source", "at"), script)
    return words.groupBy(F.window("at", window).alias("w"), "source", "word").agg(F.count(F.lit(1)).alias("frequency"))


def append_occurrences(lines: DataFrame, out: str, checkpoint: str, script: Script = GURMUKHI) -> StreamingQuery:
    """Writes occurrences of new files to out/occurrences and their counts to out/counts. A batch's rows go to folders of
    its own number, so a repeated batch changes nothing and a batch costs no more than its rows."""

    def apply(batch: DataFrame, number: int) -> None:
        occurrences(batch, ("line_id", "source"), script).write.mode("overwrite").parquet(f"{out}/occurrences/batch={number}")
        rows = batch.sparkSession.read.parquet(f"{out}/occurrences/batch={number}")
        rows.groupBy("word", "source").agg(F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(f"{out}/counts/batch={number}")

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def frequencies(spark: SparkSession, out: str) -> DataFrame:
    """(word, source, frequency) over all batches so far."""
    return spark.read.parquet(f"{out}/counts").groupBy("word", "source").agg(F.sum("n").alias("frequency"))


def compact(spark: SparkSession, out: str) -> None:
    """Joins the counts of all batches in the folder of the last one, while no stream runs. The stream goes on with the
    next number. The folder is swapped as a whole, so no reader sees a batch twice."""
    counts = spark.read.parquet(f"{out}/counts")
    last = counts.agg(F.max("batch")).first()[0]
    replace_table(counts.groupBy("word", "source").agg(F.sum("n").alias("n")).withColumn("batch", F.lit(last)), f"{out}/counts", ["batch"])
