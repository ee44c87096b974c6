"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: What makes two texts equal: SHA-256, length in bytes and a second, unrelated hash. The last two verify the first.
KEY = ["text_sha256", "n_bytes", "check_hash"]
#: What a run is ordered by: blocks are ranges of digests, by their first three digits.
ORDER = ["run", "block", *KEY]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", normalise=None, fan_in: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Each input partition becomes a run: its distinct digests in order, each with its count and its best identifier, cut
    in blocks by range of digests. In round r, runs that agree in number // fan_in**r (two for fan_in=2: partners in a
    binomial tree) send each other their blocks; a task that has the same block of each merges them in order (the
    exchange, sort and sorted aggregation of _merged), joins equal keys - digest, length and second hash, so that every
    level verifies anew - and keeps the best identifier and the count. ceil(log_fan_in(runs)) rounds leave one run, every
    level of which is written, in order, to the shared folder; texts are read once. As a run holds a key once, no key has
    more rows in a merge than fan_in: a group with a third of all rows is never gathered. The winners return to the rows
    by (key, run), which no hot group dominates either.

    keep: "min" or "max" identifier stays. normalise: a function Column -> Column applied to the text first.
    Null text counts as empty. Rows that repeat an id as well as a text are told apart by their place, so exactly one
    row of a group is kept. A null id sorts below every other id for "max" and is kept only alone for "min".
    Very long texts are digested whole. An empty table gives an empty result. Other columns are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    spark, ws = docs.sparkSession, Workspace(docs.sparkSession, "exact-dedup")
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    rows = docs.select(
        F.col(id_col).alias("id"), F.sha2(text.cast("binary"), 256).alias("text_sha256"), F.octet_length(text).cast("long").alias("n_bytes"), F.xxhash64(text).alias("check_hash"), F.spark_partition_id().alias("run"), F.monotonically_increasing_id().alias("place")
    )
    runs = ws.save(rows, "rows")
    best = F.min if keep == "min" else F.max
    rank = F.struct((F.col("id").isNull() if keep == "min" else F.col("id").isNotNull()).alias("nulls"), "id", "place")
    local = ws.save(runs.groupBy("run", F.left("text_sha256", F.lit(3)).alias("block"), *KEY).agg(F.count(F.lit(1)).alias("n"), best(rank).alias("best")).sortWithinPartitions(*ORDER), "runs")
    merged, n_runs, level = local, (runs.agg(F.max("run")).first()[0] or 0) + 1, 0
    while n_runs > 1:
        n_runs, level = -(-n_runs // fan_in), level + 1
        merged = ws.save(_merged(merged, fan_in, best), f"level{level}")
        if level > 1:
            ws.drop(f"level{level - 1}")
    groups = merged.filter("n > 1").select(*KEY, F.col("n").alias("group_n"), F.col("best").alias("group_best"))
    by_run = local.select(*KEY, "run").join(groups, KEY)
    ids = runs.join(by_run, [*KEY, "run"], "left")
    return ids.select(
        F.col("id").alias(id_col),
        F.when(F.col("group_n").isNull(), F.col("id")).otherwise(F.col("group_best.id")).alias("keep_id"),
        F.coalesce("group_n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("place") == F.col("group_best.place"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def _merged(runs: DataFrame, fan_in: int, best) -> DataFrame:
    """One round: the runs of a family exchange their blocks, which are merged in order; equal keys become one."""
    met = runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")).repartition("run", "block").sortWithinPartitions(*ORDER)
    return met.groupBy(*ORDER).agg(F.sum("n").alias("n"), best("best").alias("best"))
