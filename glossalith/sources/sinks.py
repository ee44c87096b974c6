"""Tables on Parquet: upserts, scoped replaces, teardown. Every write goes beside the table and is swapped in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def replace_table(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes df beside the table, then swaps the two by renaming; df may read the table itself. The old table is removed
    last: a crash in between leaves it, or both, under names that begin like the table's."""
    spark = df.sparkSession
    beside, aside = (f"{path.rstrip('/')}.{uuid.uuid4().hex[:8]}.{kind}" for kind in ("new", "old"))
    df.write.partitionBy(*(by or [])).parquet(beside)
    fs, target = _fs(spark, path)
    _, old = _fs(spark, aside)
    if had := fs.exists(target):
        fs.rename(target, old)
    if not fs.rename(_fs(spark, beside)[1], target):
        raise OSError(f"{beside} could not be renamed to {path}")
    if had:
        fs.delete(old, True)


def batches(rows: DataFrame, key: str, size: int) -> DataFrame:
    """Rows with the number, from 0, of their batch of `size` keys each, in order of the key: for targets that take so
    many at a time. Parquet needs none."""
    from ..operators.corpus import word_dimension

    if size <= 0:
        raise ValueError("a batch holds at least one row")
    numbered = word_dimension(rows.select(key), key)
    return rows.join(numbered.select(key, F.floor((F.col("word_id") - 1) / size).alias("batch")), key)


def merge_rows(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win over old ones of the same keys; old rows without a new one stay."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose keys the old table lacks."""
    return new.join(old.select(*keys), keys, "left_anti")


def upsert(new: DataFrame, path: str, keys: list[str]) -> None:
    """Merge into the table at path, made if missing."""
    spark = new.sparkSession
    replace_table(merge_rows(spark.read.parquet(path), new, keys) if exists(spark, path) else new, path)


def append_absent(new: DataFrame, path: str, keys: list[str]) -> None:
    """Insert-if-absent into the table at path."""
    spark = new.sparkSession
    (insert_absent(spark.read.parquet(path), new, keys) if exists(spark, path) else new).write.mode("append").parquet(path)


def scoped_rows(old: DataFrame, new: DataFrame, scope: dict[str, object]) -> DataFrame:
    """The old table without the rows of the scope (column: value), plus the new rows."""
    inside = F.lit(True)
    for column, value in scope.items():
        inside = inside & F.col(column).eqNullSafe(F.lit(value))
    return old.filter(~inside).unionByName(new, allowMissingColumns=True)


def scoped_replace(new: DataFrame, path: str, scope: dict[str, object]) -> None:
    """Idempotent delete and insert: run twice, the table is the same."""
    spark = new.sparkSession
    replace_table(scoped_rows(spark.read.parquet(path), new, scope) if exists(spark, path) else new, path)


def replace_partitions(new: DataFrame, path: str, by: list[str]) -> None:
    """As scoped_replace for a table partitioned by the scope's columns: only the partitions of new are rewritten."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def changed_rows(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """New rows whose value differs from the old one, nulls compared as values."""
    before = old.select(key, F.col(column).alias("old__"))
    return new.join(before, key).filter(~F.col(column).eqNullSafe(F.col("old__"))).drop("old__")


def teardown_counts(tables: dict[str, DataFrame], column: str, value: object) -> DataFrame:
    """Dry run of removing a source: table_name, n rows that would go."""
    out = None
    for name, df in tables.items():
        row = df.filter(F.col(column) == value).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def teardown(spark: SparkSession, paths: dict[str, str], column: str, value: object, keep: tuple[str, ...] = ("words",)) -> None:
    """Removes a source's rows from the tables; those of `keep` are only counted."""
    for name, path in paths.items():
        if name not in keep:
            replace_table(spark.read.parquet(path).filter(~F.col(column).eqNullSafe(F.lit(value))), path)
