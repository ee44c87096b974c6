"""Shared pieces: table reads, folds, and byte-level word handling for Arrow workers."""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import Workspace, scratch, shared_dir  # noqa: F401

#: Word pattern of the contracts: runs of bytes other than ASCII white space. bytes.split() cuts at exactly these.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the folds of the contracts."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)


def utf8(col: str | Column) -> Column:
    """The column as bytes; null counts as empty."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(col, F.lit("")).cast("binary")


class WordCache(dict):
    """Values by word, computed once each; emptied when full, so its memory is bounded on any input."""

    def __init__(self, make, limit: int = 300_000) -> None:
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.make(word)
        return value


def ascii_words(text: bytes) -> list[bytes]:
    """Words with A-Z lower-cased (bytes.lower changes no other letter)."""
    return text.lower().split()


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else (e := math.exp(x)) / (1 + e)


def rename_free(columns: Iterable[str], wanted: str) -> str:
    """A column name that no input column has."""
    columns = {c.lower() for c in columns}
    while wanted.lower() in columns:
        wanted += "_"
    return wanted
