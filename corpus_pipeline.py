"""The corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing, token files, each on what the one before kept."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession

from glossalith.llm.common import Workspace, bucket_of, scratch, table
from glossalith.llm.decontaminate import decontaminate
from glossalith.llm.mixing import mixed_rows
from glossalith.llm.odd_sketch import near_dedup_keep
from glossalith.llm.queries import END_ID, tokenizer_path
from glossalith.llm.token_output import encode_documents, ids_crc32, read_tokens, write_tokens
from glossalith.llm.toxicity import score_column, train


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5."""
    scorer = train(docs, table(spark, sf_dir, "labels"), lambda i: bucket_of(i, 5) != 0)
    return docs.filter(score_column(scorer, spark) < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share 80 % of their five-word shingles."""
    return near_dedup_keep(docs, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def write_token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files' rows, read back: doc_id, start, n_tokens, ids_crc32."""
    path = Workspace(spark, "pipeline-tokens").path("ids")
    write_tokens(encode_documents(docs, tokenizer_path(), END_ID), path)
    return ids_crc32(read_tokens(spark, path)).select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [("toxicity", reject_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix_sources), ("token_output", write_token_files)]

#: Learned scores, sketches and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents; each stage's rows are written to the shared folder and read again. What the stages
    wrote on the way goes once their rows are written; the last stage's token files stay."""
    ws = Workspace(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        with scratch() if k < len(STAGES) - 1 else nullcontext():
            docs = ws.save(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            ws.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
