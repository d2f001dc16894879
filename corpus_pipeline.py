"""A training-corpus pipeline: each stage calls one operator on all rows that the stage before kept.

Toxic documents go, one document of each group of near-duplicates stays, secrets are masked, sources are mixed to
their target weights, and the mix is packed into windows of token ids.

Null and empty texts are documents without words: they stay (one of them, after near-duplicates), take no part in the mix,
and so aren't packed. A null id is an id, a null source a source. Rows that share id and text become one row. Columns
besides doc_id, text, source and n_chars pass through, whatever their names. An empty table stays empty in all stages.
A stage's result must be written before the next stage runs: that one removes the tables the former worked with.
Stages pass whole texts to Python 1,000 rows at a time; since their results are written later, the session keeps that setting.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablescribe.llm import mixing, packing, secret_scan, simhash, toxicity
from tablescribe.llm.common import BATCH_ROWS, drop_tables, tables_of, written
from tablescribe.llm.queries import TOKENIZER


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models, fitted on the labels, don't reject."""
    return toxicity.not_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the smallest id."""
    return simhash.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: whole documents, parts and repeats, as the quotas of their sources have it."""
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in windows of 2,048 token ids."""
    return packing.pack(docs, TOKENIZER, end_id=1, window=2048)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _after(earlier: str | None, name: str, stage: Stage) -> tuple[str, Stage]:
    """The stage under its name; it starts by removing the working tables of the earlier one."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if earlier:
            drop_tables(spark, earlier)
        spark.conf.set(BATCH_ROWS, 1000)
        with tables_of(name):
            return stage(spark, docs, sf_dir)

    return name, run_stage


STAGES: list[tuple[str, Stage]] = [
    _after(None, "toxicity", drop_toxic),
    _after("toxicity", "simhash_near_duplicates", drop_near_duplicates),
    _after("simhash_near_duplicates", "secret_scan", mask_secrets),
    _after("secret_scan", "source_mixing", mix_sources),
    _after("source_mixing", "packing", pack_windows),
]

#: No stage but the mixing can be said in SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn over documents, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
