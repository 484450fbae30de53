"""The corpus pipeline: five stages over documents, each written and read again before the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import release, stored, table
from lodestone.llm.decontaminate import without_leaks
from lodestone.llm.mixing import mix_documents
from lodestone.llm.simhash import keep_one
from lodestone.llm.tokens_out import op6_token_output
from lodestone.llm.toxicity import without_toxic

STAGES = [
    ("toxicity", lambda spark, docs, sf_dir: without_toxic(docs, table(spark, sf_dir, "labels"))),
    ("SimHash near-dedup", lambda spark, docs, sf_dir: keep_one(docs)),
    ("benchmark decontamination", lambda spark, docs, sf_dir: without_leaks(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing sources to target weights", lambda spark, docs, sf_dir: mix_documents(docs)),
    ("token-ID / binary output", lambda spark, docs, sf_dir: op6_token_output(docs)),
]

#: Training, hashing and tokenizing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        done = stored(stage(spark, docs, sf_dir), "pipeline")
        release(docs)  # the stage's input, which nothing reads again; the given table stays
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
