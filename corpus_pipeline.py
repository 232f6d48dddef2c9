"""Documents to training sequences. Each stage takes (spark, docs, sf_dir); its result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecspark.llm import common, decontaminate, line_dedup, packing, simhash, toxicity


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar finds toxic go."""
    return toxicity.reject(docs, toxicity.train(docs, common.read(spark, sf_dir, "labels")))


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that match an earlier line, word by word, go; every document stays."""
    return line_dedup.cleaned(docs, shingle=1)


def _simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays."""
    return simhash.deduplicate(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark go; every document stays."""
    return decontaminate.decontaminate(docs, common.read(spark, sf_dir, "benchmark"))


def _packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in the training sequences."""
    return packing.packed(docs)


STAGES = [("toxicity", _toxicity), ("line dedup", _line_dedup), ("simhash near-dedup", _simhash), ("benchmark decontamination", _decontaminate), ("best-fit packing", _packing)]
#: Learned weights, XXH64 fingerprints and tokenizer ids can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; what one returns is written to the shared folder and read again as the next one's documents."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.table(spark, docs, name.replace(" ", "-"))
    return docs
