"""Corpus pipeline: quality rules, quality classifier, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is stored as Parquet and read
again as the next one's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import cotraining, decontam, near_dedup, packing, quality_rules
from quillmill.llm.base import folders_of, give_back, made_so_far, remove, remove_since, shared_dir, table
from quillmill.llm.queries import vocabulary


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the last stage's result still reads.
_left: list[str] = []


def tidy(stage: Stage) -> Stage:
    """A stage's result is stored before the next stage is called, so what its operator stored on the way is then
    removed, unless `docs` reads it, and memory that the driver freed is given back."""

    @wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        read = folders_of(docs)
        for folder in [x for x in _left if x not in read]:
            remove(spark, folder)
            _left.remove(folder)
        give_back(spark)
        before = made_so_far()
        out = stage(spark, docs, sf_dir)
        _left.extend(set(made_so_far()) - set(before))
        return out

    return call


@tidy
def pass_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the learned decision list or its base rule rejects."""
    rules = quality_rules.learn_rules(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge_quality(docs, rules, carry=True).where("kept").select("row.*")


@tidy
def pass_quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the co-trained classifier rejects."""
    return cotraining.classify(docs, table(spark, sf_dir, "labels"), carry=True).where("kept").select("row.*")


@tidy
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each group: shingles of five words, similarity 0.8. Of rows that
    repeat this document one is kept; rows with a null id or without words are in no group and all kept."""
    return near_dedup.near_duplicates(docs, width=5, percent=80, carry=True).where("kept").select("row.*")


@tidy
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage or a paraphrase of one."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True).where("kept").select("row.*")


@tidy
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left. Workers keep few words here, as they hold what the other stages need as well."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), words_kept=60_000)


STAGES = [
    ("quality rules", pass_quality_rules),
    ("quality classifier", pass_quality_classifier),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("best-fit packing", pack_sequences),
]

#: Learned rules, classifiers and tokenizers can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. What stages store, and each stage's result once the next one has been stored, is removed."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/quillmill-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        before = made_so_far()
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        remove_since(spark, before)
        if k:
            remove(spark, f"{folder}/{k - 1}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
