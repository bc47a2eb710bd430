"""A corpus pipeline: five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, mixing, toxicity
from lodestream.llm.exact_dedup import exact_dedup
from lodestream.llm.labelled import fold
from lodestream.llm.ngram_join import jaccard_components
from lodestream.llm.queries import MAX_EPOCHS, SCHEDULES, TOKENIZER
from lodestream.llm.scratch import delete, mark, save, since, spent

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def hidden(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """docs with its further columns under names that no operator uses, and the columns as they were."""
    names = [c if c in ("doc_id", "text", "source") else f"_p{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(new).alias(old) for new, old in zip(names, docs.columns, strict=True)]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3, each as often as it came.

    Null and empty texts score as texts without hits and stay; equal texts fare
    alike. Labels with a null teach nothing; without labels every document stays.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, fold(F.col("_key"), 4) != 2)
    rows, columns = hidden(docs)
    return toxicity.score(rows, model, 0.3).where("predicted = 0").select(columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, white space aside: the one with the least id.

    Null and empty texts are one text. Of rows with the same id any one stays;
    an id of null comes last.
    """
    rows, columns = hidden(docs)
    return exact_dedup(rows).where("kept").select(columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is linked by five-word shingles at 0.8 or more: the one with the least id.

    A row is known by its id and a hash of its text, so rows without an id are
    told apart too; an id of null comes first. Rows that are alike in both stay
    or go together: the stage before leaves one of them. Documents without words
    are linked with nothing and stay.
    """
    rows, columns = hidden(docs)
    known = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    found = jaccard_components(known, words=5, num=4, den=5, key="key", carry=False)
    gone = found.where("key <> component_id").select(F.col("key.doc_id").alias("_id"), F.col("key.h").alias("_h")).distinct()
    # always by a sort-merge join: both sides grow with the corpus
    return rows.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti").select(columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time, in training order.

    Documents without words are never taken; a null source is one source.
    """
    rows, columns = hidden(docs)
    return mixing.emit(mixing.mix(rows, SCHEDULES, MAX_EPOCHS)).select(columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with n_tokens, ids and the decoded text; null is as empty.

    Columns of these names are replaced.
    """
    return bpe.encode_decode(docs, public_tokenizers.path(TOKENIZER))


#: Tables that the last stage of this thread of control worked with.
_spent: ContextVar[tuple[str, ...]] = ContextVar("pipeline_spent", default=())


def tidy(stage: Stage) -> Stage:
    """A stage that first deletes what the stage before it worked with.

    A stage's result is written before the next one begins, so the tables that
    it was made from are no longer needed. Runs in other threads have their own;
    in one thread a stage's result is written before another stage is called.
    """

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, list(_spent.get()))
        point = mark()
        out = stage(spark, docs, sf_dir)
        _spent.set(tuple(since(point)))
        return out

    return run_stage


STAGES = [(name, tidy(stage)) for name, stage in (("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("source_mixing", mix_sources), ("bpe", tokenize))]

#: Learned scores and hashed orders are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over the table documents.

    Without documents the result is empty; other columns of theirs are kept.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
        if last is not None:
            spent(last)
        last = docs
    return docs
