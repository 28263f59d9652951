"""A corpus from documents to packed sequences: language, toxicity, near duplicates, packing.

Defined cases: an empty table passes through every stage and gives no pieces; a document without text or letters
has no language and goes in the first stage; rows that repeat are judged alike by the first two stages, and one of
them stays in the third; rows without an id are told apart by their texts and other columns; other columns are kept
as they are, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcela.llm import common, langid, neardup, packing, toxicity


#: Of five-word shingles in common, in percent, from which on documents are near duplicates: the value for stages without a contract of their own.
SIMILAR_PERCENT = 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those without letters, without text or between two languages go."""
    common.small_batches(spark)
    model = langid.fit(docs)
    return common.filtered(docs, lambda d, *keep: langid.predict(d, model, *keep), "lang_pred <> 'und' and not ambiguous")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic, by a model of the labels."""
    common.small_batches(spark)
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels").withColumnRenamed("toxic", "grade"))
    return common.filtered(docs, lambda d, *keep: toxicity.score(d, model, *keep), "not toxic")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the least id; documents without words stay, and so do repeated rows of them."""
    common.small_batches(spark)
    return neardup.one_of_each(docs, SIMILAR_PERCENT)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("best_fit_packing", best_fit_packing)]

#: Learned models and BPE ids aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.cut(docs)
    return docs
