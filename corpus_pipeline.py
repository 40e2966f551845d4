"""A training corpus from `documents`: five stages, each on all that the one before it kept.

Defined results: an empty table stays empty through every stage; extra columns
are kept up to the last stage; a row with a null or empty text goes in the
first stage, as it has no letter; repeated rows get equal decisions until the
near-duplicate stage, which keeps one of them; of a group of near copies the
row of the least doc_id stays; very long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollmeter.llm import bpe, decontam, langid, nearjoin, toxicity
from rollmeter.llm.frames import crc_mod, table, written

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a language the model knows; those without a letter go.  A text of several languages stays."""
    model = langid.train(docs, crc_mod(F.col("doc_id"), 4) != 2)
    seen = langid.predict(docs, model)
    return seen.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts scored below one half."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One text of each group of near copies."""
    return nearjoin.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    return decontam.without(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [("language_id", language), ("toxicity", harmless), ("near_duplicates", distinct_texts), ("decontamination", uncontaminated), ("byte_bpe", encoded)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: No stage has a SQL form; tests hold each against brute force or held-out labels.
ORACLE_SQL = None
