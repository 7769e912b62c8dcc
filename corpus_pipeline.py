"""The corpus pipeline: language ID, line dedup, SimHash near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import langid, line_dedup, mixing, packing, simhash
from weftline.llm.common import materialise, read
from weftline.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null texts and texts without a letter.  The others keep their text and get the
    language found as their lang.  The model is learned from the documents that operator 6 may learn from."""
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs, model).where(F.col("lang_pred") != langid.UND)
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One line of each component of similar lines stays; documents keep their other lines, or an empty text."""
    found = line_dedup.dedup_lines(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates stays; empty texts are one component."""
    return simhash.one_of_each(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", language), ("line_dedup", lines), ("simhash", near), ("mixing", mix), ("packing", pack)]

#: SQL can't express the language model, the union-find nor the packing.  tests/llm check the operators one by one on small
#: fixtures, and of the stages together only columns, ids, gapless packing and counts of rows, not rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs
