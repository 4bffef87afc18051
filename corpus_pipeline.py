"""The corpus pipeline: five stages over documents, each written and read again before the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame. All but the last return the columns of
documents; the last returns the index of the token file that it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthframe.llm import decontam, language, mixing, simhash, tokens
from hearthframe.llm.common import fresh, table
from hearthframe.staging import drop_stage, stage, tidy


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too); a null lang becomes the predicted one, if any was learned.

    The profiles are learned from the labelled documents, a bounded number of distinct texts of each
    language. Long texts are counted whole; ties go to the first language by name; repeated rows and null
    doc_ids stay; columns of any name are handed on as they are; without any label nothing is learned, and lang
    stays null; an empty table gives an empty one.
    """
    columns = docs.columns
    pred, score = fresh("lang_pred", columns), fresh("score", columns)
    found = language.identify(docs, language.learn(docs), pred, score).where(language.has_letter(F.col("text")))
    return found.withColumn("lang", F.coalesce("lang", F.nullif(F.col(pred), F.lit(language.NONE)))).select(*columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of each group that 5-word Jaccard links of 0.8 or more connect.

    Null doc_ids come last, and rows alike in doc_id are ordered by a hash of their words; of repeated rows
    one stays, of different texts of one doc_id all that are not linked. Texts without a word are one
    group. Long texts are compared whole; columns of any name are handed on; an empty table gives an empty one.
    """
    return simhash.one_of_similar(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item.

    Null and empty texts and items match nothing; repeated rows and null doc_ids stay or go alike; long
    texts are compared whole; columns of any name are handed on; an empty table gives an empty one.
    """
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws each source to its target; a document drawn twice is there twice.

    A null source is a source, a null or empty text has no words, and rows of one doc_id in one source are
    drawn together. Ties in the permuted order go by block and doc_id. A long text is a document like any
    other; columns of any name are handed on; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def write_token_file(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns its index: doc_id, start, n_tokens, ids_crc32.

    A null text is empty and has the end id only; null doc_ids come first; rows of one doc_id follow each
    other in any order; long texts are encoded whole; other columns are left out; an empty table gives an
    empty one.
    """
    return tokens.encoded(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("simhash_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("source_mix", mix_sources),
    ("token_file", write_token_file),
]

#: SQL cannot express SimHash, tiling or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


@tidy
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of the token file. All stages run when this is called; each one's table goes as soon as the next one
    is written, and only the token file that the result reads stays."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES[:-1]):
        after = stage(step(spark, docs, sf_dir), name)
        if k:
            drop_stage(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
