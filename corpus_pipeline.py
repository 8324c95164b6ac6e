"""From raw documents to token ids: five stages, each written as a table and read again by the next.

A stage takes (spark, docs, sf_dir) and returns rows with the columns of documents (doc_id, text, lang, source,
n_chars); the last one returns the digests of the token ids. Rows with null or empty texts pass all stages as they
are (an empty text is neither toxic, nor boilerplate, nor a copy, nor contaminated); extra columns of documents stay
until the last stage; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm import bpe, fm_index, line_spread, ngram_join, toxicity
from lettermill.llm.vocabulary import vocabulary_path
from lettermill.llm.work import kept, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model, trained on labels, scores as toxic go."""
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on many sites, all near copies counted as one, leave the texts, and passages that repeat all but the first; every document stays."""
    cleaned = line_spread.without_repeated_lines(docs, over_classes=True, counts=None)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else cleaned


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts that Jaccard links join, the document of the least id stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one word in twenty or more lies in a benchmark phrase go."""
    return fm_index.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.digests(docs, bpe.Ranks(spark, vocabulary_path(bpe.VOCABULARY)))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_level_bpe", token_ids),
]

#: SQL can't express the learned stage or the merges; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
