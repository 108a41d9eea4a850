"""A training-data pipeline over ``documents``: quality, language, near-duplicates, mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelmill.llm import byte_cnn, mil_quality, near_sets, numpy_bpe, poisson_mix
from labelmill.llm.common import free_prefix, keep, table
from labelmill.llm.queries import MIX_SEED, tokenizer

#: A text whose language is less certain than this is rejected, as is one without letters.
LEAST_CERTAIN = 0.4


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier marks 1; it learns from all labels."""
    model = mil_quality.fit(docs, table(spark, sf_dir, "labels"))
    own = free_prefix(docs)
    scored = mil_quality.with_quality(docs, model, prefix=own)
    return scored.filter(F.col(own + "predicted") == 1).select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network has learned and is certain of; lang becomes the predicted one where it is null."""
    net = byte_cnn.fit(docs)
    own = free_prefix(docs)
    found = byte_cnn.with_language(docs, net, prefix=own)
    found = found.filter((F.col(own + "lang_pred") != "und") & (F.col(own + "score") >= LEAST_CERTAIN))
    return found.withColumn("lang", F.coalesce("lang", own + "lang_pred")).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group whose five-word shingles are alike by 0.8 or more."""
    return near_sets.one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order."""
    return poisson_mix.mix(docs, MIX_SEED, prefix=free_prefix(docs)).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the digests of the ids and of the decoded text."""
    rows = docs.select("doc_id", "lang", "source", "text")
    coded = numpy_bpe.with_encoding(rows, tokenizer("word_bpe_49k.json"), ids=True)
    return coded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned stages have no SQL; tests hold every stage against a plain version.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
