"""Documents to packed training sequences in five stages, each written as Parquet and read again by the next.

    run(spark, sf_dir)

Every stage works on all rows its predecessor kept. Null texts have no language and end with the first stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorframe.llm import jaccard, langid, mixing, packing, substrings
from anchorframe.llm.queries import WORD_BPE, WORD_END, mix_target
from anchorframe.llm.tokens import tokenizer_path
from anchorframe.session import shared_folder


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language the model rejects; it learns from the labelled documents themselves."""
    return langid.keep_known(docs, langid.train(docs, F.lit(True)))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies (five-word shingles, similarity 0.8) the document with the smallest id."""
    return jaccard.keep_first(docs, 80, 100, 5)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes 50-byte strings of earlier documents out of the texts; drops documents with nothing left."""
    return substrings.removed(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Four fifths of the tokens by the target weights of domains, languages and sources, each document once at most."""
    return mixing.mixed_documents(docs, **mix_target(), share=(4, 5))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 512 to 4096 ids."""
    return packing.pack(docs, tokenizer_path(WORD_BPE), WORD_END, keep=False)


STAGES = [("language_id", known_language), ("jaccard_join", one_of_each), ("suffix_dedup", without_repeats), ("mixing", mixed), ("packing", packed)]

# The first and second stage are a trained model and a join over shingle sets of whole texts. tests/llm/test_pipeline.py
# compares the rows of the second to the last stage with plain Python and SQL, and those of the first with the model's own predictions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents in ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline/{uuid.uuid4().hex}"
    for n, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{n}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
