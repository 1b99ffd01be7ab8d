"""A training corpus from the table ``documents``, in five stages.

Each stage gets what the one before kept, as a written and reread table; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthbook.llm import bpe, decontaminate, jaccard_join, langid, suffix_dedup
from hearthbook.llm.common import written

#: Repeated passages of this many bytes go, and of this many words: 51 short words may
#: have fewer bytes (1.2% of the English ones of sf0.1 by the review of the round).
REPEATED_BYTES = 256
REPEATED_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, and null texts, go: they have no language (``und``).
    Which other language the model predicts, and its score, decide nothing here.
    The model learns from the stage's own labelled rows that are not held out. A table
    without labelled rows has no languages to learn; then all with a letter stay."""
    model = langid.fit(docs.where(~langid.held_out(F.col("doc_id"))))
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    predicted = langid.predict(docs, model, keep=docs.columns)
    return predicted.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that share 0.8 or more of their five-word shingles, the one with the
    smallest doc_id stays."""
    return jaccard_join.keep_one(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out of the texts; a text of nothing else goes."""
    cut = suffix_dedup.cut_repeats(docs, least=REPEATED_BYTES, words=REPEATED_WORDS)
    cut = cut.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return cut.where(F.length("text") > 0)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of a benchmark item go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents with token ids, their number, and the decoded text."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep=docs.columns)
    decoded = bpe.decode_ids(encoded, path, public_tokenizers.PATTERN, keep=encoded.columns)
    return decoded.withColumn("decoded", F.decode("decoded", "UTF-8"))


STAGES = [
    ("language ID", language),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeats),
    ("benchmark decontamination", decontamination),
    ("byte-level BPE", tokens),
]

#: Suffix matching and learned models are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return docs
