"""The corpus pipeline: documents to token ids, in five stages that each take the rows that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from keyloom.llm import bpe, decontaminate, jaccard, langid, secrets
from keyloom.session import table, written

RANKS = "byte_bpe_multi_50k.tiktoken"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected."""
    return langid.keep_identified(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component of n-gram Jaccard links the document of the least id."""
    return jaccard.keep_one(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which an item of benchmark occurs."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [SECRET] for secrets in text; n_chars follows."""
    return secrets.redact(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, with the digests of the ids and of what they decode to."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", decontaminate_benchmark),
    ("secret scans", redact_secrets),
    ("byte-level BPE encoding and decoding", encode_tokens),
]

#: SQL can express neither the compression of the first stage nor the merges of the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again, so none runs twice."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
