"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept.  All
but the last return the columns of documents:

* quality_rules drops what fails the base rules or the likelihood-ratio verdict; the trusted documents are those labelled of
  good quality and not toxic.
* near_duplicates keeps one row of each group linked by a Jaccard similarity of 5-word shingles of 0.8 or more: SimHash
  fingerprints compared in tiles find the pairs, and the sets of shingles are then compared exactly. The row of
  the smallest id stays; a row without an id stays only if its group has none.
* substring_dedup cuts passages of 20 words and more that also start earlier. Texts that lose a word are joined anew by single
  spaces and n_chars follows; a text that loses all its words goes.
* source_mixing repeats each document as often as the mix takes it, not at all up to three times.
* bpe_encoding adds n_tokens, ids (little-endian unsigned 32-bit integers) and decoded.

Every stage takes null and empty texts, null, equal and repeated ids, very long texts and empty tables; what each makes of them is
said beside it.  Ids must be whole numbers.  Near duplicates, substring dedup and encoding are no matter for SQL, so there is no
ORACLE_SQL; tests/llm holds the pipeline against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import mixing, quality, similar, substring, word_bpe
from lumenframe.llm.common import Scratch, read

ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass. Null and empty texts fail; rows of one id are judged each by its own text; without labels only the base rules hold."""
    return quality.good_documents(docs, quality.trusted_labels(read(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group: the smallest id, nulls last, then the smallest text hash; of equal rows one. Texts without words are one group."""
    return similar.first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages. Rows without an id come first, so their passages stay; null and short texts stay as they are."""
    return substring.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document up to three times. A null source is one of its own; equal ids of equal size are taken alike; empty texts weigh nothing."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its ids and their text; a null text has none and decodes to an empty one."""
    out = word_bpe.encoded_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("n_tokens", (F.octet_length("ids") / 4).cast("long"))


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("substring_dedup", substring_dedup), ("source_mixing", source_mixing), ("bpe_encoding", bpe_encoding)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written in the shared folder and read by the next."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
