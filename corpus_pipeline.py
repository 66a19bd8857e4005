"""A training corpus from raw documents: toxic ones go, one of each group of near copies (five-word shingles, Jaccard similarity
0.8 or more, linked through others too) stays, what holds benchmark passages goes, the rest is sampled to target weights
and packed as token ids.

Each stage takes (spark, docs, sf_dir) and all its predecessor kept, and returns the columns of ``documents`` but for the
last, which returns a row per document with its place in the packed files. SQL can express neither the compression
distance nor the groups of copies, so there is no ORACLE_SQL; tests/llm/test_defined_cases.py holds every stage and run() against plain Python rules.

Defined cases, in every stage: a null text counts as empty; a null doc_id keeps its row (it stands for its group only if no other does, and is hashed like
an empty one when sampling); of rows that repeat a doc_id each goes or stays by its own text; of rows equal in doc_id and text one stays; null lang and
source are values of their own; further columns of the documents table are left out whatever their names; empty tables give no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from remarq.llm import decontaminate, mixing, near_copies, packed_ids, toxicity
from remarq.storage import stored

#: The sample's expected tokens as a share of those that reach the mixing stage; languages are drawn towards each other, sources and topics likewise.
MIX = mixing.Targets(source=0.7, lang={"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.15}, topic=0.8, budget=0.8)
END_ID = 2
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, _table(spark, sf_dir, "labels"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs, MIX)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_ids.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash_near_dedup", without_copies),
    ("decontamination", without_benchmark),
    ("mixing", mixed),
    ("packed_ids", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage keeps is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
