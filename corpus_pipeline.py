"""The corpus pipeline: documents become clean, deduplicated, packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the
next stage's `docs`. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnish.llm.decontaminate import decontaminate
from tarnish.llm.line_dedup import drop_repeated_lines
from tarnish.llm.packing import pack, special_tokens
from tarnish.llm.simhash import drop_near_copies
from tarnish.llm.text import documents
from tarnish.llm.toxicity import fit_toxicity
from tarnish.session import staging_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    model, _ = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.keep_clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in one document only; `n_chars` follows the text."""
    kept = drop_repeated_lines(docs, with_text=False)
    changed = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.withColumns(changed).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays.

    SimHash fingerprints of at most two different bits link texts, as in operator 8; an exact check adds the
    links of texts whose five-word shingles have a similarity of 0.8 or more.
    """
    return drop_near_copies(docs, similarity=0.8, width=5, max_bits=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too much of the benchmark go; all others stay as they are."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.filter("not contaminated").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    special = special_tokens(public_tokenizers.path("byte_bpe_50k.json"))
    return pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, special=special)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# Scores, fingerprints and tokens are beyond SQL; the tests compare with plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = os.path.join(staging_dir(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
