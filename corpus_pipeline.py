"""From raw documents to packed training sequences, in five stages.

Each stage reads all rows that its predecessor kept. The first four return the
columns of ``documents``; the last returns the pieces of the sequences. Models
and SQL: the first stage fits on labelled rows, the third compares by
signatures, the last tokenizes, so no SQL gives the same rows (``ORACLE_SQL``
is None); the tests hold ``run`` against a plain version of all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossaria.llm import decontaminate, line_dedup, minhash, packing, toxicity
from glossaria.llm.common import table
from glossaria.llm.queries import fit_toxicity
from glossaria.sources.shared import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
REJECTED = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below ``REJECTED``."""
    return toxicity.score(docs, fit_toxicity(spark, sf_dir)).where(F.col("toxicity") < REJECTED).select(*COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines of their source."""
    cleaned = line_dedup.drop_boilerplate(docs)
    return cleaned.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each class of near-duplicates."""
    return minhash.representatives(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.search(docs, table(spark, sf_dir, "benchmark")).where(F.size("leaks") == 0).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens."""
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("tokens")).drop("tokens")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
