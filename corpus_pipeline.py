"""A training-data pipeline over `documents`: quality rules, near copies, repeated passages, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet and reads
them again as the next one's docs. All stages but the last return the columns of documents.

Defined results, for every stage: an empty table gives an empty one; columns besides COLUMNS are left out, whatever their
names; rows with a null language or source are kept and mixed under the empty name. What a stage does with null ids,
null texts and repeated rows is said at the stage.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glimmer.llm import mixing, packing, quality, simhash, substrings
from glimmer.operators.graph import shared_folder

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: Target weights of the corpus; every document is taken once at most, and nearly all budget can be met.
MIX = replace(mixing.PRODUCTION, budget_permille=900, epochs=1)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy for a corpus rejects go; a null text or one without words is one of them, a short one isn't.
    Rows are judged each on their own, so that repeated rows and null ids are kept or go by their texts."""
    return quality.keep_good(docs.select(*COLUMNS), quality.CORPUS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by near fingerprints, directly or over others, the one of the smallest id stays. A document has
    nine fingerprints, by independent hashes of its five-word shingles; any may be near another's.

    Fingerprints within 4 bits don't find all texts of similarity 0.8; the README has the shares. A row without an id stays only where no linked row has one; of rows
    with one id and one text one stays; null texts are empty ones, all alike.
    """
    return simhash.drop_near_copies(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller id has too go from the text; a document of nothing else goes. A row without an
    id keeps its text and takes none from others, and so do rows of one id among themselves; a null text is an empty one."""
    done = substrings.drop_repeats(docs, keep=("lang", "source"), layout="text")
    left = done.where("n_removed < n_words OR n_words = 0")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the target weights take. Rows that share an id (or have none, in one source) are taken or left
    together; a text without words costs nothing and is taken."""
    return mixing.mix_sources(docs, MIX, keep=("text", "lang", "source", "n_chars")).select(*COLUMNS)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in training sequences. Repeated rows are packed each; a null id is kept; an
    empty text is the end token alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: SimHash and the tokenizer can't be expressed in DuckDB; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table. Each stage's table goes to the session's shared folder, and the one before it is
    removed; the last one stays, as the result reads it."""
    root = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
        if done:
            path = spark._jvm.org.apache.hadoop.fs.Path(done)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        done = f"{root}/{name}"
    return docs
