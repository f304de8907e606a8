"""A training corpus from documents: rejection of toxic documents, one document of each group of
near duplicates, masking of personal data, mixing of sources to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept and returns the columns
of documents; the last returns pieces of sequences. run() writes every stage to the shared folder
and reads it back for the next. An empty table stays empty through every stage; columns that a
stage doesn't name are carried along, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeloom.llm import mixing, packing, parity, pii, toxicity
from gazeloom.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't predict to be toxic; it is fitted on labelled
    rows of docs. Null and empty texts, and rows without id, are scored like any other; repeated rows are
    kept or dropped each for itself."""
    return toxicity.reject(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the least id. Rows without words or without id stay; repeated rows are copies, of which
    one stays."""
    return parity.survivors(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars counts the new text. Null texts stay
    null, rows are neither dropped nor added."""
    return pii.mask(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; none where it takes none.
    Rows without words stay once; a null source is a source of its own; ties go by a hash of the
    row, so that reruns agree."""
    return mixing.repeat(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids. Null and empty texts are one end id each; copies are
    packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", one_of_each),
    ("personal data", mask_private),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL: the first, third and last stage can't be written in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
