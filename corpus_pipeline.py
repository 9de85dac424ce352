"""The corpus pipeline: five stages over ``documents``, each one of the operators of tessera.llm.

A stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame; its
result is written as Parquet and read again as the next one's docs. All but the last return the columns of
``documents``. All take extra columns, whatever their names, and empty tables; long texts are handled whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, line_chunks, minhash, packing, toxicity
from tessera.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.7. Labels of held-out documents aren't learned from. Null and empty texts
    are scored like others; rows with a null id are never learned from; repeated rows stay or go together."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels").where(~toxicity.held_out("doc_id")))


def drop_repeated_chunks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts less their repeated passages of whole lines; n_chars follows. Documents of which nothing is left go; those
    whose text was null or empty stay as they are. Of ties the least id keeps the passage, and rows without one rank last."""
    return line_chunks.without_repeated_chunks(docs, chars_col="n_chars", pairs=True)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of each component of near duplicates. Rows without an id, words or text
    stay; repeated rows stay or go together."""
    return minhash.without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts hold none; null items are in none."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens; a null or empty text is the end id alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, special=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_chunks),
    ("near-duplicate removal", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The learned and the tokenizing stages have no SQL; tests hold the chain, stage by stage, against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name.replace(" ", "-"))
    return docs
