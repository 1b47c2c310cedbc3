"""A training corpus from ``documents`` in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before
kept, and is written as Parquet and read again as the next one's input. All
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline import configure
from faultline.llm import jaccard, lang_id, line_dedup, mixing, packing
from faultline.llm.common import private
from faultline.session import cut


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is not told: no letters, or the narrowest margins."""
    configure(spark)
    return lang_id.keep_identified(docs, lang_id.learn(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated chunks of lines out of texts; documents that lose every line go."""
    configure(spark)
    lines, removed = (f"{private(docs)}{n}" for n in ("lines_all", "lines_removed"))
    d = line_dedup.line_dedup(docs, counts=(lines, removed))
    d = d.where(f"{removed} = 0 or {removed} < {lines}").withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return d.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each near-duplicate class."""
    configure(spark)
    return jaccard.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents, up to three times each, so that sources near their target shares."""
    configure(spark)
    return mixing.mix_sources(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place documents in sequences; copies of one document never share one."""
    configure(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack_sequences),
]

ORACLE_SQL = None  # compression and best fit have no SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
