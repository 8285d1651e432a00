"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and hands what it reads again to the next one. All stages but the last return the
columns of ``documents``.

Each stage takes nulls in any column, texts of any length and repeated rows. Rows without a text, or
with a blank one, are rejected by the first stage. Rows that repeat an id are documents of their own:
equal ones stay together through both deduplications and are mixed and packed as often as they stand
there; a null id is the largest one where copies are compared, and links with nothing where near copies
are. An empty table gives an empty result at every stage. Further columns go along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywheel.llm.common import documents, settled, width
from tallywheel.llm.exact_dedup import keep_first_copies
from tallywheel.llm.minmax_hash import drop_near_duplicates
from tallywheel.llm.mixing import mix_sources
from tallywheel.llm.packing import pack_documents
from tallywheel.llm.quality_rules import quality_rules


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that break a rule go, and so do documents that the rules reject."""
    found = quality_rules(docs).where("kept")
    renewed = {"text": F.col("clean_text"), "n_chars": F.length("clean_text").cast(docs.schema["n_chars"].dataType)}
    return found.select(*[renewed[c].alias(c) if c in renewed else F.col(c) for c in docs.columns])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return keep_first_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of similarity 0.8 or more hold together, one document stays."""
    return drop_near_duplicates(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least; small sources up to twice, so that the hot source weighs less."""
    return mix_sources(docs, width(spark), max_repeats=2.0)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 1024 tokens; a document that the mix repeats is packed as often."""
    return pack_documents(docs)


STAGES = [("quality_rules", clean), ("exact_dedup", drop_copies), ("minmax_near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Tokenising and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
