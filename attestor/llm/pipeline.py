"""A training corpus from the documents table: toxicity, near duplicates, personal data, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table, written
from . import mixing, near_copies, packing, pii, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; labels are those of the held-in folds. Null and empty texts score like a text
    without any feature; very long ones are read whole; equal texts, also with null or repeated ids, get equal verdicts.
    Without labels nothing goes; an empty table gives no rows; all columns pass through."""
    return toxicity.kept(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (sets of five-word shingles with a similarity of 0.8 or more): the one
    with the least id, null ids last, or else with the least digest of its text. Texts without words, null ones too, are
    one group. Rows that share an id but not the text are judged each by its text; of rows that share both any one stays.
    An empty table gives no rows; all columns pass through."""
    return near_copies.deduplicated(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; personal data give way to the tags of their kinds, and n_chars, where there is one, follows the text.
    Null and empty texts stay as they are, very long ones are read whole, repeated rows are redacted alike; an empty table
    gives no rows; all columns pass through."""
    out = pii.redact(docs)
    if "n_chars" in docs.columns:
        length = F.length(F.coalesce(F.col("text"), F.lit(""))).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", length)
    return out.select([F.col(f"`{c}`") for c in docs.columns])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them, whole. Null and empty texts have no words and cost nothing; a null
    source is one of its own; ties of keys go by id and text, so reruns agree; copies of one document share what it takes.
    An empty table gives no rows; all columns pass through."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op4_packing returns them. Null and empty texts have their closing id only; very long
    ones fill several sequences; repeated rows and null ids are each packed; an empty table gives no rows; other columns
    than id and text are not read."""
    return packing.report(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("packing", pack),
]

#: Trained models, fingerprints and tokenizers have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage before it is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
