"""The corpus pipeline: language identification, line dedup, near-duplicate removal, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of ``documents``; ``run`` writes each stage's rows to the shared folder and reads them for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import language_id, line_dedup, mixing, near_dedup, packing
from evalspark.llm.common import stored, table

MIN_LINE_CHARS, MIN_LINE_DOCS = 20, 10


def with_text(columns: list[str], text, row: str = "row"):
    """The input columns with a new text and, where they have it, its length."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return [new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in columns]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (no letters, or less evidence than any learned language has); fills in a missing lang."""
    out = language_id.learn_and_reject(docs)
    return out.select(*[(F.coalesce(F.col("row.lang"), F.col("lang_pred")) if c == "lang" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that stand in 10 documents or more stay in the first of them only."""
    out = line_dedup.dedup_lines(docs, MIN_LINE_CHARS, MIN_LINE_DOCS, keep_first=True)
    kept = F.coalesce("out.changed", "row.text")
    left = out.filter((F.col("out.n_dropped") == 0) | (F.trim("out.changed") != ""))
    return left.select(*with_text(docs.columns, kept))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts linked by a Jaccard similarity of 0.8 or more over five-word shingles."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 2,048 tokens."""
    return packing.pack_documents(docs)


STAGES = [("language id", identify_language), ("line dedup", drop_common_lines), ("near dedup", drop_near_duplicates),
          ("mixing", mix_sources), ("packing", pack_sequences)]
ORACLE_SQL = None  # a trained model decides in the first stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
