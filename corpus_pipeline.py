"""Training-corpus pipeline: quality filter, near-duplicate removal, decontamination, sanitisation, tokenisation.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`.  Every stage takes null, empty and very long texts, null and repeated ids, repeated rows and tables
without rows; further columns of `docs` are left out, so that none can clash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm.common import drop_table, write_table
from glyphmill.llm.decontaminate import drop_contaminated
from glyphmill.llm.jaccard_join import jaccard_components
from glyphmill.llm.pii import sanitise
from glyphmill.llm.piece_dropout import encode_pieces
from glyphmill.llm.quality_classifier import keep_quality
from glyphmill.llm.queries import piece_model

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; without labels all stay."""
    return keep_quality(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: five-word shingles, similarity of 0.8 or more, the smallest id stays.

    Rows with the kept id all stay; documents without words link with nothing and stay.
    """
    found = jaccard_components(docs, size=5, num=80, den=100)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    return drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and disclosing terms generalised; null texts stay null, `n_chars` is counted anew."""
    clean = sanitise(docs.select(*COLUMNS))
    out = clean.withColumn("n_chars", F.length("text").cast("long"))
    out._glyphmill_under = clean._glyphmill_under
    return out


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with merge dropout, one row per document; null and empty texts have none."""
    return encode_pieces(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("tokens", tokens),
]

#: The classifier and the tokeniser have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            written = write_table(made)
            drop_table(made, docs)  # the tables that the stage wrote, and its input
            made = written
        docs = made
    return docs
