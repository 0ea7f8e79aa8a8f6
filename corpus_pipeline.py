"""The corpus pipeline: toxicity, line dedup, near dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns of
``documents``; each result is written as Parquet and read again as the next stage's input. Null ids and texts, repeated rows and
empty tables pass through every stage by its operator's rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quartzite.llm import decontamination, line_dedup, near_dedup, packing, queries, toxicity
from quartzite.llm.common import settled, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go; null and empty texts, like all others, by their score. Repeated rows go or stay together."""
    return toxicity.drop_toxic(docs, queries.toxicity_model(docs, table(spark, sf_dir, "labels")))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more stay in their first document only; n_chars follows the text. Every row stays, a null text stays null."""
    kept = line_dedup.drop_lines(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (0.8 or more over 5-word shingles) one row stays, of smallest id. Null and blank texts are one group."""
    return near_dedup.drop_near(docs)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with a passage of ``benchmark`` go; rows of the same id without one stay, as do null and empty texts."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1,024 tokens; a null or empty text is its end token, an empty table gives no pieces."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("decontamination", leaks), ("packing", packed)]

#: Toxicity and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's files go once the next one's are written."""

    def kept(k: int) -> DataFrame:
        if k == 0:
            return table(spark, sf_dir, "documents")
        name, stage = STAGES[k - 1]
        return settled(lambda: stage(spark, kept(k - 1), sf_dir), f"stage-{name}")

    return STAGES[-1][1](spark, kept(len(STAGES) - 1), sf_dir)
