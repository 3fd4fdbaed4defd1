"""FE-10: the EDA report as a DataFrame of text lines (AG-08 .. AG-11 in one job)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airwise.operators import aggregates as AG


def full_report(merged: DataFrame, numeric: list[str], outcome: str = "rescueUsed", score: str = "symptomScore") -> DataFrame:
    """(section, rank, line): row count, value counts of the outcome, a describe of the score, null counts per
    column with nulls, and correlations with the score by falling size.  Section and rank are the order."""
    none = F.lit("")

    def part(df: DataFrame, section: int, rank, line) -> DataFrame:
        return df.select(F.lit(section).alias("section"), rank.cast("string").alias("rank"), line.alias("line"))

    rows = part(merged.agg(F.count(F.lit(1)).alias("n")), 0, none, F.concat(F.lit("rows: "), F.col("n").cast("string")))
    counts = AG.value_counts(merged, outcome)
    vc = part(counts, 1, F.coalesce(F.col(outcome).cast("string"), none),
              F.concat(F.lit(f"count {outcome}="), F.coalesce(F.col(outcome).cast("string"), F.lit("null")), F.lit(": "), F.col("count").cast("string")))
    d = AG.describe_col(merged, score).unpivot([], ["mean", "std", "min", "q25", "q50", "q75", "max"], "stat", "value")
    desc = part(d, 2, F.col("stat"), F.concat(F.lit(f"describe {score} "), F.col("stat"), F.lit(": "), F.format_string("%.3f", "value")))
    nulls = part(AG.null_counts(merged), 3, F.col("column"), F.concat(F.lit("missing "), F.col("column"), F.lit(": "), F.col("nulls").cast("string")))
    c = AG.correlations(merged, score, numeric).where("r IS NOT NULL")
    corr = part(c, 4, F.format_string("%.9f %s", 1 - F.abs("r"), F.col("column")),
                F.concat(F.lit(f"correlation {score} "), F.col("column"), F.lit(": "), F.format_string("%.3f", "r")))
    return rows.unionByName(vc).unionByName(desc).unionByName(nulls).unionByName(corr)
