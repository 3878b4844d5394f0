"""Pairwise balanced accuracy of a bucketing against golden labels, from the contingency table; no pairs are made."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_labels(rows: DataFrame, label: str, case: str = "Case") -> DataFrame:
    """(Case, label) with text labels; a missing column or a repeated case is an error that names it."""
    missing = [c for c in (case, label) if c not in rows.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {rows.columns}")
    again = [r[0] for r in rows.groupBy(case).count().where("count > 1").orderBy(case).select(case).limit(20).collect()]
    if again:
        raise ValueError(f"cases with more than one row: {again}")
    return rows.select(F.col(case).alias("Case"), F.col(label).cast("string").alias(label))


def one_sided(golden: DataFrame, predicted: DataFrame, case: str = "Case") -> DataFrame:
    """Cases that only one of the tables has: (Case, missing_in)."""
    g, p = golden.select(F.col(case).alias("Case"), F.lit(1).alias("g")), predicted.select(F.col(case).alias("Case"), F.lit(1).alias("p"))
    both = g.join(p, "Case", "full_outer").where("g IS NULL OR p IS NULL")
    return both.select("Case", F.when(F.col("g").isNull(), "golden").otherwise("predicted").alias("missing_in"))


def _pairs(n: Column) -> Column:
    return F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0).cast("long"))


def pair_counts(labels: DataFrame, golden: str, predicted: str) -> DataFrame:
    """One row: tp, fn, fp, tn, n_cases, positive_pairs, negative_pairs over unordered pairs of cases."""
    cell = labels.groupBy(F.col(golden).alias("g"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    # grouping sets over the small contingency table: cells, golden totals, predicted totals, all
    sums = cell.groupingSets([["g", "p"], ["g"], ["p"], []], "g", "p").agg(F.sum("n").alias("n"), F.grouping_id().alias("level"))
    n = F.col("n")
    of = lambda level: _pairs(F.when(F.col("level") == level, n))
    totals = sums.agg(of(0).alias("tp"), of(1).alias("positive_pairs"), of(2).alias("together"), of(3).alias("pairs"), F.coalesce(F.max(F.when(F.col("level") == 3, n)), F.lit(0)).cast("long").alias("n_cases"))
    c = F.col
    return totals.select(
        "tp", (c("positive_pairs") - c("tp")).alias("fn"), (c("together") - c("tp")).alias("fp"), (c("pairs") - c("positive_pairs") - c("together") + c("tp")).alias("tn"),
        "n_cases", "positive_pairs", (c("pairs") - c("positive_pairs")).alias("negative_pairs"),
    )


def balanced_accuracy(counts: DataFrame) -> DataFrame:
    """Adds tpr (1 without positive pairs), tnr (1 without negative ones) and their mean."""
    c = F.col
    tpr = F.when(c("positive_pairs") == 0, 1.0).otherwise(c("tp") / c("positive_pairs"))
    tnr = F.when(c("negative_pairs") == 0, 1.0).otherwise(c("tn") / c("negative_pairs"))
    return counts.withColumn("tpr", tpr).withColumn("tnr", tnr).withColumn("balanced_accuracy", (c("tpr") + c("tnr")) / 2)


def score(predicted: DataFrame, golden: DataFrame, pred_col: str = "bucket", golden_col: str = "Bug") -> DataFrame:
    """One row of counts and rates; cases that only one side has are an error that lists them."""
    p, g = checked_labels(predicted, pred_col), checked_labels(golden, golden_col)
    lone = one_sided(g, p).limit(20).collect()
    if lone:
        raise ValueError("cases on one side only: " + ", ".join(f"{r['Case']} (not in {r['missing_in']})" for r in lone))
    both = g.withColumnRenamed(golden_col, "_g").join(p.withColumnRenamed(pred_col, "_p"), "Case")
    return balanced_accuracy(pair_counts(both, "_g", "_p"))


def derived_k(golden: DataFrame, column: str = "Bug") -> DataFrame:
    return golden.agg(F.countDistinct(column).alias("k"))
