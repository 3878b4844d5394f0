"""The character-histogram baseline: three 128-count vectors a case and Ward's linkage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X
from faultweave.operators import linkage as L
from faultweave.operators.clustering import grouped
from faultweave.sources.logs import last_lines


def vector_sum(column: Column) -> Column:
    """Aggregate: place-wise sum of 128-arrays."""
    return F.array(*[F.sum(F.get(column, i)) for i in range(128)])


def histograms(cases: DataFrame, regr: DataFrame, sim: DataFrame, trace: DataFrame) -> DataFrame:
    """(case_id, ord, embedding of 384): first report line, last ten trace rows' mnemonics, whole regression log."""
    v = F.col("value")
    report = sim.where(v.rlike(R.BASELINE_REPORT)).groupBy("case_id").agg(F.min_by("value", "line_no").alias("line"))
    report = report.select("case_id", X.ascii_histogram(F.col("line")).alias("s"))
    names = last_lines(trace, 10).where(v.rlike(R.BASELINE_TRACE)).select("case_id", X.ascii_histogram(F.regexp_extract(v, R.BASELINE_TRACE, 5)).alias("h"))
    names = names.groupBy("case_id").agg(vector_sum(F.col("h")).alias("t"))
    whole = regr.select("case_id", X.ascii_histogram(F.concat("value", F.lit("\n"))).alias("h")).groupBy("case_id").agg(vector_sum(F.col("h")).alias("r"))
    none = F.array_repeat(F.lit(0.0), 128)
    both = cases.select("case_id", "ord").join(report, "case_id", "left").join(names, "case_id", "left").join(whole, "case_id", "left")
    return both.select("case_id", "ord", F.concat(F.coalesce("s", none), F.coalesce("t", none), F.coalesce("r", none)).alias("embedding"))


def cluster_ward(points: DataFrame, k: int) -> DataFrame:
    """(case_id, ord, label) of ``points(case_id, ord, embedding)`` by Ward's linkage."""
    values = points.select(F.col("ord").alias("a"), F.col("ord").alias("b"), F.posexplode("embedding").alias("dim", "x"))

    def solve(n: int, data: dict[str, np.ndarray]) -> np.ndarray:
        x = np.zeros((n, int(data["dim"].max()) + 1 if len(data["dim"]) else 1))
        x[data["a"], data["dim"].astype(int)] = data["x"]
        return L.labels(L.ward(x, L.clamp(k, n)), n) if n else np.zeros(0, np.int64)

    return grouped(points.sparkSession, points, values, solve)
