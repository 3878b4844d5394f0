"""Trace tails over a stream: the last rows of every case are its state, however often new ones arrive."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from faultweave.functions import rules as R
from faultweave.operators.components import shared_dir

_OUT = "case_id long, total long, unique_pcs long, tail_text string"
_STATE = "total long, line_no array<long>, pc array<string>, mnemonic array<string>"


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    total, lines, pcs, names = state.get if state.exists else (0, [], [], [])
    kept = pd.DataFrame({"line_no": list(lines), "pc": list(pcs), "mnemonic": list(names)})
    for pdf in batches:
        total += len(pdf)
        kept = pd.concat([kept, pdf[["line_no", "pc", "mnemonic"]]]).nlargest(R.TAIL, "line_no", keep="first")
    kept = kept.sort_values("line_no")
    state.update((total, kept["line_no"].astype(int).tolist(), kept["pc"].tolist(), kept["mnemonic"].tolist()))
    yield pd.DataFrame({"case_id": [key[0]], "total": [total], "unique_pcs": [kept["pc"].nunique()], "tail_text": [" ".join(kept["mnemonic"].tail(R.TAIL_TEXT))]})


def tails_of_stream(rows: DataFrame) -> DataFrame:
    """(case_id, total, unique_pcs, tail_text) of a stream of (case_id, line_no, pc, mnemonic), a new row for each case that a batch touches.

    The state of a case is its TAIL latest rows by line_no, so late lines fall into their place.
    """
    return rows.groupBy("case_id").applyInPandasWithState(_update, _OUT, _STATE, "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame) -> DataFrame:
    """Runs a stream over what is there and gives the last row of each case."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/out/batch={n}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{_OUT}, batch int").parquet(f"{root}/out")
    last = rows.groupBy("case_id").agg(F.max_by(F.struct("total", "unique_pcs", "tail_text"), "batch").alias("r"))
    return last.select("case_id", "r.total", "r.unique_pcs", "r.tail_text")
