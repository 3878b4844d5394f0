"""The whole run: manifest to signatures to buckets, and the score of a bucketing.

Regression logs are read first; what they say routes each case to its simulation or its trace log,
and only those files are read.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.operators import clustering, scoring
from faultweave.operators.parsing import parse_regr, parse_sim, parse_trace
from faultweave.operators.signatures import routes, signatures
from faultweave.sources import logs


def signatures_of_lines(cases: DataFrame, regr: DataFrame, sim: DataFrame, trace: DataFrame) -> DataFrame:
    """Signature rows from lines already at hand: ``cases(case_id, ord)`` and (case_id, line_no, value) of each log."""
    record = parse_regr(regr)
    way = routes(cases, record)
    of = lambda log: way.where(F.col("log") == log)
    sims = sim.join(of("sim").select("case_id"), "case_id", "left_semi")
    traces = trace.join(of("trace").select("case_id"), "case_id", "left_semi")
    return signatures(cases, record, parse_sim(sims), parse_trace(traces, of("trace").select("case_id", "target")))


def signatures_of_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    regr = logs.read_lines(spark, manifest.select("case_id", F.col("regr_log").alias("path"))).persist()
    record = parse_regr(regr)
    way = manifest.join(routes(manifest, record).select("case_id", "log"), "case_id")
    sim = logs.read_lines(spark, way.where("log = 'sim'").select("case_id", F.col("sim_log").alias("path")))
    trace = logs.read_lines(spark, way.where("log = 'trace'").select("case_id", F.col("trace_log").alias("path")))
    return signatures_of_lines(manifest.select("case_id", "ord"), regr, sim, trace)


def bucket(spark: SparkSession, manifest: DataFrame, k: int, method: str = "hybrid") -> DataFrame:
    """(Case, bucket) of a manifest as read by ``read_manifest``."""
    return clustering.buckets(clustering.cluster(signatures_of_files(spark, manifest), k, method))


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    began = time.time()
    manifest = logs.read_manifest(spark, args.input)
    cases = signatures_of_files(spark, manifest).persist()
    labelled = clustering.cluster(cases, args.k, args.method).persist()
    logs.write_buckets(clustering.buckets(labelled), args.output)
    if args.verbose:
        keys = clustering.key_histogram(cases).count()
        print(f"{cases.count()} cases, {keys} distinct keys, method {args.method}, k {args.k}, {time.time() - began:.1f} s", file=sys.stderr)
        for r in clustering.summarise(cases, labelled).orderBy("label").toLocalIterator():
            print(f"bucket_{r['label']}: {r['n_cases']} cases {r['cases']}; {r['failure_mode']} {r['sim_fatal_kind'] or r['mismatch_ibex_mnemonic']}", file=sys.stderr)
    return 0


def evaluate(args: argparse.Namespace, spark: SparkSession) -> int:
    try:
        row = scoring.score(logs.read_labels(spark, args.output), logs.read_labels(spark, args.golden), args.pred_col, args.golden_col).first()
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    if args.verbose:
        print(row.asDict(), file=sys.stderr)
    print(f"{row['balanced_accuracy']:.6f}")
    return 0


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="faultweave")
    sub = top.add_subparsers(dest="command", required=True)
    b = sub.add_parser("bucket", help="group failing cases into buckets")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--k", type=int, required=True)
    b.add_argument("--method", default="hybrid", choices=[m for m in clustering.METHODS if m != "dbscan_pca"], type=str.lower)
    b.add_argument("--seed", type=int, default=42, help="accepted for compatibility; no step draws random numbers")
    b.add_argument("--workers", type=int, default=0, help="partitions of parallel steps; 0 leaves them to Spark")
    b.add_argument("-v", "--verbose", action="store_true")
    e = sub.add_parser("eval", help="pairwise balanced accuracy of a bucketing")
    e.add_argument("--output", required=True)
    e.add_argument("--golden", required=True)
    e.add_argument("--pred-col", default="bucket")
    e.add_argument("--golden-col", default="Bug")
    e.add_argument("--verbose", action="store_true")
    args = top.parse_args(argv)
    spark = SparkSession.builder.appName("faultweave").getOrCreate()
    if args.command == "bucket":
        if args.workers:
            spark.conf.set("spark.sql.shuffle.partitions", args.workers)
        return run(args, spark)
    return evaluate(args, spark)
