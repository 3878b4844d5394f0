"""Case signatures: the three records of a case joined, routed and reduced to one typed row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X

_LIST = "array<string>"


def failure_mode(kind: Column, fatal_kind: Column, asserts: Column) -> Column:
    return F.when(kind == "mismatch", "mismatch").when((F.size(asserts) > 0) & (fatal_kind == ""), "assert").when(fatal_kind != "", "fatal").otherwise("unknown")


def is_early(kind: Column, matched: Column, retire: Column) -> Column:
    return (kind == "mismatch") & ((matched < R.EARLY_MATCHED) | ((retire > 0) & (retire < R.EARLY_RETIRE)))


def routes(cases: DataFrame, regr: DataFrame) -> DataFrame:
    """(case_id, log, target): which further log each case is read from; a mismatch reads its trace from the retire index on."""
    both = cases.select("case_id").join(regr.select("case_id", "kind", "retire_index"), "case_id", "left")
    mismatch = F.coalesce(F.col("kind") == "mismatch", F.lit(False))
    return both.select("case_id", F.when(mismatch, "trace").otherwise("sim").alias("log"), F.when(mismatch, F.col("retire_index")).otherwise(0).cast("long").alias("target"))


def signatures(cases: DataFrame, regr: DataFrame, sim: DataFrame, trace: DataFrame) -> DataFrame:
    """One row per case of ``cases(case_id, ord)`` in its order; what a record lacks takes its default."""
    named = lambda df, p: df.select("case_id", *[F.col(c).alias(f"{p}_{c}") for c in df.columns if c != "case_id"])
    all_ = cases.join(named(regr, "r"), "case_id", "left").join(named(sim, "s"), "case_id", "left").join(named(trace, "t"), "case_id", "left")
    kind = F.coalesce("r_kind", F.lit("unknown"))
    mismatch = kind == "mismatch"
    of = lambda when, c, default: F.when(when, F.coalesce(c, default)).otherwise(default)
    blank, none, zero = F.lit(""), F.array().cast(_LIST), F.lit(0).cast("long")
    text_r, num_r = (lambda c: F.coalesce(c, blank)), (lambda c: F.coalesce(c, zero))
    sim_fatal, sim_asserts = of(~mismatch, "s_fatal_kind", blank), of(~mismatch, "s_error_asserts", none)
    ibex, spike = text_r("r_ibex_mnemonic"), text_r("r_spike_mnemonic")
    rows = all_.select(
        "case_id", "ord", failure_mode(kind, sim_fatal, sim_asserts).alias("failure_mode"), kind.alias("regr_kind"), text_r("r_test_name").alias("regr_test_name"),
        sim_fatal.alias("sim_fatal_kind"), of(~mismatch, "s_fatal_source", blank).alias("sim_fatal_source"), sim_asserts.alias("sim_error_asserts"), of(~mismatch, "s_uvm_testname", blank).alias("sim_uvm_testname"),
        of(mismatch, "t_mnemonics", none).alias("trace_tail_mnemonics"), of(mismatch, "t_loop_mnems", none).alias("trace_loop_mnems"), of(mismatch, "t_total", zero).alias("trace_total"),
        of(mismatch, "t_length_bucket", blank).alias("trace_length_bucket"), of(mismatch, "t_has_repeating_tail", F.lit(False)).alias("has_repeating_tail"),
        of(mismatch, "t_has_signature_loop", F.lit(False)).alias("has_signature_loop"), of(mismatch, "t_tail_uniformity", F.lit(0.0)).alias("tail_mnem_uniformity"),
        num_r("r_retire_index").alias("mismatch_retire_index"), num_r("r_matched_count").alias("mismatch_matched_count"), ibex.alias("mismatch_ibex_mnemonic"), spike.alias("mismatch_spike_mnemonic"),
        of(mismatch, "t_mismatch_context_mnemonics", none).alias("mismatch_context_mnemonics"),
        is_early(kind, num_r("r_matched_count"), num_r("r_retire_index")).alias("early_mismatch"), (mismatch & (ibex != "") & (ibex == spike)).alias("same_reg_pair"),
        of(~mismatch, "s_error_messages", none).alias("error_messages"),
    )
    return rows.withColumn("text_blob", text_blob())


def text_blob() -> Column:
    """The weighted token text of a signature row; tokens of facts that are missing are left out."""
    c = F.col
    rep = lambda token, n=1, when=None: F.array_repeat(token, n) if when is None else F.when(when, F.array_repeat(token, n)).otherwise(F.array().cast(_LIST))
    tag = lambda name, col: F.concat(F.lit(name), col.cast("string"))
    ibex, spike, ctx = c("mismatch_ibex_mnemonic"), c("mismatch_spike_mnemonic"), F.array_join("mismatch_context_mnemonics", " ")
    uniform = c("tail_mnem_uniformity")
    mismatch = F.concat(
        rep(F.lit("MODE_mismatch"), 2), rep(tag("LEN_", c("trace_length_bucket"))),
        rep(tag("IBEX_", ibex), 3, ibex != ""), rep(tag("SPIKE_", spike), 3, spike != ""), rep(F.concat(F.lit("PAIR_"), ibex, F.lit("_"), spike), 3, (ibex != "") & (spike != "")),
        rep(tag("RETIRE_", X.retire_bucket(c("mismatch_retire_index"))), 1, c("mismatch_retire_index") != 0),
        rep(F.lit("EARLY_MISMATCH"), 4, c("early_mismatch")), rep(F.lit("SAME_REG_PAIR"), 4, c("same_reg_pair")), rep(F.lit("NO_SIG_LOOP"), 2, ~c("has_signature_loop")),
        rep(tag("CTX ", ctx), 2, ctx != ""), rep(F.lit("SIG_LOOP"), 3, c("has_signature_loop")), rep(F.lit("REPEAT_TAIL"), 2, c("has_repeating_tail")),
        rep(F.concat(F.lit("UNIFORM_"), F.format_string("%.2f", uniform)), 1, uniform >= 0.75),
    )
    other = F.concat(
        rep(tag("MODE_", c("failure_mode"))), rep(tag("REGR_", c("regr_kind"))), rep(tag("FATAL_", c("sim_fatal_kind")), 3, c("sim_fatal_kind") != ""),
        rep(tag("FATALSRC_", c("sim_fatal_source")), 2, c("sim_fatal_source") != ""), F.flatten(F.transform("sim_error_asserts", lambda a: F.array_repeat(F.concat(F.lit("ASSERT_"), a), 3))),
        rep(tag("REGRTEST_", c("regr_test_name")), 2, c("regr_test_name") != ""), rep(tag("UVMTEST_", c("sim_uvm_testname")), 1, c("sim_uvm_testname") != ""),
        F.transform(F.slice("error_messages", 1, R.ERRORS_USED), X.letters_only),
    )
    return F.array_join(F.when(c("failure_mode") == "mismatch", mismatch).otherwise(other), " ")


def categorical_key(prefix: str = "") -> Column:
    """The exact facts that two cases of one bucket share, as JSON of those that count in the row's mode."""
    c = lambda name: F.col(prefix + name)
    mismatch = F.struct(F.lit("mismatch"), *[c(n) for n in ("mismatch_ibex_mnemonic", "mismatch_spike_mnemonic", "has_signature_loop", "trace_length_bucket", "has_repeating_tail", "same_reg_pair", "early_mismatch")])
    other = F.struct(*[c(n) for n in ("failure_mode", "sim_fatal_kind", "sim_fatal_source", "sim_error_asserts", "regr_test_name")])
    return F.when(c("failure_mode") == "mismatch", F.to_json(mismatch)).otherwise(F.to_json(other))
