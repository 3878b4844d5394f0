"""Log lines to one typed record per case. Lines are (case_id, line_no, value); order is line_no.

First and last matches are min_by and max_by over the few lines that a pattern takes, so a log of any
length is one pass of filters and a partial aggregate; only tails and contexts use ranked windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X


def within_budget(lines: DataFrame, budget: int = R.SIM_BUDGET) -> DataFrame:
    """Lines up to the first whose characters (each line and its end) pass the budget of its case."""
    w = Window.partitionBy("case_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("_used", F.sum(F.length("value") + 1).over(w)).where(F.col("_used") <= budget).drop("_used")


def first_match(value: Column, when: Column, line: Column | str = "line_no") -> Column:
    """Aggregate: value of the first line that meets the condition."""
    return F.min_by(value, F.when(when, F.col(line) if isinstance(line, str) else line))


def last_match(value: Column, when: Column, line: Column | str = "line_no") -> Column:
    return F.max_by(value, F.when(when, F.col(line) if isinstance(line, str) else line))


def parse_regr(lines: DataFrame) -> DataFrame:
    """(case_id, kind, test_name, retire_index, ibex_mnemonic, spike_mnemonic, ibex_pc, matched_count, mismatch_count).

    A failed-test line before any mismatch line makes the case failed_only; else from the first
    mismatch line on each field is its last match up to the line where all three facts are known.
    Cases none of whose lines matches are absent: join to the manifest and take defaults.
    """
    v = F.col("value")
    marked = lines.select(
        "case_id", "line_no", "value",
        v.rlike(R.MISMATCH).alias("m"), v.rlike(R.DUT_LINE).alias("i"), v.rlike(R.MODEL_LINE).alias("s"), v.rlike(R.COUNTS_LINE).alias("c"),
        F.trim(F.regexp_replace(v, r"^\s+|\s+$", "")).rlike(R.FAILED_TEST).alias("f"),
    ).where("m OR i OR s OR c OR f")
    at = lambda flag: F.min(F.when(F.col(flag), F.col("line_no")))
    whole = Window.partitionBy("case_id")
    begun = marked.withColumn("m0", at("m").over(whole)).withColumn("f0", at("f").over(whole))
    failed = F.col("f0").isNotNull() & (F.col("m0").isNull() | (F.col("f0") < F.col("m0")))
    after = F.col("line_no") >= F.col("m0")
    firsts = [F.min(F.when(F.col(k) & after, F.col("line_no"))).over(whole) for k in "isc"]
    stop = F.when(firsts[0].isNotNull() & firsts[1].isNotNull() & firsts[2].isNotNull(), F.greatest(*firsts))
    told = begun.withColumn("stop", stop).withColumn("failed", failed)
    used = lambda k: F.col(k) & after & ~F.col("failed") & (F.col("stop").isNull() | (F.col("line_no") <= F.col("stop")))
    group = lambda pattern, n: F.regexp_extract(v, pattern, n)
    name = X.test_stem(F.regexp_extract(F.regexp_replace(v, r"^\s+", ""), R.FAILED_TEST, 1))
    out = told.groupBy("case_id").agg(
        F.max("failed").alias("failed"), F.max(F.col("m0").isNotNull()).alias("mismatch"),
        first_match(name, F.col("f")).alias("test"),
        last_match(group(R.DUT_LINE, 1), used("i")).alias("retire"), last_match(group(R.DUT_LINE, 2), used("i")).alias("pc"), last_match(group(R.DUT_LINE, 3), used("i")).alias("ibex"),
        last_match(group(R.MODEL_LINE, 1), used("s")).alias("spike"),
        last_match(group(R.COUNTS_LINE, 1), used("c")).alias("matched"), last_match(group(R.COUNTS_LINE, 2), used("c")).alias("missed"),
    )
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    number = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    return out.select(
        "case_id",
        F.when(F.col("failed"), "failed_only").when(F.col("mismatch"), "mismatch").otherwise("unknown").alias("kind"),
        F.when(F.col("failed"), text("test")).otherwise("").alias("test_name"),
        number("retire").alias("retire_index"), text("ibex").alias("ibex_mnemonic"), text("spike").alias("spike_mnemonic"), F.lower(text("pc")).alias("ibex_pc"),
        number("matched").alias("matched_count"), number("missed").alias("mismatch_count"),
    )


def is_fatal_report(value: Column) -> Column:
    return ~value.contains(R.FATAL_TOTAL) & ~F.trim(value).rlike(R.FATAL_SUMMARY) & value.rlike(R.FATAL_REPORT)


def assert_name(value: Column) -> Column:
    """The two-part scope's name, else the property after a bracket, else ""."""
    named = F.regexp_extract(value, R.ASSERT_NAME, 1)
    return F.when(named != "", named).otherwise(F.regexp_extract(value, R.ASSERT_PROPERTY, 1))


def parse_sim(lines: DataFrame, budget: int | None = R.SIM_BUDGET) -> DataFrame:
    """(case_id, verdict, fatal_kind, fatal_source, fatal_template, error_asserts, uvm_testname, error_messages)."""
    if budget is not None:
        lines = within_budget(lines, budget)
    v = F.col("value")
    fatal, error = is_fatal_report(v), v.contains(R.ERROR_WORD)
    passed, named = v.contains(R.PASSED), v.rlike(R.TEST_NAME)
    marked = lines.where(fatal | error | passed | v.contains(R.FAILED) | named)
    w = Window.partitionBy("case_id").orderBy("line_no")
    nth = F.sum(F.when(error, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    marked = marked.withColumn("nth", nth)
    message = X.normalise_message(F.regexp_extract(v, R.ERROR_TEXT, 0))
    raw = first_match(v, fatal)
    out = marked.groupBy("case_id").agg(
        last_match(F.when(passed, "passed").otherwise("failed"), passed | v.contains(R.FAILED)).alias("verdict"),
        F.coalesce(raw, F.lit("")).alias("raw"),
        F.array_sort(F.collect_set(F.when(error, F.nullif(assert_name(v), F.lit(""))))).alias("error_asserts"),
        first_match(F.regexp_extract(v, R.TEST_NAME, 1), named).alias("uvm_testname"),
        F.sort_array(F.collect_list(F.when(error & (F.col("nth") <= R.MAX_ERRORS), F.struct("nth", message.alias("message"))))).alias("messages"),
    )
    raw = F.col("raw")
    return out.select(
        "case_id", F.coalesce("verdict", F.lit("")).alias("verdict"),
        F.when(raw == "", "").otherwise(R.classify(raw, X.normalise_message(raw))).alias("fatal_kind"),
        X.basename(F.regexp_extract(raw, R.FATAL_SOURCE, 1)).alias("fatal_source"),
        F.when(raw == "", "").otherwise(X.fatal_template(raw)).alias("fatal_template"),
        "error_asserts", F.coalesce("uvm_testname", F.lit("")).alias("uvm_testname"), F.col("messages.message").alias("error_messages"),
    )


def trace_rows(lines: DataFrame) -> DataFrame:
    """(case_id, retire_no, pc, mnemonic): the parsed rows of traces, numbered from 1."""
    v = F.col("value")
    rows = lines.where(v.rlike(R.TRACE_ROW)).select("case_id", "line_no", F.lower(F.regexp_extract(v, R.TRACE_ROW, 3)).alias("pc"), F.regexp_extract(v, R.TRACE_ROW, 5).alias("mnemonic"))
    w = Window.partitionBy("case_id").orderBy("line_no")
    return rows.withColumn("retire_no", F.row_number().over(w).cast("long")).select("case_id", "retire_no", "pc", "mnemonic")


def mode_share(items: Column) -> Column:
    """How large a part of an array its commonest item is; 0 for an empty one."""
    top = F.array_max(F.transform(items, lambda x: F.size(F.filter(items, lambda y: y == x))))
    return F.when(F.size(items) == 0, F.lit(0.0)).otherwise(top / F.size(items))


def signature_loop(mnemonics: Column) -> Column:
    has = lambda m: F.array_contains(mnemonics, m)
    return has("auipc") & has("sw") & (has("c.j") | has("c.jal"))


def summarise_trace(rows: DataFrame, tail: int = R.TAIL) -> DataFrame:
    """One record per case from (case_id, retire_no, pc, mnemonic, target): target 0 takes the whole trace, else what is retired from it on."""
    kept = rows.where((F.col("target") == 0) | (F.col("retire_no") >= F.col("target")))
    back = Window.partitionBy("case_id").orderBy(F.col("retire_no").desc())
    context = (F.col("target") > 0) & (F.col("retire_no") <= F.col("target") + R.CONTEXT)
    totals = kept.groupBy("case_id").agg(F.count("*").alias("total"), F.sort_array(F.collect_list(F.when(context, F.struct("retire_no", "mnemonic")))).alias("around"))
    last = kept.withColumn("back", F.row_number().over(back)).where(F.col("back") <= tail)
    last = last.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("retire_no", "pc", "mnemonic"))).alias("tail"))
    both = totals.join(last, "case_id")
    names = F.col("tail.mnemonic")
    take = lambda n: F.slice(names, F.greatest(F.lit(1), F.size(names) - (n - 1)), F.lit(n))
    pcs = F.size(F.array_distinct(F.col("tail.pc")))
    out = both.select("case_id", "total", names.alias("names"), take(R.TAIL_SHOWN).alias("mnemonics"), F.array_sort(F.array_distinct(names)).alias("loop_mnems"), pcs.cast("long").alias("unique_pcs"), take(R.TAIL_TEXT).alias("last16"), F.col("around.mnemonic").alias("mismatch_context_mnemonics"))
    n = F.size("names")
    return out.select(
        "case_id", "mnemonics", "loop_mnems", "unique_pcs", "total",
        ((n >= 10) & (F.col("unique_pcs") <= F.greatest(F.lit(2), F.floor(n / 4)))).alias("has_repeating_tail"),
        F.array_join("last16", " ").alias("tail_text"), X.length_bucket(F.col("total")).alias("length_bucket"), mode_share(F.col("last16")).alias("tail_uniformity"),
        "mismatch_context_mnemonics", F.array_join("mismatch_context_mnemonics", " ").alias("mismatch_context_text"), signature_loop(F.col("loop_mnems")).alias("has_signature_loop"),
    )


def parse_trace(lines: DataFrame, targets: DataFrame) -> DataFrame:
    """Trace records; ``targets(case_id, target)`` gives the retire index from which a case counts (0: all)."""
    return summarise_trace(trace_rows(lines).join(targets, "case_id"))
