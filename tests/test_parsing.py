from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X
from faultweave.operators import parsing


def lines(spark, *logs):
    return spark.createDataFrame([(c, n, v) for c, log in enumerate(logs) for n, v in enumerate(log)], "case_id long, line_no int, value string")


def test_regr_later_block_wins_and_failed_first(spark):
    rows = parsing.parse_regr(
        lines(
            spark,
            ["Mismatch[1]:", "ibex[7] : pc[80AB] c.addi x", "Mismatch[2]:", "ibex[9] : pc[90CD] lw x", "spike[9] : pc[0] sw x", "[FAILED]: 12 matched, 3 mismatch", "ibex[99] : pc[1] add x"],
            ["  riscv_x.12 : [FAILED]", "Mismatch[1]:", "ibex[7] : pc[80] add x"],
            ["nothing here"],
            ["Mismatch[1]:", "spike[1] : add x", "spike[2] : sub x"],
        )
    )
    found = {r["case_id"]: r for r in rows.collect()}
    a = found[0]
    assert (a["kind"], a["retire_index"], a["ibex_mnemonic"], a["spike_mnemonic"], a["ibex_pc"], a["matched_count"], a["mismatch_count"]) == ("mismatch", 9, "lw", "sw", "90cd", 12, 3)
    assert (found[1]["kind"], found[1]["test_name"], found[1]["ibex_mnemonic"]) == ("failed_only", "riscv_x", "")
    assert 2 not in found
    assert found[3]["spike_mnemonic"] == "sub"  # not all facts are known: the last line counts


def test_sim_first_fatal_asserts_and_messages(spark):
    log = ["run +UVM_TESTNAME=core_a +UVM_TESTNAME=core_b", "UVM_FATAL :    1", "UVM_FATAL /x/tb.sv(3) @ 5: t [t] Check failed signature_data memory fault type", "UVM_FATAL /x/other.sv(3) TEST TIMEOUT!!"]
    log += [f"UVM_ERROR /a/b.sv({i}) @ {i}: r [ASSERT FAILED] [top.Dup] Dup: x" for i in range(9)] + ["UVM_ERROR /a.sv(1) [ASSERT FAILED] [a.b.c.Deep] Deep: y", "UVM_ERROR reports : 0"]
    r = parsing.parse_sim(lines(spark, log)).first()
    assert (r["fatal_kind"], r["fatal_source"], r["uvm_testname"]) == ("check_memory", "tb.sv", "core_a")
    assert r["error_asserts"] == ["Deep", "Dup"]
    assert len(r["error_messages"]) == 8
    assert r["error_messages"][0] == "UVM_ERROR <PATH>(<N>) @<T>: r [ASSERT FAILED] [top.Dup] Dup: x"
    assert r["fatal_template"] == "UVM_FATAL @<T>: t [t] Check failed signature_data memory fault type"


def test_budget_drops_the_line_that_crosses(spark):
    kept = parsing.within_budget(lines(spark, ["aaaa", "bbb", "cc"]), 9).collect()
    assert [r["value"] for r in kept] == ["aaaa", "bbb"]


def test_rules_are_ordered(spark):
    df = spark.createDataFrame([("Did not receive core_status IN_DEBUG_MODE",), ("cosim mismatch pc mismatch",), ("strange",), ("",)], "v string")
    assert [r[0] for r in df.select(R.classify(F.col("v"), F.col("v"))).collect()] == ["debug_timeout", "cosim_pc", "other_fatal", ""]


def trace(spark, n, target=0, pc=lambda i: f"{i:x}", name=lambda i: "add"):
    rows = [(0, i, f" {i} {i} {pc(i)} 00ff {name(i)} x1") for i in range(1, n + 1)]
    df = spark.createDataFrame(rows, "case_id long, line_no int, value string")
    return parsing.parse_trace(df, spark.createDataFrame([(0, target)], "case_id long, target long"))


def test_tail_boundaries(spark):
    assert trace(spark, 9, pc=lambda i: "a").first()["has_repeating_tail"] is False
    assert trace(spark, 10, pc=lambda i: "a").first()["has_repeating_tail"] is True
    assert trace(spark, 12, pc=lambda i: "abc"[i % 3]).first()["has_repeating_tail"] is True
    assert trace(spark, 12, pc=lambda i: "abcd"[i % 4]).first()["has_repeating_tail"] is False
    assert trace(spark, 65).first()["unique_pcs"] == 64
    for n, name in ((999, "short"), (1000, "medium")):
        assert trace(spark, n).first()["length_bucket"] == name


def test_target_window_and_context(spark):
    r = trace(spark, 30, target=20, name=lambda i: f"m{i}").first()
    assert r["total"] == 11
    assert r["mismatch_context_mnemonics"] == [f"m{i}" for i in range(20, 29)]
    assert trace(spark, 5, target=6).count() == 0
    assert trace(spark, 5).first()["mismatch_context_mnemonics"] == []


def test_uniformity_and_loop(spark):
    names = ["auipc", "sw", "c.j"]
    r = trace(spark, 20, name=lambda i: names[i % 3] if i < 10 else "nop").first()
    assert r["has_signature_loop"] is True
    assert abs(r["tail_uniformity"] - 11 / 16) < 1e-9
    assert r["loop_mnems"] == sorted([*names, "nop"])


def test_clean_blob_and_ngrams(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.clean_blob(F.lit("MODE_fatal A ctx a B b UNIFORM_0.88 b c"))) == "a b c"
    assert one(X.clean_blob(F.lit("  "))) == ""
    assert one(X.word_ngrams(X.word_tokens(F.lit("ibex_c.addi x1 a")), 1, 2)) == ["ibex_c", "addi", "x1", "ibex_c addi", "addi x1"]
    assert one(X.char_ngrams(F.lit("a bcd"), 3, 6)) == [" a ", " bc", "bcd", "cd ", " bcd", "bcd ", " bcd "]
    assert one(X.normalise_message(F.lit("UVM at /a/b.sv @ 12  0xFF 7"))) == "UVM at <PATH> @<T> <HEX> <N>"
    h = one(X.ascii_histogram(F.lit("aab é")))
    assert (h[97], h[98], h[32], sum(h)) == (2.0, 1.0, 1.0, 4.0)
