import gzip

import pytest

from faultweave.plans import bucketing
from faultweave.sources import logs


def write(tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c/regr1.log").write_bytes(b"Mismatch[1]:\r\nibex[2] : pc[80] add x\r\nspike[2] : pc[80] sub x\r\n[FAILED]: 9 matched, 1 mismatch\r\n")
    (tmp_path / "c/regr2.log").write_text("riscv_a.1 : [FAILED]\n")
    (tmp_path / "c/regr3.log").write_text("riscv_a.2 : [FAILED]\n")
    with gzip.open(tmp_path / "c/sim.log.gz", "wt") as f:
        f.write("x +UVM_TESTNAME=t1\nUVM_FATAL /a/top.sv(3) @ 1: No mret detected\n")
    (tmp_path / "c/trace.log").write_bytes(b"Time Cycle PC Insn\n" + b"".join(b" %d %d 80%02d 00ff \xff%s x\n" % (i, i, i, b"" if i else b"") for i in range(5)))
    (tmp_path / "in.csv").write_bytes(b"Case,Regr Log,Sim Log,Trace Log,Extra\r\n" + b"".join(b"%d,c/regr%d.log,c/sim.log.gz,c/trace.log,x\r\n" % (i, i) for i in (3, 1, 2)) + b"4,c/none.log,c/none.log,c/none.log,x\r\n")


def test_run_and_evaluate(spark, tmp_path, capsys):
    write(tmp_path)
    manifest = logs.read_manifest(spark, str(tmp_path / "in.csv"))
    assert [r["case_id"] for r in manifest.orderBy("ord").collect()] == [3, 1, 2, 4]
    rows = {r["case_id"]: r for r in bucketing.signatures_of_files(spark, manifest).collect()}
    assert rows[1]["failure_mode"] == "mismatch" and rows[1]["mismatch_retire_index"] == 2 and rows[1]["trace_total"] == 4
    assert rows[2]["sim_fatal_kind"] == "no_mret" and rows[2]["sim_uvm_testname"] == "t1" and rows[2]["sim_fatal_source"] == "top.sv"
    assert rows[4]["failure_mode"] == "unknown" and rows[4]["regr_kind"] == "unknown"
    (tmp_path / "golden.csv").write_text("Case,Bug\n1,9\n2,7\n3,7\n4,8\n")
    assert bucketing.main(["bucket", "--input", str(tmp_path / "in.csv"), "--output", str(tmp_path / "out"), "--k", "3", "-v"]) == 0
    capsys.readouterr()
    assert bucketing.main(["eval", "--output", str(tmp_path / "out"), "--golden", str(tmp_path / "golden.csv")]) == 0
    assert capsys.readouterr().out.strip() == "1.000000"
    assert bucketing.main(["eval", "--output", str(tmp_path / "out"), "--golden", str(tmp_path / "golden.csv"), "--golden-col", "No"]) == 1


def test_output_is_one_file(spark, tmp_path):
    out = tmp_path / "buckets.csv"
    for rows in ([(3, "bucket_0"), (1, "bucket_1"), (2, "bucket_0")], [], [(7, "bucket_0")]):
        logs.write_buckets(spark.createDataFrame(rows, "Case long, bucket string"), str(out))
        assert out.is_file() and out.read_text() == "Case,bucket\n" + "".join(f"{c},{b}\n" for c, b in rows)
        assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["buckets.csv"]


def test_lines_of_large_cut_and_missing_files(spark, tmp_path):
    """Lines of a file that is read in many splits keep their numbers; a cut gzip gives what it holds; line ends of all kinds."""
    plain = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "a.log").write_text("\n".join(plain) + "\n")
    (tmp_path / "b.log").write_bytes(b"one\r\ntwo\rthree\n\nfive")
    (tmp_path / "empty.log").write_text("")
    packed = gzip.compress("".join(f"row {i} {i * 7919 % 1000003}\n" for i in range(200_000)).encode())
    (tmp_path / "cut.log.gz").write_bytes(packed[: len(packed) // 2])
    (tmp_path / "folder.log").mkdir()
    names = ["a.log", "b.log", "empty.log", "cut.log.gz", "none.log", "folder.log", "no/such/folder.log"]
    wanted = spark.createDataFrame([(i, str(tmp_path / n)) for i, n in enumerate(names)] + [(9, str(tmp_path / "b.log")), (10, None)], "case_id long, path string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = {}
        for r in logs.read_lines(spark, wanted).collect():
            got.setdefault(r["case_id"], {})[r["line_no"]] = r["value"]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [got[0][i] for i in range(len(got[0]))] == plain
    assert [got[1][i] for i in range(5)] == ["one", "two", "three", "", "five"] and got[9] == got[1]
    assert 50_000 < len(got[3]) < 200_000 and all(got[3][i] == f"row {i} {i * 7919 % 1000003}" for i in range(len(got[3]) - 1))
    assert set(got) == {0, 1, 3, 9}


def test_manifest_columns_are_checked(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("Case,Sim Log\n1,a\n")
    with pytest.raises(ValueError, match="Regr Log"):
        logs.read_manifest(spark, str(tmp_path / "bad.csv"))


def first_set(tmp_path):
    """Nine cases in the shape of the first published set: two root causes that show as timeouts, a mismatch, an assertion and a log that is missing."""
    timeout = "UVM_FATAL /work/dv/tests/core_base_test.sv(194) @ {}: uvm_test_top [uvm_test_top] Did not receive core_status {} within {} cycle timeout period\n"
    debug, irq = timeout.format(4065000, "IN_DEBUG_MODE", 1000), timeout.format(3965000, "HANDLING_IRQ", 750)
    failed = "UVM_ERROR /work/rtl/prim_assert.sv(21) @ 4165000: reporter [ASSERT FAILED] [tb_top.dut.u_core.unit_i.DataOffsetKnown] DataOffsetKnown: !$isunknown(x) (/work/rtl/unit.sv:487)\n"
    cases = [("debug_ebreak", debug), ("debug_ebreakmu", debug), (None, ""), ("multiple_interrupt", irq), ("single_interrupt", irq), ("csr", None), ("interrupt_csr", irq), ("multiple_interrupt", failed), ("single_interrupt", irq)]
    lines = ["Case,Regr Log,Sim Log,Trace Log"]
    for n, (name, report) in enumerate(cases, 1):
        folder = tmp_path / f"case_{n}"
        folder.mkdir()
        mismatch = "Mismatch[1]:\nibex[74] : pc[8000019c] c.addi\tx29,6: t4:00000000\nspike[74] : pc[80011080] addi\tt0, t0, -124: t0:80021da0\n[FAILED]: 64 matched, 3458 mismatch\n"
        (folder / "regr.log").write_text(f"riscv_{name}_test.0 : [FAILED]" if name else mismatch)
        if report is not None:
            with gzip.open(folder / "sim.log.gz", "wt") as f:
                f.write(f"simulator +UVM_TESTNAME=core_{name}_test +seed=1\n{report}--- UVM Report Summary ---\nUVM_ERROR :    0\nUVM_FATAL :    1\nRISC-V UVM TEST FAILED\n")
        lines.append(f"{n},case_{n}/regr.log,case_{n}/sim.log.gz,case_{n}/trace.log.gz")
    (tmp_path / "input.csv").write_text("\r\n".join(lines) + "\r\n")
    (tmp_path / "golden.csv").write_text("Case,Bug\r\n" + "".join(f"{n},{'first' if n <= 5 else 'second'}\r\n" for n in range(1, 10)))


def test_published_accuracy_of_the_first_set(spark, tmp_path, capsys):
    first_set(tmp_path)
    for method in ("signature", "tfidf", "signature_then_tfidf"):
        out = str(tmp_path / f"{method}.csv")
        assert bucketing.main(["bucket", "--input", str(tmp_path / "input.csv"), "--output", out, "--k", "2", "--method", method]) == 0
        capsys.readouterr()
        assert bucketing.main(["eval", "--output", out, "--golden", str(tmp_path / "golden.csv")]) == 0
        assert float(capsys.readouterr().out.strip()) == 0.475
