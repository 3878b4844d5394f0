"""Fixed values of the log formats: patterns, ordered rules, word lists, limits and weights.

The patterns are ASCII; where the log format means any letter or digit they say so by property.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: line patterns ---
MISMATCH = r"^Mismatch\[[0-9]+\]:"
DUT_LINE = r"^ibex\[([0-9]+)\]\s*:\s*pc\[([0-9a-fA-F]+)\]\s+([a-z][a-z0-9.]*)\b"
MODEL_LINE = r"^spike\[[0-9]+\]\s*:\s*(?:pc\[[^\]]+\]\s+)?([a-z][a-z0-9.]*)\b"
COUNTS_LINE = r"\[FAILED\]:\s*([0-9]+)\s+matched,\s*([0-9]+)\s+mismatch"
FAILED_TEST = r"^([A-Za-z0-9_.]+)\s*:\s*\[FAILED\]"
FATAL_REPORT = r"UVM_FATAL\s+\S+\.sv\([0-9]+\)"
FATAL_SUMMARY = r"^UVM_FATAL\s*:\s*[0-9]+\s*$"
FATAL_TOTAL = "UVM_FATAL reports"
FATAL_SOURCE = r"UVM_FATAL\s+(\S+?\.sv)\b"
FATAL_HEAD = r"^UVM_FATAL\s+<PATH>\(<N>\)\s*"
ERROR_WORD = "UVM_ERROR"
ERROR_TEXT = r"UVM_ERROR\b.*"
PASSED, FAILED = "RISC-V UVM TEST PASSED", "RISC-V UVM TEST FAILED"
ASSERT_NAME = r"ASSERT FAILED\] \[[^.\]]*\.([^.\]]+)\]"
ASSERT_PROPERTY = r"\] ([A-Za-z_][A-Za-z0-9_]*):"
TEST_NAME = r"\+UVM_TESTNAME=(\S+)"
TRACE_ROW = r"^\s*([0-9]+)\s+([0-9]+)\s+([0-9a-fA-F]+)\s+([0-9a-fA-F]+)\s+(\S+)"
BASELINE_REPORT = r"^(UVM_FATAL.*|UVM_ERROR.*)"
BASELINE_TRACE = r"^\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+(.*)"

# --- fixed values: message normalisation, in order ---
NORMALISE = [
    (r"/[\p{L}\p{N}_\-./]+", "<PATH>"),
    (r"0x[0-9a-fA-F]+", "<HEX>"),
    (r"@\s*[0-9]+", "@<T>"),
    (r"\b[0-9]+\b", "<N>"),
    (r"\s+", " "),
]

# --- fixed values: kinds of fatal reports, the first that matches counts ---
FATAL_RULES = [
    ("wall_clock_timeout", r"wall-clock timeout"),
    ("test_timeout", r"TEST TIMEOUT!!"),
    ("debug_timeout", r"IN_DEBUG_MODE"),
    ("irq_timeout", r"HANDLING_IRQ"),
    ("csr_timeout", r"Did not receive write to csr"),
    ("core_status_timeout", r"Did not receive core_status"),
    ("handshake_test_fail", r"RISCV-DV handshake \(payload=TEST_FAIL\)"),
    ("handshake_malformed", r"Incorrectly formed handshake"),
    ("bad_signature_format", r"signature address is formatted incorrectly"),
    ("double_fault", r"double_fault detector"),
    ("check_memory", r"memory fault"),
    ("check_mcause", r"Check failed mcause"),
    ("check_signature", r"Check failed signature_data"),
    ("no_dret", r"No dret detected"),
    ("no_mret", r"No mret detected"),
    ("check_priv_mode", r"Check failed.*Incorrect privilege mode"),
    ("debug_ebreak_init", r"EBreak seen whilst doing initial debug initialization"),
    ("debug_ebreak", r"Core did not enter debug mode after execution of ebreak"),
    ("irq_in_debug", r"Core is handling interrupt detected in debug mode"),
    ("illegal_instr", r"Illegal instruction detected"),
    ("invalid_xret", r"Invalid xRET instruction"),
    ("invalid_compressed", r"Invalid C1 compressed|Illegal C2 compressed|Instruction is not compressed"),
    ("dcsr_priv", r"dcsr\.prv is an unsupported privilege mode"),
    ("cosim_reg_write", r"Cosim mismatch Register write data mismatch"),
    ("cosim_reg_missing", r"Cosim mismatch DUT didn't write to register"),
    ("cosim_trap", r"Cosim mismatch Synchronous trap"),
    ("cosim_mem_access", r"Cosim mismatch (?:DUT generated|A store at address|load at address)"),
    ("cosim_pc", r"Cosim mismatch PC mismatch"),
    ("cosim_mismatch", r"Cosim mismatch"),
    ("hdl_read_fail", r"Check failed \(uvm_hdl_read"),
    ("env_setup", r"Cannot get (?:RV32|clk_if|dut_if|instr_monitor_if|csr_if)"),
    ("missing_binary", r"Please specify test binary"),
    ("cannot_open_file", r"Cannot open file"),
    ("base_class_stub", r"Base class task should not be used"),
]
OTHER_FATAL = "other_fatal"

# --- fixed values: families of fatal kinds and their distances ---
FAMILIES = {
    "timeout": ["debug_timeout", "irq_timeout", "core_status_timeout", "csr_timeout", "wall_clock_timeout", "test_timeout"],
    "check": ["check_signature", "check_memory", "check_mcause", "check_priv_mode"],
    "cosim": ["cosim_mismatch", "cosim_reg_write", "cosim_reg_missing", "cosim_trap", "cosim_mem_access", "cosim_pc"],
    "debug": ["debug_ebreak", "debug_ebreak_init", "irq_in_debug", "dcsr_priv"],
}
FAMILY_DISTANCE = {"timeout": 0.45, "check": 0.35, "cosim": 0.40, "debug": 0.50}
TIMEOUT_CHECK = 0.55

# --- fixed values: limits ---
SIM_BUDGET = 50 * 1024 * 1024
TAIL, TAIL_TEXT, TAIL_SHOWN, CONTEXT = 64, 16, 8, 8
MAX_ERRORS, ERRORS_USED = 8, 2
EARLY_MATCHED, EARLY_RETIRE = 200, 150
LENGTHS = [(1_000, "short"), (10_000, "medium"), (100_000, "long")]
LONGEST = "huge"
NOISE_TOKENS = ["mode_mismatch", "mode_fatal", "mode_assert", "mode_unknown", "regr_mismatch", "regr_failed_only", "regr_unknown", "ctx"]
NOISE_PATTERN = r"^uniform_[0-9.]+$"


def classify(raw: Column, normalised: Column, rules: list[tuple[str, str]] = FATAL_RULES, other: str = OTHER_FATAL) -> Column:
    """The name of the first rule that the raw or the normalised text matches, any case; ``other`` for any other text; "" for none."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules):
        hit = raw.rlike(f"(?i){pattern}") | normalised.rlike(f"(?i){pattern}")
        out = F.when(hit, F.lit(name)).otherwise(out)
    return F.coalesce(out, F.when(normalised != "", F.lit(other)).otherwise(F.lit("")))
