"""Driver queries: every operator on a whole driver table, with the SQL that says the same.

The tables have no regression logs, so a stand-in is derived in plain sight: a user's events are a
trace (event type: mnemonic, props.k: pc), and lines and records are computed from event columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X
from faultweave.operators import baselines, clustering, distances, nearest, parsing, scoring, vectors
from faultweave.operators.components import Saved
from faultweave.operators.signatures import categorical_key, is_early, routes, signatures
from faultweave.sources import logs

MNEMONICS = {"view": "auipc", "signup": "sw", "click": "c.j", "error": "addi", "purchase": "lw"}
KINDS = ["", "no_dret", "check_memory", "debug_timeout", "irq_timeout", "cosim_pc", "debug_ebreak", "cosim_trap", "check_mcause", "other_fatal"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _mnemonic() -> Column:
    c = F.lit(None).cast("string")
    for k, v in MNEMONICS.items():
        c = F.when(F.col("event_type") == k, F.lit(v)).otherwise(c)
    return c


def _trace(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _t(spark, d, "events")
    target = F.when(F.col("user_id") % 3 == 0, 0).otherwise(F.col("user_id") % 40).cast("long")
    return ev.select(F.col("user_id").alias("case_id"), F.row_number().over(w).cast("long").alias("retire_no"), F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("pc"), _mnemonic().alias("mnemonic"), target.alias("target"))


_TRACE = """ev AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS retire_no,
  regexp_extract(props, '"k": *([0-9]+)', 1) AS pc,
  CASE event_type WHEN 'view' THEN 'auipc' WHEN 'signup' THEN 'sw' WHEN 'click' THEN 'c.j' WHEN 'error' THEN 'addi' WHEN 'purchase' THEN 'lw' END AS mnemonic,
  CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS target FROM events)"""
_SUMMARY = (
    _TRACE
    + """,
kept AS (SELECT * FROM ev WHERE target = 0 OR retire_no >= target),
tot AS (SELECT case_id, count(*) AS total, max(target) AS target FROM kept GROUP BY case_id),
tail AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY retire_no DESC) AS back FROM kept) WHERE back <= 64),
t1 AS (SELECT case_id, count(*) AS n, count(DISTINCT pc) AS unique_pcs, string_agg(mnemonic, ' ' ORDER BY retire_no) FILTER (back <= 16) AS tail_text,
  string_agg(mnemonic, ' ' ORDER BY retire_no) FILTER (back <= 8) AS mnemonics, array_to_string(list_sort(list(DISTINCT mnemonic)), ' ') AS loop_mnems,
  bool_or(mnemonic = 'auipc') AND bool_or(mnemonic = 'sw') AND (bool_or(mnemonic = 'c.j') OR bool_or(mnemonic = 'c.jal')) AS has_signature_loop FROM tail GROUP BY case_id),
uni AS (SELECT case_id, max(c) / sum(c)::DOUBLE AS tail_uniformity FROM (SELECT case_id, mnemonic, count(*) AS c FROM tail WHERE back <= 16 GROUP BY case_id, mnemonic) GROUP BY case_id),
ctx AS (SELECT case_id, list(mnemonic ORDER BY retire_no) AS context FROM kept WHERE target > 0 AND retire_no <= target + 8 GROUP BY case_id),
summary AS (SELECT case_id, total, mnemonics, loop_mnems, unique_pcs, n >= 10 AND unique_pcs <= greatest(2, n // 4) AS has_repeating_tail, tail_text,
  CASE WHEN total < 1000 THEN 'short' WHEN total < 10000 THEN 'medium' WHEN total < 100000 THEN 'long' ELSE 'huge' END AS length_bucket,
  tail_uniformity, coalesce(context, []::VARCHAR[]) AS context, has_signature_loop
  FROM tot JOIN t1 USING (case_id) JOIN uni USING (case_id) LEFT JOIN ctx USING (case_id))"""
)


def _cases(spark: SparkSession, d: str) -> DataFrame:
    """Signature rows of all users: records computed from their events, then the engine's own join, routing and blob."""
    trace = _trace(spark, d)
    c = trace.groupBy("case_id").agg(F.count("*").alias("n"), F.min_by("mnemonic", "retire_no").alias("first"), F.max_by("mnemonic", "retire_no").alias("last"))
    u = F.col("case_id")
    kind = F.when(u % 3 == 0, "mismatch").otherwise("failed_only")
    regr = c.select(
        "case_id", kind.alias("kind"), F.when(u % 3 == 0, "").otherwise(F.concat(F.lit("test_"), u % 5)).alias("test_name"), (u * 7 % 400).alias("retire_index"), F.when(u % 3 == 0, F.col("first")).otherwise("").alias("ibex_mnemonic"),
        F.when(u % 3 == 0, F.col("last")).otherwise("").alias("spike_mnemonic"), F.lit("").alias("ibex_pc"), (F.col("n") * 3).alias("matched_count"), F.lit(1).cast("long").alias("mismatch_count"),
    )
    asserts = F.when(u % 5 == 0, F.array(F.concat(F.lit("A"), u % 4), F.concat(F.lit("B"), u % 2))).when(u % 5 == 1, F.array(F.concat(F.lit("A"), u % 4))).otherwise(F.array().cast("array<string>"))
    sim = c.select(
        "case_id", F.lit("failed").alias("verdict"), F.get(F.array(*[F.lit(k) for k in KINDS]), (u % 10).cast("int")).alias("fatal_kind"), F.concat(F.lit("f"), u % 4, F.lit(".sv")).alias("fatal_source"), F.lit("").alias("fatal_template"),
        asserts.alias("error_asserts"), F.concat(F.lit("uvm_"), u % 2).alias("uvm_testname"), F.array(F.concat(F.lit("UVM_ERROR <N> at "), F.col("first"))).alias("error_messages"),
    )
    summary = parsing.summarise_trace(trace.withColumn("target", F.col("case_id") * 7 % 400))
    return Saved(spark).save(signatures(c.select("case_id", F.col("case_id").alias("ord")), regr, sim, summary))


_CASES = (
    _SUMMARY.replace("CASE WHEN user_id % 3 = 0 THEN 0 ELSE user_id % 40 END AS target", "user_id * 7 % 400 AS target")
    + """,
u AS (SELECT case_id, count(*) AS n, arg_min(mnemonic, retire_no) AS first, arg_max(mnemonic, retire_no) AS last FROM ev GROUP BY case_id),
raw AS (SELECT u.case_id, u.case_id % 3 = 0 AS m, n, first, last, u.case_id * 7 % 400 AS retire,
  CASE WHEN u.case_id % 3 = 0 THEN '' ELSE (['', 'no_dret', 'check_memory', 'debug_timeout', 'irq_timeout', 'cosim_pc', 'debug_ebreak', 'cosim_trap', 'check_mcause', 'other_fatal'])[u.case_id % 10 + 1] END AS kind,
  CASE WHEN u.case_id % 3 = 0 THEN []::VARCHAR[] WHEN u.case_id % 5 = 0 THEN ['A' || (u.case_id % 4), 'B' || (u.case_id % 2)] WHEN u.case_id % 5 = 1 THEN ['A' || (u.case_id % 4)] ELSE []::VARCHAR[] END AS asserts,
  s.* EXCLUDE (case_id) FROM u LEFT JOIN summary s ON s.case_id = u.case_id),
sig AS (SELECT case_id, case_id AS ord, CASE WHEN m THEN 'mismatch' WHEN len(asserts) > 0 AND kind = '' THEN 'assert' WHEN kind <> '' THEN 'fatal' ELSE 'unknown' END AS mode,
  kind, CASE WHEN m THEN '' ELSE 'f' || (case_id % 4) || '.sv' END AS source, asserts, CASE WHEN m THEN '' ELSE 'test_' || (case_id % 5) END AS test,
  CASE WHEN m THEN coalesce(length_bucket, '') ELSE '' END AS len_bucket, m AND coalesce(has_repeating_tail, false) AS rep, m AND coalesce(has_signature_loop, false) AS loop_,
  CASE WHEN m THEN coalesce(tail_uniformity, 0.0) ELSE 0.0 END AS uni, retire, CASE WHEN m THEN first ELSE '' END AS ibex, CASE WHEN m THEN last ELSE '' END AS spike,
  CASE WHEN m THEN coalesce(context, []::VARCHAR[]) ELSE []::VARCHAR[] END AS ctx, m AND (n * 3 < 200 OR (retire > 0 AND retire < 150)) AS early, m AND first <> '' AND first = last AS same,
  'UVM_ERROR <N> at ' || first AS message FROM raw)"""
)


# --- queries, in the order of the inventory ---


def q_balanced_accuracy(spark, d):
    return scoring.balanced_accuracy(scoring.pair_counts(_t(spark, d, "documents"), "lang", "source"))


def _accuracy_sql(table: str, g: str, p: str) -> str:
    return f"""
WITH x AS (SELECT {g} AS g, {p} AS p FROM {table}),
s AS (SELECT (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY g, p)) AS tp,
  (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY g)) AS pos,
  (SELECT coalesce(sum(n * (n - 1) // 2), 0) FROM (SELECT count(*) AS n FROM x GROUP BY p)) AS tog, (SELECT count(*) FROM x) AS n)
SELECT tp::BIGINT AS tp, (pos - tp)::BIGINT AS fn, (tog - tp)::BIGINT AS fp, (n * (n - 1) // 2 - pos - tog + tp)::BIGINT AS tn, n AS n_cases, pos::BIGINT AS positive_pairs, (n * (n - 1) // 2 - pos)::BIGINT AS negative_pairs,
  CASE WHEN pos = 0 THEN 1.0::DOUBLE ELSE tp / pos::DOUBLE END AS tpr, CASE WHEN n * (n - 1) // 2 = pos THEN 1.0::DOUBLE ELSE (n * (n - 1) // 2 - pos - tog + tp) / (n * (n - 1) // 2 - pos)::DOUBLE END AS tnr,
  (CASE WHEN pos = 0 THEN 1.0::DOUBLE ELSE tp / pos::DOUBLE END + CASE WHEN n * (n - 1) // 2 = pos THEN 1.0::DOUBLE ELSE (n * (n - 1) // 2 - pos - tog + tp) / (n * (n - 1) // 2 - pos)::DOUBLE END) / 2 AS balanced_accuracy
FROM s"""


def q_pair_counts(spark, d):
    return scoring.pair_counts(_t(spark, d, "labels"), "quality", "toxic")


PAIR_COUNTS_SQL = """
SELECT count(*) FILTER (a.quality = b.quality AND a.toxic = b.toxic)::BIGINT AS tp, count(*) FILTER (a.quality = b.quality AND a.toxic <> b.toxic)::BIGINT AS fn,
  count(*) FILTER (a.quality <> b.quality AND a.toxic = b.toxic)::BIGINT AS fp, count(*) FILTER (a.quality <> b.quality AND a.toxic <> b.toxic)::BIGINT AS tn,
  (SELECT count(*) FROM labels) AS n_cases, count(*) FILTER (a.quality = b.quality)::BIGINT AS positive_pairs, count(*) FILTER (a.quality <> b.quality)::BIGINT AS negative_pairs
FROM labels a JOIN labels b ON a.doc_id < b.doc_id"""


def q_embedding_accuracy(spark, d):
    e = _t(spark, d, "embeddings").select("label", (F.col("vec_id") % 10).alias("p"))
    return scoring.balanced_accuracy(scoring.pair_counts(e, "label", "p"))


def q_label_validation(spark, d):
    return scoring.one_sided(_t(spark, d, "documents"), _t(spark, d, "labels"), "doc_id")


LABEL_SQL = """SELECT coalesce(d.doc_id, l.doc_id) AS "Case", CASE WHEN d.doc_id IS NULL THEN 'golden' ELSE 'predicted' END AS missing_in
FROM documents d FULL OUTER JOIN labels l ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR l.doc_id IS NULL"""


def q_derived_k(spark, d):
    return scoring.derived_k(_t(spark, d, "embeddings"), "label")


def q_normalise_message(spark, d):
    return _t(spark, d, "pages").select("page_id", X.normalise_message(F.col("url")).alias("url"), F.md5(X.normalise_message(F.col("html"))).alias("html_md5"))


def _normal_sql(c: str) -> str:
    for pattern, by in R.NORMALISE:
        c = f"regexp_replace({c}, '{pattern}', '{by}', 'g')"
    return f"trim({c})"


def _lines(spark, d):
    return logs.numbered_lines(_t(spark, d, "documents"), "doc_id", "text")


_LINES = "l AS (SELECT doc_id AS case_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS value FROM documents)"


def q_first_last_match(spark, d):
    hit, end = F.col("value").rlike("(?i)the"), F.col("value").contains(",")
    return _lines(spark, d).groupBy("case_id").agg(F.md5(parsing.first_match(F.col("value"), hit)).alias("first_md5"), F.md5(parsing.last_match(F.col("value"), end)).alias("last_md5"), F.min(F.when(hit, F.col("line_no"))).cast("long").alias("first_line"))


FIRST_SQL = f"""WITH {_LINES} SELECT case_id, md5(arg_min(value, line_no) FILTER (contains(lower(value), 'the'))) AS first_md5, md5(arg_max(value, line_no) FILTER (contains(value, ','))) AS last_md5,
  min(line_no) FILTER (contains(lower(value), 'the'))::BIGINT AS first_line FROM l GROUP BY case_id"""

_RULES = [("numbers", r"[0-9]{4}"), ("the", r"\bthe\b"), ("shout", r"!!"), ("pipe", r"\|")]


def q_rule_classifier(spark, d):
    v = F.col("value")
    return _lines(spark, d).select("case_id", R.classify(v, X.normalise_message(v), _RULES, "other").alias("kind")).groupBy("case_id", "kind").agg(F.count("*").alias("n"))


RULES_SQL = f"""WITH {_LINES}, n AS (SELECT case_id, value, {_normal_sql("value")} AS norm FROM l)
SELECT case_id, CASE {" ".join(f"WHEN regexp_matches(value, '(?i){p}') OR regexp_matches(norm, '(?i){p}') THEN '{k}'" for k, p in _RULES)} WHEN norm <> '' THEN 'other' ELSE '' END AS kind, count(*) AS n FROM n GROUP BY ALL"""


#: A report of each fixed kind, one that two rules match, one that none does, and none.
_REPORTS = [
    "hit the wall-clock timeout", "TEST TIMEOUT!! after 5 us", "stuck IN_DEBUG_MODE", "stuck handling_irq", "Did not receive write to csr 0x300", "Did not receive core_status 3", "RISCV-DV handshake (payload=TEST_FAIL)", "Incorrectly formed handshake",
    "signature address is formatted incorrectly", "double_fault detector fired", "memory fault at 0x80", "Check failed mcause == 3", "Check failed signature_data == 1", "No dret detected", "No mret detected", "Check failed mode: Incorrect privilege mode",
    "EBreak seen whilst doing initial debug initialization", "Core did not enter debug mode after execution of ebreak", "Core is handling interrupt detected in debug mode", "Illegal instruction detected", "Invalid xRET instruction", "Illegal C2 compressed 7",
    "dcsr.prv is an unsupported privilege mode", "Cosim mismatch Register write data mismatch", "Cosim mismatch DUT didn't write to register", "Cosim mismatch Synchronous trap", "Cosim mismatch load at address 0x4", "Cosim mismatch PC mismatch", "Cosim mismatch other",
    "Check failed (uvm_hdl_read(x))", "Cannot get clk_if", "Please specify test binary", "Cannot open file /a/b", "Base class task should not be used", "Check failed signature_data after a memory fault", "some other text", "",
]


def q_fatal_kinds(spark, d):
    """Every fixed rule on reports that are built from the parts' names."""
    p = _t(spark, d, "part")
    report = F.get(F.array(*[F.lit(r) for r in _REPORTS]), (F.col("p_partkey") % len(_REPORTS)).cast("int"))
    text = F.when(report == "", "").otherwise(F.concat(F.lit("UVM_FATAL "), report, F.lit(" in "), "p_name"))
    return p.select("p_partkey", R.classify(text, X.normalise_message(text)).alias("kind"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


KINDS_SQL = f"""WITH r AS (SELECT p_partkey, p_name, ([{", ".join(map(_quoted, _REPORTS))}])[p_partkey % {len(_REPORTS)} + 1] AS report FROM part),
t AS (SELECT p_partkey, CASE WHEN report = '' THEN '' ELSE 'UVM_FATAL ' || report || ' in ' || p_name END AS value FROM r), n AS (SELECT *, {_normal_sql("value")} AS norm FROM t)
SELECT p_partkey, CASE {" ".join(f"WHEN regexp_matches(value, {_quoted('(?i)' + p)}) OR regexp_matches(norm, {_quoted('(?i)' + p)}) THEN '{k}'" for k, p in R.FATAL_RULES)} WHEN norm <> '' THEN '{R.OTHER_FATAL}' ELSE '' END AS kind FROM n"""


def q_byte_budget(spark, d):
    return parsing.within_budget(_lines(spark, d), 2000).groupBy("case_id").agg(F.count("*").alias("n_lines"), F.max("line_no").cast("long").alias("last_line"))


BUDGET_SQL = f"""WITH {_LINES}, r AS (SELECT case_id, line_no, sum(length(value) + 1) OVER (PARTITION BY case_id ORDER BY line_no) AS used FROM l)
SELECT case_id, count(*) AS n_lines, max(line_no)::BIGINT AS last_line FROM r WHERE used <= 2000 GROUP BY case_id"""


def _regr_lines(spark, d):
    """A regression log per user, from the event's number; every kind of line occurs in every order."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _t(spark, d, "events").withColumn("line_no", F.row_number().over(w))
    e, k = F.col("event_id"), F.regexp_extract("props", '"k": *([0-9]+)', 1)
    m = _mnemonic()
    value = (
        F.when(e % 13 == 1, F.concat(F.lit("Mismatch["), e, F.lit("]:")))
        .when(e % 13 == 2, F.concat(F.lit("ibex["), e, F.lit("] : pc[8000AB"), k, F.lit("] "), m, F.lit("\tx1")))
        .when(e % 13 == 3, F.concat(F.lit("spike["), e, F.lit("] : pc[80000000] "), m, F.lit(" x2")))
        .when(e % 13 == 4, F.concat(F.lit("[FAILED]: "), e, F.lit(" matched, "), k, F.lit(" mismatch")))
        .when(e % 97 == 5, F.concat(F.lit("  riscv_"), k, F.lit("."), e, F.lit(" : [FAILED]")))
        .otherwise(F.concat(F.lit("noise "), e))
    )
    return ev.select(F.col("user_id").alias("case_id"), "line_no", value.alias("value"))


def q_parse_regr(spark, d):
    return parsing.parse_regr(_regr_lines(spark, d))


_M = "CASE event_type WHEN 'view' THEN 'auipc' WHEN 'signup' THEN 'sw' WHEN 'click' THEN 'c.j' WHEN 'error' THEN 'addi' WHEN 'purchase' THEN 'lw' END"
REGR_SQL = f"""
WITH e AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_id AS e, regexp_extract(props, '"k": *([0-9]+)', 1) AS k, {_M} AS m FROM events),
x AS (SELECT *, CASE WHEN e % 13 = 1 THEN 'm' WHEN e % 13 = 2 THEN 'i' WHEN e % 13 = 3 THEN 's' WHEN e % 13 = 4 THEN 'c' WHEN e % 97 = 5 THEN 'f' END AS t FROM e),
y AS (SELECT *, min(line_no) FILTER (t = 'm') OVER (PARTITION BY case_id) AS m0, min(line_no) FILTER (t = 'f') OVER (PARTITION BY case_id) AS f0 FROM x WHERE t IS NOT NULL),
z AS (SELECT *, min(line_no) FILTER (t = 'i' AND line_no >= m0) OVER (PARTITION BY case_id) AS i0, min(line_no) FILTER (t = 's' AND line_no >= m0) OVER (PARTITION BY case_id) AS s0,
  min(line_no) FILTER (t = 'c' AND line_no >= m0) OVER (PARTITION BY case_id) AS c0, f0 IS NOT NULL AND (m0 IS NULL OR f0 < m0) AS failed FROM y),
u AS (SELECT *, line_no >= m0 AND NOT failed AND (i0 IS NULL OR s0 IS NULL OR c0 IS NULL OR line_no <= greatest(i0, s0, c0)) AS used FROM z)
SELECT case_id, CASE WHEN bool_or(failed) THEN 'failed_only' WHEN bool_or(m0 IS NOT NULL) THEN 'mismatch' ELSE 'unknown' END AS kind,
  CASE WHEN bool_or(failed) THEN arg_min('riscv_' || k, line_no) FILTER (t = 'f') ELSE '' END AS test_name,
  coalesce(arg_max(e, line_no) FILTER (t = 'i' AND used), 0)::BIGINT AS retire_index, coalesce(arg_max(m, line_no) FILTER (t = 'i' AND used), '') AS ibex_mnemonic, coalesce(arg_max(m, line_no) FILTER (t = 's' AND used), '') AS spike_mnemonic,
  coalesce(arg_max('8000ab' || k, line_no) FILTER (t = 'i' AND used), '') AS ibex_pc, coalesce(arg_max(e, line_no) FILTER (t = 'c' AND used), 0)::BIGINT AS matched_count, coalesce(arg_max(k, line_no) FILTER (t = 'c' AND used), '0')::BIGINT AS mismatch_count
FROM u GROUP BY case_id"""


def _sim_lines(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _t(spark, d, "events").withColumn("line_no", F.row_number().over(w))
    e, k = F.col("event_id"), F.regexp_extract("props", '"k": *([0-9]+)', 1)
    value = (
        F.when(e % 11 == 1, F.concat(F.lit("UVM_ERROR /a/b.sv("), e, F.lit(") @ "), e, F.lit(": reporter [ASSERT FAILED] [top.u"), k, F.lit("] Prop: x")))
        .when(e % 11 == 2, F.concat(F.lit("UVM_ERROR /a/b.sv(1) @ 7: reporter [ASSERT FAILED] [a.b.c] P"), k, F.lit(": 0x"), k))
        .when(e % 41 == 3, F.concat(F.lit("UVM_FATAL /x/y/core_"), k, F.lit(".sv(12) @ 900: t [t] "), F.when(e % 2 == 0, "TEST TIMEOUT!!").otherwise("No dret detected")))
        .when(e % 41 == 4, F.lit("UVM_FATAL :    1"))
        .when(e % 29 == 5, F.concat(F.lit("cmd +UVM_TESTNAME=t_"), k, F.lit(" +x")))
        .when(e % 53 == 6, F.lit("--- RISC-V UVM TEST FAILED ---"))
        .otherwise(F.lit("noise"))
    )
    return ev.select(F.col("user_id").alias("case_id"), "line_no", value.alias("value"))


def q_parse_sim(spark, d):
    s = parsing.parse_sim(_sim_lines(spark, d))
    return s.select("case_id", "verdict", "fatal_kind", "fatal_source", "fatal_template", F.array_join("error_asserts", ",").alias("error_asserts"), "uvm_testname", F.array_join("error_messages", ";").alias("error_messages"))


SIM_SQL = """
WITH e AS (SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_id AS e, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events),
x AS (SELECT *, CASE WHEN e % 11 = 1 THEN 'a' WHEN e % 11 = 2 THEN 'p' WHEN e % 41 = 3 THEN 'f' WHEN e % 41 = 4 THEN 'n' WHEN e % 29 = 5 THEN 't' WHEN e % 53 = 6 THEN 'v' END AS t FROM e),
y AS (SELECT *, CASE t WHEN 'a' THEN 'UVM_ERROR <PATH>(<N>) @<T>: reporter [ASSERT FAILED] [top.u' || k || '] Prop: x' WHEN 'p' THEN 'UVM_ERROR <PATH>(<N>) @<T>: reporter [ASSERT FAILED] [a.b.c] P' || k || ': <HEX>' END AS msg,
  sum(CASE WHEN t IN ('a', 'p') THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY line_no) AS nth FROM x)
SELECT case_id, coalesce(max(CASE WHEN t = 'v' THEN 'failed' END), '') AS verdict, coalesce(arg_min(CASE WHEN e % 2 = 0 THEN 'test_timeout' ELSE 'no_dret' END, line_no) FILTER (t = 'f'), '') AS fatal_kind,
  coalesce(arg_min('core_' || k || '.sv', line_no) FILTER (t = 'f'), '') AS fatal_source,
  coalesce(arg_min('UVM_FATAL @<T>: t [t] ' || CASE WHEN e % 2 = 0 THEN 'TEST TIMEOUT!!' ELSE 'No dret detected' END, line_no) FILTER (t = 'f'), '') AS fatal_template,
  coalesce(array_to_string(list_sort(list(DISTINCT CASE t WHEN 'a' THEN 'u' || k WHEN 'p' THEN 'P' || k END) FILTER (t IN ('a', 'p'))), ','), '') AS error_asserts,
  coalesce(arg_min('t_' || k, line_no) FILTER (t = 't'), '') AS uvm_testname, coalesce(string_agg(msg, ';' ORDER BY line_no) FILTER (nth <= 8 AND msg IS NOT NULL), '') AS error_messages
FROM y WHERE t IS NOT NULL AND t <> 'n' GROUP BY case_id"""


def q_trace_rows(spark, d):
    """The trace parser on lines: numbers what parses, and only that."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ev = _t(spark, d, "events").withColumn("line_no", F.row_number().over(w))
    k = F.regexp_extract("props", '"k": *([0-9]+)', 1)
    value = F.when(F.col("event_id") % 9 == 0, "Time Cycle PC Insn Decoded").otherwise(F.concat(F.lit("  "), F.col("event_id"), F.lit("\t"), k, F.lit("\tABC"), k, F.lit("\t00ff\t"), _mnemonic(), F.lit("\tx1,x2")))
    return parsing.trace_rows(ev.select(F.col("user_id").alias("case_id"), "line_no", value.alias("value")))


ROWS_SQL = f"""SELECT user_id AS case_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS retire_no, 'abc' || regexp_extract(props, '"k": *([0-9]+)', 1) AS pc, {_M} AS mnemonic FROM events WHERE event_id % 9 <> 0"""


def q_trace_summary(spark, d):
    t = parsing.summarise_trace(_trace(spark, d))
    joined = {c: F.array_join(c, " ").alias(c) for c in ("mnemonics", "loop_mnems", "mismatch_context_mnemonics")}
    return t.select("case_id", joined["mnemonics"], joined["loop_mnems"], "unique_pcs", "total", "has_repeating_tail", "tail_text", "length_bucket", F.round("tail_uniformity", 6).alias("tail_uniformity"), joined["mismatch_context_mnemonics"].alias("context"), "has_signature_loop")


SUMMARY_SQL = f"""WITH {_SUMMARY} SELECT case_id, mnemonics, loop_mnems, unique_pcs, total, has_repeating_tail, tail_text, length_bucket, round(tail_uniformity, 6) AS tail_uniformity, array_to_string(context, ' ') AS context, has_signature_loop FROM summary"""


def q_length_bucket(spark, d):
    o = _t(spark, d, "orders")
    total = F.floor("o_totalprice")
    return o.select("o_orderkey", X.length_bucket(total).alias("length_bucket"), X.retire_bucket(total).alias("retire_bucket"), is_early(F.lit("mismatch"), total, F.col("o_custkey")).alias("early"))


LENGTH_SQL = """SELECT o_orderkey, CASE WHEN floor(o_totalprice) < 1000 THEN 'short' WHEN floor(o_totalprice) < 10000 THEN 'medium' WHEN floor(o_totalprice) < 100000 THEN 'long' ELSE 'huge' END AS length_bucket,
  least(floor(floor(o_totalprice) / 100), 999)::BIGINT AS retire_bucket, floor(o_totalprice) < 200 OR (o_custkey > 0 AND o_custkey < 150) AS early FROM orders"""


def q_routes(spark, d):
    c = _t(spark, d, "conversations").groupBy(F.col("conv_id").alias("case_id")).agg(F.max("turn").alias("n"))
    regr = c.where("case_id % 4 <> 3").select("case_id", F.when(F.col("n") > 3, "mismatch").otherwise("failed_only").alias("kind"), F.col("n").alias("retire_index"))
    return routes(c, regr)


ROUTES_SQL = """WITH c AS (SELECT conv_id AS case_id, max(turn) AS n FROM conversations GROUP BY conv_id)
SELECT case_id, CASE WHEN case_id % 4 <> 3 AND n > 3 THEN 'trace' ELSE 'sim' END AS log, CASE WHEN case_id % 4 <> 3 AND n > 3 THEN n ELSE 0 END::BIGINT AS target FROM c"""


def q_signatures(spark, d):
    s = _cases(spark, d)
    return s.select("case_id", "failure_mode", "sim_fatal_kind", "sim_fatal_source", F.array_join("sim_error_asserts", ",").alias("asserts"), "regr_test_name", "trace_length_bucket", "has_repeating_tail", "has_signature_loop", F.round("tail_mnem_uniformity", 6).alias("uniformity"), "mismatch_retire_index", "mismatch_ibex_mnemonic", "mismatch_spike_mnemonic", F.array_join("mismatch_context_mnemonics", " ").alias("context"), "early_mismatch", "same_reg_pair")


SIGNATURES_SQL = f"""WITH {_CASES} SELECT case_id, mode AS failure_mode, kind AS sim_fatal_kind, source AS sim_fatal_source, array_to_string(asserts, ',') AS asserts, test AS regr_test_name, len_bucket AS trace_length_bucket, rep AS has_repeating_tail, loop_ AS has_signature_loop,
  round(uni, 6) AS uniformity, retire AS mismatch_retire_index, ibex AS mismatch_ibex_mnemonic, spike AS mismatch_spike_mnemonic, array_to_string(ctx, ' ') AS context, early AS early_mismatch, same AS same_reg_pair FROM sig"""

_REP = "repeat"
BLOB_SQL_EXPR = """trim(regexp_replace(CASE WHEN mode = 'mismatch' THEN 'MODE_mismatch MODE_mismatch LEN_' || len_bucket || CASE WHEN ibex <> '' THEN repeat(' IBEX_' || ibex, 3) ELSE '' END || CASE WHEN spike <> '' THEN repeat(' SPIKE_' || spike, 3) ELSE '' END
  || CASE WHEN ibex <> '' AND spike <> '' THEN repeat(' PAIR_' || ibex || '_' || spike, 3) ELSE '' END || CASE WHEN retire <> 0 THEN ' RETIRE_' || least(retire // 100, 999) ELSE '' END || CASE WHEN early THEN repeat(' EARLY_MISMATCH', 4) ELSE '' END
  || CASE WHEN same THEN repeat(' SAME_REG_PAIR', 4) ELSE '' END || CASE WHEN NOT loop_ THEN repeat(' NO_SIG_LOOP', 2) ELSE '' END || CASE WHEN len(ctx) > 0 THEN repeat(' CTX ' || array_to_string(ctx, ' '), 2) ELSE '' END
  || CASE WHEN loop_ THEN repeat(' SIG_LOOP', 3) ELSE '' END || CASE WHEN rep THEN repeat(' REPEAT_TAIL', 2) ELSE '' END || CASE WHEN uni >= 0.75 THEN ' UNIFORM_' || printf('%.2f', uni) ELSE '' END
  ELSE 'MODE_' || mode || ' REGR_failed_only' || CASE WHEN kind <> '' THEN repeat(' FATAL_' || kind, 3) ELSE '' END || CASE WHEN source <> '' THEN repeat(' FATALSRC_' || source, 2) ELSE '' END
  || array_to_string(list_transform(asserts, lambda x: repeat(' ASSERT_' || x, 3)), '') || CASE WHEN test <> '' THEN repeat(' REGRTEST_' || test, 2) ELSE '' END || ' UVMTEST_uvm_' || (case_id % 2) || ' ' || regexp_replace(message, '[^A-Za-z_]+', ' ', 'g') END, ' +', ' ', 'g'))"""


def q_text_blob(spark, d):
    return _cases(spark, d).select("case_id", F.regexp_replace("text_blob", " +", " ").alias("text_blob"), X.clean_blob(F.col("text_blob")).alias("cleaned"))


BLOB_SQL = f"""WITH {_CASES}, b AS (SELECT case_id, {BLOB_SQL_EXPR} AS text_blob FROM sig),
t AS (SELECT case_id, text_blob, list_filter(string_split(lower(text_blob), ' '), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in R.NOISE_TOKENS)}) AND NOT regexp_matches(x, '^uniform_[0-9.]+$')) AS ts FROM b)
SELECT case_id, text_blob, array_to_string(list_filter(ts, lambda x, i: i = 1 OR x <> ts[i - 1]), ' ') AS cleaned FROM t"""


def q_key_histogram(spark, d):
    """Bucket sizes per key, and each key's rank of first appearance."""
    labelled = clustering.cluster_signature(_cases(spark, d))
    return labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("ord").alias("first_case")).select(F.col("label").cast("long").alias("label"), "n", "first_case")


KEY_SQL = f"""WITH {_CASES}, k AS (SELECT ord, CASE WHEN mode = 'mismatch' THEN concat_ws('/', 'm', ibex, spike, loop_, len_bucket, rep, same, early) ELSE concat_ws('/', mode, kind, source, array_to_string(asserts, ','), test) END AS key FROM sig),
g AS (SELECT key, count(*) AS n, min(ord) AS first_case FROM k GROUP BY key) SELECT row_number() OVER (ORDER BY first_case) - 1 AS label, n, first_case FROM g"""


CLUSTER_SIGNATURE_SQL = KEY_SQL.split("\ng AS")[0] + """
r AS (SELECT key, row_number() OVER (ORDER BY min(ord)) - 1 AS label FROM k GROUP BY key) SELECT ord AS "Case", 'bucket_' || label AS bucket FROM k JOIN r USING (key)"""


def q_cluster_signature_orders(spark, d):
    o = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    keyed = o.select(F.col("o_orderkey"), F.concat_ws("/", "o_orderstatus", "o_orderpriority", "c_mktsegment").alias("key"))
    out = clustering.first_appearance(keyed, "key", "o_orderkey")
    return out.select("o_orderkey", X.bucket_name(F.col("label")).alias("bucket"))


ORDERS_SQL = """WITH k AS (SELECT o_orderkey, concat_ws('/', o_orderstatus, o_orderpriority, c_mktsegment) AS key FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT key, row_number() OVER (ORDER BY min(o_orderkey)) - 1 AS label FROM k GROUP BY key) SELECT o_orderkey, 'bucket_' || label AS bucket FROM k JOIN r USING (key)"""


def q_bucket_summary(spark, d):
    c = _cases(spark, d)
    s = clustering.summarise(c, clustering.cluster_signature(c))
    return s.select(F.col("label").cast("long").alias("label"), "n_cases", "failure_mode", "sim_fatal_kind", F.array_join(F.transform("cases", lambda x: x.cast("string")), ",").alias("cases"))


SUMMARISE_SQL = KEY_SQL.split("\ng AS")[0].rstrip().rstrip(",").replace("AS key FROM sig", "AS key, mode, kind FROM sig") + """,
g AS (SELECT key, count(*) AS n_cases, min(ord) AS f, arg_min(mode, ord) AS failure_mode, arg_min(kind, ord) AS sim_fatal_kind, string_agg(ord::VARCHAR, ',' ORDER BY ord) AS cases FROM k GROUP BY key)
SELECT row_number() OVER (ORDER BY f) - 1 AS label, n_cases, failure_mode, sim_fatal_kind, cases FROM g"""


def _items(spark, d):
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), "text")


def q_word_ngrams(spark, d):
    return vectors.term_counts(_items(spark, d), {"word": (1, 3)}).select("case_id", "term", "tf")


def q_char_ngrams(spark, d):
    return vectors.term_counts(_items(spark, d), {"char": (3, 6)}).select("case_id", "term", "tf")


_WORD = r"""w AS (SELECT item_id AS case_id, regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_<>]+') AS ts FROM benchmark),
wt AS (SELECT case_id, array_to_string(ts[i:i + n - 1], ' ') AS term FROM (SELECT case_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM w), range(1, 4) r(n) WHERE i + n - 1 <= len(ts)),
wc AS (SELECT case_id, term, count(*) AS tf FROM wt GROUP BY ALL)"""
_CHAR = r"""c0 AS (SELECT item_id AS case_id, ' ' || unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) || ' ' AS p FROM benchmark),
ct AS (SELECT case_id, substr(p, i, n) AS term FROM (SELECT case_id, p, unnest(range(1, length(p) + 1)) AS i FROM c0), range(3, 7) r(n) WHERE (i + n - 1 <= length(p)) OR (i = 1 AND n = 3)),
cc AS (SELECT case_id, term, count(*) AS tf FROM ct GROUP BY ALL)"""
_TFIDF = (
    _WORD
    + ",\n"
    + _CHAR
    + """,
tc AS (SELECT case_id, 'word' AS space, term, tf FROM wc UNION ALL SELECT case_id, 'char', term, tf FROM cc),
df AS (SELECT space, term, count(*) AS df FROM tc GROUP BY ALL),
rw AS (SELECT case_id, space, term, tf, df, (1 + ln(tf)) * (ln((1.0 + (SELECT count(*) FROM benchmark)) / (1 + df)) + 1) AS w FROM tc JOIN df USING (space, term)),
vec AS (SELECT case_id, space, term, w / sqrt(sum(w * w) OVER (PARTITION BY case_id, space)) AS weight FROM rw)"""
)


def q_tfidf(spark, d):
    return vectors.tfidf(_items(spark, d)).select("case_id", "space", "term", F.round("weight", 6).alias("weight"))


def q_cosines(spark, d):
    return vectors.cosines(vectors.tfidf(_items(spark, d))).select("a", "b", F.round("cosine", 6).alias("cosine"))


COSINE_SQL = f"""WITH {_TFIDF}, s AS (SELECT case_id, sqrt(sum(weight * weight)) AS size FROM vec GROUP BY case_id),
p AS (SELECT x.case_id AS a, y.case_id AS b, sum(x.weight * y.weight) AS dot FROM vec x JOIN vec y ON x.space = y.space AND x.term = y.term AND x.case_id < y.case_id GROUP BY ALL)
SELECT a, b, round(least(1.0, dot / (sa.size * sb.size)), 6) AS cosine FROM p JOIN s sa ON sa.case_id = a JOIN s sb ON sb.case_id = b"""


def q_set_and_place_overlap(spark, d):
    t = parsing.summarise_trace(_trace(spark, d)).select(F.col("case_id").alias("ord"), "loop_mnems", "mismatch_context_mnemonics")
    return distances.overlap_pairs(Saved(spark).save(t), "loop_mnems", "mismatch_context_mnemonics")


OVERLAP_SQL = f"""WITH {_SUMMARY}, t AS (SELECT case_id, string_split(loop_mnems, ' ') AS s, context AS c FROM summary)
SELECT a.case_id AS a, b.case_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE, 6) AS jaccard,
  CASE WHEN greatest(len(a.c), len(b.c)) = 0 THEN 1.0::DOUBLE ELSE round(len(list_filter(range(1, greatest(len(a.c), len(b.c)) + 1), lambda i: coalesce(a.c[i] = b.c[i], false))) / greatest(len(a.c), len(b.c))::DOUBLE, 6) END AS overlap
FROM t a JOIN t b ON a.case_id < b.case_id"""


def q_fatal_taxonomy(spark, d):
    kinds = ["", *[k for k, _ in R.FATAL_RULES], R.OTHER_FATAL]
    place = (F.col("c_custkey") % len(kinds)).cast("int")  # every kind has its customers
    n = _t(spark, d, "customer").select(place.alias("k")).distinct().select("k", F.get(F.array(*[F.lit(k) for k in kinds]), F.col("k")).alias("kind"))
    a, b = n.select(F.col("k").alias("a"), F.col("kind").alias("ka")), n.select(F.col("k").alias("b"), F.col("kind").alias("kb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", distances.fatal_distance(F.col("ka"), F.col("kb")).alias("distance"))


def _fatal_sql(a: str, b: str) -> str:
    both = lambda f: f"{a} IN ({', '.join(repr(k) for k in R.FAMILIES[f])}) AND {b} IN ({', '.join(repr(k) for k in R.FAMILIES[f])})"
    inside = lambda x, f: f"{x} IN ({', '.join(repr(k) for k in R.FAMILIES[f])})"
    cases = " ".join(f"WHEN {both(f)} THEN {by}::DOUBLE" for f, by in R.FAMILY_DISTANCE.items())
    return f"CASE WHEN {a} = {b} THEN 0.0::DOUBLE WHEN {a} = 'no_dret' OR {b} = 'no_dret' THEN 1.0::DOUBLE {cases} WHEN ({inside(a, 'timeout')} AND {inside(b, 'check')}) OR ({inside(a, 'check')} AND {inside(b, 'timeout')}) THEN {R.TIMEOUT_CHECK}::DOUBLE ELSE 1.0::DOUBLE END"


_ALL_KINDS = ", ".join(repr(k) for k in ["", *[k for k, _ in R.FATAL_RULES], R.OTHER_FATAL])
TAXONOMY_SQL = f"""WITH n AS (SELECT DISTINCT (c_custkey % 36)::INTEGER AS k, ([{_ALL_KINDS}])[c_custkey % 36 + 1] AS kind FROM customer)
SELECT a.k AS a, b.k AS b, {_fatal_sql("a.kind", "b.kind")} AS distance FROM n a JOIN n b ON a.k < b.k"""


def q_signature_distance(spark, d):
    return distances.distance_pairs(_cases(spark, d), with_text=False, digits={"signature": 6}).withColumnRenamed("signature", "distance")


def _pair_sql() -> str:
    overlap = "CASE WHEN greatest(len(a.ctx), len(b.ctx)) = 0 THEN 1.0::DOUBLE ELSE len(list_filter(range(1, greatest(len(a.ctx), len(b.ctx)) + 1), lambda i: coalesce(a.ctx[i] = b.ctx[i], false))) / greatest(len(a.ctx), len(b.ctx))::DOUBLE END"
    jac = "CASE WHEN len(a.asserts) + len(b.asserts) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a.asserts, b.asserts)) / len(list_distinct(list_concat(a.asserts, b.asserts)))::DOUBLE END"
    key = lambda x: f"CASE WHEN {x}.mode = 'mismatch' THEN concat_ws('/', 'm', {x}.ibex, {x}.spike, {x}.loop_, {x}.len_bucket, {x}.rep, {x}.same, {x}.early) ELSE concat_ws('/', {x}.mode, {x}.kind, {x}.source, array_to_string({x}.asserts, ','), {x}.test) END"
    cross = lambda m, o: f"CASE WHEN {o}.kind = 'no_dret' THEN (CASE WHEN {m}.early AND {m}.len_bucket = 'short' THEN 0.68 ELSE 0.92 END) WHEN {o}.mode = 'assert' AND len({o}.asserts) > 0 THEN 1.0 WHEN {o}.kind <> '' AND {m}.loop_ THEN 0.95 ELSE 1.0 END::DOUBLE"
    return f"""
p AS (SELECT a.ord AS a, b.ord AS b, {key("a")} = {key("b")} AS same_key, a.mode AS ma, b.mode AS mb,
  CASE WHEN a.ibex <> '' AND a.ibex <> b.ibex THEN 0.75::DOUBLE ELSE 0 END AS di, CASE WHEN a.spike <> '' AND a.spike <> b.spike THEN 0.75::DOUBLE ELSE 0 END AS ds,
  CASE WHEN a.len_bucket = b.len_bucket THEN 0.0::DOUBLE WHEN a.len_bucket = 'short' OR b.len_bucket = 'short' THEN 0.95 ELSE 0.6 END AS dl, (a.len_bucket = 'short') <> (b.len_bucket = 'short') AS one_short,
  1.0::DOUBLE - {overlap} AS dc, CASE WHEN a.loop_ <> b.loop_ THEN 0.80::DOUBLE ELSE 0 END AS dloop, CASE WHEN a.rep <> b.rep THEN 0.35::DOUBLE ELSE 0 END AS drep, CASE WHEN a.early <> b.early THEN 0.70::DOUBLE ELSE 0 END AS dearly,
  CASE WHEN a.same <> b.same THEN 0.85::DOUBLE ELSE 0 END AS dsame, abs(a.uni - b.uni) AS duni, a.spike <> '' AND a.spike = b.spike AS spike_same,
  {cross("a", "b")} AS cab, {cross("b", "a")} AS cba, {jac} AS asim, {_fatal_sql("a.kind", "b.kind")} AS fd,
  CASE WHEN a.source = b.source AND a.source <> '' THEN 0.0::DOUBLE ELSE 0.35 END AS src, CASE WHEN a.test = b.test AND a.test <> '' THEN 0.0::DOUBLE ELSE 0.35 END AS tst,
  (a.kind = 'no_dret' AND b.kind NOT IN ('', 'no_dret')) OR (b.kind = 'no_dret' AND a.kind NOT IN ('', 'no_dret')) AS dret, (len(a.asserts) > 0) <> (len(b.asserts) > 0) AS one_set, len(a.asserts) > 0 AS has_set
  FROM sig a JOIN sig b ON a.ord < b.ord),
m AS (SELECT *, least(1.0, 0.18 * di + 0.16 * ds + 0.24 * dc + 0.14 * dl + 0.10 * dloop + 0.05 * drep + 0.04 * duni + 0.04 * dearly + 0.05 * dsame) AS m0,
  greatest(CASE WHEN di > 0 AND ds > 0 THEN 0.80 ELSE 0 END, CASE WHEN one_short THEN 0.88 ELSE 0 END, CASE WHEN dloop > 0 THEN 0.82 ELSE 0 END, CASE WHEN dearly > 0 THEN 0.84 ELSE 0 END, CASE WHEN dsame > 0 THEN 0.88 ELSE 0 END)::DOUBLE AS floor_,
  CASE WHEN ma = mb THEN 0.0 WHEN asim >= 0.5 THEN 0.15 ELSE 0.45 END::DOUBLE AS pen FROM p),
dist AS (SELECT a, b, same_key, ma, mb, CASE WHEN same_key THEN 0.0::DOUBLE WHEN ma = 'mismatch' AND mb = 'mismatch' THEN (CASE WHEN spike_same THEN greatest(0.0, greatest(m0, floor_) - 0.16) ELSE greatest(m0, floor_) END)
  WHEN ma = 'mismatch' THEN cab WHEN mb = 'mismatch' THEN cba WHEN dret THEN 0.90 WHEN one_set THEN greatest(0.75, pen + 0.30 * fd + 0.30 * (1 - asim) + 0.10 * src)
  WHEN asim = 1 AND has_set THEN least(1.0, 0.20 * fd + 0.10 * pen) ELSE least(1.0, pen + 0.30 * fd + 0.30 * (1 - asim) + 0.10 * src + 0.05 * tst) END AS d FROM m)"""


DISTANCE_SQL = f"""WITH {_CASES}, {_pair_sql()} SELECT a, b, round(d, 6) AS distance FROM dist"""


_DOCS = BLOB_SQL.split("WITH ", 1)[1].rsplit("\nSELECT", 1)[0]  # the cases and their cleaned blobs' tokens, as t
HYBRID_SQL = f"""WITH {_DOCS}, {_pair_sql()},
docs AS (SELECT case_id AS item_id, array_to_string(list_filter(ts, lambda x, i: i = 1 OR x <> ts[i - 1]), ' ') AS text FROM t),
{_TFIDF.replace("benchmark", "docs")},
s AS (SELECT case_id, sqrt(sum(weight * weight)) AS size FROM vec GROUP BY case_id),
dots AS (SELECT x.case_id AS a, y.case_id AS b, sum(x.weight * y.weight) AS dot FROM vec x JOIN vec y ON x.space = y.space AND x.term = y.term AND x.case_id < y.case_id GROUP BY ALL),
cosine AS (SELECT a, b, least(1.0, dot / (sa.size * sb.size)) AS cosine FROM dots JOIN s sa ON sa.case_id = a JOIN s sb ON sb.case_id = b),
f AS (SELECT dist.a, dist.b, same_key, d, coalesce(cosine, 0.0) AS cosine, CASE WHEN ma = 'mismatch' AND mb = 'mismatch' THEN (CASE WHEN d < 0.72 THEN 0.96 ELSE 1.0 END) ELSE (CASE WHEN d < 0.72 THEN 0.85 ELSE 0.92 END) END::DOUBLE AS w
  FROM dist LEFT JOIN cosine ON cosine.a = dist.a AND cosine.b = dist.b)
SELECT a, b, round(d, 6) AS signature, round(cosine, 5) AS cosine, round(CASE WHEN same_key THEN 0.0::DOUBLE ELSE w * d + (1 - w) * (1 - cosine) END, 5) AS distance FROM f"""


def q_hybrid_matrix(spark, d):
    return distances.distance_pairs(_cases(spark, d), digits={"signature": 6, "cosine": 5, "distance": 5})


def _vectors(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


_VECTORS = "e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), p AS (SELECT x.vec_id AS a, y.vec_id AS b, sqrt(list_sum(list_transform(list_zip(x.v, y.v), lambda t: (t[1] - t[2]) * (t[1] - t[2])))) AS d FROM e x JOIN e y ON x.vec_id < y.vec_id)"


def q_radius_grid(spark, d):
    q = clustering.DENSITY_QUANTILES
    found = spark.createDataFrame(list(zip(q, nearest.pair_quantiles(_vectors(spark, d), q), strict=True)), "quantile double, r double")
    low, high = clustering.DENSITY_LIMITS
    return found.select("quantile", F.round("r", 5).alias("radius"), F.round(F.greatest(F.lit(low), F.least(F.lit(high), F.col("r"))), 5).alias("clipped"))


# the quantile must be a constant in an aggregate: one query each
RADIUS_SQL = f"WITH {_VECTORS}, r AS (" + " UNION ALL ".join(f"SELECT {x}::DOUBLE AS quantile, quantile_cont(d, {x}::DOUBLE) AS r FROM p" for x in clustering.DENSITY_QUANTILES) + ") SELECT quantile, round(r, 5) AS radius, round(greatest(0.05::DOUBLE, least(0.85::DOUBLE, r)), 5) AS clipped FROM r"


def q_second_neighbour(spark, d):
    return nearest.nth_distance(_vectors(spark, d), 2).select(F.col("id").alias("vec_id"), F.round("distance", 5).alias("distance"))


SECOND_SQL = f"""WITH {_VECTORS}, s AS (SELECT a AS v, d FROM p UNION ALL SELECT b, d FROM p)
SELECT v AS vec_id, round(d, 5) AS distance FROM (SELECT v, d, row_number() OVER (PARTITION BY v ORDER BY d) AS nth FROM s) WHERE nth = 2"""


def q_density_components(spark, d):
    """Groups of vectors within 1.2 of each other by chains: least member, by label propagation over the edges."""
    from faultweave.operators.components import components

    found = components(nearest.near_links(_vectors(spark, d), 1.2))
    return _t(spark, d, "embeddings").select("vec_id").join(found, F.col("vec_id") == F.col("node"), "left").select("vec_id", F.col("component"), F.col("component").isNull().alias("noise"))


DENSITY_SQL = f"""WITH RECURSIVE {_VECTORS}, g AS (SELECT a, b FROM p WHERE d <= 1.2 UNION SELECT b, a FROM p WHERE d <= 1.2),
r(v, c) AS (SELECT a, a FROM g UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v)
SELECT vec_id, c AS component, c IS NULL AS noise FROM embeddings LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) ON v = vec_id"""


def _clustered(method: str):
    def q(spark, d):
        return clustering.buckets(clustering.cluster(_cases(spark, d), 6, method))

    return q


def q_upgma_vectors(spark, d):
    v = _vectors(spark, d)
    return clustering.by_vectors(v.select(F.col("id").alias("case_id"), F.col("id").alias("ord"), "v"), 10)


def q_ascii_histogram(spark, d):
    h = _items(spark, d).select("case_id", F.posexplode(X.ascii_histogram(F.col("text"))).alias("code", "n"))
    return h.where("n > 0").select("case_id", F.col("code").cast("long").alias("code"), F.col("n").cast("long").alias("n"))


ASCII_SQL = """WITH c AS (SELECT item_id AS case_id, unnest(string_split(text, '')) AS x FROM benchmark) SELECT case_id, unicode(x)::BIGINT AS code, count(*) AS n FROM c WHERE unicode(x) BETWEEN 1 AND 127 GROUP BY ALL"""


def q_baseline_histograms(spark, d):
    """The baseline's three vectors a case: a user's events as report, trace and regression lines."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    ev = _t(spark, d, "events").select(F.col("user_id").alias("case_id"), F.row_number().over(w).alias("line_no"), "event_id", "event_type", "props")
    report = ev.select("case_id", "line_no", F.when(F.col("event_type") == "error", F.concat(F.lit("UVM_ERROR "), "props")).otherwise(F.col("event_type")).alias("value"))
    trace = ev.select("case_id", "line_no", F.concat(F.lit("  "), "line_no", F.lit(" 1 80 00ff "), "event_type", F.lit(" x1,x2")).alias("value"))
    cases = ev.select("case_id").distinct().select("case_id", F.col("case_id").alias("ord"))
    h = baselines.histograms(cases, ev.select("case_id", "line_no", F.col("props").alias("value")), report, trace)
    return h.select("case_id", F.posexplode("embedding").alias("place", "n")).where("n > 0").select("case_id", F.col("place").cast("long").alias("place"), F.col("n").cast("long").alias("n"))


HISTOGRAMS_SQL = """WITH ev AS (SELECT user_id AS case_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events),
parts AS (SELECT case_id, 0 AS base, 'UVM_ERROR ' || arg_min(props, i) AS value FROM ev WHERE event_type = 'error' GROUP BY case_id
  UNION ALL SELECT case_id, 128, event_type FROM ev WHERE back <= 10 UNION ALL SELECT case_id, 256, props || chr(10) FROM ev),
c AS (SELECT case_id, base, unicode(unnest(string_split(value, ''))) AS code FROM parts)
SELECT case_id, (base + code)::BIGINT AS place, count(*) AS n FROM c WHERE code BETWEEN 0 AND 127 GROUP BY ALL"""


def q_ward_characters(spark, d):
    items = _items(spark, d)
    h = items.select("case_id", F.col("case_id").alias("ord"), X.ascii_histogram(F.col("text")).alias("h"))
    return baselines.cluster_ward(h.select("case_id", "ord", F.concat("h", "h", "h").alias("embedding")), 5)


def q_stream_tails(spark, d):
    """The streaming tail over all events, run to its end."""
    from faultweave.streaming.tails import tails_of_stream, run_to_end

    source = _t(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events.parque[t]")
    rows = stream.select(F.col("user_id").alias("case_id"), F.col("event_id").alias("line_no"), F.regexp_extract("props", '"k": *([0-9]+)', 1).alias("pc"), _mnemonic().alias("mnemonic"))
    return run_to_end(tails_of_stream(rows))


STREAM_SQL = f"""WITH ev AS (SELECT user_id AS case_id, event_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS pc, {_M} AS mnemonic, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT case_id, max(total) AS total, count(DISTINCT pc) AS unique_pcs, string_agg(mnemonic, ' ' ORDER BY event_id) FILTER (back <= 16) AS tail_text FROM ev WHERE back <= 64 GROUP BY case_id"""

QUERIES = {
    "pair_counts": (q_pair_counts, PAIR_COUNTS_SQL),
    "balanced_accuracy": (q_balanced_accuracy, _accuracy_sql("documents", "lang", "source")),
    "embedding_accuracy": (q_embedding_accuracy, _accuracy_sql("embeddings", "label", "vec_id % 10")),
    "label_validation": (q_label_validation, LABEL_SQL),
    "derived_k": (q_derived_k, "SELECT count(DISTINCT label) AS k FROM embeddings"),
    "normalise_message": (q_normalise_message, f"SELECT page_id, {_normal_sql('url')} AS url, md5({_normal_sql('html')}) AS html_md5 FROM pages"),
    "first_last_match": (q_first_last_match, FIRST_SQL),
    "rule_classifier": (q_rule_classifier, RULES_SQL),
    "fatal_kinds": (q_fatal_kinds, KINDS_SQL),
    "byte_budget": (q_byte_budget, BUDGET_SQL),
    "parse_regr": (q_parse_regr, REGR_SQL),
    "parse_sim": (q_parse_sim, SIM_SQL),
    "trace_rows": (q_trace_rows, ROWS_SQL),
    "trace_summary": (q_trace_summary, SUMMARY_SQL),
    "length_bucket": (q_length_bucket, LENGTH_SQL),
    "routes": (q_routes, ROUTES_SQL),
    "signatures": (q_signatures, SIGNATURES_SQL),
    "text_blob": (q_text_blob, BLOB_SQL),
    "key_histogram": (q_key_histogram, KEY_SQL),
    "cluster_signature_orders": (q_cluster_signature_orders, ORDERS_SQL),
    "bucket_summary": (q_bucket_summary, SUMMARISE_SQL),
    "word_ngrams": (q_word_ngrams, f"WITH {_WORD} SELECT case_id, term, tf FROM wc"),
    "char_ngrams": (q_char_ngrams, f"WITH {_CHAR} SELECT case_id, term, tf FROM cc"),
    "tfidf": (q_tfidf, f"WITH {_TFIDF} SELECT case_id, space, term, round(weight, 6) AS weight FROM vec"),
    "cosines": (q_cosines, COSINE_SQL),
    "set_and_place_overlap": (q_set_and_place_overlap, OVERLAP_SQL),
    "fatal_taxonomy": (q_fatal_taxonomy, TAXONOMY_SQL),
    "signature_distance": (q_signature_distance, DISTANCE_SQL),
    "hybrid_matrix": (q_hybrid_matrix, HYBRID_SQL),
    "radius_grid": (q_radius_grid, RADIUS_SQL),
    "second_neighbour": (q_second_neighbour, SECOND_SQL),
    "density_components": (q_density_components, DENSITY_SQL),
    "cluster_signature": (_clustered("signature"), CLUSTER_SIGNATURE_SQL),
    "cluster_tfidf": (_clustered("tfidf"), None),
    "cluster_hybrid": (_clustered("hybrid"), None),
    "cluster_signature_then_tfidf": (_clustered("signature_then_tfidf"), None),
    "cluster_dbscan": (_clustered("dbscan"), None),
    "cluster_dbscan_pca": (_clustered("dbscan_pca"), None),
    "upgma_vectors": (q_upgma_vectors, None),
    "ascii_histogram": (q_ascii_histogram, ASCII_SQL),
    "baseline_histograms": (q_baseline_histograms, HISTOGRAMS_SQL),
    "ward_characters": (q_ward_characters, None),
    "stream_tails": (q_stream_tails, STREAM_SQL),
}
