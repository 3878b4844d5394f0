"""Distances between two signature rows as Column expressions over prefixes ``a_`` (the earlier row) and ``b_``."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions import rules as R
from faultweave.functions import text as X
from faultweave.operators import kernels as K
from faultweave.operators.components import MAX_BROADCAST
from faultweave.operators.signatures import categorical_key
from faultweave.operators.vectors import cosines, tfidf

#: Rows of two cases that one task makes, about; tasks and rows of a batch at most.
ROWS_A_PART, MAX_PARTS, ROWS_A_BATCH = 20_000_000, 2000, 100_000
#: Items of arrays that are broadcast, for each case that may be; values that are looked up in a table at most.
ITEMS_A_CASE, TABLE = 8, 2**20


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are alike."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap(a: Column, b: Column) -> Column:
    """Equal places over the longer length; two empty arrays are alike."""
    longer = F.greatest(F.size(a), F.size(b))
    equal = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() & y.isNotNull() & (x == y)), lambda e: e))
    return F.when(longer == 0, F.lit(1.0)).otherwise(equal / longer)


def fatal_distance(a: Column, b: Column) -> Column:
    """Between two kinds of fatal report, by family."""
    inside = {name: (a.isin(kinds), b.isin(kinds)) for name, kinds in R.FAMILIES.items()}
    out = F.when(a == b, F.lit(0.0)).when((a == "no_dret") | (b == "no_dret"), F.lit(1.0))
    for name, (x, y) in inside.items():
        out = out.when(x & y, F.lit(R.FAMILY_DISTANCE[name]))
    crossed = (inside["timeout"][0] & inside["check"][1]) | (inside["timeout"][1] & inside["check"][0])
    return out.when(crossed, F.lit(R.TIMEOUT_CHECK)).otherwise(F.lit(1.0))


def _pair(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def _differs(name: str, by: float) -> Column:
    a, b = _pair(name)
    return F.when(a != b, F.lit(by)).otherwise(F.lit(0.0))


def mismatch_distance() -> Column:
    """Both rows are mismatches. Not symmetric where the earlier row lacks a mnemonic."""
    ibex_a, ibex_b = _pair("mismatch_ibex_mnemonic")
    spike_a, spike_b = _pair("mismatch_spike_mnemonic")
    len_a, len_b = _pair("trace_length_bucket")
    short_a, short_b = len_a == "short", len_b == "short"
    ibex = F.when((ibex_a != "") & (ibex_a != ibex_b), 0.75).otherwise(0.0)
    spike = F.when((spike_a != "") & (spike_a != spike_b), 0.75).otherwise(0.0)
    length = F.when(len_a == len_b, 0.0).when(short_a | short_b, 0.95).otherwise(0.6)
    context = 1.0 - F.col("places")
    flags = [("has_signature_loop", 0.80), ("has_repeating_tail", 0.35), ("early_mismatch", 0.70), ("same_reg_pair", 0.85)]
    loop, repeat, early, same = (_differs(n, by) for n, by in flags)
    uni_a, uni_b = _pair("tail_mnem_uniformity")
    # fixed values: weights, then floors in order
    terms = [(0.18, ibex), (0.16, spike), (0.24, context), (0.14, length), (0.10, loop), (0.05, repeat), (0.04, F.abs(uni_a - uni_b)), (0.04, early), (0.05, same)]
    score = F.least(F.lit(1.0), reduce(lambda x, y: x + y, [w * d for w, d in terms]))
    raised = [(0.80, (ibex > 0) & (spike > 0)), (0.88, short_a != short_b), (0.82, loop > 0), (0.84, early > 0), (0.88, same > 0)]
    # greatest() skips nulls: each floor counts where its condition holds, and the score is written once
    score = F.greatest(score, *[F.when(when, F.lit(floor)) for floor, when in raised])
    return F.greatest(F.lit(0.0), score - F.when((spike_a != "") & (spike_a == spike_b), F.lit(0.16)).otherwise(F.lit(0.0)))


def cross_mode_distance() -> Column:
    """Just one of the rows is a mismatch."""

    def seen(m: str, o: str) -> Column:
        mode, kind, asserts = F.col(f"{o}_failure_mode"), F.col(f"{o}_sim_fatal_kind"), F.col(f"{o}_sim_error_asserts")
        near = F.col(f"{m}_early_mismatch") & (F.col(f"{m}_trace_length_bucket") == "short")
        return F.when(kind == "no_dret", F.when(near, 0.68).otherwise(0.92)).when((mode == "assert") & (F.size(asserts) > 0), 1.0).when((kind != "") & F.col(f"{m}_has_signature_loop"), 0.95).otherwise(1.0)

    return F.when(F.col("a_failure_mode") == "mismatch", seen("a", "b")).otherwise(seen("b", "a"))


def other_distance() -> Column:
    """Neither row is a mismatch."""
    (kind_a, kind_b), (set_a, set_b), (mode_a, mode_b) = _pair("sim_fatal_kind"), _pair("sim_error_asserts"), _pair("failure_mode")
    alike = F.col("alike")
    penalty = F.when(mode_a == mode_b, 0.0).when(alike >= 0.5, 0.15).otherwise(0.45)
    fatal, asserts = fatal_distance(kind_a, kind_b), 1.0 - alike
    known = lambda name: F.when((_pair(name)[0] == _pair(name)[1]) & (_pair(name)[0] != ""), 0.0).otherwise(0.35)
    source, test = known("sim_fatal_source"), known("regr_test_name")
    no_dret = ((kind_a == "no_dret") & (kind_b != "") & (kind_b != "no_dret")) | ((kind_b == "no_dret") & (kind_a != "") & (kind_a != "no_dret"))
    base = penalty + 0.30 * fatal + 0.30 * asserts + 0.10 * source
    return (
        F.when(no_dret, F.lit(0.90))
        .when((F.size(set_a) > 0) != (F.size(set_b) > 0), F.greatest(F.lit(0.75), base))
        .when((alike == 1.0) & (F.size(set_a) > 0), F.least(F.lit(1.0), 0.20 * fatal + 0.10 * penalty))
        .otherwise(F.least(F.lit(1.0), base + 0.05 * test))
    )


def signature_distance() -> Column:
    a, b = F.col("a_failure_mode") == "mismatch", F.col("b_failure_mode") == "mismatch"
    return F.when(a & b, mismatch_distance()).when(a != b, cross_mode_distance()).otherwise(other_distance())


def blend(signature: Column, cosine_distance: Column) -> Column:
    """Signature and text distance; the text counts for more while the signatures are near."""
    both = (F.col("a_failure_mode") == "mismatch") & (F.col("b_failure_mode") == "mismatch")
    near = signature < 0.72
    w = F.when(both, F.when(near, 0.96).otherwise(1.0)).otherwise(F.when(near, 0.85).otherwise(0.92))
    return w * signature + (1.0 - w) * cosine_distance


#: What the distance of two signature rows depends on.
RELEVANT = [
    "failure_mode", "regr_test_name", "sim_fatal_kind", "sim_fatal_source", "sim_error_asserts", "trace_length_bucket", "has_repeating_tail", "has_signature_loop", "tail_mnem_uniformity",
    "mismatch_ibex_mnemonic", "mismatch_spike_mnemonic", "mismatch_context_mnemonics", "early_mismatch", "same_reg_pair",
]


def alike(cases: DataFrame, with_text: bool = True) -> DataFrame:
    """The cases with their key, their prepared text and ``cls``, which rows have in common that no distance tells apart."""
    text = X.or_placeholder(X.clean_blob(F.col("text_blob")), F.col("ord")) if with_text else F.lit("")
    named = cases.withColumn("key", categorical_key()).withColumn("text", text)
    return named.withColumn("cls", F.xxhash64(*RELEVANT, "key", "text"))


def class_pairs(named: DataFrame) -> DataFrame:
    """(a, b, signature, cosine, distance) for the classes of ``alike`` rows, a's row being the earlier one; a pair has both orders if both occur.

    Distances are a value per pair by definition, but failing cases come in many like ones: the pairs are those of unlike rows.
    """
    classes = named.groupBy("cls").agg(F.min("ord").alias("ord"), F.max("ord").alias("last"), *[F.first(c).alias(c) for c in (*RELEVANT, "key", "text")])
    a = classes.select(*[F.col(c).alias(f"a_{c}") for c in classes.columns])
    b = classes.select(*[F.col(c).alias(f"b_{c}") for c in classes.columns])
    pairs = a.join(b, (F.col("a_ord") < F.col("b_last")) & (F.col("a_cls") != F.col("b_cls")))
    pairs = pairs.withColumn("alike", jaccard(*_pair("sim_error_asserts"))).withColumn("places", overlap(*_pair("mismatch_context_mnemonics")))
    same = F.col("a_key") == F.col("b_key")
    pairs = pairs.withColumn("signature", F.when(same, 0.0).otherwise(signature_distance()))
    texts = named.groupBy(F.xxhash64("text").alias("case_id")).agg(F.first("text").alias("text"), F.count("*").alias("n"))
    near = cosines(tfidf(texts)).select(F.col("a").alias("x"), F.col("b").alias("y"), "cosine")
    x, y = F.xxhash64("a_text"), F.xxhash64("b_text")
    pairs = pairs.withColumn("x", F.least(x, y)).withColumn("y", F.greatest(x, y)).join(near, ["x", "y"], "left")
    pairs = pairs.withColumn("cosine", F.when(F.col("x") == F.col("y"), 1.0).otherwise(F.coalesce("cosine", F.lit(0.0))))
    away = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1.0 - F.col("cosine")))
    pairs = pairs.withColumn("distance", F.when(same, 0.0).otherwise(blend(F.col("signature"), away)))
    return pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"), "signature", "cosine", "distance")


def spread(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """``pairs(a, b, values)`` of classes as rows of all cases ``members(cls, ord)``, ``a`` and ``b`` being ords a < b.

    A row per two cases is by far more than what it is made of, so no such row is moved or looked up: a
    class's values are laid over all cases once, and each of its cases gives those after it as a slice.
    The cases' ords and classes are two numbers each; beyond what is broadcast at most they are joined.
    """
    n = members.count()
    if n > MAX_BROADCAST:
        a, b = (members.select(F.col("cls").alias(k), F.col("ord").alias(f"{k}_ord")) for k in "ab")
        out = pairs.join(a, "a").join(b, "b").where("a_ord < b_ord")
        return out.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"), *[c for c in pairs.columns if c not in ("a", "b")])
    known = members.where("ord IS NOT NULL").select("cls", F.col("ord").cast("long").alias("ord")).toArrow().sort_by("ord")
    shared = pairs.sparkSession.sparkContext.broadcast((known.column("cls").to_numpy(), known.column("ord").to_numpy()))
    parts = F.floor(F.count("*") * F.lit(n) / F.lit(ROWS_A_PART)).cast("int")
    sizes = members.groupBy("cls").agg(parts.alias("last")).select(F.col("cls").alias("a"), F.explode(F.sequence(F.lit(0), "last")).alias("part"), "last")
    values = [c for c in pairs.columns if c not in ("a", "b")]
    dealt = pairs.join(F.broadcast(sizes), "a").select("a", "part", "last", "b", *values)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, ords = shared.value
        names, cls = np.unique(cls, return_inverse=True)

        def laid(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            own, part, last = (t.column(c)[0].as_py() for c in ("a", "part", "last"))
            at = np.full(len(names), -1)
            at[np.searchsorted(names, t.column("b").to_numpy())] = np.arange(t.num_rows)
            later = np.flatnonzero(at[cls] >= 0)  # the cases whose class has a row
            cols = [pa.array(ords[later]), *[t.column(c).combine_chunks().take(pa.array(at[cls[later]])) for c in values]]
            for a in ords[cls == np.searchsorted(names, own)][part :: last + 1].tolist():
                for s in range(int(np.searchsorted(ords[later], a, "right")), len(later), ROWS_A_BATCH):
                    here = [c.slice(s, ROWS_A_BATCH) for c in cols]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here[0]), a)), *here], names=["a", "b", *values])

        held: list[pa.RecordBatch] = []
        for rb in it:
            a, part = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            edges = np.flatnonzero((a[1:] != a[:-1]) | (part[1:] != part[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(a)], strict=True):
                if e > s:
                    if held and (held[0].column(0)[0].as_py(), held[0].column(1)[0].as_py()) != (a[s], part[s]):
                        yield from laid(held)
                        held = []
                    held.append(rb.slice(s, e - s))
        if held:
            yield from laid(held)

    tasks = max(1, min(MAX_PARTS, n * n // ROWS_A_PART))
    ddl = ", ".join(["a long", "b long", *[f"{c} {pairs.schema[c].dataType.simpleString()}" for c in values]])
    return dealt.repartition(tasks, "a", "part").sortWithinPartitions("a", "part").mapInArrow(run, ddl)


def text_cosines(texts: DataFrame) -> tuple[np.ndarray, K.Cosines]:
    """(ids in order, cosines of their rows) of ``texts(case_id, text, n)``."""
    ids = np.sort(texts.select("case_id").toArrow().column("case_id").to_numpy())
    w = tfidf(texts).select("case_id", F.xxhash64("space", "term").alias("term"), "weight").toArrow()
    row, term, weight = (w.column(c).to_numpy() for c in ("case_id", "term", "weight"))
    return ids, K.Cosines(len(ids), np.searchsorted(ids, row), term, weight)


def classes(named: DataFrame, with_text: bool = True) -> K.Classes:
    """The classes of ``alike`` rows, their texts' cosines too: they are far fewer than their pairs, and come to the driver to be broadcast."""
    found = named.groupBy("cls").agg(*[F.first(c).alias(c) for c in (*RELEVANT, "key")], F.first(F.xxhash64("text")).alias("text")).toArrow().sort_by("cls")
    if not with_text:
        return K.Classes(found)
    ids, cosines_ = text_cosines(named.groupBy(F.xxhash64("text").alias("case_id")).agg(F.first("text").alias("text"), F.count("*").alias("n")))
    return K.Classes(found, cosines_, np.searchsorted(ids, found.column("text").to_numpy()))


def in_tasks(spark: SparkSession, tasks: int, ddl: str, made: Callable[[int], Iterator[pa.RecordBatch]]) -> DataFrame:
    """The batches of ``made(t)`` for each t below ``tasks``."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for t in rb.column(0).to_pylist():
                yield from made(t)

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, ddl)


def sliced(a: int, cols: list[pa.Array], names: list[str], start: int = 0) -> Iterator[pa.RecordBatch]:
    """Case a's rows from ``start`` on, a batch at a time."""
    for s in range(start, len(cols[0]), ROWS_A_BATCH):
        here = [c.slice(s, ROWS_A_BATCH) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here[0]), a)), *here], names=names)


def distance_pairs(cases: DataFrame, with_text: bool = True, digits: dict[str, int] | None = None) -> DataFrame:
    """(a, b, signature, cosine, distance) for all pairs of signature rows with ``ord`` a < b; equal keys are at distance 0.

    ``digits`` rounds the columns named, once for two classes and not for each two cases. A class's distances
    are worked out where its cases' rows are made; too many cases to broadcast are joined with their classes' pairs.
    """
    named = alike(cases, with_text)
    n = named.count()
    if n > MAX_BROADCAST:
        own = named.select("cls").distinct().select(F.col("cls").alias("a"), F.col("cls").alias("b"), F.lit(0.0).alias("signature"), F.lit(1.0).alias("cosine"), F.lit(0.0).alias("distance"))
        pairs = class_pairs(named).unionByName(own)
        if not with_text:
            pairs = pairs.withColumn("cosine", F.lit(0.0)).withColumn("distance", F.col("signature"))
        if digits is not None:
            pairs = pairs.select("a", "b", *[F.round(c, d).alias(c) for c, d in digits.items()])
        return spread(pairs, named.select("cls", "ord"))
    wanted = digits or dict.fromkeys(("signature", "cosine", "distance"))
    kernel = classes(named, with_text)
    known = named.where("ord IS NOT NULL").select("cls", F.col("ord").cast("long").alias("ord")).toArrow().sort_by("ord")
    own, ords = np.searchsorted(kernel.cls, known.column("cls").to_numpy()), known.column("ord").to_numpy()
    size = np.bincount(own, minlength=len(kernel.cls))
    parts = size * n // ROWS_A_PART + 1
    items = np.stack([np.repeat(np.arange(len(size)), parts), np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts), np.repeat(parts, parts)], axis=1)
    items = items[np.argsort(-size[items[:, 0]] / items[:, 2], kind="stable")]
    tasks = max(1, min(MAX_PARTS, n * n // ROWS_A_PART))
    shared = cases.sparkSession.sparkContext.broadcast((kernel, own, ords, items))

    def made(t: int) -> Iterator[pa.RecordBatch]:
        kernel, own, ords, items = shared.value
        for i, part, parts in items[t::tasks].tolist():
            row = kernel.row(i)
            cols = [pa.array(ords), *[pa.array((row[c] if d is None else K.rounded(row[c], d))[own]) for c, d in wanted.items()]]
            for a in ords[own == i][part::parts].tolist():
                yield from sliced(a, cols, ["a", "b", *wanted], int(np.searchsorted(ords, a, "right")))

    return in_tasks(cases.sparkSession, tasks, ", ".join(["a long", "b long", *[f"{c} double" for c in wanted]]), made)


def overlap_pairs(rows: DataFrame, sets: str, places: str) -> DataFrame:
    """(a, b, jaccard, overlap) of the arrays ``sets`` and ``places`` for all pairs of ``rows`` with ``ord`` a < b, by 6 decimals.

    The arrays are broadcast as numbers, and a case's values are worked out where its rows are made. Too many
    to broadcast, or null arrays: the values of unlike rows are joined with the cases.
    """
    rows = rows.select("ord", sets, places)
    n, many, whole = rows.agg(F.count("*"), F.sum(F.coalesce(F.size(sets), F.lit(0)) + F.coalesce(F.size(places), F.lit(0))), F.count(F.when(F.col(sets).isNotNull() & F.col(places).isNotNull(), 1))).first()
    if n > MAX_BROADCAST or whole < n or (many or 0) > ITEMS_A_CASE * MAX_BROADCAST:
        return _overlaps_joined(rows, sets, places)
    known = rows.where("ord IS NOT NULL").withColumn("ord", F.col("ord").cast("long")).toArrow().sort_by("ord")
    n = known.num_rows
    shared = rows.sparkSession.sparkContext.broadcast((known.column("ord").to_numpy(), K.Sets(known.column(sets)), K.Places(known.column(places))))
    tasks = max(1, min(MAX_PARTS, n * n // ROWS_A_PART))

    def made(t: int) -> Iterator[pa.RecordBatch]:
        ords, sets, places = shared.value
        of, length, most, alike = sets.of.astype(np.int32), places.length.astype(np.int32), places.most, {}
        few = (most + 1) ** 2 <= TABLE
        longer, equal = np.divmod(np.arange((most + 1) ** 2 if few else 0), most + 1)
        table = K.rounded(np.where(longer == 0, 1.0, equal / np.maximum(longer, 1)), 6)
        for i in range(t, n, tasks):
            since = int(np.searchsorted(ords, ords[i], "right"))
            row = alike.get(of[i])
            if row is None:
                row = K.rounded(sets.jaccard(of[i]), 6)
                if len(row) ** 2 <= TABLE:
                    alike[of[i]] = row
            if few:
                overlap_ = table[np.maximum(length[i], length[since:]) * np.int32(most + 1) + places.equal(i, since)]
            else:
                overlap_ = K.rounded(places.overlap(i, since), 6)
            yield from sliced(int(ords[i]), [pa.array(ords[since:]), pa.array(row[of[since:]]), pa.array(overlap_)], ["a", "b", "jaccard", "overlap"])

    return in_tasks(rows.sparkSession, tasks, "a long, b long, jaccard double, overlap double", made)


def _overlaps_joined(rows: DataFrame, sets: str, places: str) -> DataFrame:
    named = rows.select("ord", sets, places, F.xxhash64(F.to_json(F.struct(sets, places), {"ignoreNullFields": "false"})).alias("cls"))
    classes = named.groupBy("cls").agg(F.min("ord").alias("ord"), F.max("ord").alias("last"), F.first(sets).alias("sets"), F.first(places).alias("places"))
    a, b = (classes.select(*[F.col(c).alias(f"{k}_{c}") for c in classes.columns]) for k in "ab")
    pairs = a.join(b, F.col("a_ord") < F.col("b_last"))
    pairs = pairs.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b"), F.round(jaccard(*_pair("sets")), 6).alias("jaccard"), F.round(overlap(*_pair("places")), 6).alias("overlap"))
    return spread(pairs, named.select("cls", "ord"))
