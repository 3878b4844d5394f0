"""Document fingerprints: bottom-k sketches of word shingles, in SQL functions only.

A sketch is the sorted array of the k smallest 64-bit hashes of a text's distinct shingles. Sketches
merge (the k smallest of both), count (k-th order statistic) and compare (k-minimum-values of the union).
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.llm._shared import SPACE, shuffle_partitions, table

#: Hashes kept, words in a shingle.
K, WORDS = 128, 5
_SPAN = 2.0**64


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE, -1), lambda w: w != "")


def sketch(text: Column, k: int = K, width: int = WORDS) -> Column:
    """The k smallest distinct hashes of the text's shingles of ``width`` words (a shorter text is one shingle; none: [])."""
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w))

    def shingles(h: Column) -> Column:
        at = lambda i, j: F.get(h, i + j)
        whole = F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(h)))
        return F.when(F.size(h) < width, whole).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[at(i, j) for j in range(width)])))

    # one pass over a one-element array names the hashes once instead of computing them for each use
    out = F.flatten(F.transform(F.array(hashes), shingles))
    return F.slice(F.sort_array(F.array_distinct(out)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both parts' shingles together."""
    return F.slice(F.sort_array(F.array_distinct(F.concat(a, b))), 1, k)


def distinct_estimate(s: Column, k: int = K) -> Column:
    """Distinct shingles: exact below k, else (k - 1) over the k-th smallest hash's place in the hash range."""
    kth = (F.element_at(s, -1).cast("double") + _SPAN / 2 + 1) / _SPAN
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / kth)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness: the share of the union's k smallest hashes that both have; two empty sketches: 1."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), both))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.size(both))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has; an empty a is contained in anything."""
    j = resemblance(a, b, k)
    both = j * (distinct_estimate(a, k) + distinct_estimate(b, k)) / (1 + j)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_estimate(a, k)))


def as_text(s: Column) -> Column:
    """Lower-case hex, 16 digits a hash, ascending as signed numbers."""
    return F.lower(F.concat_ws("", F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0"))))


def with_next(df: DataFrame, id_col: str, columns: list[str], ties: list[str], parts: int) -> DataFrame:
    """Adds ``next_<column>`` of the row next in order of ``id_col`` (nulls first, then by hashes of ``ties``); the last row's next is the first row.

    The order is cut into ranges at quantiles of the id; an id (or null) with more rows than a range is cut
    again by the first hash. Each range's first row is also sent to the range before it, so every
    range finds its last row's successor at home and text moves once.
    """
    spark = df.sparkSession
    cuts, nulls = df.select(F.percentile_approx(id_col, [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("c"), F.avg(F.col(id_col).isNull().cast("int")).alias("n")).first()
    found = Counter(cuts if cuts and parts > 1 else [])
    places = sorted(found)
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")  # noqa: E731  folded
    share = F.xxhash64(ties[0]) / _SPAN + 0.5
    within = F.lit(0)
    bucket = F.lit(0)
    if places:
        held, times = constant(places), constant([found[c] for c in places])
        steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(places).bit_length()))])
        bucket = F.aggregate(steps, F.lit(0), lambda at, k: F.when((at + k <= len(places)) & (F.get(held, at + k - 1) <= F.col(id_col)), at + k).otherwise(at))
        own = F.get(times, bucket - 1)
        within = F.when(own > 1, F.when(F.get(held, bucket - 1) == F.col(id_col), F.least(F.floor(share * own), own - 1)).otherwise(own)).otherwise(0)
    for_nulls = max(1, math.ceil((nulls or 0) * parts))
    of_null = F.least(F.floor(share * for_nulls), F.lit(for_nulls - 1))
    df = df.withColumn("_range", F.when(F.col(id_col).isNull(), of_null).otherwise((bucket + 1) * (parts + 1) + within).cast("long"))
    order = [F.col(id_col).asc_nulls_first(), *[F.xxhash64(c) for c in ties]]
    key = F.struct(F.col(id_col).isNotNull().alias("k"), F.coalesce(F.col(id_col), F.lit(0)).alias("i"), *[F.xxhash64(c).alias(f"h{n}") for n, c in enumerate(ties)])
    firsts = sorted((r for r in df.groupBy("_range").agg(F.min(key).alias("f")).collect()), key=lambda r: r["_range"])  # one small row a range
    if not firsts:
        return df.select(*[c for c in df.columns if c != "_range"], *[F.col(c).alias(f"next_{c}") for c in columns])
    lead_of = {r["_range"]: firsts[i - 1]["_range"] for i, r in enumerate(firsts)}
    first_rows = spark.createDataFrame([(r["_range"], lead_of[r["_range"]], r["f"]["k"], r["f"]["i"], [r["f"][f"h{n}"] for n in range(len(ties))]) for r in firsts], "_range long, _to long, _k boolean, _i long, _h array<long>")
    hashes = F.array(*[F.xxhash64(c) for c in ties])
    marked = df.join(F.broadcast(first_rows), "_range", "left")
    is_first = (F.col("_k") == F.col(id_col).isNotNull()) & (F.col("_i") == F.coalesce(F.col(id_col), F.lit(0))) & (F.col("_h") == hashes)
    # a sentinel copy of each range's first row closes the range before; the first range's closes the last
    goals = F.when(is_first, F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("s")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("s"))))
    spread = marked.withColumn("_goal", F.explode(goals)).select(*[c for c in df.columns if c != "_range"], F.col("_goal.r").alias("_range"), F.col("_goal.s").alias("_s"))
    w = Window.partitionBy("_range").orderBy(F.col("_s"), *order)
    return spread.select(*[c for c in spread.columns], *[F.lead(c).over(w).alias(f"next_{c}") for c in columns]).where("_s = 0").drop("_range", "_s")


def fingerprint(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WORDS) -> DataFrame:
    """Each document's sketch: (doc_id, sketch array<long>, fingerprint string, n_distinct double).

    Null and empty texts have the empty sketch; nulls and repeats in the id stay as rows; an empty
    table gives no rows; other columns are ignored. Equal texts have equal sketches at any length.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), sketch(F.col(text_col), k, width).alias("sketch"))
    return rows.select("doc_id", "sketch", as_text(F.col("sketch")).alias("fingerprint"), distinct_estimate(F.col("sketch"), k).alias("n_distinct"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(docs.withColumn("sketch", sketch(F.col("text"))), "doc_id", ["text", "sketch"], ["text"], shuffle_partitions(spark))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", "sketch", "next_sketch", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), sketch(F.col("edited")).alias("edited_sketch"))
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
