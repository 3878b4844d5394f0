"""Sharding by sampled splitters: sizes near equal, equal texts together, texts too large for a shard split.

Records are ordered by (hash of the text, hash of the id and the row): equal texts are neighbours, and any number
of equal rows can still be cut. A size-weighted sample of that order gives splitters; the ranges between them
are summed exactly, and overfull ones are split again from a denser sample of their own rows. Groups of equal
texts that are a notable part of a shard are put where they fit first; each other record's place in the cumulated bytes
picks its shard among the room that is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.llm._shared import Saved, table

#: Bytes of records aimed at in one range: a window over a range never sees much more than this.
RANGE_BYTES = 8 << 20
#: A group of equal texts that is more than this part of a shard gets its shard before all others; there are n_shards / NOTABLE of them at most.
NOTABLE = 0.01
SAMPLES_PER_RANGE = 24
MAX_SAMPLE = 200_000


def _splitters(rows: list, parts: int) -> list[tuple[int, int]]:
    """Weighted quantiles of a sample [(key, tie, size)]."""
    rows = sorted(rows)
    total, run, out = sum(r[2] for r in rows), 0, []
    for key, tie, size in rows:
        run += size
        if run * parts >= total * (len(out) + 1) and len(out) < parts - 1:
            while len(out) < parts - 1 and run * parts >= total * (len(out) + 1):
                out.append((key, tie))
    return sorted(set(out))


def _range_of(spark: SparkSession, df: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """Adds ``range``: how many cuts lie before (key, tie). The cuts are an array of at most MAX_SAMPLE pairs; a binary
    search in SQL: 18 halvings of an index into the constant array."""
    if not cuts:
        return df.withColumn("range", F.lit(0))
    steps = max(1, len(cuts)).bit_length()
    ck, ct = (F.split(F.lit(",".join(str(c[n]) for c in cuts)), ",").cast("array<bigint>") for n in (0, 1))  # folded to constants
    df = df.withColumn("range", F.lit(0))
    for step in reversed(range(steps)):
        probe = F.col("range") + (1 << step)
        at = F.when(probe <= len(cuts), probe).otherwise(1)
        k, t = F.get(ck, at - 1), F.get(ct, at - 1)
        before = (probe <= len(cuts)) & ((k < F.col("key")) | ((k == F.col("key")) & (t < F.col("tie"))))
        df = df.withColumn("range", F.when(before, probe).otherwise(F.col("range")))
    return df


def _fitted(groups: list[tuple[int, int]], n_shards: int, target: float) -> tuple[dict[int, int], list[float]]:
    """(key -> shard, room left) of groups (key, size), largest first, each where least room stays; one that fits nowhere gets none."""
    room, out = [target] * n_shards, {}
    for key, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        fits = [s for s in range(n_shards) if room[s] >= size]
        if fits:
            best = min(fits, key=lambda s: (room[s], s))
            out[key], room[best] = best, room[best] - size
    return out, room


def shard(spark: SparkSession, documents: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Put every row in one of ``n_shards`` by sampled splitters; the law is ``bytes``.

    Returns doc_id, size (UTF-8 bytes + 8; null text 8), text_crc32 (null text: that of ""), law,
    shard, slot (gapless from 0 in each shard), grown_shard (null under this law).
    Nulls and repeated ids are ordinary rows; repeated rows get slots of their own; an empty table
    gives no rows; other columns are ignored. Long texts only count by size. Equal texts are in one
    shard, unless they are more than a NOTABLE part of one and fit in no shard's room beside the larger
    groups: such are cut between shards. Shards differ by one small group or one record.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    saved = Saved(spark)
    rows = saved.save(
        documents.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text, F.col(text_col).isNull()).alias("key"),
            F.xxhash64(F.col(id_col).cast("long"), F.monotonically_increasing_id()).alias("tie"),
        )
    )
    total, largest = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("size"), F.lit(8))).first()
    most = MAX_SAMPLE // SAMPLES_PER_RANGE
    parts = max(n_shards, min(most, -(-total // range_bytes)))
    full_size, target = 2 * max(range_bytes, largest, -(-total // parts)), total / n_shards

    def drawn(of: DataFrame, weight: int, count: int, salt: int) -> list:
        # size-weighted, repeatable: a row is drawn with probability size * count / weight, so about MAX_SAMPLE rows at most
        share = F.least(F.lit(1.0), F.col("size") * (count / max(1, weight)))
        luck = (F.pmod(F.xxhash64("key", "tie", F.lit(salt)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
        return [tuple(r) for r in of.where(luck < share).select("key", "tie", F.greatest("size", F.lit(int(weight / max(1, count)))).alias("size")).collect()]

    cuts = _splitters(drawn(rows, total, parts * SAMPLES_PER_RANGE, 1), parts)
    for round_ in range(2, 5):
        full = _range_of(spark, rows, cuts).groupBy("range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("b") > full_size) & (F.col("n") > 1))
        over = [tuple(r) for r in full.collect()]  # no more than there are ranges
        if not over:
            break
        weight = sum(b for _, b, _ in over)
        more = min(most, -(-weight * 2 // full_size))
        inside = _range_of(spark, rows, cuts).join(F.broadcast(spark.createDataFrame([(r,) for r, _, _ in over], "range int")), "range", "left_semi")
        cuts = sorted(set(cuts) | set(_splitters(drawn(inside, weight, more * SAMPLES_PER_RANGE, round_), more + 1)))
    notable = rows.groupBy("key").agg(F.sum("size").alias("b"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("b") > NOTABLE * target) & (F.col("b") <= target))
    fixed, room = _fitted([(r["key"], r["b"]) for r in notable.collect()], n_shards, target)  # n_shards / NOTABLE rows at most
    given = spark.createDataFrame(list(fixed.items()), "key long, fixed int")
    ranged = _range_of(spark, rows, cuts).join(F.broadcast(given), "key", "left").withColumn("weight", F.when(F.col("fixed").isNull(), F.col("size")).otherwise(0))
    ranged = saved.save(ranged)
    before, b = [], 0
    for r in ranged.groupBy("range").agg(F.sum("weight").alias("b")).orderBy("range").collect():  # one row a range
        before.append((r["range"], b))
        b += r["b"]
    offsets = spark.createDataFrame(before, "range int, b0 long")
    inner = Window.partitionBy("range").orderBy("key", "tie")
    upto = inner.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = saved.save(ranged.withColumn("end", F.sum("weight").over(upto)).join(F.broadcast(offsets), "range").withColumn("start", F.col("b0") + F.col("end") - F.col("weight")).drop("b0", "end", "weight"))
    limits = F.array(*[F.lit(x) for x in _limits(placed.where("fixed IS NULL"), room, b, NOTABLE * target)]) if b else F.array()
    sharded = placed.withColumn("shard", F.coalesce("fixed", F.size(F.filter(limits.cast("array<long>"), lambda x: x <= F.col("start")))).cast("int"))
    sharded = saved.save(sharded.select("doc_id", "size", "text_crc32", "key", "tie", "range", "shard"))
    filled, firsts = [0] * n_shards, []
    for r in sharded.groupBy("range", "shard").agg(F.count("*").alias("n")).orderBy("range", "shard").collect():  # a row for a range and a few for each notable group
        firsts.append((r["range"], r["shard"], filled[r["shard"]]))
        filled[r["shard"]] += r["n"]
    nth = F.row_number().over(Window.partitionBy("range", "shard").orderBy("key", "tie"))
    return sharded.withColumn("nth", nth).join(F.broadcast(spark.createDataFrame(firsts, "range int, shard int, n0 long")), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("n0") + F.col("nth") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def _limits(stream: DataFrame, room: list[float], total: int, notable: float) -> list[int]:
    """Where each shard but the first begins in the cumulated bytes: at the edge of a group of equal texts, or of a record if the group is a notable one."""
    scale, at, wanted = total / sum(room), 0.0, []
    for r in room[:-1]:
        at += r * scale
        wanted.append(at)
    on = F.lit(False)
    for p in wanted:
        on = on | ((F.col("start") <= p) & (F.col("start") + F.col("size") > p))
    records = sorted((tuple(r) for r in stream.where(on).select("start", "size", "key").collect()))  # one for each shard
    keys = sorted({r[2] for r in records})
    spans = {r["key"]: (r["low"], r["b"]) for r in stream.where(F.col("key").isin(keys)).groupBy("key").agg(F.min("start").alias("low"), F.sum("size").alias("b")).collect()}
    out = []
    for p in wanted:
        start, size, key = next((r for r in records if r[0] <= p < r[0] + r[1]), (total, 0, None))
        if key is not None and spans[key][1] <= notable:
            start, size = spans[key]
        out.append(start if p - start < size / 2 else start + size)
    return out


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark, table(spark, sf_dir, "documents"))
