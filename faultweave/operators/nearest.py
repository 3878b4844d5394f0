"""Euclidean distances between all rows of a vector table, block by block.

Vectors are dealt to blocks of a bounded size and each two blocks meet in one task, which gives only
what is asked for: nearest distances, counts by bin, or a spanning forest of near pairs. So the work
is that of all pairs, but no row is made for a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors in a block, distances held at once, bins of the first count of distances.
BLOCK, HELD, BINS = 2000, 4_000_000, 65_536


def distances(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances of some rows of x from all of y)."""
    step = max(1, HELD // max(1, y.size))
    for s in range(0, len(x), step):
        yield s, np.sqrt(((x[s : s + step, None] - y[None]) ** 2).sum(axis=2))


def meet(vectors: DataFrame, work: Callable[..., Iterator[pa.RecordBatch]], ddl: str, block: int = BLOCK) -> DataFrame:
    """work(ids, x, other ids, y, same) for each two blocks of ``vectors(id, v)``; with ``same`` both are one block. Rows without a vector are left out."""
    rows = vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, -(-rows.count() // block))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("id", "v", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            ids, sides = t.column("id").to_numpy(), t.column("block").to_numpy()
            x = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            left = sides == key[0]
            right = left if key[0] == key[1] else ~left
            if left.any() and right.any():
                yield from work(ids[left], x[left], ids[right], x[right], key[0] == key[1])

        for rb in it:
            i, j = (rb.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            edges = np.flatnonzero((i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            for s, e in zip([0, *edges], [*edges, len(i)], strict=True):
                if e > s and (i[s], j[s]) != key:
                    yield from done()
                    key, held = (i[s], j[s]), []
                held.append(rb.slice(s, e - s))
        yield from done()

    return dealt.repartition("i", "j").sortWithinPartitions("i", "j", "id").mapInArrow(run, ddl)


def nth_distance(vectors: DataFrame, n: int, block: int = BLOCK) -> DataFrame:
    """(id, distance) of each vector from its n-th nearest other; with fewer others null. Ids are unique."""

    def work(ids, x, others, y, same) -> Iterator[pa.RecordBatch]:
        for a, p, q in ((ids, x, y),) if same else ((ids, x, y), (others, y, x)):
            for s, d in distances(p, q):
                if same:
                    d[np.arange(len(d)), s + np.arange(len(d))] = np.inf
                k = min(n, d.shape[1])
                near = np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(a[s : s + len(d)], k)), pa.array(near.ravel())], names=["id", "distance"])

    found = meet(vectors, work, "id long, distance double", block).where(F.col("distance") < float("inf"))
    found = found.groupBy("id").agg(F.get(F.sort_array(F.collect_list("distance")), F.lit(n - 1)).alias("distance"))
    return vectors.where("v IS NOT NULL").select(F.col("id").cast("long").alias("id")).join(found, "id", "left")


def pair_quantiles(vectors: DataFrame, quantiles: list[float], block: int = BLOCK) -> list[float | None]:
    """Quantiles of the distances of all pairs, between two of them in proportion: distances are counted by bin, then only the bins that are asked for are looked into."""
    top = vectors.select(F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()[0]
    width = max(2.0 * (top or 0.0) * (1 + 1e-9), 1e-300) / BINS

    def each(give: Callable[[np.ndarray], Iterator[pa.RecordBatch]]):
        def work(ids, x, others, y, same) -> Iterator[pa.RecordBatch]:
            for s, d in distances(x, y):
                yield from give(d[np.arange(s, s + len(d))[:, None] < np.arange(d.shape[1])] if same else d.ravel())

        return work

    def bins(d: np.ndarray) -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.minimum(d / width, BINS - 1).astype(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["bin", "n"])

    counts = sorted(tuple(r) for r in meet(vectors, each(bins), "bin long, n long", block).groupBy("bin").agg(F.sum("n").alias("n")).collect())  # BINS rows at most
    total = sum(n for _, n in counts)
    if not total:
        return [None] * len(quantiles)
    at = [q * (total - 1) for q in quantiles]
    ranks = sorted({r for x in at for r in (int(x), min(int(x) + 1, total - 1))})
    wanted, before = {}, 0
    for b, n in counts:
        inside = [r for r in ranks if before <= r < before + n]
        if inside:
            wanted[b] = before
        before += n
    keep = np.array(sorted(wanted))

    def values(d: np.ndarray) -> Iterator[pa.RecordBatch]:
        b = np.minimum(d / width, BINS - 1).astype(np.int64)
        ok = np.isin(b, keep)
        found, n = np.unique(d[ok], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(found / width, BINS - 1).astype(np.int64)), pa.array(found), pa.array(n)], names=["bin", "d", "n"])

    inside = meet(vectors, each(values), "bin long, d double, n long", block).groupBy("bin", "d").agg(F.sum("n").alias("n"))
    starts = vectors.sparkSession.createDataFrame(list(wanted.items()), "bin long, before long")
    upto = F.sum("n").over(Window.partitionBy("bin").orderBy("d"))
    ranked = inside.withColumn("upto", upto).join(F.broadcast(starts), "bin").select("d", (F.col("before") + F.col("upto") - F.col("n")).alias("low"), (F.col("before") + F.col("upto")).alias("high"))
    of_rank = vectors.sparkSession.createDataFrame([(r,) for r in ranks], "r long")
    value = {r["r"]: r["d"] for r in ranked.join(F.broadcast(of_rank), (F.col("r") >= F.col("low")) & (F.col("r") < F.col("high"))).collect()}  # two for each quantile
    return [value[int(x)] + (x - int(x)) * (value[min(int(x) + 1, total - 1)] - value[int(x)]) for x in at]


def near_links(vectors: DataFrame, radius: float, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join the same vectors as all pairs within ``radius`` do, fewer than the vectors for each two blocks."""

    def work(ids, x, others, y, same) -> Iterator[pa.RecordBatch]:
        n = len(ids)
        name = np.arange(n if same else n + len(others))
        links = []
        for s, d in distances(x, y):
            for r, row in enumerate(d <= radius, s):
                hit = np.flatnonzero(row) + (0 if same else n)
                hit = hit[name[hit] != name[r]]
                if len(hit):
                    groups, first = np.unique(name[hit], return_index=True)
                    links += [(r, int(hit[k])) for k in first]
                    name[np.isin(name, groups)] = name[r]
        every = ids if same else np.concatenate([ids, others])
        a, b = (np.array([link[k] for link in links], np.int64) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(every[a]), pa.array(every[b])], names=["a", "b"])

    return meet(vectors, work, "a long, b long", block)
