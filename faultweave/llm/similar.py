"""n-gram Jaccard join by T-occurrence search with DivideSkip.

A set of n shingles can only be linked with sets that share T = ceil(0.75 n) of its shingles. Corpus
counts of all shingles come from the n-gram exchange: a set with more than n - T shingles that no
other set has is alone. The others' n - T + 1 rarest shingles (the lists left when the T - 1 longest
are put aside) bring together every pair that can be linked; what hangs together by them is one
index block (a large one is cut into blocks that meet in pairs). In a block each set is looked up:
its short inverted lists are merged by a heap, which skips what is in too few of them; the candidates'
places in the long lists are found by binary search, and those that reach the overlap are linked. Equal sets count once throughout.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm import words as W
from faultweave.llm._shared import Saved, components, shuffle_partitions, table
from faultweave.llm.ngram_exchange import Batch, distinct_counts, exchange

WORDS, SIMILAR = 5, 75
#: Shingles in an index block; a larger group is cut into blocks by hash and the blocks are met in pairs.
BLOCK_SHINGLES = 1_000_000
#: Words in a batch of the exchange: a batch's sets take several times the memory of its words.
BATCH_WORDS = 500_000
#: The DivideSkip constant: T / (MU log2 M + 1) lists count as long, M the longest list.
MU = 0.0085
_DDL = "doc_id long, is_null boolean, n_shingles long, node long, shingles binary, keys array<long>"
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("is_null", pa.bool_()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary()), ("keys", pa.list_(pa.int64()))])


def required(n: np.ndarray, similar: int) -> np.ndarray:
    """The least shingles that a set of n must share with any set it is linked with."""
    return -(-n * similar // 100)


def shingle_sets(counts: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set sizes, all sets' sorted shingles end to end, a 64-bit name of each set; 0 for the empty one)."""
    left = W.left_in_text(counts)
    doc = np.repeat(np.arange(len(counts)), counts)
    total = np.repeat(counts, counts)
    values, owner = [W.grams(h, width)[left >= width]], [doc[left >= width]]
    for n in range(1, width):
        at = (total == n) & (left == n)
        values.append(W.grams(h, n)[at])
        owner.append(doc[at])
    v, d = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((v, d))
    v, d = v[order], d[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (d[1:] != d[:-1])
    v, d = v[new], d[new]
    sizes = np.bincount(d, minlength=len(counts)).astype(np.int64)
    sums = np.zeros(len(v) + 1, np.uint64)
    np.cumsum(W.mix(v ^ np.uint64(0xA5A5A5A5A5A5A5A5)), out=sums[1:])
    ends = np.cumsum(sizes)
    names = W.mix(sums[ends] - sums[ends - sizes] + sizes.astype(np.uint64)) | np.uint64(1)
    names[sizes == 0] = 0
    return sizes, v, names


def _distinct_sets(b: Batch, width: int):
    sizes, v, names = shingle_sets(b.counts, b.h, width)
    _, first = np.unique(names, return_index=True)
    first = np.sort(first[sizes[first] > 0])
    starts = np.cumsum(sizes) - sizes
    take = np.concatenate([np.arange(starts[i], starts[i] + sizes[i]) for i in first]) if len(first) else np.zeros(0, np.int64)
    return sizes, names, first, v[take]


def merge_skip(lists: list[list[int]], least: int, allowed: list[int] | None, found) -> None:
    """found(c, count) for every number c that ``least`` or more of the ascending lists have, by a heap of their heads.

    ``allowed`` (ascending; None: all) are the numbers that matter; found may return a new one, from which the lists go on.
    """

    def heads(start: int) -> list[tuple[int, int]]:
        out = []
        for k, run in enumerate(lists):
            at[k] = bisect_left(run, start, at[k])
            if at[k] < len(run):
                out.append((run[at[k]], k))
        heapify(out)
        return out

    at = [0] * len(lists)
    heap = heads(0)
    while len(heap) >= least:
        c = heap[0][0]
        if allowed is not None:
            i = bisect_left(allowed, c)
            if i == len(allowed):
                return
            if allowed[i] != c:
                heap = heads(allowed[i])
                continue
        popped = []
        while heap and heap[0][0] == c:
            popped.append(heappop(heap)[1])
        if len(popped) >= least:
            now = found(c, len(popped))
            allowed, start = (allowed, c + 1) if now is None else (now, c + 1)
        else:  # c is too rare: with least - 1 lists put aside, no number before the next head can be in enough
            while heap and len(popped) < least - 1:
                popped.append(heappop(heap)[1])
            if not heap:
                return
            start = heap[0][0]
        for k in popped:
            run = lists[k]
            at[k] = bisect_left(run, start, at[k])
            if at[k] < len(run):
                heappush(heap, (run[at[k]], k))


def divide_skip(sets: list[np.ndarray], similar: int = SIMILAR, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the same sets as all pairs of Jaccard likeness of ``similar`` percent do (a spanning forest of them).

    The short inverted lists of a set's shingles are merged by a heap, the long ones probed by halving
    for what the merge finds. Sets that are joined already are skipped over, so a large group of
    copies costs each of its sets one link. With ``side`` only pairs of different sides are looked for.
    """
    order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    u, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    postings: list[list[int]] = [[] for _ in range(len(u))]
    group = np.arange(len(order))  # each set's group by the links so far
    members: dict[int, list[int]] = {}
    sides = None if side is None else np.asarray(side)[order]
    links, at, size_of = [], 0, sizes.tolist()

    def join(x: int, y: int) -> None:
        big, small = (int(group[k]) for k in ((x, y) if len(members.get(int(group[x]), ())) >= len(members.get(int(group[y]), ())) else (y, x)))
        moved = members.pop(small, [small])
        group[moved] = big
        members.setdefault(big, [big]).extend(moved)

    for q, n in enumerate(size_of):
        own = inverse[at : at + n].tolist()
        at += n
        full = sorted((postings[i] for i in own if postings[i]), key=len)
        t_least = -(-n * similar // 100)
        if len(full) >= t_least:
            n_long = min(t_least - 1, int(t_least / (MU * math.log2(len(full[-1]) + 1) + 1)))
            short, long = full[: len(full) - n_long], full[len(full) - n_long :]
            first = int(np.searchsorted(sizes, t_least))  # smaller sets are too small

            def allowed() -> list[int]:
                ok = group[first:q] != group[q]  # noqa: B023
                if sides is not None:
                    ok &= sides[first:q] != sides[q]  # noqa: B023
                return (np.flatnonzero(ok) + first).tolist()  # noqa: B023

            def found(c: int, count: int) -> list[int] | None:
                need = -(-similar * (n + size_of[c]) // (100 + similar))  # noqa: B023
                left = n_long  # noqa: B023
                for run in long:  # noqa: B023
                    if count + left < need:
                        return None
                    i = bisect_left(run, c)
                    count += i < len(run) and run[i] == c
                    left -= 1
                if count < need:
                    return None
                links.append((order[c], order[q]))  # noqa: B023
                join(c, q)  # noqa: B023
                return allowed()  # noqa: B023

            merge_skip(short, max(1, t_least - n_long), allowed() if first or sides is not None else None, found)
        for i in own:
            postings[i].append(q)
    return links


def similar_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, similar: int = SIMILAR, block_shingles: int = BLOCK_SHINGLES, saved: Saved | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Words are runs of non-space with A-Z as a-z; a text of fewer than ``width`` words is one shingle;
    null, empty and blank texts have no shingle and no link. Two sets link when
    100 |A and B| >= similar |A or B|, so repeated rows and equal sets link. A null doc_id is a row
    of its own that joins sets but never names a component unless all of its ids are null; ties
    need no rule; an empty table gives no rows; other columns are ignored. All texts, all shingles
    and all links count: nothing is capped or sampled. ``saved`` holds the tables that
    the result is read from, for a caller that will drop them.
    """
    spark = documents.sparkSession
    saved, parts = saved or Saved(spark), shuffle_partitions(spark)

    def grams(b: Batch, number: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return distinct_counts(_distinct_sets(b, width)[3], bits)

    def finish(b: Batch, known, total: int, bits: int) -> Iterator[pa.RecordBatch]:
        sizes, names, first, v = _distinct_sets(b, width)
        nodes = names.view(np.int64)
        ids = pa.array(b.ids, pa.int64(), mask=b.null)
        n = len(b.ids)
        yield pa.RecordBatch.from_arrays([ids, pa.array(b.null), pa.array(sizes), pa.array(nodes), pa.nulls(n, pa.binary()), pa.nulls(n, pa.list_(pa.int64()))], schema=_SCHEMA)
        u, _, sums = known(0)
        df = sums[np.searchsorted(u, v >> np.uint64(64 - bits))]  # a shared hash only makes a shingle look less rare
        own, rows, at = sizes[first], [], 0
        for i, size in zip(first, own, strict=True):
            s, d = v[at : at + size], df[at : at + size]
            at += size
            t = int(required(size, similar))
            alone = int((d < 2).sum())
            if size - alone >= t:
                order = np.lexsort((s, d))[alone : size - t + 1]
                rows.append((None, None, int(size), int(nodes[i]), s.tobytes(), s[order].view(np.int64)))
            if len(rows) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = saved.save(exchange(docs, [0], grams, finish, _DDL, parts, BATCH_WORDS))
    members = rows.where("is_null IS NOT NULL").select("doc_id", "n_shingles", "node")
    sets = rows.where("is_null IS NULL")
    postings = sets.select("node", F.explode("keys").alias("key"))
    heads = postings.groupBy("key").agg(F.min("node").alias("head"), F.max("node").alias("tail")).where("head < tail").select("key", "head")
    near = components(postings.join(heads, "key").where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), saved)
    near = saved.save(near)
    once = sets.groupBy("node").agg(F.first("shingles").alias("shingles"), F.first("n_shingles").alias("n")).join(near, "node")
    once = saved.save(once)
    volume = once.groupBy("component").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    placed = once.join(volume, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("component", "node", "shingles", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, sets_, sides = None, [], [], []

        def done() -> Iterator[pa.RecordBatch]:
            if len(nodes) > 1:
                links = divide_skip(sets_, similar, np.array(sides) if key[1] != key[2] else None)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in links], pa.int64()), pa.array([nodes[y] for _, y in links], pa.int64())], names=["a", "b"])

        for rb in it:
            cols = rb.to_pydict()
            for c, node, s, block, i, j in zip(*(cols[k] for k in ("component", "node", "shingles", "block", "i", "j")), strict=True):
                if (c, i, j) != key:
                    yield from done()
                    key, nodes, sets_, sides = (c, i, j), [], [], []
                nodes.append(node)
                sets_.append(np.frombuffer(s, np.uint64))
                sides.append(block)
        yield from done()

    links = placed.repartition(parts, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node").mapInArrow(search, "a long, b long")
    joined = components(links, saved)
    names = members.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = saved.save(names)
    least = names.groupBy("component").agg(F.min("least").alias("component_id"))
    named = names.join(least, "component").select("node", "component_id")
    return members.join(named, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op6_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
g AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(v, c) AS (SELECT a, a FROM g UNION SELECT g.b, r.c FROM r JOIN g ON g.a = r.v),
m AS (SELECT v, min(c) AS c FROM r GROUP BY v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.c, w.doc_id) AS component_id FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN m ON m.v = w.doc_id
"""
