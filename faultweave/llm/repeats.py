"""Repeated passages by sparse suffixes.

Suffixes are kept at content-selected places (minimisers of word 16-grams), so two copies of a passage
keep the same ones. Only suffixes whose first 16 words another text has too stay; of those with one
beginning, every window of ``least`` words that holds it is compared by its hash with all the
others', so what matches to the left and right in any mixture is found. Equal texts are one text until the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.llm import words as W
from faultweave.llm._shared import Saved, shuffle_partitions, table

LEAST, GRAM = 50, 16
#: Suffixes with one beginning that are compared in one task; windows around a more common one are dealt out by their own hashes.
GROUP = 5000
_CODE = 4  # bytes of a word in a suffix; 31 bits of them tell words apart
_A = pa.schema([("doc_id", pa.int64()), ("doc", pa.int64()), ("cls", pa.int64()), ("n_words", pa.int64()), ("gram", pa.int64()), ("pos", pa.int64())])
_B = pa.schema([("hot", pa.bool_()), ("gram", pa.int64()), ("cls", pa.int64()), ("pos", pa.int64()), ("n_before", pa.int32()), ("n_after", pa.int32()), ("words", pa.binary())])


def sampled(h: np.ndarray, counts: np.ndarray, least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(places, n-gram hashes) of the minimisers: every run of ``least`` words has one that its content alone decides."""
    g, width = W.grams(h, gram), least - gram + 1
    starts = np.flatnonzero(W.left_in_text(counts) >= least)
    if not len(starts):
        return starts, g[:0]
    view = np.lib.stride_tricks.sliding_window_view(g, width)
    at = np.concatenate([starts[i : i + 100_000] + view[starts[i : i + 100_000]].argmin(axis=1) for i in range(0, len(starts), 100_000)])
    at = np.unique(at)
    return at, g[at]


def _codes(h: np.ndarray) -> np.ndarray:
    """Words as big-endian numbers of _CODE bytes, none of them zero."""
    return (h.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :_CODE] | 1).copy()


def _two_texts(key: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Rows whose key a row of another text has too."""
    order = np.argsort(key)
    key, cls = key[order], cls[order]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    shared = np.minimum.reduceat(cls, starts) < np.maximum.reduceat(cls, starts)
    return order[np.repeat(shared, np.diff(np.append(starts, len(key))))]


def repeated_passages(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, group: int = GROUP) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): maximal runs of words that are covered by passages shared with another document.

    A passage is ``least`` words or more (runs of non-space, A-Z as a-z); places are word numbers, the
    end exclusive; overlapping or touching passages are one run. Texts that another doc_id has too
    are wholly repeated. Null, empty and shorter texts have none; rows that repeat both id and text
    are one document and give the same rows each; null ids count as one id per text; an empty table
    gives no rows; other columns are ignored. ``group`` decides where suffixes are compared, never what is found.
    Words are compared by hashes: two windows that differ in one word pass for equal once in 2**31 times.
    """
    spark = documents.sparkSession
    saved, parts = Saved(spark), shuffle_partitions(spark)
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(id_col, text_col).alias("doc"), F.xxhash64(text_col).alias("cls"), F.col(text_col).alias("text"))

    def select(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            for i in range(0, rb.num_rows, 500):
                part = rb.slice(i, 500)
                h, counts = W.tokens(part.column(3))
                at, g = sampled(h, counts, least, gram)
                ends = np.cumsum(counts)
                row = np.searchsorted(ends, at, "right")
                n, cls = len(counts), np.asarray(part.column(2))
                first = np.zeros(n, bool)
                first[np.unique(cls, return_index=True)[1]] = True  # equal texts of a batch speak once
                keep = first[row]
                at, g, row = at[keep], g[keep], row[keep]
                m = len(at)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], schema=_A)
                yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(cls[row]), pa.nulls(m, pa.int64()), pa.array(g.view(np.int64)), pa.array(at - (ends - counts)[row])], schema=_A)

    first = saved.save(docs.mapInArrow(select, "doc_id long, doc long, cls long, n_words long, gram long, pos long"))
    known = first.where("gram IS NULL").select("doc_id", "doc", "cls", "n_words")
    spots = first.where("gram IS NOT NULL").select("gram", "cls", "pos").distinct()
    shared = spots.groupBy("gram").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("gram", (F.col("n") > group).alias("hot"))
    shared = saved.save(shared)  # read again, it meets the spots by a shuffle of its own, and a gram that very many have is split
    kept = spots.join(shared, "gram").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("pos", "gram", "hot"))).alias("spots"))
    texts = known.groupBy("cls").agg(F.min("doc").alias("doc"), F.max("doc").alias("other"), F.max("n_words").alias("n_words"))
    texts = saved.save(texts)
    wanted = saved.save(texts.join(kept, "cls").select("doc", "spots"))
    given = docs.select("doc", "cls", "text").join(wanted, "doc")

    side = least - gram  # words that a window has beside the beginning

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pad = np.zeros((least, _CODE), np.uint8)
        for rb in it:
            for i in range(0, rb.num_rows, 50):
                part = rb.slice(i, 50)
                h, counts = W.tokens(part.column(2))
                codes, ends, rows = _codes(h), np.cumsum(counts), []
                for cls, spots, n, end in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), counts, ends, strict=True):
                    own, around = np.concatenate([pad, codes[end - n : end], pad]), np.zeros(n - least + 1, bool)
                    for s in spots:
                        p = s["pos"]
                        if s["hot"]:
                            around[max(0, p - side) : p + 1] = True
                        else:
                            rows.append((False, s["gram"], cls, p, min(least, p), min(least, int(n) - p), own[p + gram : p + 2 * least].tobytes()))
                    at = np.flatnonzero(around)
                    if len(at):
                        g = W.grams(h[end - n : end], least)[at].view(np.int64)
                        m, none = len(at), pa.nulls(len(at), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, bool)), pa.array(g), pa.array(np.full(m, cls)), pa.array(at), none, none, pa.nulls(m, pa.binary())], schema=_B)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _B, strict=True)], schema=_B)

    suffixes = given.mapInArrow(cut, "hot boolean, gram long, cls long, pos long, n_before int, n_after int, words binary")

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["cls", "start", "end"]
        tail: pa.Table | None = None

        def found(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Suffixes of whole groups: each one's windows that another text has."""
            n = t.num_rows
            gram_, cls, pos, nb, na = (np.asarray(t.column(k).combine_chunks()) for k in ("gram", "cls", "pos", "n_before", "n_after"))
            codes = np.frombuffer(b"".join(t.column("words").to_pylist()), np.uint8).reshape(n, side + least, _CODE)
            p, q = W._power(side + least + 1)
            sums = np.zeros((n, side + least + 1), np.uint64)
            number = sum(codes[:, :, k].astype(np.uint64) << np.uint64(8 * k) for k in range(_CODE))
            np.cumsum(W.mix(number) * p[: side + least], axis=1, out=sums[:, 1:])
            salt = W.mix(gram_.view(np.uint64))
            low, high = np.full(n, -1), np.full(n, -1)
            for d in range(side + 1):  # words of the window before the suffix
                ok = np.flatnonzero((nb >= d) & (na >= least - d))
                if len(ok):
                    s = side - d
                    hit = ok[_two_texts(W.mix((sums[ok, s + least] - sums[ok, s]) * q[s] + salt[ok]), cls[ok])]
                    low[hit] = np.where(low[hit] < 0, d, low[hit])
                    high[hit] = d
            hit = high >= 0  # all windows of a suffix hold its beginning: together they are one run
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[hit]), pa.array((pos - high)[hit]), pa.array((pos - low)[hit] + least)], names=names)

        # of the window that the last batch ended in: its hash, its first text, whether another text has it, places not yet told
        window, owner, shared, held = None, None, False, []

        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            """Windows sorted by hash and text; only the places of one window in one text are held back."""
            nonlocal window, owner, shared, held
            key, cls, pos = (np.asarray(t.column(k).combine_chunks()) for k in ("gram", "cls", "pos"))
            starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            lasts = np.append(starts[1:], len(key)) - 1
            two = cls[starts] != cls[lasts]
            if window == key[0]:
                two[0] = two[0] or shared or cls[0] != owner
                first = owner
            else:
                first, held = cls[0], []
            if two[0] and held:
                at = np.concatenate(held)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), first)), pa.array(at), pa.array(at + least)], names=names)
                held = []
            out = np.repeat(two, lasts - starts + 1)
            if out.any():
                yield pa.RecordBatch.from_arrays([pa.array(cls[out]), pa.array(pos[out]), pa.array(pos[out] + least)], names=names)
            if len(starts) > 1:
                first, held = cls[starts[-1]], []
            window, owner, shared = key[-1], first, two[-1]
            if not shared:
                held.append(pos[starts[-1] :])

        for rb in it:
            t = pa.Table.from_batches([rb])
            cold = t.num_rows - int(np.asarray(t.column("hot").combine_chunks()).sum())  # the hot ones come last
            if cold:
                now = t.slice(0, cold)
                tail = now if tail is None else pa.concat_tables([tail, now])
                gram_ = np.asarray(tail.column("gram").combine_chunks())
                others = np.flatnonzero(gram_ != gram_[-1])
                whole = int(others[-1]) + 1 if len(others) else 0  # the last group may go on in the next batch
                if whole:
                    yield from found(tail.slice(0, whole))
                tail = tail.slice(whole)
            if cold < t.num_rows:
                yield from told(t.slice(cold))
        if tail is not None and tail.num_rows:
            yield from found(tail)

    dealt = suffixes.repartition(parts, "hot", "gram").sortWithinPartitions("hot", "gram", "cls", "pos")
    pieces = saved.save(dealt.mapInArrow(compare, "cls long, start long, end long").distinct())
    whole = texts.where(F.col("doc") != F.col("other")).where(F.col("n_words") >= least).select("cls", F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end"))
    w = Window.partitionBy("cls").orderBy("start", "end")
    runs = pieces.union(whole).withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    runs = runs.withColumn("run", F.sum(F.when(F.col("start") <= F.col("reach"), 0).otherwise(1)).over(w))
    runs = saved.save(runs.groupBy("cls", "run").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word")))
    out = known.join(runs, "cls")
    return out.select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') AS ws FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
m AS (SELECT h FROM g GROUP BY h HAVING min(doc_id) < max(doc_id)),
c AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM m)),
j AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM c),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM j)
SELECT doc_id, (min(i) - 1)::BIGINT AS start_word, (max(i) + 49)::BIGINT AS end_word, (max(i) - min(i) + 50)::BIGINT AS n_words FROM k GROUP BY doc_id, run
"""
