"""Corpus-wide n-gram counts for every batch of texts: one shuffle out by hash, one back.

A task turns its texts into batches of words. For each batch it sends every hash range the sorted
distinct n-grams of that range with their counts. Each range sums its counts and answers every
batch with the places whose corpus count differs from the batch's own; there the batch's words,
from a second reading of the texts, meet the answers. Payloads are packed differences of sorted
hashes, about 4.5 bytes an n-gram; nothing is collected, and a hot n-gram is one entry per batch.
A batch is named by its task and a checksum of its content, so a reading that differs (an input
that is not the same when read again) is an error and never a wrong count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultweave.llm import words as W
from faultweave.llm._shared import kept, trim

#: Words in a batch, at most (a longer text is a batch of its own).
BATCH_WORDS = 1_400_000
#: An n-gram's hash keeps log2(bytes of all texts) + SPARE bits, so at any size of the corpus less than one n-gram in 2**SPARE shares its hash.
SPARE = 24

_OUT = "dest int, batch string, gram int, n long, a binary, b binary, c binary, d binary"
_FIELDS = pa.schema([("dest", pa.int32()), ("batch", pa.string()), ("gram", pa.int32()), ("n", pa.int64()), *[(k, pa.binary()) for k in "abcd"]])


def edges_of(parts: int, bits: int) -> np.ndarray:
    """Where the hash ranges begin."""
    return np.array([(i << bits) // parts for i in range(parts)], np.uint64)


def distinct_counts(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, shortened to ``bits``, and how often each occurs."""
    return np.unique(h >> np.uint64(64 - bits), return_counts=True)


def _rows(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 512):
        yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows[at : at + 512], strict=True), _FIELDS.types, strict=True)], schema=_FIELDS)


class Batch:
    """Texts of one batch: ids (with which are null), words per text and word hashes."""

    def __init__(self, ids: np.ndarray, null: np.ndarray, counts: np.ndarray, h: np.ndarray):
        self.ids, self.null, self.counts, self.h = ids, null, counts, h


def _pack_texts(b: Batch) -> tuple:
    u, inverse, counts = np.unique(b.h, return_inverse=True, return_counts=True)
    # words by falling frequency: small numbers are common, which the byte planes like
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(u), np.uint32)
    rank[order] = np.arange(len(u), dtype=np.uint32)
    meta = np.concatenate([b.ids, b.null.astype(np.int64), b.counts])
    return len(b.ids), W.pack(meta), W.pack_sorted(u), W.pack(rank[inverse]), W.pack(rank)


def _unpack_texts(n: int, a: bytes, b: bytes, c: bytes, d: bytes) -> Batch:
    meta = W.unpack(a, np.int64)
    u = W.unpack_sorted(b, np.uint64)
    by_rank = np.empty_like(u)
    by_rank[W.unpack(d, np.uint32)] = u
    h = by_rank[W.unpack(c, np.uint32)]
    return Batch(meta[:n], meta[n : 2 * n].astype(bool), meta[2 * n :], h)


def exchange(documents: DataFrame, numbers: list[int], grams: Callable, finish: Callable, out_ddl: str, parts: int, batch_words: int = BATCH_WORDS) -> DataFrame:
    """``documents(id long, text string)`` through the exchange.

    grams(batch, number, bits) gives (sorted distinct hashes below 2**bits, counts) for number in
    ``numbers`` and must be a pure function of the batch; it runs again at the end. finish(batch, known, total, bits) yields
    record batches; known(number) is (hashes, counts in the batch, counts in the corpus), total
    the sum of all counts of number 0.
    """
    size = documents.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(64, max(32, size.bit_length() + SPARE))
    cuts = edges_of(parts, bits)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Batch]]:
        """(name, task, batch): the same ones whenever the same rows are read in the same order."""
        kept("exchange", dict)  # what other operators left in this worker makes room
        held: list[Batch] = []
        task, serial = -1, count()

        def flush() -> tuple[str, int, Batch]:
            b = Batch(*[np.concatenate([getattr(x, k) for x in held]) for k in ("ids", "null", "counts", "h")])
            held.clear()
            check = int(np.sum(b.h * np.arange(1, len(b.h) + 1, dtype=np.uint64)) ^ np.sum(b.ids.astype(np.uint64)))
            return f"{task:08d}-{next(serial):06d}-{check:016x}", task, b

        for rb in it:
            if task < 0 and rb.num_rows:
                task = rb.column(2)[0].as_py()
            ids = rb.column(0)
            null = np.asarray(ids.is_null())
            ids = np.asarray(ids.fill_null(0)).astype(np.int64)
            for i in range(0, len(ids), 1000):
                h, counts = W.tokens(rb.column(1).slice(i, 1000))
                if held and sum(len(x.h) for x in held) + len(h) > batch_words:
                    yield flush()
                held.append(Batch(ids[i : i + 1000], null[i : i + 1000], counts, h))
        if held:
            yield flush()

    def send_grams(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, _, b in batches(it):
            for number in numbers:
                rows = []
                u, c = grams(b, number, bits)
                at = np.append(np.searchsorted(u, cuts), len(u))
                for p in range(parts):
                    s, e = at[p], at[p + 1]
                    if e > s or number == 0:
                        rows.append((p, name, number, int(e - s), W.pack_sorted(u[s:e]), W.pack(c[s:e].astype(np.uint32)), None, None))
                yield from _rows(rows)
            del rows, u, c
            trim()

    def send_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, task, b in batches(it):
            yield from _rows([(task % parts, name, -1, *_pack_texts(b))])
            trim()

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("exchange", dict)
        # one hash range a partition at most times a few: payloads stay packed until their gram number's turn
        held: dict[tuple[int, int], list[tuple]] = {}
        for rb in it:
            for r in rb.to_pylist():
                held.setdefault((r["dest"], r["gram"]), []).append((r["batch"], r["n"], r["a"], r["b"]))
        for dest, gram in list(held):
            rows = held.pop((dest, gram))
            keys = np.concatenate([W.unpack_sorted(x[2], np.uint64) for x in rows])
            counts = np.concatenate([W.unpack(x[3], np.uint32) for x in rows]).astype(np.int64)
            u, inverse = np.unique(keys, return_inverse=True)
            del keys
            sums = np.zeros(len(u), np.int64)
            np.add.at(sums, inverse, counts)
            all_ = int(counts.sum())
            out, at = [], 0
            for name, n, _, _ in rows:
                now = sums[inverse[at : at + n]]
                more = np.flatnonzero(now != counts[at : at + n])
                at += n
                if len(more) or gram == 0:
                    out.append((dest, name, gram, all_, W.pack_sorted(more.astype(np.uint32)), W.pack(now[more]), None, None))
            del inverse, sums, counts, u, rows
            yield from _rows(out)
            del out
            trim()

    def answer(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("exchange", dict)
        name, rows = None, []

        def done() -> Iterator[pa.RecordBatch]:
            own = next((r for r in rows if r["gram"] == -1), None)
            if own is None or not any(r["gram"] == 0 for r in rows):
                raise RuntimeError(f"batch {name} differs between two readings of the documents: give the exchange a frame that reads alike each time")
            b = _unpack_texts(own["n"], own["a"], own["b"], own["c"], own["d"])

            def known(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
                u, c = grams(b, number, bits)
                sums, at = c.astype(np.int64), np.searchsorted(u, cuts)
                for r in rows:
                    if r["gram"] == number:
                        sums[at[r["dest"]] + W.unpack_sorted(r["a"], np.uint32).astype(np.int64)] = W.unpack(r["b"], np.int64)
                return u, c, sums

            yield from finish(b, known, sum(r["n"] for r in rows if r["gram"] == 0), bits)
            trim()

        for rb in it:
            for r in rb.to_pylist():
                if r["batch"] != name:
                    if rows:
                        yield from done()
                    name, rows = r["batch"], []
                rows.append(r)
        if rows:
            yield from done()

    # the number of the partition that is read, which (unlike a task's number) is the same in both readings
    documents = documents.select("id", "text", F.spark_partition_id().alias("part"))
    summed = documents.mapInArrow(send_grams, _OUT).repartition(parts, "dest").mapInArrow(add, _OUT)
    back = summed.unionAll(documents.mapInArrow(send_texts, _OUT)).repartition(parts, "batch").sortWithinPartitions("batch")
    return back.mapInArrow(answer, out_ddl)
