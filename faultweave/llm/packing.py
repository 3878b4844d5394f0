"""Pattern packing by non-negative least squares.

Patterns of a few lengths that nearly fill a sequence are enumerated from the length histogram, their
repeat counts are fitted to it by non-negative least squares and rounded, and what is left is packed
best-fit, longest first, also by counts. The plan is in lengths, so its size depends on the histogram
(``size`` bins at most) and not on the rows; rows find their places by their rank in their length.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultweave.llm._shared import Saved, kept, table, trim
from faultweave.llm.words import text_buffers

SIZE, END_ID = 4096, 1
#: Partners tried for each longest length; tokens a pattern may waste (each is tried, the shortest plan is taken; None: the patterns are best-fit's own sequences of two to four pieces); rounds of the fit.
PARTNERS, WASTES, ROUNDS = 24, (16, 2, 0, None), 200
#: Parts that a length's rows are ranked in, so that a common length is never one task.
SALTS = 64
#: New strings and those met again that are remembered, and characters of either, at most; bytes of text encoded together (a longer text alone), and by a worker that knows no string yet.
_YOUNG, _OLD, _CHARS, _SLICE, _FIRST = 500_000, 400_000, 30_000_000, 3 << 20, 1 << 18
_BLANKS = np.arange(256, dtype=np.uint8)
_BLANKS[[9, 10, 13]] = 32
_RUNS = re.compile(r"[^\W\d_]+|[\W\d_]+")
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Token ids of texts as little-endian uint32 bytes.

    The vocabulary drops white space and never joins over it, so a text's ids are those of its
    space-separated chunks one after the other. A chunk of plain characters without an apostrophe is
    also the ids of its runs of letters and of others. Plain are only characters whose lower case and
    kind were found to be the tokenizer's own; every other chunk is encoded as it stands. Chunks and
    runs are remembered, up to a bound and longer if they are met again, and new ones are encoded together; runs of letters need only
    the vocabulary's merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.chars, self.slices = [0, 0], 0
        tried = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA1, 0x530)) if chr(c) != "'" and self.alone(chr(c))]
        whole = self.tokenizer.encode_batch([f"a{c}b{c}{c}" for c in tried], add_special_tokens=False)
        parts = self.tokenizer.encode_batch([" ".join(_RUNS.findall(f"a{c}b{c}{c}".lower())) for c in tried], add_special_tokens=False)
        plain = "".join(c for c, x, y in zip(tried, whole, parts, strict=True) if x.ids == y.ids)
        self.plain = re.compile(f"[{re.escape(plain)}\\n]*").fullmatch  # of chunks, or of lines of them

    @staticmethod
    def alone(c: str) -> bool:
        """Whether a character's lower case and normal form are one character whatever stands around it."""
        return c != "\u03a3" and len(c.lower()) == 1 and unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)

    def encode_all(self, tokenizer, runs: list[str]) -> None:
        if not runs:
            return
        e = tokenizer.encode(runs, is_pretokenized=True, add_special_tokens=False)
        raw = np.array(e.ids, "<u4").tobytes()
        ends = np.cumsum(np.bincount(np.array(e.word_ids, np.int64), minlength=len(runs)) * 4).tolist()
        self.young.update(zip(runs, map(raw.__getitem__, map(slice, [0, *ends], ends)), strict=True))

    def learn(self, chunks: list[str]) -> None:
        """Remembers the ids of new chunks."""
        lines = "\n".join(chunks)
        if "<|" not in lines and self.plain(lines):
            runs = [[low] if low.isalpha() else _RUNS.findall(low) for low in lines.lower().split("\n")]
            strange: set[str] = set()
        else:
            strange = {c for c in chunks if "<|" in c or not self.plain(c)}
            runs = [[c] if c in strange else _RUNS.findall(c.lower()) for c in chunks]
        young, old = self.young, self.old
        fresh = {r for r in chain.from_iterable(runs) if r not in old and r not in young}
        # a run of plain letters in lower case is one word of the vocabulary's: nothing of it is normalised or split
        letters = [r for r in fresh if r.isalpha() and r not in strange]
        self.encode_all(self.bare, letters)
        self.encode_all(self.tokenizer, list(fresh.difference(letters)))
        ids = lambda r: old[r] if r in old else young[r]
        young.update([(c, ids(rs[0]) if len(rs) == 1 else b"".join([ids(r) for r in rs])) for c, rs in zip(chunks, runs, strict=True) if rs != [c]])
        self.chars[0] += len(lines) + sum(map(len, fresh))

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode(pa.array(texts, pa.large_string()))
        return [ids[s:e].tobytes() for s, e in zip([0, *ends[:-1]], ends, strict=True)]

    def encode(self, texts: pa.LargeStringArray) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts end to end, and where each text's ids end. Each distinct chunk is looked up once."""
        if len(self.young) > _YOUNG or self.chars[0] > _CHARS:
            self.young, self.chars[0] = {}, 0
        if len(self.old) > _OLD or self.chars[1] > _CHARS:
            self.old, self.chars[1] = {}, 0
        split = pc.split_pattern(_blanks(texts), " ")
        words = split.flatten().dictionary_encode()
        here = words.dictionary.to_pylist()
        found = list(map(self.old.get, here))
        missed = [k for k, i in enumerate(found) if i is None]
        if missed:
            chunks = [here[k] for k in missed]
            ids = list(map(self.young.get, chunks))
            again = [(c, i) for c, i in zip(chunks, ids, strict=True) if i is not None]
            self.learn([c for c, i in zip(chunks, ids, strict=True) if i is None])
            for k, c, i in zip(missed, chunks, ids, strict=True):
                found[k] = self.young[c] if i is None else i
            self.old.update(again)  # most strings are met once and forgotten
            self.chars[1] += sum(len(c) for c, _ in again)
        flat, sizes = np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4
        at = words.indices.to_numpy()
        size = sizes[at]
        upto = np.append(0, np.cumsum(size))
        # from each chunk's place in ``flat`` on, as many ids as it has; places fit 32 bits unless one text alone has more ids
        kind = np.int32 if upto[-1] < 2**31 else np.int64
        places = np.repeat(((np.cumsum(sizes) - sizes)[at] - upto[:-1]).astype(kind), size)
        places += np.arange(upto[-1], dtype=kind)
        ids = flat[places]
        return ids, upto[split.offsets.to_numpy()[1:] - split.offsets[0].as_py()].tolist()


def _blanks(texts: pa.LargeStringArray) -> pa.LargeStringArray:
    """The texts with a blank for each line end and tab."""
    raw, offsets = text_buffers(texts)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets), pa.py_buffer(_BLANKS[raw]))


def pieces(documents: DataFrame, vocabulary: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and ``end_id``, cut only if longer than ``size``."""
    last = np.array([end_id], "<u4").tobytes()

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(("packing", vocabulary), lambda: Encoder(vocabulary))  # the worker's next tasks find what this one has learned
        for rb in it:
            rows, upto = [], np.cumsum(pc.fill_null(pc.binary_length(rb.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < rb.num_rows:
                most = min(_SLICE, _FIRST << min(encoder.slices, 8))  # while nearly every string is new, a slice takes far more memory
                encoder.slices += 1
                j = max(i + 1, int(np.searchsorted(upto, (upto[i - 1] if i else 0) + most, "right")))
                ids, ends = encoder.encode(pc.fill_null(rb.column(1).slice(i, j - i), "").cast(pa.large_string()))
                for doc, first, end in zip(rb.column(0).slice(i, j - i).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    n = end - first + 1
                    for k, s in enumerate(range(0, n, size)):
                        crc = zlib.crc32(ids[first + s : min(end, first + s + size)])
                        rows.append((doc, k, s, min(size, n - s), zlib.crc32(last, crc) if s + size >= n else crc))
                i = j
                del ids, ends
                trim()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECES, strict=True)] if rows else [pa.array([], f.type) for f in _PIECES], schema=_PIECES)

    return documents.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def _patterns(lengths: np.ndarray, size: int, waste: int) -> np.ndarray:
    """Patterns of two to four lengths, as rows of indices into ``lengths`` (ascending), -1 for none."""
    out: set[tuple[int, ...]] = set()
    fit = lambda room: bisect.bisect_right(values, room) - 1
    values = lengths.tolist()
    for a in range(len(values)):
        room = size - values[a]
        top = min(fit(room), a)
        if top < 0:
            continue
        for b in {int(x) for x in np.linspace(0, top, PARTNERS)}:
            found, left = [a, b], room - values[b]
            while left > 0 and len(found) < 4 and (c := fit(left)) >= 0:
                found.append(c)
                left -= values[c]
            if left <= waste:
                out.add(tuple(sorted(found, reverse=True)))
    return np.array([p + (-1,) * (4 - len(p)) for p in sorted(out)], np.int64).reshape(-1, 4)


def fit_counts(patterns: np.ndarray, histogram: np.ndarray, rounds: int = ROUNDS, start: np.ndarray | None = None) -> np.ndarray:
    """x >= 0 that brings the patterns' lengths near the histogram in least squares, by multiplicative updates."""
    n, valid = len(histogram), patterns >= 0
    at = np.where(valid, patterns, n)
    up = lambda v: np.append(v, 0.0)[at].sum(axis=1)  # noqa: E731  A^T v
    down = lambda x: np.bincount(at.ravel(), np.repeat(x, 4), n + 1)[:n]  # noqa: E731  A x
    if start is None:
        start = np.full(len(patterns), max(1.0, histogram.sum()) / max(1, len(patterns)) / 3)
    else:
        histogram = down(start)  # what these patterns are to hold
    want, x = up(histogram.astype(float)), start.astype(float)
    for _ in range(rounds):
        x *= want / np.maximum(up(down(x)), 1e-12)
    return x


def plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, list[int]]]:
    """[(how many sequences, their lengths)] that hold every length as often as the histogram says, in as few sequences as any tried set of patterns gives.

    With best-fit's own patterns the plan is best-fit's, so it is never longer than that.
    """
    return min((_plan(histogram, size, waste) for waste in WASTES), key=lambda groups: sum(m for m, _ in groups))


def _plan(histogram: dict[int, int], size: int, waste: int | None) -> list[tuple[int, list[int]]]:
    left = {n: c for n, c in histogram.items() if c > 0}
    groups: list[tuple[int, list[int]]] = [(left.pop(size), [size])] if size in left else []
    lengths = np.array(sorted(left), np.int64)
    open_: dict[int, list[tuple[int, list[int]]]] = {}
    if waste is None:
        patterns, start = _own_patterns(lengths, _best_fit(dict(left), size, {}))
    else:
        patterns, start = _patterns(lengths, size, waste), None
    if len(patterns):
        x = fit_counts(patterns, np.array([left[n] for n in lengths.tolist()]), start=start)
        for k in np.argsort(-x, kind="stable"):
            if x[k] < 0.5:
                break
            held = [int(lengths[i]) for i in patterns[k] if i >= 0]
            m = min(round(x[k]), *(left[n] // held.count(n) for n in held))
            if m > 0:
                for n in held:
                    left[n] -= m
                open_.setdefault(size - sum(held), []).append((m, held))
    if waste is None:
        return groups + [g for gs in open_.values() for g in gs] + _best_fit(left, size, {})
    return groups + _best_fit(left, size, open_)


def _own_patterns(lengths: np.ndarray, groups: list[tuple[int, list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sequences of two to four pieces as patterns, and how often each occurs."""
    at, found = {int(n): i for i, n in enumerate(lengths)}, {}
    for m, held in groups:
        if 2 <= len(held) <= 4:
            key = tuple(sorted((at[n] for n in held), reverse=True))
            found[key] = found.get(key, 0) + m
    rows = sorted(found)
    return np.array([r + (-1,) * (4 - len(r)) for r in rows], np.int64).reshape(-1, 4), np.array([found[r] for r in rows], float)


def _best_fit(left: dict[int, int], size: int, open_: dict[int, list[tuple[int, list[int]]]]) -> list[tuple[int, list[int]]]:
    """All sequences once the lengths that are left are put, longest first, where least room stays."""
    frees = sorted(open_)
    for n in sorted((n for n, c in left.items() if c), reverse=True):
        c = left[n]
        while c:
            at = bisect.bisect_left(frees, n)
            if at == len(frees):
                per = size // n
                fresh = [(c // per, per)] * (c >= per) + [(1, c % per)] * bool(c % per)
                for m, k in fresh:
                    _open(open_, frees, size - n * k, (m, [n] * k))
                break
            free = frees[at]
            m, held = open_[free].pop()
            if not open_[free]:
                del open_[free]
                frees.pop(at)
            t = min(m, c)
            if m > t:
                _open(open_, frees, free, (m - t, held))
            _open(open_, frees, free - n, (t, [*held, n]))
            c -= t
    return [g for gs in open_.values() for g in gs]


def _open(open_: dict, frees: list[int], free: int, group: tuple[int, list[int]]) -> None:
    if free not in open_:
        open_[free] = []
        bisect.insort(frees, free)
    open_[free].append(group)


def place(groups: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """The plan by length: ranks from ``lo`` on go to sequences from ``sequence`` on, at ``offset``."""
    rows, next_rank, sequence = [], {}, 0
    for m, held in groups:
        offset = 0
        for n in held:
            lo = next_rank.get(n, 0)
            rows.append((n, lo, sequence, offset))
            next_rank[n], offset = lo + m, offset + n
        sequence += m
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 4).T
    return dict(zip(("length", "lo", "sequence", "offset"), cols, strict=True))


def pack(documents: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Every document's pieces with their sequence and offset.

    Null and empty texts are one piece with the end id alone; null and repeated ids and repeated rows
    are pieces of their own; ties in rank are equal pieces; an empty table gives no rows; other
    columns are ignored. Ids are those of ``tokenizers`` without special tokens added.
    """
    spark = documents.sparkSession
    saved = Saved(spark)
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = pieces(rows, vocabulary or default_vocabulary(), size, end_id)
    cut = saved.save(cut.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")))
    counts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most size * SALTS rows
    before = counts.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    at = place(plan(histogram, size))
    keys = (at["length"] << 44) + at["lo"]
    ranked = cut.withColumn("nth", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "start")))
    ranked = ranked.join(before, ["length", "salt"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth") - 1).alias("rank"))
    shared = spark.sparkContext.broadcast((keys, at["lo"], at["sequence"], at["offset"]))

    def find(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, lo, sequence, offset = shared.value
        for rb in it:
            n, rank = (np.asarray(rb.column(k)).astype(np.int64) for k in ("length", "rank"))
            i = np.searchsorted(keys, (n << 44) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*rb.columns[:5], pa.array(sequence[i] + rank - lo[i]), pa.array(offset[i])], names=[*rb.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(find, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
