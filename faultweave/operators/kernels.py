"""Distances from one row to all rows at once, in numpy: what ``distances`` says of two rows, without a row for a pair.

Rows are held as numbers. A kernel's size goes with the items of its rows, so it can be broadcast and
each task makes the rows of the matrix that it needs.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa

from faultweave.functions import rules as R

#: A column of which at least this part of the rows has a value is held as a value a row.
DENSE_PART = 8


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark's ``round``: half up by the shortest decimal that stands for the number."""
    y = x * 10.0**digits
    out = np.floor(y + 0.5) / 10.0**digits
    near = np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-6)
    if len(near):
        values, place = np.unique(x[near], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        out[near] = np.array([float(Decimal(repr(v)).quantize(unit, ROUND_HALF_UP)) for v in values.tolist()])[place.ravel()]
    return out


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _numbers(values: pa.Array) -> tuple[np.ndarray, list]:
    """(each value's number, the values in their numbers' order); null is -1."""
    found = values.dictionary_encode()
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, item numbers) of a column of arrays."""
    lists = _whole(column)
    length = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    codes, _ = _numbers(lists.flatten())
    return np.cumsum(length) - length, length, codes


class Places:
    """Arrays whose items are compared place by place."""

    def __init__(self, column: pa.ChunkedArray):
        self.start, self.length, codes = _lists(column)
        n, top = len(self.length), int(codes.max()) + 2 if len(codes) else 1
        self.codes = (codes + 1).astype(np.min_scalar_type(top))  # 0: null or no item
        self.most = int(self.length.max()) if n else 0
        self.dtype = np.uint8 if self.most < 256 else np.int32
        order = np.argsort(-self.length, kind="stable")
        count = np.searchsorted(-self.length[order], -np.arange(self.most), "left")  # how many are longer than each place
        self.columns: list[tuple[np.ndarray | None, np.ndarray]] = []
        for p in range(self.most):
            who = np.sort(order[: count[p]])
            values = self.codes[self.start[who] + p]
            if len(who) * DENSE_PART >= n:
                dense = np.zeros(n, self.codes.dtype)
                dense[who] = values
                self.columns.append((None, dense))
            else:
                self.columns.append((who, values))

    def equal(self, i: int, since: int = 0) -> np.ndarray:
        """In how many places row i has the item of each row from ``since`` on; null is like nothing."""
        out = np.zeros(len(self.length) - since, self.dtype)
        for p, code in enumerate(self.codes[self.start[i] : self.start[i] + self.length[i]]):
            if code == 0:
                continue
            who, values = self.columns[p]
            if who is None:
                np.add(out, (values[since:] == code).view(np.uint8), out=out)
            else:
                at = int(np.searchsorted(who, since))
                out[who[at:][values[at:] == code] - since] += 1
        return out

    def overlap(self, i: int, since: int = 0) -> np.ndarray:
        """Equal places over the longer length; two empty arrays are alike."""
        longer = np.maximum(self.length[i], self.length[since:])
        return np.where(longer == 0, 1.0, self.equal(i, since) / np.maximum(longer, 1))


class Sets:
    """Arrays as sets; ``of`` is each row's set, equal ones once."""

    def __init__(self, column: pa.ChunkedArray):
        start, length, codes = _lists(column)
        row = np.repeat(np.arange(len(length)), length)
        items = np.unique(np.stack([row, codes], axis=1), axis=0) if len(codes) else np.zeros((0, 2), np.int64)
        ends = np.searchsorted(items[:, 0], np.arange(len(length) + 1))
        known: dict[bytes, int] = {}
        self.of = np.array([known.setdefault(items[s:e, 1].tobytes(), len(known)) for s, e in zip(ends, ends[1:], strict=False)], np.int64)
        self.items = [np.frombuffer(b, np.int64) for b in known]
        self.size = np.array([len(x) for x in self.items], np.int64)
        flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)
        own = np.repeat(np.arange(len(self.items)), self.size)
        order = np.argsort(flat, kind="stable")
        self.low = int(flat.min()) if len(flat) else 0
        self.owners = own[order]
        self.bounds = np.searchsorted(flat[order], np.arange(self.low, int(flat.max()) + 2 if len(flat) else 1))

    def jaccard(self, u: int) -> np.ndarray:
        """Of set u to every set; two empty ones are alike."""
        shared = np.zeros(len(self.items), np.int64)
        for x in self.items[u] - self.low:
            shared[self.owners[self.bounds[x] : self.bounds[x + 1]]] += 1
        union = self.size[u] + self.size - shared
        return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


class Cosines:
    """Cosines of sparse rows ``weights(row, term, weight)``: frequent terms as dense columns, the others by who has them."""

    def __init__(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray):
        size = np.sqrt(np.bincount(row, weight * weight, n))
        _, term, count = np.unique(term, return_inverse=True, return_counts=True)
        often = np.cumsum(count * DENSE_PART >= n) * (count * DENSE_PART >= n) - 1  # a frequent term's column, else -1
        dense = often[term] >= 0
        self.n, self.dense = n, np.zeros((n, int(often.max(initial=-1)) + 1))
        value = weight / size[row]
        self.dense[row[dense], often[term[dense]]] = value[dense]
        row, term, value = row[~dense], term[~dense], value[~dense]
        order = np.lexsort((term, row))
        self.terms, self.values = term[order], value[order]
        self.starts = np.searchsorted(row[order], np.arange(n + 1))
        order = np.lexsort((row, term))
        self.rows, self.shares = row[order], value[order]
        self.bounds = np.searchsorted(term[order], np.arange(len(count) + 1))

    def block(self, start: int, end: int) -> np.ndarray:
        """Of rows start to end to every row."""
        out = self.dense[start:end] @ self.dense.T
        for i in range(start, end):
            for t, w in zip(self.terms[self.starts[i] : self.starts[i + 1]], self.values[self.starts[i] : self.starts[i + 1]], strict=True):
                s, e = self.bounds[t], self.bounds[t + 1]
                out[i - start, self.rows[s:e]] += w * self.shares[s:e]
        return np.minimum(out, 1.0, out=out)

    def away(self) -> np.ndarray:
        """All distances, 1 - cosine, symmetric; a row is at 0 from itself."""
        out, step = np.empty((self.n, self.n)), max(1, 2**22 // max(1, self.n))
        for s in range(0, self.n, step):
            e = min(self.n, s + step)
            out[s:e, s:] = np.maximum(0.0, 1.0 - self.block(s, e)[:, s:])
            for i in range(s, e):
                out[i, i], out[i + 1 :, i] = 0.0, out[i, i + 1 :]
        return out


def fatal(a: str, b: str) -> float:
    """``distances.fatal_distance`` of two names."""
    if a == b:
        return 0.0
    if "no_dret" in (a, b):
        return 1.0
    for name, kinds in R.FAMILIES.items():
        if a in kinds and b in kinds:
            return R.FAMILY_DISTANCE[name]
    timeout, check = R.FAMILIES["timeout"], R.FAMILIES["check"]
    return R.TIMEOUT_CHECK if (a in timeout and b in check) or (a in check and b in timeout) else 1.0


class _Text:
    """A column of texts as numbers; ``blank`` is whether each is empty."""

    def __init__(self, column: pa.ChunkedArray):
        self.code, self.names = _numbers(_whole(column))
        self.blank = np.array([x == "" for x in self.names], bool)[self.code] if self.names else np.zeros(0, bool)

    def at(self, rows: np.ndarray) -> _Text:
        out = object.__new__(_Text)
        out.code, out.names, out.blank = self.code[rows], self.names, self.blank[rows]
        return out


class Classes:
    """Classes of signature rows (``distances.alike``), a row each, sorted by ``cls``; no field is null.

    ``weights(row, term, weight)`` are those of the text ``text_of`` each class; without them cosines are 0.
    """

    def __init__(self, t: pa.Table, cosines: Cosines | None = None, text_of: np.ndarray | None = None):
        self.cls = t.column("cls").to_numpy()
        self.cosines, self.text_of = cosines, text_of
        col = lambda name: _Text(t.column(name))
        flag = lambda name: _whole(t.column(name)).to_numpy(zero_copy_only=False).astype(bool)
        mode = col("failure_mode")
        self.mismatch = np.array([x == "mismatch" for x in mode.names], bool)[mode.code] if mode.names else np.zeros(0, bool)
        self.key = col("key").code
        self.m, self.o = np.flatnonzero(self.mismatch), np.flatnonzero(~self.mismatch)
        self.place = np.empty(len(self.cls), np.int64)
        self.place[self.m], self.place[self.o] = np.arange(len(self.m)), np.arange(len(self.o))
        # of mismatches
        length = col("trace_length_bucket")
        self.ibex, self.spike, self.length = col("mismatch_ibex_mnemonic").at(self.m), col("mismatch_spike_mnemonic").at(self.m), length.code[self.m]
        self.short = np.array([x == "short" for x in length.names], bool)[self.length] if length.names else np.zeros(0, bool)
        self.loop, self.repeat, self.early, self.same = (flag(c)[self.m] for c in ("has_signature_loop", "has_repeating_tail", "early_mismatch", "same_reg_pair"))
        self.uniform = t.column("tail_mnem_uniformity").to_numpy()[self.m]
        self.places = Places(_whole(t.column("mismatch_context_mnemonics")).take(pa.array(self.m)))
        # of the others
        kind = col("sim_fatal_kind")
        self.kind, self.source, self.test, self.mode = kind.at(self.o), col("sim_fatal_source").at(self.o), col("regr_test_name").at(self.o), mode.at(self.o)
        self.fatal = np.array([[fatal(a, b) for b in kind.names] for a in kind.names]).reshape(len(kind.names), len(kind.names))
        self.no_dret = np.array([x == "no_dret" for x in kind.names], bool)[self.kind.code] if kind.names else np.zeros(0, bool)
        self.asserted = np.array([x == "assert" for x in mode.names], bool)[self.mode.code] if mode.names else np.zeros(0, bool)
        asserts = _whole(t.column("sim_error_asserts")).take(pa.array(self.o))
        self.some, self.sets = asserts.value_lengths().to_numpy(zero_copy_only=False) > 0, Sets(asserts)

    def _mismatch(self, i: int) -> np.ndarray:
        ibex = 0.75 * ((self.ibex.code != self.ibex.code[i]) & ~self.ibex.blank[i])
        spike = 0.75 * ((self.spike.code != self.spike.code[i]) & ~self.spike.blank[i])
        length = np.where(self.length == self.length[i], 0.0, np.where(self.short | self.short[i], 0.95, 0.6))
        loop, repeat, early, same = self.loop != self.loop[i], self.repeat != self.repeat[i], self.early != self.early[i], self.same != self.same[i]
        # the weights, sums and floors of distances.mismatch_distance, in its order
        score = 0.18 * ibex + 0.16 * spike
        for w, d in ((0.24, 1.0 - self.places.overlap(i)), (0.14, length), (0.10, loop * 0.80), (0.05, repeat * 0.35), (0.04, np.abs(self.uniform[i] - self.uniform)), (0.04, early * 0.70), (0.05, same * 0.85)):
            score += w * d
        score = np.minimum(1.0, score)
        for floor, when in ((0.80, (ibex > 0) & (spike > 0)), (0.88, self.short != self.short[i]), (0.82, loop), (0.84, early), (0.88, same)):
            np.maximum(score, floor, out=score, where=when)
        return np.maximum(0.0, score - 0.16 * ((self.spike.code == self.spike.code[i]) & ~self.spike.blank[i]))

    def _crossed(self, m, o) -> np.ndarray:
        """Of mismatches and others, one of the two a single place."""
        near, loop = self.early[m] & self.short[m], self.loop[m]
        late = np.where(self.asserted[o] & self.some[o], 1.0, np.where(~self.kind.blank[o] & loop, 0.95, 1.0))
        return np.where(self.no_dret[o], np.where(near, 0.68, 0.92), late)

    def _other(self, i: int) -> np.ndarray:
        alike = self.sets.jaccard(self.sets.of[i])[self.sets.of]
        penalty = np.where(self.mode.code == self.mode.code[i], 0.0, np.where(alike >= 0.5, 0.15, 0.45))
        fatal_ = self.fatal[self.kind.code[i]][self.kind.code]
        known = lambda c: np.where((c.code == c.code[i]) & ~c.blank[i], 0.0, 0.35)
        no_dret = (self.no_dret[i] & ~self.kind.blank & ~self.no_dret) | (self.no_dret & (not self.kind.blank[i] and not self.no_dret[i]))
        base = penalty + 0.30 * fatal_ + 0.30 * (1.0 - alike) + 0.10 * known(self.source)
        out = np.minimum(1.0, base + 0.05 * known(self.test))
        out = np.where((alike == 1.0) & self.some[i], np.minimum(1.0, 0.20 * fatal_ + 0.10 * penalty), out)
        out = np.where(self.some != self.some[i], np.maximum(0.75, base), out)
        return np.where(no_dret, 0.90, out)

    def signature(self, i: int) -> np.ndarray:
        """Distance of class i, its row being the earlier one, to each class."""
        out, at = np.empty(len(self.cls)), self.place[i]
        if self.mismatch[i]:
            out[self.m], out[self.o] = self._mismatch(at), self._crossed(at, slice(None))
        else:
            out[self.m], out[self.o] = self._crossed(slice(None), at), self._other(at)
        out[self.key == self.key[i]] = 0.0
        return out

    def cosine(self, i: int) -> np.ndarray:
        if self.cosines is None:
            return np.zeros(len(self.cls))
        own = self.text_of[i]
        out = self.cosines.block(own, own + 1)[0][self.text_of]
        out[self.text_of == own] = 1.0
        return out

    def blended(self, i: int, signature: np.ndarray, away: np.ndarray) -> np.ndarray:
        near = signature < 0.72
        w = np.where(near, 0.85, 0.92)
        if self.mismatch[i]:
            w = np.where(self.mismatch, np.where(near, 0.96, 1.0), w)
        return np.where(self.key == self.key[i], 0.0, w * signature + (1.0 - w) * away)

    def row(self, i: int) -> dict[str, np.ndarray]:
        """signature, cosine and distance of class i, its row being the earlier one, to each class; to itself 0, 1 and 0."""
        signature = self.signature(i)
        if self.cosines is None:
            return {"signature": signature, "cosine": np.zeros(len(signature)), "distance": signature}
        cosine = self.cosine(i)
        return {"signature": signature, "cosine": cosine, "distance": self.blended(i, signature, np.clip(1.0 - cosine, 0.0, 1.0))}

    def matrix(self) -> np.ndarray:
        """All distances; [i, j] is that of i's row as the earlier one."""
        away, out = self.cosines.away(), np.empty((len(self.cls), len(self.cls)))
        for i in range(len(out)):
            out[i] = self.blended(i, self.signature(i), away[self.text_of[i]][self.text_of])
        return out
