"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is
the sum over all its segmentations into pieces (forward algorithm); the pieces' probabilities are
learned by expectation-maximisation over the same sums; a text's score is the sum over its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from faultweave.llm._shared import kept, table

#: Labelled rows per language that the model is fitted on, at most.
SAMPLE = 400
ROUNDS, PRIOR, UNKNOWN = 4, 0.05, 1e-7
#: Words of more letters are summed one by one with rescaled numbers, so many letters at a time; nothing is cut.
LONG_WORD, LONG_STEP, RESCALE = 32, 20_000, 1e120
#: Words of evidence that the score's softmax takes at most, so that mixed texts score low.
EVIDENCE = 20
_CACHE_WORDS = 400_000
_RUN = re.compile(r"[^\W\d_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary_pieces(path: str) -> list[str]:
    """The vocabulary's plain pieces; a leading mark stands for the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)))
    return sorted(set(plain))


def text_words(text: str | None) -> list[str]:
    runs = _RUN.findall((text or "").lower())
    if not any(w.isalpha() for w in runs) and not any(c.isalpha() for w in runs for c in w):
        return []
    return runs


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points, one column longer."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + codes[:, k]
    return out


@dataclass
class Model:
    """Piece probabilities by language: ``table[g, piece]``, the last column for a character that no piece has; no piece has more than ``widest`` characters."""

    languages: list[str]
    keys: np.ndarray
    slots: np.ndarray
    table: np.ndarray
    widest: int

    @classmethod
    def empty(cls, languages: list[str], pieces: list[str]) -> Model:
        keys = np.array([_hash_of(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        table = np.full((len(languages), len(pieces) + 1), 1.0 / max(1, len(pieces)))
        table[:, -1] = UNKNOWN
        return cls(languages, keys[order], order, table, max(map(len, pieces), default=1))

    def spans(self, words: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]]:
        """Words by length: their indices and, for every span from s to e, the piece of each word (-1: none)."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(i)
        for n, at in by.items():
            codes = np.array([[0x2581, *map(ord, words[i])] for i in at], np.uint64)
            h = _hashes(codes)
            out = []
            for e in range(1, n + 1):
                for s in range(max(0, e - self.widest), e):
                    piece = self.piece(h[:, e], h[:, s], e - s)
                    if (piece >= 0).any():
                        out.append((s, e, piece))
            yield np.array(at), out

    def piece(self, end: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
        """The piece between two prefix hashes, -1 for none; a character that is none is the unknown one."""
        key = end - start * np.uint64(pow(int(_BASE), width, 1 << 64))
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, self.slots[k], self.table.shape[1] - 1 if width == 1 else -1)

    def steps(self, h: np.ndarray, back: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place of a long word: the pieces that end there, by width, and their probabilities."""
        n = len(h) - 1
        starts = range(1, n + 1, LONG_STEP)
        for low in reversed(starts) if back else starts:
            high = min(n + 1, low + LONG_STEP)
            pieces = np.full((self.widest, high - low), -1)
            for width in range(1, self.widest + 1):
                e = np.arange(max(low, width), high)
                if len(e):
                    pieces[width - 1, e - low] = self.piece(h[e], h[e - width], width)
            chances = np.where(pieces >= 0, self.table[:, pieces], 0.0)
            for e in range(high - 1, low - 1, -1) if back else range(low, high):
                yield e, pieces[:, e - low], chances[:, :, e - low]

    def long_forward(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(alpha, scale) of a long word: the sum over all segmentations up to place e is alpha[:, e] * exp(-scale[:, e])."""
        n = len(h) - 1
        alpha, scale, now = np.zeros((len(self.languages), n + 1)), np.zeros((len(self.languages), n + 1)), np.zeros(len(self.languages))
        alpha[:, 0] = 1.0
        for e, _, chance in self.steps(h):
            width = min(e, self.widest)
            alpha[:, e] = (alpha[:, e - width : e][:, ::-1] * chance[:, :width]).sum(axis=1)
            scale[:, e] = now
            small = alpha[:, e] < 1 / RESCALE
            if small.any():
                recent = slice(max(0, e - self.widest), e + 1)
                alpha[small, recent] *= RESCALE
                scale[small, recent] += np.log(RESCALE)
                now[small] += np.log(RESCALE)
        return alpha, scale

    def long_score(self, word: str) -> np.ndarray:
        alpha, scale = self.long_forward(_prefix(word))
        return np.log(alpha[:, -1]) - scale[:, -1]

    def long_learn(self, word: str, count: np.ndarray, sums: np.ndarray) -> None:
        """Adds a long word's expected pieces, ``count`` times in each language."""
        h = _prefix(word)
        alpha, scale = self.long_forward(h)
        with np.errstate(divide="ignore"):
            before = np.log(alpha) - scale
        n, total = len(h) - 1, before[:, -1]
        beta, now = np.zeros_like(alpha), np.zeros(len(count))
        beta[:, n] = 1.0
        for e, piece, chance in self.steps(h, back=True):
            width = min(e, self.widest)
            small = beta[:, e] < 1 / RESCALE
            if small.any():
                beta[small, max(0, e - self.widest) : e + 1] *= RESCALE
                now[small] += np.log(RESCALE)
            beta[:, e - width : e] += beta[:, e : e + 1] * chance[:, :width][:, ::-1]
            with np.errstate(divide="ignore"):
                after = np.log(beta[:, e]) - now - total
                used = np.exp(before[:, e - width : e][:, ::-1] + np.log(chance[:, :width]) + after[:, None]) * count[:, None]
            for g in range(len(count)):
                np.add.at(sums[g], np.maximum(piece[:width], 0), used[g])

    def forward(self, spans: list, n: int, count: int) -> np.ndarray:
        alpha = np.zeros((n + 1, len(self.languages), count))
        alpha[0] = 1.0
        for s, e, piece in spans:
            alpha[e] += alpha[s] * np.where(piece >= 0, self.table[:, piece], 0.0)
        return alpha

    def word_scores(self, words: list[str]) -> np.ndarray:
        """ln of each word's probability in each language."""
        out = np.zeros((len(words), len(self.languages)))
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
        for at, spans in self.spans([words[i] for i in short]):
            n = len(words[short[at[0]]]) + 1
            out[short[at]] = np.log(self.forward(spans, n, len(at))[n]).T
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                out[i] = self.long_score(w)
        return out

    def learn(self, words: list[str], counts: np.ndarray, rounds: int) -> None:
        """``counts[g, word]``; expectation-maximisation over all segmentations."""
        short = np.array([i for i, w in enumerate(words) if len(w) <= LONG_WORD], np.int64)
        held = [(short[at], spans, len(words[short[at[0]]]) + 1) for at, spans in self.spans([words[i] for i in short])]
        for _ in range(rounds):
            sums = np.full(self.table.shape, PRIOR)
            for at, spans, n in held:
                alpha = self.forward(spans, n, len(at))
                beta = np.zeros_like(alpha)
                beta[n] = 1.0
                for s, e, piece in reversed(spans):
                    beta[s] += beta[e] * np.where(piece >= 0, self.table[:, piece], 0.0)
                weight = counts[:, at] / alpha[n]
                for s, e, piece in spans:
                    used = np.where(piece >= 0, self.table[:, piece], 0.0) * alpha[s] * beta[e] * weight
                    for g in range(len(self.languages)):
                        sums[g] += np.bincount(np.maximum(piece, 0), used[g], self.table.shape[1])
            for i, w in enumerate(words):
                if len(w) > LONG_WORD:
                    self.long_learn(w, counts[:, i], sums)
            sums[:, -1] = 0
            self.table = sums / sums.sum(axis=1, keepdims=True)
            self.table[:, -1] = UNKNOWN


def _prefix(word: str) -> np.ndarray:
    """Prefix hashes of a long word with its mark."""
    h, out = 0, [0]
    for c in "\u2581" + word:
        h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
        out.append(h)
    return np.array(out, np.uint64)


def _hash_of(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(_BASE) + ord(c)) & (2**64 - 1)
    return h


def fit(labelled: DataFrame, vocabulary: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> Model:
    """A model from ``labelled(id long, text, lang)``: of each language the ``sample`` ids with the smallest hashes.

    Ids are first cut by a bound on the hash that leaves about twice the sample, so no task ranks more
    than that; rows of one id share the weight of one row. Texts are read once and never shuffled.
    Languages are few: their counts go to the driver, and so do the word counts of the sample.
    """
    ids = labelled.where("lang IS NOT NULL").select("lang", "id")
    counts = ids.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return Model.empty([], vocabulary_pieces(vocabulary or default_vocabulary()))
    top, wanted = 2**63 - 1, 2 * sample + 50
    bounds = labelled.sparkSession.createDataFrame([(r["lang"], top if r["n"] <= wanted else -(2**63) + (2**64 * wanted) // r["n"]) for r in counts], "lang string, bound long")
    near = ids.join(F.broadcast(bounds), "lang").where(F.xxhash64("id") <= F.col("bound")).groupBy("lang", "id").agg((1.0 / F.count("*")).alias("weight"))
    pick = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    picked = near.withColumn("nth", F.row_number().over(pick)).where(F.col("nth") <= sample).select("lang", "id", "weight")
    chosen = labelled.where("lang IS NOT NULL AND text IS NOT NULL").join(F.broadcast(picked), ["lang", "id"])  # ``sample`` rows a language

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in it:
            found: dict[tuple[str, str], float] = {}
            for lang, text, weight in zip(*(c.to_pylist() for c in rb.columns), strict=True):
                for w in text_words(text):
                    found[lang, w] = found.get((lang, w), 0.0) + weight
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.string()), pa.array(list(found.values()), pa.float64())], names=["lang", "word", "n"])

    counted = chosen.select("lang", "text", "weight").mapInArrow(count, "lang string, word string, n double").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    languages, words = sorted(set(counted["lang"])), sorted(set(counted["word"]))
    counts = np.zeros((len(languages), len(words)))
    place = {w: i for i, w in enumerate(words)}
    for lang, w, n in zip(counted["lang"], counted["word"], counted["n"], strict=True):
        counts[languages.index(lang), place[w]] = n
    model = Model.empty(languages, vocabulary_pieces(vocabulary or default_vocabulary()))
    if words:
        model.learn(words, counts, rounds)
    return model


def predict(documents: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The frame with lang_pred and score added: every word of every whole text counts."""
    place, names = documents.columns.index(text_col), [*documents.columns, "lang_pred", "score"]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        state = kept("languages", dict)
        if state.get("model") is not m:
            state.update(model=m, words={}, scores=np.zeros((0, len(m.languages))))
        for rb in it:
            for i in range(0, rb.num_rows, 200):
                part = rb.slice(i, 200)
                texts = [text_words(t) for t in part.column(place).to_pylist()]
                known: dict[str, int] = state["words"]
                new, long = [w for w in dict.fromkeys(w for ws in texts for w in ws if len(w) <= LONG_WORD) if w not in known], {}
                if len(known) + len(new) > _CACHE_WORDS:
                    known = state["words"] = {}
                    state["scores"] = np.zeros((0, len(m.languages)))
                    new = list(dict.fromkeys(w for ws in texts for w in ws if len(w) <= LONG_WORD))
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    state["scores"] = np.concatenate([state["scores"], m.word_scores(new)])
                langs, scores = [], []
                for ws in texts:
                    if not ws or not m.languages:
                        langs.append("und")
                        scores.append(0.0)
                        continue
                    s = state["scores"][[known[w] for w in ws if len(w) <= LONG_WORD]].sum(axis=0)
                    for w in ws:
                        if len(w) > LONG_WORD:
                            s = s + (long[w] if w in long else long.setdefault(w, m.long_score(w)))
                    s = s * (min(len(ws), EVIDENCE) / len(ws))
                    p = np.exp(s - s.max())
                    best = int(np.argmax(p))
                    langs.append(m.languages[best])
                    scores.append(float(p[best] / p.sum()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=names)

    schema = StructType([*documents.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return documents.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 when divided by 3 (a null id: no)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str | None = None, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learned from the rows that are not held out.

    Text that is null or has no letter is ``und`` with score 0, and so is all text if no row has a
    label. Null ids are predicted and never learned from; repeated rows are predicted alike; ties go
    to the first language by name; an empty table gives no rows; other columns are ignored.
    """
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(docs.where(F.col("id").isNotNull() & ~held_out(F.col("id"))), vocabulary, sample)
    out = predict(docs.select(F.col("id").alias("doc_id"), "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
