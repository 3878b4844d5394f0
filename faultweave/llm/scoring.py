"""Language-model scores by stupid backoff, each document against the counts of all the others.

n-gram counts of the whole corpus are partitioned by hash and joined back to each text's n-grams;
a document's own counts are taken off, so its text never vouches for itself and backing off happens.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm import words as W
from faultweave.llm._shared import shuffle_partitions, table
from faultweave.llm.ngram_exchange import Batch, distinct_counts, exchange

ORDER, BACKOFF = 3, 0.4
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


def lm_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score) of every whole text.

    A word with history u v costs ln(c(u v w) / c(u v)) if the other documents have u v w, else ln
    backoff plus the cost with the history shortened by a word; at the end c(w) / N, and for a word
    that no other document has backoff / N (N: words of the other documents, 1 at least). Words are
    runs of non-space with A-Z as a-z, histories stay in the text. Null and empty texts: 0 words,
    score 0, mean null. Null and repeated ids are rows of their own, and repeated rows count as
    other documents to each other; an empty table gives no rows; other columns are ignored.
    """

    def grams(b: Batch, number: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        return distinct_counts(W.grams(b.h, number + 1)[W.left_in_text(b.counts) > number], bits)

    def finish(b: Batch, known, total: int, bits: int) -> Iterator[pa.RecordBatch]:
        left, doc = W.left_in_text(b.counts), np.repeat(np.arange(len(b.counts)), b.counts)
        others = []  # for n: at each place, how often other documents have the n-gram that starts there
        for n in range(1, order + 1):
            ok = left >= n
            u, _, sums = known(n - 1)
            at = np.searchsorted(u, W.grams(b.h, n)[ok] >> np.uint64(64 - bits))
            _, inverse, own = np.unique(doc[ok] * np.int64(max(1, len(u))) + at, return_inverse=True, return_counts=True)
            c = np.zeros(len(b.h), np.int64)
            c[ok] = sums[at] - own[inverse]
            others.append(c)
            del u, sums, at, inverse, own
        rest = np.maximum(1, total - b.counts)[doc].astype(float)
        score = np.where(others[0] > 0, others[0], backoff) / rest
        place = np.arange(len(b.h)) - np.repeat(np.cumsum(b.counts) - b.counts, b.counts)
        for n in range(2, order + 1):
            has = np.flatnonzero(place >= n - 1)
            seen, context = others[n - 1][has - n + 1], others[n - 2][has - n + 1]
            score[has] = np.where(seen > 0, seen / np.maximum(context, 1), backoff * score[has])
        sums = np.zeros(len(b.counts))
        np.add.at(sums, doc, np.log(score))
        ids = pa.array(b.ids, pa.int64(), mask=b.null)
        yield pa.RecordBatch.from_arrays([ids, pa.array(b.counts, pa.int64()), pa.array(sums, pa.float64())], schema=_SCHEMA)

    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = exchange(docs, list(range(order)), grams, finish, "doc_id long, n_words long, log_score double", shuffle_partitions(documents.sparkSession))
    return rows.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lm_scores(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t-\\r]+')"
OP1_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
t AS (SELECT r, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM d),
g AS (SELECT r, i, w, lag(w) OVER (PARTITION BY r ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY r ORDER BY i) AS u FROM t),
d1 AS (SELECT r, w, count(*) AS n FROM g GROUP BY ALL), c1 AS (SELECT w, sum(n) AS n FROM d1 GROUP BY w),
d2 AS (SELECT r, v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY ALL), c2 AS (SELECT v, w, sum(n) AS n FROM d2 GROUP BY v, w),
d3 AS (SELECT r, u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY ALL), c3 AS (SELECT u, v, w, sum(n) AS n FROM d3 GROUP BY u, v, w),
o1 AS (SELECT r, w, c1.n - d1.n AS n FROM d1 JOIN c1 USING (w)),
o2 AS (SELECT r, v, w, c2.n - d2.n AS n FROM d2 JOIN c2 USING (v, w)),
o3 AS (SELECT r, u, v, w, c3.n - d3.n AS n FROM d3 JOIN c3 USING (u, v, w)),
len AS (SELECT r, doc_id, len(ws) AS n_words, greatest(1, (SELECT count(*) FROM t) - len(ws)) AS rest FROM d),
s AS (
  SELECT g.r, CASE WHEN o3.n > 0 THEN o3.n / p2.n::DOUBLE
    ELSE (CASE WHEN g.u IS NULL THEN 1 ELSE {BACKOFF} END) * CASE WHEN o2.n > 0 THEN o2.n / p1.n::DOUBLE
    ELSE (CASE WHEN g.v IS NULL THEN 1 ELSE {BACKOFF} END) * (CASE WHEN o1.n > 0 THEN o1.n ELSE {BACKOFF} END) / len.rest::DOUBLE END END AS p
  FROM g JOIN len ON len.r = g.r JOIN o1 ON o1.r = g.r AND o1.w = g.w
  LEFT JOIN o2 ON o2.r = g.r AND o2.v = g.v AND o2.w = g.w LEFT JOIN o1 p1 ON p1.r = g.r AND p1.w = g.v
  LEFT JOIN o3 ON o3.r = g.r AND o3.u = g.u AND o3.v = g.v AND o3.w = g.w LEFT JOIN o2 p2 ON p2.r = g.r AND p2.v = g.u AND p2.w = g.v),
f AS (SELECT r, sum(ln(p)) AS log_score FROM s GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, round(coalesce(log_score, 0.0), 4) AS log_score,
  CASE WHEN n_words > 0 THEN round(log_score / n_words, 6) END AS mean_log_score
FROM len LEFT JOIN f USING (r)
"""
