"""Text vectors in long form: (case_id, space, term, weight). No dense matrix is made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultweave.functions import text as X

SPACES = {"word": (1, 3), "char": (3, 6)}


def term_counts(docs: DataFrame, spaces: dict = SPACES) -> DataFrame:
    """(case_id, space, term, tf) of ``docs(case_id, text)``."""
    out = None
    for space, (low, high) in spaces.items():
        grams = X.word_ngrams(X.word_tokens(F.col("text")), low, high) if space == "word" else X.char_ngrams(F.col("text"), low, high)
        one = docs.select("case_id", F.lit(space).alias("space"), F.explode(grams).alias("term")).groupBy("case_id", "space", "term").agg(F.count("*").alias("tf"))
        out = one if out is None else out.unionByName(one)
    return out


def tfidf(docs: DataFrame, spaces: dict = SPACES) -> DataFrame:
    """Sublinear term frequency times smooth inverse document frequency, each case's space at length 1.

    ``docs(case_id, text)`` may have ``n``, how many cases have that text; a row counts as so many then.
    """
    many = "n" in docs.columns
    n = (docs.agg(F.sum("n")).first()[0] or 0) if many else docs.count()
    counts = term_counts(docs, spaces)
    weighed = counts.join(docs.select("case_id", "n"), "case_id") if many else counts.withColumn("n", F.lit(1))
    df = weighed.groupBy("space", "term").agg(F.sum("n").alias("df"))
    raw = counts.join(df, ["space", "term"])
    raw = raw.withColumn("w", (1 + F.log("tf")) * (F.log((1.0 + n) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("case_id", "space")))
    return raw.select("case_id", "space", "term", "tf", "df", (F.col("w") / norm).alias("weight"))


def cosines(vectors: DataFrame) -> DataFrame:
    """(a, b, cosine) for the pairs a < b that share a term; pairs that share none have cosine 0 and no row.

    A case's length over all spaces is the root of the number of its non-empty spaces, each being of length 1.
    """
    size = vectors.groupBy("case_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("size"))
    left = vectors.select(F.col("case_id").alias("a"), "space", "term", F.col("weight").alias("wa"))
    right = vectors.select(F.col("case_id").alias("b"), "space", "term", F.col("weight").alias("wb"))
    dots = left.join(right, ["space", "term"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    sizes = lambda k: size.select(F.col("case_id").alias(k), F.col("size").alias(f"size_{k}"))
    both = dots.join(sizes("a"), "a").join(sizes("b"), "b")
    return both.select("a", "b", F.least(F.lit(1.0), F.col("dot") / (F.col("size_a") * F.col("size_b"))).alias("cosine"))


def prepared_text(cases: DataFrame) -> DataFrame:
    """(case_id, text) from signature rows: the cleaned blob or a placeholder."""
    return cases.select("case_id", X.or_placeholder(X.clean_blob(F.col("text_blob")), F.col("case_id")).alias("text"))
