"""A corpus pipeline of five of the llm operators.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir) and returns the
documents that it keeps, with the columns of ``documents``; the last one returns packed pieces. Between two stages the
documents are written as Parquet to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm import languages, leaks, packing, private, similar
from faultweave.llm._shared import Saved, table, without

#: Below this posterior a text's language is not settled.
MIN_SCORE = 0.5


def _named(docs: DataFrame) -> DataFrame:
    """(row, id, text): id is a hash of doc_id and text, so rows that repeat an id are told apart and equal rows are not."""
    return docs.select(F.struct("*").alias("row"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("id"), "text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter (null and empty ones too) and texts whose language is not settled.

    Learns from the labelled rows it is given; with none, only texts without a letter go. Null and
    repeated ids, repeated rows and columns of any name pass as they are; no rows give none.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("id"), "text", "lang").where(F.col("id").isNotNull())
    model = languages.fit(labelled.where(~languages.held_out(F.col("id"))))
    names = [f"c{n}" for n in range(len(docs.columns))]  # no column can clash with the prediction's
    text = names[docs.columns.index("text")]
    told = languages.predict(docs.toDF(*names), model, text)
    unlabelled = F.lit(not model.languages)  # nothing was learned: only texts without a letter go
    told = told.where((unlabelled & F.col(text).rlike(r"\p{L}")) | (F.col("lang_pred") != "und") & (F.col("score") >= MIN_SCORE))
    return told.select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked texts, the one with the smallest id.

    Null, empty and blank texts are linked with nothing and stay. Rows without an id, and rows of one
    id with different texts, are documents of their own, named by a negative hash of id and text;
    of rows that agree in id and text one stays. Only the ids of what goes are joined with the texts.
    """
    doc_id, own = F.col("doc_id").cast("long"), F.lit(-1) - F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), "text"), 1)
    named = docs.select(F.struct("*").alias("row"), F.coalesce(doc_id, own).alias("id"), own.alias("own"), "text")
    saved, inner = Saved(spark), Saved(spark)
    torn = saved.save(named.groupBy("id").agg(F.min("own").alias("low"), F.max("own").alias("high")).where("low < high").select("id"))
    if torn.count():
        marked = named.join(torn.withColumn("torn", F.lit(True)), "id", "left")
        named = marked.select("row", F.when(F.col("torn"), F.col("own")).otherwise(F.col("id")).alias("id"), "own", "text")
    groups = saved.save(similar.similar_documents(named, id_col="id", saved=inner))
    inner.drop_all()  # before the texts are read again
    fate = groups.groupBy(F.col("doc_id").alias("id")).agg(F.min("component_id").alias("least"), F.max("n_shingles").alias("n"), F.count("*").alias("rows"))
    fate = saved.save(fate.where("least <> id OR n > 0 AND rows > 1").select("id", F.expr("least = id").alias("again")))
    gone, again = saved.save(fate.select("id")), saved.save(fate.where("again").select("id"))
    kept = without(named, gone, "id").select("row")
    if again.count():  # equal rows: aggregated before the shuffle, so any number of them is one row a task
        kept = kept.union(named.join(again, "id", "left_semi").groupBy("id").agg(F.first("row").alias("row")).select("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, word for word or with other numbers, names or units.

    Null and empty texts hold nothing and stay; rows are judged by id and text, so repeated rows go
    or stay together and null ids are no exception; with no items or no rows nothing changes.
    """
    named, saved = _named(docs), Saved(spark)
    gone = saved.save(leaks.find_leaks(named, table(spark, sf_dir, "benchmark"), id_col="id").select(F.col("doc_id").alias("id")).distinct())
    return without(named, gone, "id").select("row.*")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in angle brackets; n_chars becomes the new length.

    Every row stays; null texts stay null, and rows without personal data are not touched (not even a
    wrong n_chars). Repeated rows and null ids are rows like any other; no rows give none.
    """
    found = private.find_private(docs.select("doc_id", "text", F.struct("*").alias("row")), keep=("row",))
    spans, text = F.concat("base", "added"), F.col("row.text")
    new = F.when(text.isNotNull(), private.redact(text, spans))
    changed = {"text": new, "n_chars": F.when(F.size(spans) > 0, F.char_length(new).cast("long")).otherwise(F.col("row.n_chars"))}
    return found.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents as pieces of packed sequences; null and empty texts are one piece with the end id alone, and repeated rows and ids are pieces of their own."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("PII", redact), ("best-fit packing", pack)]

#: The language model and the packing plan have no SQL form; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, saved = table(spark, sf_dir, "documents"), Saved(spark)
    for n, (_, stage) in enumerate(STAGES[:-1]):
        before, count = docs, len(Saved.live)
        docs = saved.save(stage(spark, before, sf_dir))
        Saved.drop_since(count, docs)  # the stage's own tables
        if n:
            saved.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
