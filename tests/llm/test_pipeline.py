"""The pipeline's stages on a small corpus, held against what a plain reading of the same rules keeps."""

import random

import numpy as np
import zlib

import corpus_pipeline
from faultweave.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, lang_pred string, base int"


def test_run_keeps_what_plain_rules_keep(spark, tmp_path):
    rng = random.Random(8)
    vocab = {g: [rng.choice(h) + rng.choice("aeiou") + rng.choice(h) + rng.choice(t) for _ in range(250)] for g, h, t in (("aa", "bdklm", ["", "a", "o"]), ("bb", "strzp", ["en", "ung", "st"]))}
    item = " ".join(rng.choice(vocab["aa"]) for _ in range(30))
    rows = []
    for i in range(60):
        g = "aa" if i % 2 else "bb"
        rows.append([i, " ".join(rng.choice(vocab[g]) for _ in range(60)), g])
    rows[11][1] = rows[10][1]  # an exact copy
    near = rows[20][1].split()
    near[30] = "other"
    rows[33][1] = " ".join(near)  # a near copy
    rows[40][1] += " " + item
    rows[41][1] = "write to a.b@c.org or +1 (017) 555-7713 " + rows[41][1]
    rows[42][1], rows[43][1], rows[44][1] = None, "12 34 !!", rows[44][1] + " " + " ".join(rng.choice(vocab["bb"]) for _ in range(9000))
    rows += [[None, rows[50][1], None], rows[51]]
    data = [(i, t, g, "s", len(t or ""), "x", "y", 1) for i, t, g in rows]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(data, SCHEMA).repartition(2).write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))

    from tokenizers import Tokenizer

    tk, want = Tokenizer.from_file(packing.default_vocabulary()), []
    gone = {11, 33, 40, 42, 43, 50}  # 50: the row without an id has its text, and the smaller number
    for i, t, _ in [*rows[:60], [None, rows[50][1], None]]:
        if i in gone:
            continue
        t = t.replace("a.b@c.org", "<email>").replace("+1 (017) 555-7713", "<phone>")
        ids = np.array(tk.encode(t, add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    got = [tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path / "d")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    docs = spark.read.parquet(str(tmp_path / "d/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "d"))
        assert docs.columns == [f.split()[0] for f in SCHEMA.split(", ")]


def test_stages_on_no_documents(spark, tmp_path):
    (tmp_path / "d").mkdir()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "d")).count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark, monkeypatch):
    """One row stays of each group, whatever the ids; rows without words stay; the joins' kind decides nothing."""
    from faultweave.operators import components

    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    near = a.replace(a.split()[39], "other")
    rows = [(1, a), (2, near), (3, b), (3, c), (4, c), (5, d), (5, d), (5, e), (None, e), (None, a), (None, None), (None, None), (6, ""), (6, ""), (7, None), (8, "one two"), (8, "one two"), (9, "ONE two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "x", "y", 1) for i, t in rows], SCHEMA).repartition(3)
    for most in (2_000_000, 0):
        monkeypatch.setattr(components, "MAX_BROADCAST", most)
        got = corpus_pipeline.near_duplicates(spark, docs, "")
        assert got.columns == docs.columns
        got = [(r["doc_id"], r["text"]) for r in got.collect()]
        assert [t for t in (a, near) if (1 if t == a else 2, t) in got] in ([a], []) and sum(t in (a, near) for _, t in got) == 1
        for t in (b, c, d, e):
            assert sum(x == t for _, x in got) == 1
        assert sum((x or "").lower() == "one two" for _, x in got) == 1
        assert sum(not x for _, x in got) == 5


def test_tables_of_a_stage_can_be_dropped(spark):
    from faultweave.operators.components import Saved

    saved = Saved(spark)
    first = saved.save(spark.range(3))
    count = len(Saved.live)
    second, third = saved.save(spark.range(4)), Saved(spark).save(spark.range(5))
    Saved.drop_since(count, third)
    assert [x[1] for x in Saved.live[count - 1 :]] == [first, third] and first.count() == 3 and third.count() == 5
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(second._saved_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert not fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(second._saved_path))
