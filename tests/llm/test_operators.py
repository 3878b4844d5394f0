"""Every operator against a plain version of itself on a small table with nulls, ties, repeats, empty and very long texts and clashing columns."""

import bisect
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from faultweave.llm import languages, leaks, packing, pages, private, repeats, scoring, shards, similar, sketches
from faultweave.llm import words as W

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, base string, id long, cls string, score double"
CLASH = (7, "b", 8, "c", 0.5)
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^ \t-\r]+", (t or "").translate(LOW))


def corpus():
    rng = random.Random(5)
    vocab = [rng.choice("bdfglmnprst") + rng.choice("aeiou") + rng.choice("bdglmnrst") + rng.choice(["", "en", "or"]) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    base = prose(120).split()
    near = base[:]
    near[60] = "CHANGED"
    passage = prose(70)
    texts = [
        None, "", "   \n", "one", "One two THREE", "one two three", prose(40), " ".join(base), " ".join(near), " ".join(base), prose(90) + " " + passage + " " + prose(30), prose(20) + "\n" + passage + " " + prose(80),
        prose(6000), "x" * 30_000, "mail a.b@c.org or +1 (017) 555-7713, ip 10.0.0.256 and 10.0.0.1; card 4111 1111 1111 1111 é", "###\n123 456",
    ]
    rows = [(i, t, "en" if i % 2 else None, "s", len(t or ""), *CLASH) for i, t in enumerate(texts)]
    return rows + [rows[6], (None, texts[7], None, None, None, *CLASH), (None, None, None, None, None, *CLASH)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_word_hashes_match_plain_split():
    import pyarrow as pa

    texts = [r[1] for r in corpus()]
    h, counts, a, b = W.tokens(pa.array(texts), places=True)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))
    u = np.unique(h)
    assert (W.unpack_sorted(W.pack_sorted(u), np.uint64) == u).all()


def test_lm_scores(spark, docs, empty):
    import math

    data = [(r[0], words(r[1])) for r in corpus()]
    grams = lambda ws, n: Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    own = [[grams(ws, n) for n in (1, 2, 3)] for _, ws in data]
    all_ = [sum((o[n] for o in own), Counter()) for n in range(3)]
    total, want = sum(len(ws) for _, ws in data), []
    for (i, ws), o in zip(data, own):
        c = lambda g: all_[len(g) - 1][g] - o[len(g) - 1][g]  # noqa: B023, E731
        s, rest = 0.0, max(1, total - len(ws))
        for k, w in enumerate(ws):
            p = (c((w,)) or 0.4) / rest
            for n in (2, 3):
                if k >= n - 1:
                    g = tuple(ws[k - n + 1 : k + 1])
                    p = c(g) / c(g[:-1]) if c(g) > 0 else 0.4 * p
            s += math.log(p)
        want.append((i, len(ws), round(s, 6)))
    got = [(r["doc_id"], r["n_words"], round(r["log_score"], 6)) for r in scoring.lm_scores(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert scoring.lm_scores(empty).count() == 0


def test_word_queries_on_a_table_with_clashing_columns(spark, tmp_path):
    """The registered queries of the word operators: their columns, and the rows their plain versions give."""
    data = corpus()
    (tmp_path / "d").mkdir()
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    here = str(tmp_path / "d")
    found = similar.op6_similar(spark, here)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert rows(found, *found.columns) == sorted(plain_components([(r[0], r[1]) for r in data]), key=str)
    found = repeats.op8_repeats(spark, here)
    assert found.columns == ["doc_id", "start_word", "end_word", "n_words"]
    once = {(r[0], r[1]): words(r[1]) for r in data}
    copies = Counter((r[0], r[1]) for r in data)
    want = [(d, a, b, b - a) for (d, t), w in once.items() for x, a, b in plain_repeats([((i, u), v) for (i, u), v in once.items()]) if x == (d, t) for _ in range(copies[d, t])]
    assert rows(found, *found.columns) == sorted(want, key=str)
    found = scoring.op1_lm_scores(spark, here)
    assert found.columns == ["doc_id", "n_words", "log_score", "mean_log_score"] and found.count() == len(data)


def test_sketches(spark, docs, empty):
    from pyspark.sql import functions as F

    f = {r["doc_id"]: r for r in sketches.fingerprint(docs).collect() if r["doc_id"] is not None}
    assert f[0]["fingerprint"] == f[1]["fingerprint"] == f[2]["fingerprint"] == ""
    assert f[4]["fingerprint"] == f[5]["fingerprint"] and f[7]["fingerprint"] == f[9]["fingerprint"] != f[8]["fingerprint"]
    assert f[12]["n_distinct"] == pytest.approx(5996, rel=0.3)
    pair = spark.createDataFrame([(f[7]["sketch"], f[8]["sketch"], f[12]["sketch"])], "a array<long>, b array<long>, c array<long>")
    r = pair.select(sketches.resemblance(F.col("a"), F.col("b")).alias("j"), sketches.containment(F.col("a"), F.col("c")).alias("c"), sketches.merge(F.col("a"), F.col("b")).alias("m")).first()
    assert r["j"] == pytest.approx(111 / 121, abs=0.1) and r["c"] < 0.1
    assert r["m"] == sorted(set(f[7]["sketch"]) | set(f[8]["sketch"]))[: sketches.K]
    assert sketches.fingerprint(empty).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_next_row(docs, empty, parts):
    got = sketches.with_next(docs.where("doc_id IS NOT NULL").select("doc_id", "text").distinct(), "doc_id", ["doc_id", "text"], ["text"], parts)
    assert rows(got, "doc_id", "next_doc_id") == sorted([(i, (i + 1) % 16) for i in range(16)], key=str)
    assert sketches.with_next(docs.select("doc_id", "text"), "doc_id", ["text"], ["text"], parts).count() == docs.count()
    assert sketches.with_next(empty.select("doc_id", "text"), "doc_id", ["text"], ["text"], parts).count() == 0


def spark_hash(*values):
    """Spark's 64-bit hash of text and numbers, one after the other."""
    import struct

    import xxhash

    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(struct.pack("<q", v) if isinstance(v, int) else v.encode(), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def signed_hash(*hashes):
    import struct

    import xxhash

    h = 42
    for v in hashes:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def plain_sketch(text):
    h = [spark_hash(w) for w in re.split("[ \\t-\\r]+", text.lower()) if w]
    shingles = {signed_hash(*h[i : i + 5]) for i in range(len(h) - 4)} if len(h) >= 5 else {signed_hash(*h)} if h else set()
    return sorted(shingles)[: sketches.K]


def plain_likeness(a, b):
    both = sorted(set(a) | set(b))[: sketches.K]
    return len(set(a) & set(b) & set(both)) / len(both) if both else 1.0


@pytest.mark.parametrize("hot", [False, True])
def test_fingerprints_query(spark, tmp_path, hot):
    """Every column against plain Python; with hot: a third of the rows without an id, a third with one id."""
    rng = random.Random(4)
    vocab = ["w%d" % i for i in range(60)] + ["\u00e9t\u00e9", "\U0001f600"]
    data = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 1, 3, 4, 5, 9, 40, 400])))) for i in rng.sample(range(10**6), 60)]
    data += [(-5, None), (-4, ""), (10**12, "a b c d e f"), (10**12 + 1, "a b c d e g")]
    if hot:
        data += [(None, f"none {rng.random()} " + "x y z " * 4) for _ in range(64)] + [(77, f"one {rng.random()} " + "p q " * 5) for _ in range(64)]
    (tmp_path / "d").mkdir()
    spark.createDataFrame([(*r, *CLASH) for r in data], "doc_id long, text string, sketch long, next_text string, _range int, edited string, n double").repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    df = sketches.op2_fingerprints(spark, str(tmp_path / "d"))
    assert df.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    order = sorted([(i, t or "") for i, t in data], key=lambda r: (r[0] is not None, r[0] or 0, spark_hash(r[1])))
    text = lambda s: "".join(f"{x & (2**64 - 1):016x}" for x in s)
    want = []
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = plain_sketch(t), plain_sketch(edited), plain_sketch(n)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), text(a), text(b), round(plain_likeness(a, b), 9), round(plain_likeness(a, c), 9)))
    assert sorted(((*tuple(r)[:5], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str) == sorted(want, key=str)


def test_private_spans(spark, docs, empty):
    r = next(r for r in private.find_private(docs).collect() if r["doc_id"] == 14)
    t = corpus()[14][1]
    assert [(private.KINDS[s["kind"]], t[s["start"] : s["end"]]) for s in r["base"]] == [("email", "a.b@c.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert private.find_private(empty).count() == 0
    seeds = [(i, f"please dial desk +1 (2{i}0) 555-01{i}3 today", None, None, 0, *CLASH) for i in range(4)]
    extra = [(9, "please dial desk 555-0199-22 today", None, None, 0, *CLASH), (10, "serial 555-0177-33 sold", None, None, 0, *CLASH)]
    found = {r["doc_id"]: r["added"] for r in private.find_private(spark.createDataFrame(seeds + extra, SCHEMA)).collect()}
    assert [(s["kind"], s["value"]) for s in found[9]] == [(3, "555-0199-22")] and found[10] == [] and found[1] == []
    from pyspark.sql import functions as F

    out = private.find_private(docs, keep=("text",)).withColumn("t", private.redact(F.col("text"), F.concat("base", "added"))).where("doc_id = 14").first()["t"]
    assert out == "mail <email> or <phone>, ip 10.0.0.256 and <ip>; card <card> é"


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_private_regexes_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    plain = {"email": EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab1.2@-+ _(9é") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["a@b.c.@d.e_x@d.e", "1.2.3.4.5.6.7.8", "1" * 20_000, "a" * 20_000]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for kind, pattern in private.PATTERNS.items():
        for t, m in df.select("t", private.matches(F.col("t"), pattern)).collect():
            assert [(x["start"], x["end"]) for x in m] == [x.span() for x in plain[kind].finditer(t)], (kind, t)


def test_packing(docs, empty):
    got = packing.pack(docs).collect()
    from tokenizers import Tokenizer

    tk, want = Tokenizer.from_file(packing.default_vocabulary()), []
    for i, t, *_ in corpus():
        ids = np.array(tk.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(i, k, s, min(4096, len(ids) - s), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted(tuple(r)[:5] for r in got if r[0] is not None) == sorted(w for w in want if w[0] is not None) and len(got) == len(want)
    held = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in held.values():
        v.sort()
        assert v[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(v, v[1:])) and sum(n for _, n in v) <= 4096
    assert packing.pack(empty).count() == 0


def test_encoder_equals_the_tokenizer():
    """Random Unicode texts, and every character of the first plane among others."""
    from tokenizers import Tokenizer

    path = packing.default_vocabulary()
    own, tk, rng = packing.Encoder(path), Tokenizer.from_file(path), random.Random(1)
    ascii_ = [chr(c) for c in range(32, 127)] + list(" \t\n\r'") * 6
    odd = "\u0130\u03a3\u03c3\u0338\u0301\u1c8a\u00b2\u00a0\u2003\u0085\x0b\x1c\u200b\u1e9e\ufb01\uac00\u1100"
    any_ = lambda: chr(c) if not 0xD800 <= (c := rng.randrange(0x80, 0x30000)) < 0xE000 else "z"
    char = lambda: rng.choice([rng.choice(ascii_), rng.choice(ascii_), rng.choice(ascii_), chr(rng.randrange(0x80, 0x600)), rng.choice(odd), any_()])
    texts = ["".join(char() for _ in range(rng.randint(1, 24))) for _ in range(100_000)]
    plane = [chr(c) for c in range(0x21, 0x10000) if not 0xD800 <= c < 0xE000]
    texts += [shape.replace("{}", c) for c in plane for shape in ("a{}b", ".{}'{}s")] + ["<|endoftext|>", "a<|startoftext|>b c", "x <| 's don't it'll"]
    for i in range(0, len(texts), 1000):
        part = texts[i : i + 1000]
        want = [np.array(e.ids, "<u4").tobytes() for e in tk.encode_batch(part, add_special_tokens=False)]
        assert own(part) == want


def test_plans_hold_every_length_and_use_patterns():
    rng = random.Random(7)
    for _ in range(40):
        size = rng.choice([100, 1000])
        h = {rng.randint(1, size if rng.random() < 0.7 else size // 10): rng.randint(1, rng.choice([2, 50])) for _ in range(rng.randint(1, 60))}
        left, plain = dict(h), packing._best_fit(dict(h), size, {})
        for waste in packing.WASTES:
            groups, held = packing._plan(left, size, waste), Counter()
            for m, g in groups:
                assert m > 0 and sum(g) <= size
                for n in g:
                    held[n] += m
            assert held == Counter(h)
        assert sum(m for m, _ in groups) == sum(m for m, _ in plain)  # the last one: best-fit's own patterns


def test_plan_holds_every_length():
    rng = random.Random(1)
    for _ in range(20):
        h = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
        groups = packing.plan(h, 100)
        held = Counter()
        for m, g in groups:
            assert m > 0 and sum(g) <= 100
            for n in g:
                held[n] += m
        assert held == Counter(h)
        free, bins = [], 0  # plain best fit, longest first
        for n in sorted((n for n, c in h.items() for _ in range(c)), reverse=True):
            k = bisect.bisect_left(free, n)
            bins += k == len(free)
            bisect.insort(free, (free.pop(k) if k < len(free) else 100) - n)
        assert sum(m for m, _ in groups) <= bins


def test_shards(docs, empty):
    big = docs
    for _ in range(5):
        big = big.union(big)
    out = shards.shard(docs.sparkSession, big, 6, range_bytes=5000).collect()
    assert len(out) == 32 * 19
    by = {}
    for r in out:
        by.setdefault(r["shard"], []).append(r)
    sizes = {k: sum(r["size"] for r in v) for k, v in by.items()}
    assert set(by) == set(range(6)) and all(sorted(r["slot"] for r in v) == list(range(len(v))) for v in by.values())
    assert max(sizes.values()) - min(sizes.values()) <= 2 * max(r["size"] for r in out)
    assert {r["text_crc32"] for r in out if r["doc_id"] == 14} == {zlib.crc32(corpus()[14][1].encode())}
    assert shards.shard(docs.sparkSession, empty, 6).count() == 0


@pytest.mark.parametrize("range_bytes", [2000, shards.RANGE_BYTES])
def test_shards_query(spark, tmp_path, monkeypatch, range_bytes):
    """Groups of equal texts of all sizes: one shard each, unless one fits in none; sizes near equal; any row may repeat."""
    monkeypatch.setattr(shards.shard, "__defaults__", (24, "doc_id", "text", range_bytes))
    rng, texts = random.Random(2), []
    for k in range(3000):
        texts += [f"{k} " + "w" * rng.randint(0, 300)] * rng.choice([1, 1, 1, 1, 2, 5])
    for k, n in enumerate([60, 30, 90, 150, 40, 40]):
        texts += [f"group {k} " + "g" * 200] * n
    texts += ["hot " + "h" * 400] * 900 + [None, None, "", "", "long " + "z" * 9000]
    rng.shuffle(texts)
    data = [(i if i % 50 else None, t, *CLASH) for i, t in enumerate(texts)] + [(7, "same row", *CLASH)] * 200
    (tmp_path / "d").mkdir()
    spark.createDataFrame(data, "doc_id long, text string, key long, shard string, range int, fixed string, size double").repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    df = shards.op5_shards(spark, str(tmp_path / "d"))
    assert df.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    got = df.collect()
    plain = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((tuple(r)[:3] for r in got), key=str) == sorted((plain(i, t) for i, t, *_ in data), key=str)
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    slots, sizes, where = {}, Counter(), {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] += r["size"]
        where.setdefault((r["text_crc32"], r["size"]), set()).add(r["shard"])
    assert set(slots) == set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    target, hot = sum(sizes.values()) / 24, zlib.crc32(("hot " + "h" * 400).encode())
    assert all(len(v) == 1 for (crc, _), v in where.items() if crc != hot) and len(where[hot, 412]) >= 900 * 412 / target
    assert max(abs(x - target) for x in sizes.values()) <= 0.01 * target + 9013


def plain_components(data):
    sets, parent = [], list(range(len(data)))
    for _, t in data:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(data, sets))]


def test_similar(docs, empty):
    want = plain_components([(r[0], r[1]) for r in corpus()])
    for block in (similar.BLOCK_SHINGLES, 100):
        assert rows(similar.similar_documents(docs, block_shingles=block), "doc_id", "n_shingles", "component_id") == sorted(want, key=str)
    assert similar.similar_documents(empty).count() == 0


def test_divide_skip_joins_what_all_pairs_join():
    def groups(n, pairs):
        parent = list(range(n))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[root(a)] = root(b)
        return [root(i) for i in range(n)]

    rng = np.random.default_rng(0)
    for trial in range(150):
        base, sets = [rng.choice(200, rng.integers(1, 40), replace=False) for _ in range(3)], []
        for _ in range(rng.integers(2, 30)):
            b = base[rng.integers(3)]
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > rng.random() * 0.3], rng.choice(200, rng.integers(0, 4))])).astype(np.uint64))
        sets = [x for x in sets if len(x)]
        side = None if trial % 2 else rng.integers(0, 2, len(sets))
        alike = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 75 * len(np.union1d(a, b))
        pairs = {(i, j) for i in range(len(sets)) for j in range(i) if (side is None or side[i] != side[j]) and alike(sets[i], sets[j])}
        got = similar.divide_skip(sets, 75, side) if sets else []
        assert all((max(x), min(x)) in pairs for x in got)
        a, b = groups(len(sets), got), groups(len(sets), pairs)
        assert len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_merge_skip_counts_what_lists_share():
    rng = random.Random(4)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 12))) for _ in range(rng.randint(1, 9))]
        least, got = rng.randint(1, 4), {}
        allowed = rng.choice([None, sorted(rng.sample(range(30), 14))])
        similar.merge_skip(lists, least, allowed, lambda c, n: got.__setitem__(c, n))  # noqa: B023
        every = Counter(x for run in lists for x in run)
        assert got == {x: n for x, n in every.items() if n >= least and (allowed is None or x in allowed)}


def test_similar_chains(spark):
    """A base with copies that are linked with it and not with each other, and chains of such."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(100)]
    data = []
    for i in range(60):
        t = base[:]
        for _ in range(rng.choice([0, 1, 2, 3, 4])):
            t[rng.randrange(100)] = f"z{rng.random()}"
        data.append((i, " ".join(t)))
    data += [(100 + i, " ".join(f"v{j}" for j in range(i * 4, i * 4 + 60))) for i in range(12)]
    df = spark.createDataFrame(data, "doc_id long, text string").coalesce(2)
    for block in (similar.BLOCK_SHINGLES, 700):
        assert rows(similar.similar_documents(df, block_shingles=block), "doc_id", "n_shingles", "component_id") == sorted(plain_components(data), key=str)


def test_repeats(docs, empty):
    data = [(i, (r[0], r[1]), words(r[1])) for i, r in enumerate(corpus())]
    at, want = {}, []
    for _, d, w in data:
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(d)
    for _, d, w in data:
        runs = []
        for k in range(len(w) - 49):
            if len(at[tuple(w[k : k + 50])]) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + 50
                else:
                    runs.append([k, k + 50])
        want += [(d[0], a, b) for a, b in runs]
    assert rows(repeats.repeated_passages(docs), "doc_id", "start_word", "end_word") == sorted(want, key=str)
    for group in (1, 20):
        assert rows(repeats.repeated_passages(docs, group=group), "doc_id", "start_word", "end_word") == sorted(want, key=str)
    assert repeats.repeated_passages(empty).count() == 0


def test_languages(spark, empty):
    rng = random.Random(4)
    talk = {"aa": "batu kore mila senu dapo", "bb": "schtrum kraff wolgt zwerb pfund"}
    data = [(i, " ".join(rng.choice(talk[g].split()) for _ in range(12)), g, "s", 0, *CLASH) for i, g in enumerate(["aa", "bb"] * 60)]
    data += [(900, None, "aa", "s", 0, *CLASH), (901, "12 %%", "aa", "s", 0, *CLASH), (902, "mila " * 9000, None, "s", 0, *CLASH), (None, "wolgt wolgt", "bb", "s", 0, *CLASH), (903, "x" * 5000, None, "s", 0, *CLASH)]
    got = {r["doc_id"]: r for r in languages.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    assert len(got) == len(data) and all(got[i]["lang_pred"] == g for i, (_, _, g, *_) in enumerate(data[:120]))
    assert (got[900]["lang_pred"], got[900]["score"]) == (got[901]["lang_pred"], got[901]["score"]) == ("und", 0.0)
    assert got[902]["lang_pred"] == "aa" and got[None]["lang_pred"] == "bb" and got[None]["held_out"] is False
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i in range(120))
    assert languages.identify(empty).count() == 0


def test_forward_sums_all_segmentations():
    m = languages.Model.empty(["x"], ["▁", "a", "b", "ab", "▁a"])
    p, u = 1 / 5, languages.UNKNOWN
    assert np.exp(m.word_scores(["ab"]))[0, 0] == pytest.approx(p**3 + p**2 + p**2)
    assert np.exp(m.word_scores(["ac"]))[0, 0] == pytest.approx(p * p * u + p * u)


def segmentations(word, pieces):
    """All ways to write the word with its mark as pieces (a character that is none: itself)."""
    if not word:
        return [[]]
    heads = [p for p in pieces if word.startswith(p)] + ([] if word[0] in pieces else [word[0]])
    return [[p, *rest] for p in heads for rest in segmentations(word[len(p) :], pieces)]


@pytest.mark.parametrize("long_word", [0, 5, languages.LONG_WORD])
def test_learning_equals_sums_over_all_segmentations(long_word, monkeypatch):
    monkeypatch.setattr(languages, "LONG_WORD", long_word)
    monkeypatch.setattr(languages, "LONG_STEP", 3)
    pieces = sorted(["\u2581", "a", "b", "c", "ab", "bc", "\u2581a", "abc", "ca"])
    words_, counts = ["ab", "abcab", "cabca", "xab", "aaaa", "bcabcab"], np.array([[3.0, 1, 0, 2, 1, 1], [1.0, 0, 5, 1, 0, 2]])
    m = languages.Model.empty(["x", "y"], pieces)
    m.learn(words_, counts, 2)
    for g in range(2):
        table = dict.fromkeys(pieces, 1 / len(pieces))
        chance = lambda seg: np.prod([table.get(p, languages.UNKNOWN) for p in seg])  # noqa: B023, E731
        for _ in range(2):
            sums = dict.fromkeys(pieces, languages.PRIOR)
            for w, n in zip(words_, counts[g]):
                all_ = segmentations("\u2581" + w, pieces)
                total = sum(map(chance, all_))
                for seg in all_:
                    for p in seg:
                        if p in sums:
                            sums[p] += n * chance(seg) / total
            table = {p: x / sum(sums.values()) for p, x in sums.items()}
        assert m.table[g, :-1] == pytest.approx([table[p] for p in pieces])
        for w, got in zip(words_, m.word_scores(words_)[:, g]):
            assert got == pytest.approx(np.log(sum(map(chance, segmentations("\u2581" + w, pieces)))))


def test_words_of_any_length():
    pieces = languages.vocabulary_pieces(languages.default_vocabulary())
    m = languages.Model.empty(["x"], pieces)
    assert {"\u2581relationship", "\u2581professional"} <= set(pieces) and m.widest == max(map(len, pieces))
    p, u, n = 1 / 2, 1 / 2, 30_000
    m = languages.Model.empty(["x"], ["\u2581", "a"])
    assert m.word_scores(["a" * n, "b" * 9])[:, 0] == pytest.approx([np.log(p) + n * np.log(u), np.log(p) + 9 * np.log(languages.UNKNOWN)])


def test_languages_query(spark, tmp_path):
    """The registered query against a plain reading of its model, and its accuracy on rows that were held out."""
    data = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    more = [(10_001, None, "en"), (10_002, "12 %", "en"), (10_003, "", None), (None, data[0]["text"], "de"), (10_004, "y" * 400, None), *[(10_005, data[1]["text"], data[1]["lang"])] * 3]
    (tmp_path / "d").mkdir()
    frame = spark.createDataFrame([(r["doc_id"], r["text"], r["lang"], 1, "w", 0.5) for r in data] + [(*r, 1, "w", 0.5) for r in more], "doc_id long, text string, lang string, n long, word string, bound double")
    frame.repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    got = languages.op7_languages(spark, str(tmp_path / "d"))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got, truth = got.collect(), {r["doc_id"]: r for r in data}
    model = languages.fit(frame.select(frame["doc_id"].alias("id"), "text", "lang").where("id IS NOT NULL AND crc32(cast(cast(id AS string) AS binary)) % 3 <> 1"))
    texts = {r["doc_id"]: r["text"] for r in data} | {r[0]: r[1] for r in more}
    table = [{p: model.table[g, i] for i, p in enumerate(languages.vocabulary_pieces(languages.default_vocabulary()))} for g in range(len(model.languages))]

    def plain(word, g):
        w = "\u2581" + word
        a = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            for s in range(max(0, e - 16), e):
                a[e] += a[s] * table[g].get(w[s:e], languages.UNKNOWN if e - s == 1 else 0.0)
        return np.log(a[-1])

    right = told = 0
    for r in got:
        text = texts[r["doc_id"]]
        ws = re.findall(r"[^\W\d_]+", (text or "").lower())
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        if r["doc_id"] is not None and r["doc_id"] % 7 == 0:
            s = np.array([sum(plain(w, g) for w in ws) for g in range(len(table))]) * min(len(ws), languages.EVIDENCE) / len(ws)
            p = np.exp(s - s.max())
            assert r["lang_pred"] == model.languages[int(p.argmax())] and r["score"] == pytest.approx(p.max() / p.sum())
        if r["held_out"] and truth.get(r["doc_id"]) and truth[r["doc_id"]]["lang"]:
            told, right = told + 1, right + (truth[r["doc_id"]]["lang"] == r["lang_pred"])
    assert told > 30 and right / told >= 0.9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Top</header><nav><ul><li><a href="/x">Menu</a></ul></nav>
<div class="ad box">Buy</div><article><h1>A &amp; B</h1><p><b>one<br>two   three<p>caf&eacute; &lt;x&gt;&nbsp;end</p><div class="comments"><p>reader</p></div><form><p>f</p></form></article><aside>s</aside><footer>&copy; f</footer></body>"""


def test_pages(spark):
    loose = "<html><body><div><p>Join our weekly letter and never miss a thing</p></div><div><p>{}</p></div></body></html>"
    data = [(1, "http://h.org/a", PAGE), (2, None, None), (3, "http://h.org/b", ""), (4, "http://h.org/c", loose.format("first own text")), (5, "http://h.org/d", loose.format("second own words")), (1, "http://h.org/a", PAGE), (6, "http://o.org/x", "<article><p>cut <b"), (7, "u", "<p>" + "w " * 50_000)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.main_text(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    assert got[1][0] == "A & B\n\none two three\n\ncafé <x> end"
    assert got[2] == got[3] == ("", 0)
    assert got[4][0] == "first own text" and got[5][0] == "second own words" and got[6][0] == "cut"
    assert got[7][1] == 99_999
    assert pages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><p>Hello <span class="ad">BUY NOW</span> world</p></article>', "Hello world"),
        ('<article><p>Story text <span class="ad">Buy</p><p>more</p></article>', "Story text\n\nmore"),
        ('<body class="has-sidebar search"><article><p>x y</p></article></body>', "x y"),
        ('<div class="page-header"><article><p>in</p></article></div>', "in"),
        ('<article><section id="notice-period"><p>keep</p></section><table class="search results"><tr><td>cell</td></tr></table><div class="notice">n</div></article>', "keep\n\ncell"),
        ('<div class="ad">buy<article><p>not closed above</p></article>', "not closed above"),
        ('<div class="related"><article>teaser</article></div><div><p>main text</p></div>', "main text"),
        ('<div class="comments"><article class="comment">c</article><main><p>m</p></main></div>', "m"),
        ('<article><p>a</p><article class="comment"><p>c</p></article><div id="comments"><p>r</p></div></article>', "a"),
        ('<p data-x="hidden menu">seen</p><p hidden>h</p><div aria-hidden="true">no</div><div style="display: NONE">no</div>', "seen"),
        ('<p>Read <a class="share" href="#">Share this</a>on</p><div class="site-footer">f</div><div class="ad-box">a</div><div class="shadow">adverse</div>', "Read on\n\nadverse"),
        ("<script>var x='<p>';</script><style>p{}</style><!-- <p>no</p> --><p>a&nbsp;b &lt;i&gt; &#233;</p>", "a b <i> é"),
    ],
)
def test_page_marks(page, text):
    found = pages.blocks(page)
    best = max(k for k, _ in found)
    assert "\n\n".join(t for k, t in found if k == best) == text


def test_repeated_against_all_substrings():
    rng = random.Random(6)
    for _ in range(60):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(rng.randint(1, 6))]
        low = [rng.randint(0, 3) for _ in streams]
        high = [x + rng.choice([0, 0, 1]) for x in low]
        least = rng.randint(2, 4)
        owners = {}
        for s, words_ in enumerate(streams):
            for k in range(len(words_) - least + 1):
                owners.setdefault(tuple(words_[k : k + least]), set()).update((low[s], high[s]))
        want = []
        for words_ in streams:
            inside = {j for k in range(len(words_) - least + 1) if len(owners[tuple(words_[k : k + least])]) > 1 for j in range(k, k + least)}
            want.append(len(inside) / len(words_) if words_ else 0.0)
        assert pages.repeated(streams, low, least, high) == pytest.approx(want)


def test_pages_query(spark, tmp_path):
    """The registered query's columns, with nulls, repeats and columns whose names the operator uses itself."""
    loose = "<html><body><div><p>Join our weekly letter and never miss a thing</p></div><div><p>{}</p></div></body></html>"
    data = [(1, "http://h.org/a", PAGE), (2, None, None), (None, "http://h.org/c", loose.format("one own text")), (5, "http://h.org/d", loose.format("second own words")), (1, "http://h.org/a", PAGE)]
    (tmp_path / "d").mkdir()
    frame = spark.createDataFrame([(*r, "h", 3, "b", 4, "k") for r in data], "page_id long, url string, html string, host string, page int, block string, kind int, text string")
    frame.repartition(2).write.parquet(str(tmp_path / "d/pages.parquet"))
    got = pages.op9_pages(spark, str(tmp_path / "d"))
    assert got.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    want = [(1, "http://h.org/a", (t := "A & B\n\none two three\n\ncafé <x> end"), len(t))] * 2
    want += [(2, None, "", 0), (None, "http://h.org/c", "one own text", 12), (5, "http://h.org/d", "second own words", 16)]
    assert rows(got, "page_id", "url", "text", "n_chars") == sorted(want, key=str)


def test_suffix_array_against_sorting():
    rng = random.Random(0)
    for _ in range(60):
        s = [rng.randint(0, 2) for _ in range(rng.randint(2, 50))]
        order, lcp = pages.suffix_array(np.array(s))
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        for k in range(1, len(s)):
            x, y = s[want[k - 1] :], s[want[k] :]
            assert lcp[k] == next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))


def test_leaks(spark, docs, empty):
    item = "If Anna buys 12 apples for 3 dollars each and then sells 5 of them to Boris how much does Anna have left"
    again = "So, here it goes: if Clara buys 40 apples for 7 euros each and then sells 9 of them to Dmitri how much does Clara have left?"
    torn = "if Clara buys 40 apples for 7 euros each and then sells 9 of them to Dmitri how much does Emil have left"
    data = [(1, f"intro words. {item.upper()} outro"), (2, again), (3, torn), (4, "nothing at all to see"), (5, None), (2, again), (6, "buys 12 apples for 3 dollars each and then")]
    bench = spark.createDataFrame([(10, item), (11, "tiny"), (12, None), (10, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in leaks.find_leaks(spark.createDataFrame(data, "doc_id long, text string"), bench).collect()}
    assert 1 in got and 2 in got and not {4, 5, 6} & set(got)
    assert got[2]["n_changed"] > 0 and got[2]["consistent"] == 1.0
    assert leaks.find_leaks(empty, bench).count() == 0 and leaks.find_leaks(docs, bench.limit(0)).count() == 0


def test_sha_of_edited_text(spark, tmp_path):
    docs = [(3, "abcde"), (1, "xyz"), (2, None), (7, "éè long tail here")]
    (tmp_path / "d").mkdir()
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "d/documents.parquet"))
    got = {r["doc_id"]: r["edited_sha256"] for r in sketches.op2_fingerprints(spark, str(tmp_path / "d")).collect()}
    order = sorted(docs)
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        k = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - k] + n[:k]).encode()).hexdigest()


def plain_repeats(data):
    at, want = {}, []
    for d, w in data:
        for k in range(len(w) - 49):
            at.setdefault(tuple(w[k : k + 50]), set()).add(d)
    for d, w in data:
        runs = []
        for k in range(len(w) - 49):
            if len(at[tuple(w[k : k + 50])]) > 1:
                if runs and k <= runs[-1][1]:
                    runs[-1][1] = k + 50
                else:
                    runs.append([k, k + 50])
        want += [(d, a, b) for a, b in runs]
    return sorted(want, key=str)


@pytest.mark.parametrize("group", [1, 7, repeats.GROUP])
def test_repeats_around_a_common_line(spark, group):
    """One licence line in all texts; a few share what stands around it."""
    rng = random.Random(21)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    line = prose(40)
    data = [(i, prose(60) + line + prose(60)) for i in range(60)]
    for i in range(10):
        left, right = prose(8), prose(8)
        data += [(100 + 2 * i + k, prose(30) + left + line + right + prose(30)) for k in range(2)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string").repartition(3)
    want = plain_repeats(data)
    assert {d for d, _, _ in want} == set(range(100, 120))
    assert rows(repeats.repeated_passages(df, group=group), "doc_id", "start_word", "end_word") == want


def test_repeats_beyond_the_next_neighbours(spark):
    """A passage many times in one text and once in another, and partners hidden behind texts that agree more on one side."""
    rng = random.Random(22)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, gram, left, right = prose(120), prose(16), prose(33), prose(33)
    data = [(1, sum((passage + prose(3) for _ in range(30)), [])), (2, prose(9) + passage + prose(9))]
    data += [(10 + i, prose(40) + left[13:] + gram + right[:20] + prose(40)) for i in range(2)]
    data += [(20 + i, prose(40) + gram + right + prose(40)) for i in range(3)] + [(30 + i, prose(40) + left + gram + prose(40)) for i in range(3)]
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in data], "doc_id long, text string").repartition(3)
    want = plain_repeats(data)
    assert {1, 2, 10, 11} == {d for d, _, _ in want}
    assert rows(repeats.repeated_passages(df), "doc_id", "start_word", "end_word") == want


PLAIN = {"email": EMAIL, "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_base(text):
    """[(kind, start, end, before, after)]; before and after are what lies between matches of one expression, 64 characters at most."""

    def passes(kind, v):
        digits = [int(c) for c in v if c.isdigit()]
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(reversed(digits))) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    out = []
    for n, kind in enumerate(private.KINDS):
        out += [(n, *m) for m in plain_matches(PLAIN[kind], text) if passes(kind, text[m[0] : m[1]])]
    return out


def plain_matches(pattern, text):
    ms = [m.span() for m in pattern.finditer(text)]
    edges = [0, *[e for _, e in ms]], [*[s for s, _ in ms], len(text)]
    return [(s, e, text[edges[0][i] : s][-64:], text[e : edges[1][i + 1]][:64]) for i, (s, e) in enumerate(ms)]


def plain_private(texts):
    """For each text (base, added) as (kind, start, end), by plain loops over the same rules."""

    def contexts(before, after):
        left, right = re.findall("[^ \t-\r]+", before.lower()), re.findall("[^ \t-\r]+", after.lower())
        out = {"l " + left[-1]} if left else set()
        if len(left) > 1:
            out.add("ll " + re.search("[^ \t-\r]+[ \t-\r]+[^ \t-\r]+(?=[ \t-\r]*$)", before.lower())[0])
        if left and right:
            out.add(f"lr {left[-1]} {right[0]}")
        return out | ({"r " + right[0]} if right else set())

    def fits(kind, v):
        n, letters = sum(c.isdigit() for c in v), re.search("[A-Za-z@_%+]", v)
        if kind == 0:
            return bool(re.fullmatch("[^@]+@[^@]+", v))
        if kind == 1:
            return bool(re.fullmatch("[0-9]{1,3}([.-][0-9]{1,3}){3}", v))
        return (not letters and 12 <= n <= 19) if kind == 2 else (not re.search("[A-Za-z@_%]", v) and 7 <= n <= 15)

    base, cands, edges, seeds, unseen = [], [], set(), set(), set()
    for t in texts:
        t = t or ""
        base.append(plain_base(t))
        found = {m[:2]: m for m in plain_matches(re.compile(private.GROUPS), t) if 7 <= sum(c.isdigit() for c in t[m[0] : m[1]]) <= 19}
        found |= {m[:2]: m for m in plain_matches(re.compile(private.CANDIDATE), t)}
        cands.append([m for m in found.values() if not any(m[0] < b[2] and b[1] < m[1] for b in base[-1])])
        for k, s, e, before, after in base[-1]:
            seeds.update((k, t[s:e].lower(), p) for p in contexts(before, after))
        for s, e, before, after in cands[-1]:
            unseen.update((t[s:e].lower(), p) for p in contexts(before, after))
    edges = {(v, p) for _, v, p in seeds} | unseen
    instances = Counter(p for _, p in edges)
    trusted = {(k, v): 1.0 for k, v, _ in seeds}
    for _ in range(private.ROUNDS):
        support = Counter()
        for v, p in edges:
            for k in range(4):
                support[p, k] += trusted.get((k, v), 0.0)
        good = {(p, k): s / instances[p] for (p, k), s in support.items() if s > private.MIN_SUPPORT - 1e-9 and s / instances[p] > private.MIN_CONFIDENCE - 1e-9}
        doubt = {}
        for v, p in unseen:
            for k in range(4):
                if (p, k) in good and fits(k, v):
                    doubt[k, v] = doubt.get((k, v), 1.0) * (1 - min(good[p, k], 0.999999))
        trusted = {x: min(0.999999, 1 - d) for x, d in doubt.items() if 1 - d > private.MIN_CONFIDENCE - 1e-9} | {(k, v): 1.0 for k, v, _ in seeds}
    best = {}
    for (k, v), w in trusted.items():
        if w < 1.0:
            best[v] = max(best.get(v, (-1, -9)), (w, -k))
    out = []
    for t, b, c in zip(texts, base, cands):
        all_ = [(-best[t[m[0] : m[1]].lower()][1], m[0], m[1]) for m in c if t[m[0] : m[1]].lower() in best]
        outer = [x for x in all_ if not any(y[1] <= x[1] and x[2] <= y[2] and y[2] - y[1] > x[2] - x[1] for y in all_)]
        out.append((sorted(x[:3] for x in b), sorted(outer)))
    return out


def private_corpus():
    rng = random.Random(15)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    luhn = [f"{k:04}" for k in range(10_000) if any(b[0] == 2 for b in plain_base(f"4111 1111 1111 {k:04}"))][:200]
    shapes = [
        *[lambda: f"call +1 ({n(3)}) 555-{n(4)} now", lambda: f"call +44 {n(4)} {n(6)} now", lambda: f"mail {name()}@{name()}.org today", lambda: f"card 4111 1111 1111 {rng.choice(luhn)} {name()}"] * 4, lambda: f"call {n(3)}-{n(4)} now", lambda: f"call (0{n(2)}) {n(3)}-{n(4)}", lambda: f"host 10.{rng.randrange(256)}.0.{rng.randrange(256)} up",
        lambda: f"host 300.{n(2)}.{n(2)}.1 up", lambda: f"mail {name()}@localhost today", lambda: f"card {n(4)}-{n(4)}-{n(4)}-{n(4)} {name()}",
        lambda: f"serial {n(8)} {name()}", lambda: f"{name()} {name()} \u00e9\U0001f600", lambda: f"hotline {n(3)}-{n(4)} {name()}", lambda: f"v{n(1)}.{n(1)}.{n(1)}.{n(1)}.{n(1)}",
    ]
    texts = [" ".join(rng.choice(shapes)() for _ in range(rng.randint(0, 6))) for _ in range(400)]
    return texts + [None, "", texts[5], "x" * 5000, " ".join(f"host 10.0.{i // 200}.{i % 200} up, ring {n(3)}-{n(4)} then" for i in range(300))]


def test_private_against_plain_loops(spark, tmp_path):
    texts = private_corpus()
    want = plain_private(texts)
    assert sum(len(a) for _, a in want) > 100 and {k for _, a in want for k, _, _ in a} == {0, 1, 2, 3}
    (tmp_path / "d").mkdir()
    spark.createDataFrame([(i, t, "g", *CLASH) for i, t in enumerate(texts)], "doc_id long, text string, pattern string, row long, base string, value long, cls string, score double").repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    got = {r["doc_id"]: r for r in private.op3_private(spark, str(tmp_path / "d")).collect()}
    told = lambda spans: ",".join(f"{private.KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))
    for i, (base, added) in enumerate(want):
        counts = Counter(k for k, _, _ in base)
        assert tuple(got[i])[:6] == (i, *[counts[k] for k in range(4)], hashlib.sha256(told(base).encode()).hexdigest()), texts[i]
        assert got[i]["spans"] == told(base + added), texts[i]


def test_redacted_text_against_slices(spark):
    from pyspark.sql import functions as F

    texts = [t for t in private_corpus() if t is not None]
    rng, data = random.Random(3), []
    for t in [*texts, "\U0001f600" * 9000, "a\u00e9" * 20_000]:
        spans = sorted((a := rng.randrange(len(t)), min(len(t), a + rng.randint(1, 30)), rng.randrange(4)) for _ in range(rng.choice([0, 1, 3, 200]) if t else 0))
        data.append((t, spans))
    df = spark.createDataFrame(data, "t string, s array<struct<start:int,end:int,kind:int>>")
    got = df.select(private.redact(F.col("t"), F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.lit("").alias("value"))))).collect()
    for (t, spans), (new,) in zip(data, got):
        at, want = 0, ""
        for a, b, k in spans:
            if a >= at:
                want, at = want + t[at:a] + f"<{private.KINDS[k]}>", b
        assert new == want + t[at:]


def test_private_in_very_long_texts(spark):
    from pyspark.sql import functions as F

    texts = ["1" * 1_000_000, "1." * 100_000, " ".join(f"10.{i % 256}.{i // 256 % 256}.7" for i in range(50_000))]
    # known without the plain expressions, which need hours for the first two
    want = [[], [(1, 8 * i, 8 * i + 7) for i in range(25_000)], [(1, *m.span()) for m in PLAIN["ip"].finditer(texts[2])]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for r in private.find_private(df, keep=("text",)).withColumn("t", private.redact(F.col("text"), F.concat("base", "added"))).collect():
        spans = [(s["kind"], s["start"], s["end"]) for s in r["base"]]
        assert spans == want[r["doc_id"]]
        if r["doc_id"] == 2:
            assert r["t"] == " ".join(["<ip>"] * 50_000)


def test_private_patterns_of_discovered_values(spark):
    """'desk' has the seeds and discovers numbers; these alone make 'hotline' a pattern, which discovers one more."""
    texts = [f"x{i}q desk +1 ({200 + i}) 555-0143 y{i}q" for i in range(100)] + [f"z{i}q desk 555-0{i:02}9-22 u{i}q" for i in range(12)]
    texts += [f"v{i}q hotline 555-0{i:02}9-22 t{i}q" for i in range(12)] + ["end hotline 555-0777-44 stop", "seen 555-0888-44 alone"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: [(s["kind"], s["value"]) for s in r["added"]] for r in private.find_private(df).collect()}
    assert [found[i] for i in range(100, 112)] == [found[i] for i in range(112, 124)] == [[(3, f"555-0{i:02}9-22")] for i in range(12)]
    assert found[124] == [(3, "555-0777-44")] and found[125] == []


def test_private_numbers_with_blanks_and_brackets(spark):
    from pyspark.sql import functions as F

    spans = {
        "x (017) 555-7713, y": ["(017) 555-7713"], "020 7946 0958.": ["020 7946 0958"], "(020 7946 0958)": ["020 7946 0958"], "a 12.34.5678 b": ["12.34.5678"],
        "4111 1111 1111 1112 é": ["4111 1111 1111 1112"], "12 345": ["12 345"], "020 7946 0958x": [], "1 2  3 4": ["1 2", "3 4"], "1 " * 5000 + "x": [("1 " * 5000).strip()], "7": [],
    }
    df = spark.createDataFrame([(t,) for t in spans], "t string")
    assert {t: [m["value"] for m in ms] for t, ms in df.select("t", private.matches(F.col("t"), private.GROUPS)).collect()} == spans
    texts = [f"x{i}q call +1 ({200 + i}) 555-0143 y{i}q card: 4000 0000 0000 {1000 + i}" for i in range(40)]
    texts += ["now call (017) 555-7713 today", "now call 020 7946 0958, please", "serial 020 7946 0959 sold", "now call 555-7714 today"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: [(s["kind"], s["value"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["added"]] for r in private.find_private(df).collect()}
    assert [got[i] for i in range(40, 44)] == [[(3, v, v)] if v else [] for v in ("(017) 555-7713", "020 7946 0958", None, "555-7714")]


@pytest.mark.parametrize("array_tokens", [8, pages.ARRAY_TOKENS])
def test_pages_of_a_host_of_any_size(spark, array_tokens):
    """Lines with a changing part on two pages each, among others; the size of the suffix arrays decides nothing."""
    page = "<html><body><div><p>Posted by {} in News and Sport of group {}</p></div><div><p>own words of page {}</p></div></body></html>"
    data = [(i, f"http://h.org/{i}", page.format(f"n{i}", f"g{i // 2} h{i // 2} i{i // 2} j{i // 2} k{i // 2} l{i // 2} m{i // 2}", i)) for i in range(40)]
    data += [(90, "http://h.org/90", "<p>nothing of this text stands anywhere else here</p>")]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.main_text(df, array_tokens=array_tokens).collect()}
    assert got == {i: f"own words of page {i}" for i in range(40)} | {90: "nothing of this text stands anywhere else here"}


@pytest.mark.parametrize("array_tokens", [8, pages.ARRAY_TOKENS])
def test_pages_with_copies(spark, array_tokens):
    """A page under two urls, or with two ids, keeps its text, and so do short paragraphs that two pages have."""
    story = "<html><nav>Menu {}</nav><body><p>the river rose again over night and took the old bridge</p><p>Yes.</p></body></html>"
    other = "<html><body><p>a wholly different text of another day stands here</p><p>Yes.</p></body></html>"
    data = [(1, "http://h.org/a", story.format(1)), (2, "http://h.org/b", story.format(2)), (3, "http://h.org/a", story.format(1)), (4, "http://h.org/c", other), (5, None, other), (6, None, other)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in pages.main_text(df, array_tokens=array_tokens).collect()}
    river, day = "the river rose again over night and took the old bridge\n\nYes.", "a wholly different text of another day stands here\n\nYes."
    assert got == {1: river, 2: river, 3: river, 4: day, 5: day, 6: day}


def test_leaks_of_short_items_and_names_at_the_start(spark):
    short, question = "Who painted the large old ceiling", "Anna has 12 apples and sells 5 of them so how many remain"
    bench = spark.createDataFrame([(1, short), (2, question), (3, "two words"), (4, "Which river flows through old Vienna"), (5, None), (6, "")], "item_id long, text string")
    texts = [
        "then he asked who painted the large old ceiling, and left", "Clara has 40 apples and sells 7 of them so how many remain", "He said: Boris has forty apples and sells seven of them so how many remain?",
        "who painted the large new ceiling", "two words", "Which river flows through old Prague", "so: which river flows through old Vienna", "", None, "Anna has", "Clara sells 40 apples and has 7 of them so how many remain",
    ]
    df = spark.createDataFrame([(i, t, *CLASH) for i, t in enumerate(texts)], "doc_id long, text string, row long, base string, item_id long, cls string, score double")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_tokens"], r["n_changed"]) for r in leaks.find_leaks(df, bench).collect()}
    assert got == {(0, 1): (3, 6, 0), (1, 2): (0, 13, 3), (2, 2): (2, 13, 3), (6, 4): (1, 6, 0)}


def plain_template(text):
    ws, out = [w for w in re.split("[ \\t-\\r]+", text) if w], []
    cores = [w.rstrip(".,;:!?\"')]}").lstrip("\"'([{") for w in ws]
    number = lambda w: bool(re.match(r"[-+$€£]?[0-9]", w)) or w.lower() in leaks.NUMBERS
    for i, w in enumerate(cores):
        start = i == 0 or ws[i - 1].rstrip("\"')]}")[-1:] in list(".!?:")
        if number(w):
            out.append(leaks.NUM)
        elif re.match("[A-Z]", w) and len(w) > 1 and w[1] == w[1].lower() and not (start and w.lower() in leaks.STARTERS):
            out.append(leaks.NAME)
        elif i and number(cores[i - 1]) and w.lower() in leaks.UNITS:
            out.append(leaks.UNIT)
        else:
            out.append(w.lower() or ws[i])
    return out


def test_templates_equal_plain_ones(spark):
    from pyspark.sql import functions as F

    rng = random.Random(12)
    bits = ["Anna", "the", "The", "12", "$5", "-3", "km", "km.", "forty", "Forty", "hours", "said:", "end.", "(Boris)", "\"If", "USA", "é", "...", "x!", "apples,", "€7", "+", "-", "A", "Ab"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(2)
    for t, got in df.select("t", leaks.template(leaks.words_of(F.col("t")))).collect():
        assert got == plain_template(t), t


def plain_leaks(docs, items):
    """Every window of every pair of texts, by plain loops."""
    split = lambda t: [w for w in re.split("[ \\t-\\r]+", t) if w]
    bare = lambda w: w.rstrip(".,;:!?\"')]}").lower()
    out = {}
    for (d, text), (item, question) in {(a, b) for a in docs for b in items if a[1] is not None and b[1] is not None}:
        dw, iw, dt, it = split(text), split(question), plain_template(text), plain_template(question)
        if len(it) < leaks.MIN_WORDS:
            continue
        w, shifts = min(leaks.WINDOW, len(it)), {}
        for i in range(len(it) - w + 1):
            if sum(not t.startswith("\x01") for t in it[i : i + w]) >= leaks.MIN_WORDS:
                for j in range(len(dt) - w + 1):
                    if dt[j : j + w] == it[i : i + w]:
                        shifts.setdefault(j - i, []).append(i)
        for shift, at in shifts.items():
            begins = [k for k in range(len(at)) if k == 0 or at[k - 1] != at[k] - 1]
            ends = [k for k in range(len(at)) if k == len(at) - 1 or at[k + 1] != at[k] + 1]
            for s in begins:
                for e in ends:
                    tokens = at[e] - at[s] + w
                    if e < s or (e - s + 1) * 2 <= tokens - w or tokens < min(leaks.MIN_TOKENS, len(it)):
                        continue
                    spots = [p for p in range(at[s], at[s] + tokens) if it[p].startswith("\x01") and dt[p + shift] == it[p]]
                    pairs = {(bare(iw[p]), bare(dw[p + shift])) for p in spots}
                    agree = min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) if pairs else 1.0
                    changed = sum(a != b for a, b in pairs)
                    if agree >= leaks.MIN_CONSISTENT and (len(it) >= leaks.WINDOW or not changed):
                        m = (tokens, agree, -(at[s] + shift), -at[s], tokens / len(it), len(pairs), changed)
                        out[d, item] = max(out.get((d, item), m), m)
    return sorted(((d, i, -m[2], -m[3], m[0], round(m[4], 9), m[5], m[6], round(m[1], 9)) for (d, i), m in out.items()), key=str)


def test_leaks_query_against_plain_loops(spark, tmp_path):
    rng = random.Random(31)
    plain = lambda n: [rng.choice("bdfgklm") + rng.choice("aeiou") + rng.choice("bdfgklm") + rng.choice("aeiou") for _ in range(n)]
    slot = lambda: rng.choice([str(rng.randint(1, 99)), "$" + str(rng.randint(1, 9)), rng.choice(["Anna", "Boris", "Clara", "Dora"]), "twelve", "5 km"])
    text = lambda n: " ".join(slot() if rng.random() < 0.2 else w + rng.choice(["", "", "", ".", ","]) for w in plain(n))
    items = [(i, text(rng.choice([3, 5, 6, 7, 8, 12, 20, 45]))) for i in range(25)] + [(30, None), (31, ""), (0, "if " + text(12))]
    items.append(items[4])

    def retold(question):
        names = {x: rng.choice(["Emil", "Frank", "Greta", "Hanna"]) for x in ("Anna", "Boris", "Clara", "Dora")}
        out = []
        for w in question.split():
            out.append(names.get(w, str(rng.randint(100, 999)) if w.isdigit() else w) if rng.random() < 0.97 else plain(1)[0])
        return " ".join(out)

    docs = [(d, " ".join(rng.choice([lambda: text(rng.randint(0, 30)), lambda: rng.choice(items)[1] or "", lambda: retold(rng.choice(items)[1] or "")])() for _ in range(rng.randint(0, 4)))) for d in range(150)]
    docs += [(None, items[7][1]), (None, items[7][1]), (200, None), (201, ""), docs[9], (9, text(20))]
    (tmp_path / "d").mkdir()
    spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, item_id int, tokens string, h int").repartition(3).write.parquet(str(tmp_path / "d/documents.parquet"))
    spark.createDataFrame([(*r, 1, "x") for r in items], "item_id long, text string, doc_id int, words string").write.parquet(str(tmp_path / "d/benchmark.parquet"))
    df = leaks.op10_leaks(spark, str(tmp_path / "d"))
    assert df.columns == ["doc_id", "item_id", "start_word", "item_start", "n_tokens", "coverage", "n_slots", "n_changed", "consistent"]
    want = plain_leaks(docs, items)
    assert len(want) > 80 and any(r[7] for r in want) and any(r[4] < leaks.WINDOW for r in want)
    assert sorted(((*tuple(r)[:5], round(r["coverage"], 9), r["n_slots"], r["n_changed"], round(r["consistent"], 9)) for r in df.collect()), key=str) == want


def test_leaks_in_parts(spark):
    """Runs of an item stand for themselves: more leaked text or text in between hides none of them."""
    rng = random.Random(3)
    plain = lambda n: [rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdfgklmnprst") + rng.choice("aeiou") + rng.choice("bdglmnrst") for _ in range(n)]
    item = plain(140)
    parts = item[:30] + plain(60) + item[90:100] + plain(5)
    every = [w if (k + 1) % 14 else "zzz" for k, w in enumerate(item)]
    torn = item[:8] + plain(20) + item[28:38] + plain(9)
    names = "if Anna and Boris meet Clara then they all go to see Dora with".split()
    swapped = "if Emil and Frank meet Greta then they all go to see Hanna with".split()
    wrong = "if Emil and Emil meet Emil then they all go to see Emil with".split()
    mixed = swapped + item[:1] + wrong + plain(3)
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(names + item[1:2] + names))], "item_id long, text string")
    data = [(1, parts), (2, every), (3, torn), (4, item), (5, mixed)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in data], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["start_word"], r["item_start"], r["n_tokens"]) for r in leaks.find_leaks(df, bench).collect()}
    assert got[1, 1] == (0, 0, 30) and got[2, 1] == (0, 0, 55) and got[4, 1] == (0, 0, 140) and (3, 1) not in got
    assert got[5, 2] == (0, 0, 14)


def test_what_a_worker_drops_goes_back_to_the_machine(monkeypatch):
    from faultweave.llm import _shared

    given = []
    monkeypatch.setattr(_shared, "_kept", {})
    monkeypatch.setattr(_shared, "trim", lambda: given.append(1))
    assert [_shared.kept("a", list), _shared.kept("a", dict), _shared.kept("b", dict)] == [[], [], {}]
    assert len(given) == 2
