"""Rows of distances made in numpy, against the Columns that say the same and plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_distances_and_clustering import BASE, OTHER, cases

from faultweave.operators import clustering, distances, kernels, linkage


def strange_cases(spark, n=40, seed=1):
    """Signature rows of all kinds, with empty mnemonics (so that the order of two rows counts), equal keys and texts without words."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    rows = []
    for _ in range(n):
        text = " ".join(pick("pc", "addi", "sub_w", "lw", "ebreak") for _ in range(rng.integers(0, 5)))
        if rng.random() < 0.6:
            rows.append(BASE | dict(
                trace_length_bucket=pick("short", "medium", "long"), has_repeating_tail=pick(True, False), has_signature_loop=pick(True, False), tail_mnem_uniformity=pick(0.25, 0.5, 1.0), early_mismatch=pick(True, False), same_reg_pair=pick(True, False),
                mismatch_ibex_mnemonic=pick("", "addi", "lw"), mismatch_spike_mnemonic=pick("", "addi", "lw"), mismatch_context_mnemonics=[pick("a", "b", "c") for _ in range(rng.integers(0, 4))], text_blob=text,
            ))
        else:
            kind = pick("", "no_dret", "debug_timeout", "irq_timeout", "check_memory", "cosim_pc", "other_fatal")
            asserts = pick([], ["A"], ["A", "B"], ["B"])
            mode = "assert" if asserts and not kind else "fatal" if kind else "unknown"
            rows.append(OTHER | dict(failure_mode=mode, sim_fatal_kind=kind, sim_fatal_source=pick("", "f", "g"), sim_error_asserts=asserts, regr_test_name=pick("", "t", "u"), text_blob=text))
    return cases(spark, *rows)


def matrix(rows, column):
    d = np.zeros((rows.count(),) * 2)
    for r in distances.distance_pairs(rows).collect():
        d[r["a"], r["b"]] = d[r["b"], r["a"]] = r[column]
    return d


def slow(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        _, i, j = min((round(float(d[np.ix_(x, y)].mean()), 12), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_rounding_is_that_of_spark(spark):
    x = [1 / 128, 3 / 128, 0.1234565, 0.1234575, 1.0000005, 2 / 3, 0.0, 1.0, *np.random.default_rng(2).random(200).round(7).tolist()]
    want = [r[0] for r in spark.createDataFrame(list(enumerate(x)), "i int, x double").orderBy("i").select(F.round("x", 6)).collect()]
    assert kernels.rounded(np.array(x), 6).tolist() == want


def test_tfidf_moves_no_pair_of_texts(spark):
    rows = strange_cases(spark)
    texts = distances.alike(rows).select("ord", "text")
    assert "wa" not in plan(clustering.cluster_tfidf(rows, 4))
    d = 1.0 - matrix(rows, "cosine")
    got = {r["ord"]: r["label"] for r in clustering.cluster_tfidf(rows, 4).collect()}
    assert texts.select("text").distinct().count() < 40
    assert [got[i] for i in range(40)] == linkage.labels(slow(np.maximum(0.0, d) * (1 - np.eye(40)), 4), 40).tolist()


def test_dbscan_moves_no_pair_of_classes(spark):
    rows = strange_cases(spark, seed=2)
    assert "b_last" not in plan(clustering.cluster_dbscan(rows, 4))
    got = {r["ord"]: r["label"] for r in clustering.cluster_dbscan(rows, 4).collect()}
    d = matrix(rows, "distance")
    want = clustering._density(d, np.arange(40), 4)
    assert [got[i] for i in range(40)] == linkage.labels(want, 40).tolist()


@pytest.mark.parametrize("seed", [3, 4])
def test_hybrid_moves_no_pair_of_classes(spark, seed):
    rows = strange_cases(spark, seed=seed)
    assert "b_last" not in plan(clustering.cluster_hybrid(rows, 4))
    got = {r["ord"]: r["label"] for r in clustering.cluster_hybrid(rows, 4).collect()}
    assert [got[i] for i in range(40)] == linkage.labels(slow(matrix(rows, "distance"), 4), 40).tolist()


def test_overlap_of_unlike_rows_needs_no_join(spark):
    rng = np.random.default_rng(8)
    some = lambda n: [None if rng.random() < 0.1 else "abcdefgh"[rng.integers(8)] for _ in range(rng.integers(0, n))]
    data = [(int(i) // 2 * 3 if i < 6 else int(i) * 3, some(4), some(300 if i % 17 == 0 else 6)) for i in rng.permutation(60)]  # ords 0, 3 and 6 occur twice
    rows = spark.createDataFrame(data, "ord long, s array<string>, p array<string>")
    found = distances.overlap_pairs(rows, "s", "p")
    assert "Join" not in plan(found)
    got = {(r["a"], r["b"]): [] for r in found.collect()}
    for r in found.collect():
        got[r["a"], r["b"]].append((r["jaccard"], r["overlap"]))

    def both(x, y):
        union, longer = set(x[1]) | set(y[1]), max(len(x[2]), len(y[2]))
        equal = sum(u == v and u is not None for u, v in zip(x[2], y[2], strict=False))
        return len(set(x[1]) & set(y[1])) / len(union) if union else 1.0, equal / longer if longer else 1.0

    want = {}
    for x in data:
        for y in data:
            if x[0] < y[0]:
                want.setdefault((x[0], y[0]), []).append(both(x, y))
    assert got.keys() == want.keys()
    assert all(np.abs(np.array(sorted(got[k])) - np.array(sorted(want[k]))).max() < 6e-7 for k in want)
    joined = distances._overlaps_joined(rows, "s", "p").collect()
    assert sorted(map(tuple, joined)) == sorted(map(tuple, found.collect()))


def test_dbscan_pca_moves_no_pair_of_classes(spark):
    rows = strange_cases(spark, seed=5)
    assert "b_last" not in plan(clustering.cluster_dbscan_pca(rows, 4))
    twice = rows.unionByName(rows.withColumn("case_id", F.col("case_id") + 40).withColumn("ord", F.col("ord") + 40).where("text_blob <> ''"))
    got = {r["ord"]: r["label"] for r in clustering.cluster_dbscan_pca(twice, 4).collect()}
    assert len(got) == twice.count() and len(set(got.values())) == 4


@pytest.mark.parametrize("seed", [6, 7])
def test_distances_of_unlike_rows_need_no_join(spark, seed):
    rows = strange_cases(spark, seed=seed)
    assert "Join" not in plan(distances.distance_pairs(rows))
    named = distances.alike(rows)
    cls = {r["ord"]: r["cls"] for r in named.select("ord", "cls").collect()}
    want = {(r["a"], r["b"]): (r["signature"], r["cosine"], r["distance"]) for r in distances.class_pairs(named).collect()}  # by Columns
    got = {(r["a"], r["b"]): (r["signature"], r["cosine"], r["distance"]) for r in distances.distance_pairs(rows).collect()}
    assert len(got) == 40 * 39 // 2
    for (a, b), values in got.items():
        assert values == pytest.approx(want.get((cls[a], cls[b]), (0.0, 1.0, 0.0)), abs=1e-12)
        assert values[0] == want.get((cls[a], cls[b]), (0.0,))[0]


@pytest.mark.parametrize("columns", [3, 10])
def test_vectors_merge_in_rounds_without_all_their_distances(columns):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(300, columns)), 2)
    x[50], x[70:80] = x[3], x[5]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    for whole, most in ((20, 1500), (5, 300), (150, 4000)):
        for k in (1, 10, 60):
            assert linkage.merged_vectors(x, k, whole, most) == linkage.average_linkage(d, k)
