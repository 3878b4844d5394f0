import numpy as np
import pytest
from pyspark.sql import Row

from faultweave.operators import clustering, distances, linkage, scoring
from faultweave.operators.signatures import categorical_key

BASE = dict(
    failure_mode="mismatch", regr_kind="mismatch", regr_test_name="", sim_fatal_kind="", sim_fatal_source="", sim_error_asserts=[], sim_uvm_testname="", trace_length_bucket="long", has_repeating_tail=False,
    has_signature_loop=False, tail_mnem_uniformity=0.5, mismatch_retire_index=300, mismatch_matched_count=300, mismatch_ibex_mnemonic="addi", mismatch_spike_mnemonic="addi", mismatch_context_mnemonics=["a", "b"],
    early_mismatch=False, same_reg_pair=False, text_blob="x y",
)
SCHEMA = "case_id long, ord long, failure_mode string, regr_kind string, regr_test_name string, sim_fatal_kind string, sim_fatal_source string, sim_error_asserts array<string>, sim_uvm_testname string, trace_length_bucket string, has_repeating_tail boolean, has_signature_loop boolean, tail_mnem_uniformity double, mismatch_retire_index long, mismatch_matched_count long, mismatch_ibex_mnemonic string, mismatch_spike_mnemonic string, mismatch_context_mnemonics array<string>, early_mismatch boolean, same_reg_pair boolean, text_blob string"


def cases(spark, *changes):
    rows = [Row(case_id=i, ord=i, **(BASE | c)) for i, c in enumerate(changes)]
    order = [f.split()[0] for f in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[c] for c in order) for r in rows], SCHEMA)


def dist(spark, *changes):
    return {(r["a"], r["b"]): r["signature"] for r in distances.distance_pairs(cases(spark, *changes), with_text=False).collect()}


OTHER = dict(failure_mode="fatal", regr_kind="failed_only", mismatch_ibex_mnemonic="", mismatch_spike_mnemonic="", trace_length_bucket="")


def test_worked_boundary(spark):
    d = dist(spark, dict(early_mismatch=True, same_reg_pair=True), dict(mismatch_ibex_mnemonic="sltu"))
    assert d[0, 1] == 0.88 - 0.16


def test_other_distances(spark):
    f = lambda **k: OTHER | k
    d = dist(
        spark, f(sim_fatal_kind="no_dret", sim_fatal_source="a"), f(sim_fatal_kind="debug_timeout", sim_fatal_source="a"), f(sim_fatal_kind="irq_timeout", sim_fatal_source="a", regr_test_name="t"),
        f(failure_mode="assert", sim_error_asserts=["P"], sim_fatal_source=""), dict(early_mismatch=True, trace_length_bucket="short"),
    )
    assert d[0, 1] == 0.90
    assert d[1, 2] == pytest.approx(0.30 * 0.45 + 0.05 * 0.35)
    assert d[1, 3] == pytest.approx(1.085)
    assert d[0, 4] == 0.68
    assert d[3, 4] == 1.0


def test_equal_keys_are_at_zero(spark):
    rows = cases(spark, {}, dict(mismatch_context_mnemonics=["q"], text_blob="z"), OTHER | dict(sim_fatal_kind="no_mret"))
    keys = [r[0] for r in rows.select(categorical_key()).collect()]
    assert keys[0] == keys[1] != keys[2]
    assert {(r["a"], r["b"]): r["distance"] for r in distances.distance_pairs(rows).collect()}[0, 1] == 0.0


def slow_linkage(d, k):
    groups = [[i] for i in range(len(d))]
    while len(groups) > k:
        _, i, j = min((d[np.ix_(x, y)].mean(), i, j) for i, x in enumerate(groups) for j, y in enumerate(groups) if i < j)
        groups[i] = sorted(groups[i] + groups.pop(j))
    return groups


def test_average_linkage_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.normal(size=(14, 3))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        for k in (1, 3, 14):
            assert linkage.average_linkage(d, k) == slow_linkage(d, k)


def test_splitting_stops_at_small_groups():
    d = np.ones((4, 4)) - np.eye(4)
    assert linkage.split_to([[0, 1], [2, 3]], d, 4) == [[0, 1], [2, 3]]
    assert len(linkage.split_to([[0, 1, 2, 3]], d, 2)) == 2


def test_density_falls_back_and_noise_grows_groups():
    d = np.full((3, 3), 0.9)
    np.fill_diagonal(d, 0)
    groups, noise, _ = linkage.best_density(d, [0.05], 2)
    assert groups == [] and noise == [0, 1, 2]
    assert len(linkage.density_groups(d, groups, noise, 2)) == 2
    assert linkage.noise_to_nearest([[0], [1]], [2], np.array([[0, 1, 0.2], [1, 0, 0.4], [0.2, 0.4, 0]])) == [[0, 2], [1]]


@pytest.mark.parametrize("method", list(clustering.METHODS))
def test_methods_on_few_cases(spark, method):
    rows = cases(spark, {}, dict(text_blob="x q"), OTHER | dict(sim_fatal_kind="no_mret", text_blob="f g"), OTHER | dict(sim_fatal_kind="test_timeout", text_blob="f h"))
    for k in (0, 1, 2, 9):
        got = [r["label"] for r in clustering.cluster(rows, k, method.upper()).orderBy("ord").collect()]
        assert len(got) == 4 and got[0] == 0 and max(got) <= 3
        if method != "signature" and k == 1:
            assert set(got) == ({0} if method != "signature_then_tfidf" else set(got))
    assert clustering.cluster(rows.limit(0), 3, method).count() == 0
    with pytest.raises(ValueError):
        clustering.cluster(rows, 2, "nope")


def test_hybrid_has_k_buckets_and_keeps_must_links(spark):
    rows = cases(spark, {}, {}, OTHER | dict(sim_fatal_kind="no_mret", text_blob="f g"), OTHER | dict(sim_fatal_kind="test_timeout", text_blob="f h"))
    got = [r["label"] for r in clustering.cluster(rows, 3).orderBy("ord").collect()]
    assert got[0] == got[1] and len(set(got)) == 3


def test_score(spark):
    g = spark.createDataFrame([(i, "ab"[i > 4]) for i in range(9)], "Case long, Bug string")
    p = spark.createDataFrame([(i, "x" if i in (4, 8) else str(i)) for i in range(9)], "Case long, bucket string")
    r = scoring.score(p, g).first()
    assert (r["tp"], r["tn"], r["positive_pairs"], r["negative_pairs"]) == (0, 19, 16, 20)
    assert r["balanced_accuracy"] == pytest.approx(0.475)
    one = scoring.score(p.limit(1), g.limit(1)).first()
    assert (one["tpr"], one["tnr"]) == (1.0, 1.0)
    with pytest.raises(ValueError, match="more than one"):
        scoring.score(p.union(p.limit(1)), g)
    with pytest.raises(ValueError, match="one side"):
        scoring.score(p.where("Case < 5"), g)
    with pytest.raises(ValueError, match="missing"):
        scoring.score(p, g, golden_col="Nope")


def like_points(rng, n, m):
    """n cases of m points (numbered by their first case) and the points' distances, with many ties and some at 0."""
    cls = rng.permutation(np.concatenate([np.arange(m), rng.integers(0, m, n - m)]))
    names = list(dict.fromkeys(cls.tolist()))
    upper = np.triu(rng.choice([0, 0.1, 0.2, 0.5, 1], size=(m, m)), 1)
    return np.array([names.index(c) for c in cls]), upper + upper.T


def test_weighed_points_link_as_their_cases_do():
    rng = np.random.default_rng(5)
    for _ in range(60):
        cls, d = like_points(rng, 9, int(rng.integers(1, 7)))
        for k in range(1, 10):
            whole = [[i] for i in range(9)]
            cases = d[np.ix_(cls, cls)]
            while len(whole) > k:
                _, i, j = min((round(float(cases[np.ix_(x, y)].mean()), 12), i, j) for i, x in enumerate(whole) for j, y in enumerate(whole) if i < j)
                whole[i] = sorted(whole[i] + whole.pop(j))
            assert sorted(sorted(g) for g in linkage.case_linkage(d, cls, k)) == sorted(whole)


def test_weighed_quantiles_and_second_neighbours_are_those_of_the_cases():
    rng = np.random.default_rng(6)
    for _ in range(60):
        cls, d = like_points(rng, 9, int(rng.integers(1, 7)))
        size, cases = np.bincount(cls), d[np.ix_(cls, cls)]
        assert linkage.pair_quantiles(d, size, [0.05, 0.26, 0.5]) == np.quantile(cases[np.triu_indices(9, 1)], [0.05, 0.26, 0.5]).tolist()
        others = cases + np.diag([np.inf] * 9)
        assert clustering.second_neighbours(d, size)[cls].tolist() == np.sort(others, axis=1)[:, 1].tolist()


def test_cases_whose_distance_depends_on_their_order_are_points_of_their_own():
    a, b, d = np.array([0, 1, 2, 3, 0, 1, 0, 3, 1, 3]), np.array([0, 1, 0, 3, 1, 0, 3, 0, 3, 1]), np.array([-1, -1, -1, -1, 0.5, 0.2, 0.7, 0.7, 0.9, 0.9])
    cls, between, home = clustering.points(4, a, b, d)  # classes {0, 2}, {1}, {3}
    assert cls.tolist() == [0, 1, 2, 3] and home.tolist() == [0, 1, 0, 3]
    assert (between[0, 1], between[1, 2], between[0, 2], between[2, 3]) == (0.5, 0.2, 0.0, 0.7)
    assert clustering.points(4, a, b, np.where(d == 0.2, 0.5, d))[0].tolist() == [0, 1, 0, 2]


@pytest.mark.parametrize("method", ["dbscan_pca", "dbscan", "tfidf", "hybrid"])
def test_many_like_cases_need_no_matrix_of_all_cases(spark, method):
    kinds = cases(spark, {}, dict(text_blob="x q"), OTHER | dict(sim_fatal_kind="no_mret", text_blob="f g"), OTHER | dict(sim_fatal_kind="test_timeout", text_blob="f h"))
    many = kinds.withColumnRenamed("ord", "kind").drop("case_id").crossJoin(spark.range(10_000).withColumnRenamed("id", "copy"))
    many = many.selectExpr("copy * 4 + kind AS case_id", "copy * 4 + kind AS ord", "*").drop("kind", "copy")
    got = clustering.cluster(many, 2, method).collect()
    assert len(got) == 40_000 and {r["label"] for r in got} == {0, 1}
    assert all(r["label"] == (r["ord"] % 4 > 1) for r in got)


def test_vectors_link_without_a_row_for_a_pair(spark):
    x = np.round(np.random.default_rng(7).normal(size=(40, 3)), 1)
    x[7] = x[3]
    rows = spark.createDataFrame([(100 + i, i, v.tolist()) for i, v in enumerate(x)], "case_id long, ord long, v array<double>")
    got = {r["ord"]: r["label"] for r in clustering.by_vectors(rows, 5).collect()}
    want = linkage.labels(slow_linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 5), 40)
    assert [got[i] for i in range(40)] == want.tolist()
    assert clustering.by_vectors(rows.limit(0), 5).count() == 0


@pytest.mark.parametrize("most", [distances.MAX_BROADCAST, 1])
def test_class_pairs_are_laid_over_all_cases(spark, monkeypatch, most):
    monkeypatch.setattr(distances, "MAX_BROADCAST", most)
    monkeypatch.setattr(distances, "ROWS_A_PART", 50)
    monkeypatch.setattr(distances, "ROWS_A_BATCH", 7)
    cls = [5, 9, 5, 5, 7, 9, 7, 5] * 5
    members = spark.createDataFrame(list(zip(cls, range(40), strict=True)), "cls long, ord long")
    pairs = spark.createDataFrame([(a, b, a * 10.0 + b if a != b else None, f"{a}-{b}") for a in (5, 7, 9) for b in (5, 7, 9)], "a long, b long, x double, y string")
    got = sorted(tuple(r) for r in distances.spread(pairs, members).collect())
    assert got == [(i, j, cls[i] * 10.0 + cls[j] if cls[i] != cls[j] else None, f"{cls[i]}-{cls[j]}") for i in range(40) for j in range(i + 1, 40)]


@pytest.mark.parametrize("query", ["set_and_place_overlap", "signature_distance", "hybrid_matrix"])
def test_queries_on_pairs_work_out_like_rows_once(spark, query):
    from faultweave.plans import queries

    plan = queries.QUERIES[query][0](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith(("MapInArrow", "Project")) and "MapInArrow" in "".join(plan.splitlines()[:2])
