"""The clustering queries, whole, against plain loops over the same rows."""

import itertools
import math
import re
from collections import Counter

import numpy as np
import pytest

from faultweave.functions import rules as R
from faultweave.operators import clustering, distances
from faultweave.operators.signatures import categorical_key
from faultweave.plans import queries

DATA, K = "/root/testdata/sf0.01", 6


def clean(blob, ord_):
    tokens = [t for t in blob.strip().lower().split() if t not in R.NOISE_TOKENS and not re.search(R.NOISE_PATTERN, t)]
    return " ".join(t for i, t in enumerate(tokens) if i == 0 or t != tokens[i - 1]) or f"empty_case_{ord_}"


def words(text, low, high):
    ws = re.findall("[A-Za-z_][A-Za-z0-9_<>]+", text.lower())
    return Counter(" ".join(ws[i : i + n]) for n in range(low, high + 1) for i in range(len(ws) - n + 1))


def chars(text, low, high):
    out = Counter()
    for w in text.lower().split():
        w = f" {w} "
        for n in range(low, high + 1):
            out.update(w[i : i + n] for i in range(max(1, len(w) - n + 1)))
            if len(w) <= n:
                break
    return out


def vectors(texts):
    """Rows of both spaces' weights side by side, each space at length 1."""
    parts = []
    for counts in ([words(t, 1, 3) for t in texts], [chars(t, 3, 6) for t in texts]):
        df = Counter(term for c in counts for term in c)
        place = {term: i for i, term in enumerate(sorted(df))}
        x = np.zeros((len(texts), len(place)))
        for row, c in enumerate(counts):
            for term, n in c.items():
                x[row, place[term]] = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[term])) + 1)
        size = np.linalg.norm(x, axis=1, keepdims=True)
        parts.append(x / np.where(size > 0, size, 1))
    return np.hstack(parts)


def unit(x):
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def upgma(d, k, groups=None):
    """Merges the two groups of least mean distance; of equal ones those with the least members."""
    groups = groups or [[i] for i in range(len(d))]
    while len(groups) > max(1, k):
        member = np.zeros((len(groups), len(d)))
        for g, own in enumerate(groups):
            member[g, own] = 1 / len(own)
        mean = np.round(member @ d @ member.T, 12)
        mean[np.tril_indices(len(groups))] = np.inf
        i, j = divmod(int(mean.argmin()), len(groups))
        groups[i] = sorted(groups[i] + groups[j])
        del groups[j]
        groups.sort()
    return groups


def labels(groups, n):
    out = [0] * n
    for label, g in enumerate(sorted(groups, key=min)):
        for i in g:
            out[i] = label
    return out


def density(near_by, radii, d, k):
    """Chains of points within a radius; the best radius; noise to the nearest group; merged or split to k."""
    n, tried = len(d), []
    for r in radii:
        name = list(range(n))
        for i, j in itertools.combinations(range(n), 2):
            if near_by[i, j] <= r and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if x == old else x for x in name]
        every = [[i for i in range(n) if name[i] == x] for x in sorted(set(name))]
        groups, noise = [g for g in every if len(g) > 1], [g[0] for g in every if len(g) == 1]
        tried.append((abs(len(groups) - k), len(noise), -len(groups), r, groups, noise))
    *_, groups, noise = min(tried)
    if not groups:
        return upgma(d, k)
    groups = [list(g) for g in groups]
    for x in noise:
        min(groups, key=lambda g: (d[x, g].mean(), groups.index(g))).append(x)
    while len(groups) > k:
        _, i, j = min((d[np.ix_(groups[i], groups[j])].mean(), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        groups[i] += groups.pop(j)
    while len(groups) < k:
        spread = [(-np.mean([d[i, j] for i, j in itertools.combinations(g, 2)]), at) for at, g in enumerate(groups) if len(g) > 2]
        if not spread:
            break
        own = groups[min(spread)[1]]
        first, second = upgma(d[np.ix_(own, own)], 2)
        groups[groups.index(own)] = [own[i] for i in first]
        groups.append([own[i] for i in second])
    return groups


@pytest.fixture(scope="module")
def rows(spark):
    cases = queries._cases(spark, DATA)
    got = cases.withColumn("key", categorical_key()).orderBy("ord").collect()
    place = {r["ord"]: i for i, r in enumerate(got)}
    d = np.zeros((len(got), len(got)))
    for r in distances.distance_pairs(cases).collect():  # held against SQL as the query hybrid_matrix
        d[place[r["a"]], place[r["b"]]] = d[place[r["b"]], place[r["a"]]] = r["distance"]
    return got, d, [clean(r["text_blob"], r["ord"]) for r in got]


def check(spark, name, rows, groups):
    got = {r["Case"]: r["bucket"] for r in queries.QUERIES[name][0](spark, DATA).collect()}
    want = labels(groups, len(rows))
    assert got == {r["case_id"]: f"bucket_{x}" for r, x in zip(rows, want, strict=True)}


def test_tfidf(spark, rows):
    got, _, texts = rows
    x = unit(vectors(texts))
    check(spark, "cluster_tfidf", got, upgma(np.clip(1 - x @ x.T, 0, 1) * (1 - np.eye(len(got))), K))


def test_hybrid(spark, rows):
    got, d, _ = rows
    check(spark, "cluster_hybrid", got, upgma(d, K))


def test_signature_then_tfidf(spark, rows):
    got, _, texts = rows
    x, keys = vectors(texts), list(dict.fromkeys(r["key"] for r in got))
    groups = [[i for i, r in enumerate(got) if r["key"] == key] for key in keys]
    while len(groups) > K:
        c = unit(np.array([x[g].mean(axis=0) for g in groups]))
        away = np.round(1 - c @ c.T, 12)
        away[np.tril_indices(len(c))] = np.inf
        i, j = divmod(int(away.argmin()), len(c))
        groups[i] += groups.pop(j)
    check(spark, "cluster_signature_then_tfidf", got, groups)


def test_dbscan(spark, rows):
    got, d, _ = rows
    upper = sorted(d[i, j] for i, j in itertools.combinations(range(len(d)), 2))
    radii = [min(0.85, max(0.05, float(np.quantile(upper, q)))) for q in clustering.DENSITY_QUANTILES]
    check(spark, "cluster_dbscan", got, density(d, radii, d, K))


def test_dbscan_pca(spark, rows):
    got, d, texts = rows
    counts = [words(t, 1, 2) for t in texts]
    terms = sorted({t for c in counts for t in c})
    x = np.array([[c[t] for t in terms] for c in counts], float)
    n, m = x.shape
    keep = min(clustering.MAX_COMPONENTS, max(2, n - 1), m - 1)
    values, vectors_ = np.linalg.eigh(x @ x.T)  # another way to the same components
    z = (vectors_ * np.sqrt(np.maximum(values, 0)))[:, ::-1][:, :keep]
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    e = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    second = [sorted(e[i, j] for j in range(n) if j != i)[1] for i in range(n)]
    radii = [min(5.0, max(0.05, float(np.quantile(second, q)))) for q in clustering.NEIGHBOUR_QUANTILES]
    check(spark, "cluster_dbscan_pca", got, density(e, radii, d, K))


def test_upgma_vectors(spark):
    got = spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r["embedding"] for r in got], float)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    want = labels(upgma(d, 10), len(got))
    assert {r["case_id"]: r["label"] for r in queries.q_upgma_vectors(spark, DATA).collect()} == {r["vec_id"]: x for r, x in zip(got, want, strict=True)}


def test_ward_characters(spark):
    got = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").collect()
    x = np.array([[r["text"].count(chr(c)) if c else 0 for c in range(128)] * 3 for r in got], float)
    spread = lambda g: ((x[g] - x[g].mean(axis=0)) ** 2).sum()
    groups = [[i] for i in range(len(got))]
    while len(groups) > 5:
        _, i, j = min((round(spread(groups[i] + groups[j]) - spread(groups[i]) - spread(groups[j]), 9), i, j) for i, j in itertools.combinations(range(len(groups)), 2))
        groups[i] = sorted(groups[i] + groups.pop(j))
        groups.sort()
    want = labels(groups, len(got))
    assert {r["case_id"]: r["label"] for r in queries.q_ward_characters(spark, DATA).collect()} == {r["item_id"]: x for r, x in zip(got, want, strict=True)}
