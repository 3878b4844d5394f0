import itertools

import numpy as np
import pytest

from faultweave.operators import nearest
from faultweave.operators.components import components


@pytest.mark.parametrize("block", [7, nearest.BLOCK])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(40, 3)), np.zeros((3, 3)), [[9.0, 9, 9]]])  # with equal vectors and a lone one
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, v array<double>").repartition(3)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    got = {r["id"]: r["distance"] for r in nearest.nth_distance(df, 2, block).collect()}
    assert got == pytest.approx({i: sorted(np.delete(d[i], i))[1] for i in range(len(x))})
    quantiles = [0.0, 0.05, 0.5, 0.9, 1.0]
    upper = [d[i, j] for i, j in itertools.combinations(range(len(x)), 2)]
    assert nearest.pair_quantiles(df, quantiles, block) == pytest.approx([np.quantile(upper, q) for q in quantiles])
    name = list(range(len(x)))
    for i, j in itertools.combinations(range(len(x)), 2):
        if d[i, j] <= 0.8:
            name = [min(name[i], name[j]) if n in (name[i], name[j]) else n for n in name]
    groups = {r["node"]: r["component"] for r in components(nearest.near_links(df, 0.8, block)).collect()}
    assert groups == {i: n for i, n in enumerate(name) if name.count(n) > 1}


def test_few_vectors(spark):
    none = spark.createDataFrame([], "id long, v array<double>")
    assert nearest.nth_distance(none, 2).count() == 0 and nearest.pair_quantiles(none, [0.5]) == [None] and nearest.near_links(none, 1.0).count() == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    assert [tuple(r) for r in nearest.nth_distance(one, 2).collect()] == [(1, None)] and nearest.pair_quantiles(one, [0.5]) == [None]
