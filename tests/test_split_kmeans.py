"""The exact split, k-means from several starts, and the Euclidean silhouette."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tradewind.operators import kmeans as KM
from tradewind.operators import split as SP


def test_exact_share_of_every_class(spark):
    rows = [(f"u{k}", k % 7 == 0, j) for k in range(503) for j in range(1 + k % 3)]
    df = spark.createDataFrame([(u, int(y), j) for u, y, j in rows], "unit string, label int, j int")
    got = SP.stratified(df, "unit", "label", 0.8, 42)
    assert got.count() == len(rows) and got.groupBy("unit").agg(F.countDistinct("part").alias("n")).where("n > 1").count() == 0
    of = {r.unit: (r.label, r.part) for r in got.select("unit", "label", "part").distinct().collect()}
    for label in (0, 1):
        mine = sorted((hashlib.md5(f"{u}:42".encode()).hexdigest(), u) for u, (y, _) in of.items() if y == label)
        k = int(0.8 * len(mine) + 0.5)
        assert {u for u, (y, p) in of.items() if y == label and p == "train"} == {u for _, u in mine[:k]}


@pytest.mark.parametrize("share,n", [(0.0, 0), (1.0, 9), (0.5, 5)])
def test_shares_at_the_ends(spark, share, n):
    df = spark.createDataFrame([(str(k), None if k > 8 else 1) for k in range(9)], "unit string, label int")
    assert SP.stratified(df, "unit", "label", share, 1).where("part = 'train'").count() == n
    assert SP.stratified(df.limit(0), "unit", "label", share, 1).count() == 0


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.6, (60, 3)) for c in ((0, 0, 0), (5, 0, 1), (0, 6, 0), (4, 4, 4))])
    return spark.createDataFrame([(f"p{k}", v.tolist()) for k, v in enumerate(x)], "id string, x array<double>").repartition(4, "id").persist()


def test_least_cost_of_ten_separate_fits(spark, points):
    centres, cost, passes = KM.fit(points, 4, 10, 300, 42)
    vectors = points.select(array_to_vector("x").alias("features"))
    separate = min(KMeans(k=4, seed=42 + s, maxIter=300).fit(vectors).summary.trainingCost for s in range(4))
    assert cost == pytest.approx(separate, rel=1e-6) and passes < 40
    again = KM.fit(points.repartition(2), 4, 10, 300, 42)
    assert again[0] == pytest.approx(centres, abs=1e-9)  # however the rows lie
    model = KM.as_model(vectors, centres, "features", "cluster")
    assert np.array(model.clusterCenters()) == pytest.approx(centres)
    assert model.transform(vectors).select("cluster").distinct().count() == 4


def test_silhouette_equals_brute_force(spark, points):
    centres = np.array([[0, 0, 0], [5, 0, 1], [0, 6, 0], [4, 4, 4.0]])
    x = np.array([r.x for r in points.collect()])
    c = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    x, c = np.vstack([x, [[50.0, 50, 50]]]), np.append(c, 4)  # one row alone in its cluster
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    s = []
    for i in range(len(x)):
        own = (c == c[i]).sum() - 1
        a = d[i][c == c[i]].sum() / own if own else 0
        b = min(d[i][c == j].mean() for j in set(c.tolist()) - {c[i]})
        s.append((b - a) / max(a, b) if own else 0.0)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, c, strict=True)], "x array<double>, cluster int")
    rows = rows.select(array_to_vector("x").alias("features"), "cluster")
    r = KM.euclidean_silhouette(rows, "features", "cluster", block_rows=50).first()
    assert (r.rows, r.silhouette) == (241, pytest.approx(np.mean(s), abs=1e-9))
    some = KM.euclidean_silhouette(rows, "features", "cluster", sample=80, block_rows=50).first()
    assert 40 < some.rows < 140 and abs(some.silhouette - np.mean(s)) < 0.1
