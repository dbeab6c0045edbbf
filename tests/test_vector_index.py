"""The vector index against the plain scan."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradewind.operators import privacy as PV
from tradewind.operators import vector_index as VI


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8))
    rows = [(k, (centres[k % 12] * rng.uniform(0.5, 3) + rng.normal(size=8) * 0.2).tolist()) for k in range(600)]
    rows += [(600, rows[0][1]), (601, rows[0][1]), (602, [0.0] * 8), (603, None), (604, [float("nan")] * 8), (605, [None] * 8), (606, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def plain(vectors, queries, k):
    rows = [(r.vec_id, np.array(r.embedding)) for r in vectors.collect() if r.vec_id < 602]
    out = {}
    for q in queries.collect():
        v = np.array(q.vector)
        best = sorted(((-(x @ v) / np.sqrt((x @ x) * (v @ v)), i) for i, x in rows))[:k]
        out[q["query"]] = [i for _, i in best]
    return out


def test_exact_and_probed(spark, vectors, tmp_path):
    queries = vectors.where("vec_id % 50 = 0 AND vec_id < 600").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    index = VI.VectorIndex.build(vectors, str(tmp_path / "i"), cells=24)
    assert sum(index.rows.values()) == 602  # without direction or of another length: not found
    want = plain(vectors, queries, 5)
    again = VI.VectorIndex.load(spark, str(tmp_path / "i"))
    for ix in (index, again):
        found, cells = ix.search(queries, 5)
        got = {}
        for r in found.orderBy("query", "rank").collect():
            got.setdefault(r["query"], []).append(r.vec_id)
        assert got == want
    few, cells = index.search(queries.where("query = 0"), 5, probes=2)
    assert index.share_read(cells) < 1 / 3 and len(cells) == 2
    assert len({r.vec_id for r in few.collect()} & set(want[0])) >= 4
    plan = index.table(cells)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan or "PartitionFilters: [isnotnull(cell" in plan


def test_nothing_to_find(spark, vectors):
    index = VI.VectorIndex.build(vectors.limit(0))
    assert index.search(vectors.limit(1).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 3)[0].count() == 0
    small = VI.VectorIndex.build(vectors.where("vec_id < 3"), cells=24)
    found, _ = small.search(vectors.where("vec_id < 2").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 5)
    assert found.count() == 6 and PV.length is not None
