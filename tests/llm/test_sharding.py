import math
from collections import Counter, defaultdict

import numpy as np

from tradewind.llm import sharding as S


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    for good, bad, draws in ((5, 7, 6), (40, 3, 20), (1, 1, 1)):
        got = Counter(S.hypergeometric(rng, good, bad, draws) for _ in range(20000))
        for k in range(max(0, draws - bad), min(good, draws) + 1):
            p = math.comb(good, k) * math.comb(bad, draws - k) / math.comb(good + bad, draws)
            assert abs(got[k] / 20000 - p) < 5 * math.sqrt(p * (1 - p) / 20000) + 1e-3
    big = [S.hypergeometric(rng, 4 * 10**10, 4 * 10**10, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 5 * 10**5) < 500


def test_matrix_sums():
    rows, shards = [5, 0, 17, 3], [7, 6, 6, 6]
    m = S.communication_matrix(rows, shards, 9)
    assert [sum(r) for r in m] == rows and [sum(c) for c in zip(*m, strict=True)] == shards


def test_shards_are_exact_and_uniform(spark):
    rows = [(i, None if i % 50 == 0 else f"t{i % 9}", i % 3) for i in range(2003)] + [(7, "same", 0)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")  # a clashing column is replaced
    out = S.shuffle_into_shards(df, 8, ["doc_id", "text"], min_buckets=5).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r[0], r[1]) for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 1
    again = S.shuffle_into_shards(df.repartition(3), 8, ["doc_id", "text"], min_buckets=5).collect()
    place = lambda o: sorted((r["shard"], r["slot"], r.doc_id, str(r.text)) for r in o)
    assert place(out) == place(again)
    by_place = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    order = np.array([r.doc_id for r in by_place], dtype=float)
    assert abs(np.corrcoef(order, np.arange(len(order)))[0, 1]) < 0.08
    assert S.shuffle_into_shards(df.limit(0), 8, ["doc_id"]).count() == 0


def test_contract_columns(spark):
    out = S.op5_sharding(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    import zlib
    assert {r.doc_id: (r["size"], r.text_crc32) for r in out} == {
        i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs.items()}
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}
