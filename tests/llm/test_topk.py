import numpy as np

from tradewind.llm import topk


def brute(q_ids, q, c_ids, c, k):
    out = []
    for i, v in zip(q_ids, q, strict=True):
        s = sorted((-int(np.dot(v.astype(object), w.astype(object))), int(j)) for j, w in zip(c_ids, c, strict=True) if j != i)
        out += [(int(i), j, -x) for x, j in s[:k]]
    return out


def test_search_in_blocks():
    rng = np.random.default_rng(3)
    for n, dim, top in ((300, 70, 200), (50, 1, 3), (4, 33, 5), (1, 5, 9), (120, 16, 1), (60, 8, 2**40)):
        c = rng.integers(-top, top + 1, (n, dim))
        if n > 100:
            c[: n // 3] = c[0]  # a third are copies
        ids = rng.permutation(n * 2)[:n]
        got = topk.search(ids[:20], c[:20].T, ids, c.T, 5)
        want = [(a, b, max(-2**63, min(2**63 - 1, s))) for a, b, s in brute(ids[:20], c[:20], ids, c, 5)]
        assert list(zip(*(x.tolist() for x in got), strict=True)) == want


def test_many_blocks_on_spark(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(5)
    v = rng.integers(-9, 10, (150, 6))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, v array<long>")
    got = topk.top_k(df, df.where("vec_id % 7 = 0"), 4).collect()
    want = brute(range(0, 150, 7), v[::7], range(150), v, 4)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == [
        (a, k % 4 + 1, b, s) for k, (a, b, s) in enumerate(want)]
