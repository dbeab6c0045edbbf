import random

import numpy as np

from tradewind.llm import near_dedup as N


def test_components_of_a_long_chain(spark):
    n = 300
    order = list(range(n))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (5000, 5000)]
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r.node: r.component for r in N.components(df).collect()}
    assert got == {**dict.fromkeys(range(n), 0), 1000: 1000, 1001: 1000}
    assert N.components(df.limit(0)).count() == 0


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    other = np.concatenate([base[:900], rng.integers(0, 2**64, 100, dtype=np.uint64)])
    same = np.mean([np.mean(N.band_keys(np.unique(base ^ np.uint64(i))) == N.band_keys(np.unique(other ^ np.uint64(i)))) for i in range(60)])
    assert abs(same - (900 / 1100) ** N.BAND) < 0.06


def test_crowded_bands_against_brute_force(spark, monkeypatch):
    """Many near copies of one text, linked and not, with blocks cut into chunks."""
    monkeypatch.setattr(N, "CHUNK", 8)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(60)}"
        docs.append((i, " ".join(w)))
    sets = [set(N.shingle_set(t.encode()).tolist()) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    df = spark.createDataFrame(docs + [(3, docs[3][1]), (None, docs[0][1])], "doc_id long, text string")
    got = N.near_duplicates(df).collect()
    assert len(got) == len(docs) + 2
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == {i: find(i) for i in range(len(docs))}
    kept = N.keep_one(df)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({find(i) for i in range(len(docs))})
