import hashlib
import random
import zlib

import numpy as np
import pytest

from tradewind.llm import prefix_trie

SMOKE = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, depth string, owner int"


def rebuilt(rows, group=100, heads=6):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    seqs = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], t[2].encode(), t[3].encode()))] for c, ts in own.items()}
    out = {}
    for c, seq in seqs.items():
        h = zlib.crc32(str(c).encode()) % heads
        out[c] = [*seqs.get(c - c % group, [])[:h], *seq[h:]]
    return out


def brute_force(convs):
    members, ends = {}, {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members.setdefault(tuple(convs[c][:d]), []).append(c)
        ends.setdefault(tuple(convs[c]), []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    sums = {}
    for seq in sorted(members, key=len, reverse=True):
        below = [sums[s] for s in children.get(seq, [])]
        saved = (len(members[seq]) - 1) * len(seq[-1][1]) if seq else 0
        sums[seq] = (sum(b[0] for b in below) if below else 1, saved + sum(b[1] for b in below))
    return sorted((ms[0], len(seq), members[seq[:-1]][0] if seq else None, len(ms), len(children.get(seq, [])), *sums[seq],
                   hashlib.sha256(",".join(map(str, ends.get(seq, []))).encode()).hexdigest()) for seq, ms in members.items())


def rows_of(df):
    return sorted(tuple(r[c] for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))
                  for r in df.collect())


def trie(spark, rows, limit):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    turns = prefix_trie.number_turns(df)
    convs = turns.select("conv_id").distinct()
    return prefix_trie.prefix_trie(prefix_trie.branch(turns, convs), convs, limit)


def test_roll_up_equals_plain_sums():
    rng = random.Random(0)
    for shape in ("random", "chain", "star", "comb"):
        for n in (1, 2, 3, 10, 200):
            parent = np.array([-1] + [{"random": rng.randrange(k), "chain": k - 1, "star": 0, "comb": max(0, k - 1 - k % 2)}[shape] for k in range(1, n)])
            values = np.array([[rng.randrange(100), k] for k in range(n)], np.int64)
            plain = values.copy()
            for k in range(n - 1, 0, -1):
                plain[parent[k]] += plain[k]
            assert (prefix_trie.roll_up(parent, values) == plain).all(), (shape, n)


ODD = [(1, 0, "user", "a"), (1, 1, "assistant", "bb"), (2, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "a"), (2, 0, "user", "a"),
       (None, 0, "user", "lost"), (100, 3, "ro", "le"), (100, 3, "r", "ole"), (101, 0, "", "é😀"), (7, -1, "user", ""), (207, 0, "user", "a")]


def test_distributed_rounds(spark):
    rng = random.Random(1)
    rows = ODD[:]
    for c in range(300, 420):  # shallow and wide, many copies
        rows += [(c, t, "user", rng.choice("ab")) for t in range(rng.randrange(1, 7))]
    rows += [(350, t, "user", "long") for t in range(10, 90)]  # one deep chain
    want = brute_force(rebuilt(rows))
    assert rows_of(trie(spark, rows, 4)) == want
    assert rows_of(trie(spark, rows, 10_000)) == want


def test_turns_and_ids_of_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "RUN", 3)
    rows = [(c, t, "user", str(t % 2)) for c in (0, 1, 2, 3, 4, 7, 8, 50, 99) for t in range(11)]
    assert rows_of(trie(spark, rows, 5)) == brute_force(rebuilt(rows))


def test_empty(spark):
    assert trie(spark, [], 10).count() == 0
    assert trie(spark, [(None, 0, "user", "x")], 10).count() == 0


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 20])
def test_query(spark, monkeypatch, limit):
    monkeypatch.setattr(prefix_trie, "LIMIT", limit)
    rows = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(prefix_trie.op12_prefix_trie(spark, SMOKE)) == brute_force(rebuilt(rows))
