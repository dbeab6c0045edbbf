"""Prefix trie of conversations, rolled up by centroid decomposition (operator 12).

A node is a distinct sequence of first turns. Every conversation that starts
with it is a member, and the smallest member names the node: at one depth no
two nodes have the same smallest member. So a node is the pair (conv_id, depth),
and the nodes that a conversation names are one run of its path, down to its
end, because whoever is the smallest of many is the smallest of some of them.

Sums over subtrees come from a centroid decomposition of the parent edges. A
component is a connected part of the trie, known by its top node. In each round,
every component of more than LIMIT nodes loses its centroid z, the deepest node
that holds at least half of the component below it. The total of z's subtree
within the component is z's result, and is added to all nodes on the path from z
to the top. What is left, one component for each child of z and one above z,
has at most half of the nodes each. Components of LIMIT nodes or fewer are
finished inside a task by the same method. There are log2(nodes / LIMIT) rounds,
however deep or wide the trie is, and every step is a join or a sum by key.

Subtree sizes, by which centroids are found, follow from the names: a node's
members own its subtree's nodes, each its run. Sequences are compared by two
64-bit hashes of each (position, role, text), combined by xor along the path.

Defined cases: a null role or text is empty; turns of one number (null comes
first) go by role, then text; repeated rows are turns like any other; rows
without conv_id take no part; a conversation without turns is a member of the
root alone; an empty table has no node, not even the root; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read

#: Nodes of a component that one task finishes by itself.
LIMIT = 10_000
#: Turns of a conversation, or ids of an interval, that are brought together at once.
RUN = 4096
VALUES = ["n_leaves", "saved_tokens"]
NODE, TOP = ["conv_id", "depth"], ["top_conv", "top_depth"]


def number_turns(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text. A range partitioning by the whole order and the
    rows of each conversation before a partition give the positions, so a conversation may
    span many tasks."""
    t = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartitionByRange("conv_id", "turn", "role", "text").withColumn("part", F.spark_partition_id())
    t = materialize(t, "trie-turns")
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = (t.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
             .select("conv_id", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")))
    inside = W.partitionBy("conv_id", "part").orderBy("turn", "role", "text")
    return (t.withColumn("nth", F.row_number().over(inside)).join(first, ["conv_id", "part"])
            .select("conv_id", (F.col("first") + F.col("nth")).alias("pos"), "role", "text"))


def _paths(turns: DataFrame) -> DataFrame:
    """conv_id, depth, two keys of the sequence so far, characters of the last text."""
    t = turns.select("conv_id", F.col("pos").alias("depth"), F.floor((F.col("pos") - 1) / RUN).alias("run"), F.length("text").alias("chars"),
                     *[F.xxhash64(F.lit(k), "pos", "role", "text").alias(f"h{k}") for k in (1, 2)])
    t = materialize(t, "trie-hashes")
    inside = W.partitionBy("conv_id", "run").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = t.groupBy("conv_id", "run").agg(*[F.bit_xor(f"h{k}").alias(f"x{k}") for k in (1, 2)])
    runs = runs.select("conv_id", "run", *[F.coalesce(F.bit_xor(f"x{k}").over(before), F.lit(0).cast("long")).alias(f"b{k}") for k in (1, 2)])
    return (t.select("conv_id", "run", "depth", "chars", *[F.bit_xor(f"h{k}").over(inside).alias(f"i{k}") for k in (1, 2)])
            .join(runs, ["conv_id", "run"])
            .select("conv_id", "depth", "chars", *[F.col(f"i{k}").bitwiseXOR(F.col(f"b{k}")).alias(f"k{k}") for k in (1, 2)]))


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's comma-joined ids in ascending order. Ids are joined inside
    intervals first; one pass over a node's sorted intervals feeds the digest piece by piece."""
    parts = (ends.groupBy(*NODE, F.floor(F.col("id") / RUN).alias("part"))
             .agg(F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids")))
    sorted_parts = parts.repartition(*NODE).sortWithinPartitions(*NODE, "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([n[0] for n, _ in done], pa.int64()), pa.array([n[1] for n, _ in done], pa.int64()),
                                               pa.array([d for _, d in done], pa.string())], names=["conv_id", "depth", "ends_sha256"])

        for batch in batches:
            for conv_id, depth, ids in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "ids")), strict=True):
                if (conv_id, depth) == node:
                    digest.update(b"," + ids.encode())
                    continue
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = (conv_id, depth), hashlib.sha256(ids.encode())
            yield rows()
            done.clear()
        if node is not None:
            done.append((node, digest.hexdigest()))
            yield rows()

    return sorted_parts.mapInArrow(run, "conv_id bigint, depth bigint, ends_sha256 string")


def roll_up(parent: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Subtree sums of one tree by centroid decomposition: ``parent[k] < k`` (-1 at the top)
    and ``values`` has a row for each node."""
    n = len(parent)
    children: list[list[int]] = [[] for _ in range(n)]
    for k in range(1, n):
        children[parent[k]].append(k)
    sums, removed, size = np.zeros_like(values), np.zeros(n, bool), [0] * n
    tops = [0]
    while tops:
        top = tops.pop()
        nodes = [top]  # parents before children
        for k in nodes:
            nodes.extend(c for c in children[k] if not removed[c])
        for k in reversed(nodes):
            size[k] = 1 + sum(size[c] for c in children[k] if not removed[c])
        z, half = top, len(nodes) / 2
        while (heavy := next((c for c in children[z] if not removed[c] and size[c] >= half), None)) is not None:
            z = heavy
        below = [z]
        for k in below:
            below.extend(c for c in children[k] if not removed[c])
        total = values[below].sum(axis=0)
        path, k = [z], z
        while k != top:
            k = parent[k]
            path.append(k)
        sums[path] += total
        removed[z] = True
        tops.extend(c for c in children[z] if not removed[c])
        if z != top:
            tops.append(top)
    return sums


def _finish(parts: DataFrame) -> DataFrame:
    """``roll_up`` of each component, whose nodes one task reads in order of depth."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*TOP, *NODE, "parent_conv", *VALUES]
        held: list[np.ndarray] = []

        def finished(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            if not len(rows):
                return
            out = np.empty((len(rows), len(VALUES)), np.int64)
            edges = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1), True])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                at = {(c, d): k for k, (c, d) in enumerate(rows[a:b, 2:4].tolist())}
                parent = np.array([-1] + [at[p, d - 1] for d, p in rows[a + 1:b, 3:5].tolist()], np.int64)
                out[a:b] = roll_up(parent, rows[a:b, 5:])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[:, 2], rows[:, 3], *out.T)], names=[*NODE, *VALUES])

        for batch in batches:
            rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(np.int64)
            if not len(rows):
                continue
            start = len(rows) - int((rows[::-1, :2] == rows[-1, :2]).all(axis=1).cumprod().sum())  # of the last component
            if start:
                yield from finished(np.concatenate([*held, rows[:start]]))
                held = []
            elif held and (held[-1][-1, :2] != rows[0, :2]).any():
                yield from finished(np.concatenate(held))
                held = []
            held.append(rows[start:])
        if held:
            yield from finished(np.concatenate(held))

    cols = [F.coalesce(c, F.lit(-1)).cast("long").alias(c) if c == "parent_conv" else F.col(c).cast("long").alias(c)
            for c in [*TOP, *NODE, "parent_conv", *VALUES]]
    return (parts.select(*cols).repartition(*TOP).sortWithinPartitions(*TOP, "depth", "conv_id")
            .mapInArrow(run, "conv_id bigint, depth bigint, n_leaves bigint, saved_tokens bigint"))


def subtree_sums(nodes: DataFrame, paths: DataFrame, limit: int = LIMIT) -> DataFrame:
    """conv_id, depth and the subtree sums of VALUES.

    ``nodes``: conv_id, depth, parent_conv, size (nodes of the subtree), VALUES.
    ``paths``: conv_id, depth, owner (the node of the conversation at that depth is
    (owner, depth)) and above (the owner one step up); both are read in each round.
    """
    root = nodes.where("depth = 0").select("conv_id", "size").first() or (None, None)
    start = {"top_conv": root[0], "top_depth": 0, "n": root[1]}  # one component, of which the root is the top
    active = materialize(nodes.withColumns({k: F.lit(v).cast("long") for k, v in start.items()}), "trie-active")
    small, added = [], []
    while True:
        small.append(active.where(F.col("n") <= limit))
        active = active.where(F.col("n") > limit)
        cuts = (active.where(F.col("size") * 2 >= F.col("n")).groupBy(*TOP)
                .agg(F.max(F.struct("depth", "conv_id", "size")).alias("z"))
                .select(*TOP, F.col("z.conv_id").alias("z_conv"), F.col("z.depth").alias("z_depth"), F.col("z.size").alias("z_size")))
        cuts = materialize(cuts, "trie-cuts")
        if cuts.isEmpty():
            break
        # Which side of its component's cut each node is on: a node below z has z on its path.
        step = paths.select("conv_id", (F.col("depth") - 1).alias("z_depth"), F.col("owner").alias("child"), "above")
        sides = active.join(cuts, TOP).join(step, ["conv_id", "z_depth"], "left")
        is_z = (F.col("conv_id") == F.col("z_conv")) & (F.col("depth") == F.col("z_depth"))
        below = (F.col("depth") > F.col("z_depth")) & (F.col("above") == F.col("z_conv"))
        sides = materialize(sides.withColumn("side", F.when(is_z, "z").when(below, "below").otherwise("above")), "trie-sides")
        totals = sides.where("side != 'above'").groupBy(*TOP).agg(*[F.sum(v).alias(v) for v in VALUES])
        # From z to the top: everything that z's subtree holds is below these nodes as well.
        on_path = (cuts.join(paths.select(F.col("conv_id").alias("z_conv"), "depth", "owner"), "z_conv")
                   .where("depth <= z_depth AND depth >= top_depth"))
        on_path = on_path.join(totals, TOP).select(F.col("owner").alias("conv_id"), "depth", (F.col("depth") < F.col("z_depth")).alias("stays"),
                                                   F.col("z_size").alias("less"), *VALUES)
        on_path = materialize(on_path, "trie-path")
        added.append(on_path.select(*NODE, *VALUES))
        tops = (sides.where("side = 'below' AND depth = z_depth + 1")
                .select(F.col("conv_id").alias("child"), F.col("depth").alias("child_depth"), F.col("size").alias("child_n")))
        lower = sides.where("side = 'below'").withColumn("child_depth", F.col("z_depth") + 1).join(tops, ["child", "child_depth"]).select(
            *NODE, "parent_conv", "size", *VALUES, F.col("child").alias("top_conv"), F.col("child_depth").alias("top_depth"), F.col("child_n").alias("n"))
        upper = sides.where("side = 'above'").join(on_path.where("stays").select(*NODE, "less"), NODE, "left").select(
            *NODE, "parent_conv", (F.col("size") - F.coalesce("less", F.lit(0))).alias("size"), *VALUES, *TOP, (F.col("n") - F.col("z_size")).alias("n"))
        active = materialize(lower.unionByName(upper), "trie-active")
    parts = small[0]
    for part in small[1:]:
        parts = parts.unionByName(part)
    sums = _finish(parts)
    for rows in added:
        sums = sums.unionByName(rows)
    return sums.groupBy(*NODE).agg(*[F.sum(v).alias(v) for v in VALUES])


def prefix_trie(turns: DataFrame, convs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, pos from 1 without gaps, role, text);
    ``convs`` (conv_id) lists all conversations, also those without turns."""
    keyed = materialize(_paths(turns), "trie-keys")
    convs = convs.select("conv_id").distinct()
    first, n_convs = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    key = ["depth", "k1", "k2"]
    named = keyed.groupBy(*key).agg(F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"))
    named = materialize(named, "trie-named")
    zero = F.lit(0).cast("long")
    owned = keyed.join(named.select(*key, "owner"), key).select("conv_id", F.col("depth").cast("long").alias("depth"), "owner")
    owned = materialize(owned.unionByName(convs.select("conv_id", zero.alias("depth"), F.lit(first).cast("long").alias("owner"))), "trie-owned")
    up = owned.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("owner").alias("above"))
    paths = materialize(owned.join(up, NODE, "left"), "trie-paths")

    # A conversation's last node, and how many nodes it names: its run from `since` to its end.
    runs = (paths.groupBy("conv_id").agg(F.max("depth").alias("end"), F.min(F.when(F.col("owner") == F.col("conv_id"), F.col("depth"))).alias("since")))
    runs = materialize(runs.withColumn("names", F.coalesce(F.col("end") - F.col("since") + 1, zero)), "trie-runs")
    held = (paths.join(runs.select("conv_id", "names"), "conv_id").groupBy(F.col("owner").alias("conv_id"), "depth").agg(F.sum("names").alias("held")))
    nodes = (named.select(F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "n_convs", "chars")
             .unionByName(convs.where(F.col("conv_id") == F.lit(first)).select(
                 "conv_id", zero.alias("depth"), F.lit(n_convs).cast("long").alias("n_convs"), F.lit(0).alias("chars"))))
    parents = paths.where("conv_id = owner").select(*NODE, F.col("above").alias("parent_conv"))
    children = parents.where("depth > 0").groupBy(F.col("parent_conv").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = (nodes.join(parents, NODE).join(children, NODE, "left").join(held, NODE).join(runs, "conv_id")
             .select(*NODE, "parent_conv", "n_convs", F.coalesce("n_children", zero).alias("n_children"),
                     F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                     ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
                     (F.col("held") - F.col("names") + F.col("end") - F.col("depth") + 1).alias("size")))
    nodes = materialize(nodes, "trie-nodes")
    ends = paths.join(runs.select("conv_id", F.col("end").alias("depth")), NODE).select(F.col("owner").alias("conv_id"), "depth", F.col("conv_id").alias("id"))
    sums = subtree_sums(nodes.select(*NODE, "parent_conv", "size", *VALUES), paths, limit)
    return (nodes.drop(*VALUES).join(sums, NODE).join(_digests(ends), NODE, "left")
            .select("conv_id", "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", *VALUES,
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def branch(turns: DataFrame, convs: DataFrame, group: int = 100, heads: int = 6) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % ``group`` in place
    of its own first h; h = crc32(c) % ``heads``. Positions have no gaps."""
    c = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"),
                     (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).alias("h"))
    starts = turns.where(F.col("pos") < heads).select(F.col("conv_id").alias("base"), "pos", "role", "text")
    given = c.join(starts, "base").where("pos <= h")
    length = given.groupBy("conv_id").agg(F.count(F.lit(1)).alias("m"))
    own = turns.join(c.select("conv_id", "h"), "conv_id").where("pos > h").join(length, "conv_id", "left")
    return given.select("conv_id", "pos", "role", "text").unionByName(
        own.select("conv_id", (F.coalesce("m", F.lit(0)) + F.col("pos") - F.col("h")).alias("pos"), "role", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the trie of all rebuilt conversations."""
    turns = materialize(number_turns(read(spark, sf_dir, "conversations")), "trie-numbered")
    convs = turns.select("conv_id").distinct()
    return prefix_trie(branch(turns, convs), convs)


_CRC_STEP = "xor(a >> 1, (a & 1) * 3988292384)"
ORACLE = f"""
WITH t AS (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT c, xor(list_reduce([4294967295] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, n: {_CRC_STEP})), 4294967295) AS crc
  FROM (SELECT DISTINCT c FROM t)
), c AS (SELECT c, c - c % 100 AS base, crc % 6 AS h FROM crc),
given AS (SELECT c.c, t.pos, t.role, t.text FROM c JOIN t ON t.c = c.base AND t.pos <= c.h),
rebuilt AS (
  SELECT c, pos AS d, role, text FROM given
  UNION ALL
  SELECT t.c, coalesce(g.m, 0) + t.pos - c.h, t.role, t.text
  FROM t JOIN c ON c.c = t.c LEFT JOIN (SELECT c, count(*) AS m FROM given GROUP BY c) g ON g.c = t.c WHERE t.pos > c.h
), path AS (
  SELECT c, d, length(text) AS chars, string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY d) AS k FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM c
), node AS (SELECT d, k, min(c) AS conv_id, count(*) AS n_convs, min(chars) AS chars FROM path GROUP BY d, k),
edge AS (
  SELECT n.d, n.k, p.k AS pk FROM node n JOIN path p ON p.c = n.conv_id AND p.d = n.d - 1
), child AS (SELECT d - 1 AS d, pk AS k, count(*) AS n_children FROM edge GROUP BY d, pk),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * chars AS saved
  FROM node n LEFT JOIN child USING (d, k)
), sums AS (
  SELECT p.d, p.k, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens
  FROM own o JOIN path p ON p.c = o.conv_id AND p.d <= o.d GROUP BY p.d, p.k
), ends AS (
  SELECT p.d, p.k, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids
  FROM path p JOIN (SELECT c, max(d) AS d FROM path GROUP BY c) l ON l.c = p.c AND l.d = p.d GROUP BY p.d, p.k
)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, o.n_convs, CAST(o.n_children AS BIGINT) AS n_children,
  CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM own o JOIN sums USING (d, k) LEFT JOIN ends USING (d, k) LEFT JOIN edge e USING (d, k)
LEFT JOIN node up ON up.d = o.d - 1 AND up.k = e.pk
"""
