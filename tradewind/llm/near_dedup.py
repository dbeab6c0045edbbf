"""Near-duplicate groups by min-max hashing (operator 10).

A document's set holds the 64-bit hashes of its distinct 5-word shingles. Of
every permutation of the hash space both the smallest and the largest value
over the set are kept: two unbiased signature values for one hash evaluation.
Four values make a band; documents that agree in a band are candidates.

1. Documents of equal sets are one class; only classes go on.
2. Star: each class is compared, on full sets, with the smallest class it shares
   a band with. One comparison a class settles most groups of copies.
3. Rest: bands whose classes are not all in one star yet are compared in full,
   class by class across stars, in blocks of a bounded number of classes. Only
   links that join two stars come out, never all pairs.
4. Components of the links by contraction; each round joins and aggregates.

The banding finds a pair at the threshold of 0.85 with probability
1 - (1 - 0.85^4)^22, short of 1 by 9e-8, more similar pairs more surely still;
every candidate is decided exactly, on 100 * |A and B| >= 85 * |A or B|.

Words: A-Z lower-cased, runs of anything but ASCII white space. Fewer than five
words make one shingle. Defined cases: a null, empty or wordless text has an
empty set and is linked with nothing; repeated rows are one class; ids are taken
as unique (classes with the same smallest id count as linked); a row whose id is
null is linked with nothing and kept; an empty table gives no row; other columns
are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read

SHINGLE = 5
PERMUTATIONS, BAND = 44, 4
BANDS = 2 * PERMUTATIONS // BAND
THRESHOLD = 85
#: Classes of one band that meet in one block, and shingles of their sets; larger bands are
#: cut into pairs of chunks, so that a worker holds two chunks' sets at most (and one set more).
CHUNK, CHUNK_SHINGLES = 512, 500_000

_rng = np.random.default_rng(10)
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE, _XOR, _MULTIPLY = _odd(SHINGLE), _odd(PERMUTATIONS)[:, None], _odd(PERMUTATIONS)[:, None]
_IN_BAND, _BAND_SALT = _odd(BAND), _odd(BANDS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text."""
    words = text.lower().split() if text else []
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < SHINGLE:  # the words as one shingle, apart from longer ones by the count
        return _mix((h * _PLACE[:n]).sum(keepdims=True) + np.uint64(n))
    x = h[:n - SHINGLE + 1] * _PLACE[0]
    for j in range(1, SHINGLE):
        x = x + h[j:n - SHINGLE + 1 + j] * _PLACE[j]
    return np.unique(_mix(x))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of the min-max signature."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), 4096):
        v = (shingles[None, at:at + 4096] ^ _XOR) * _MULTIPLY
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    signature = np.stack([low, high], axis=1).reshape(BANDS, BAND)
    return _mix((_mix(signature) * _IN_BAND).sum(axis=1) + _BAND_SALT)


def _set_key(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def _signatures(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            s = shingle_set(t)
            rows.append((len(s), _set_key(s), band_keys(s).view(np.int64)) if len(s) else (0, None, None))
        yield pd.DataFrame(rows, columns=["n_shingles", "set_key", "bands"])


def _sets(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The sets of the texts whose set has the given key; null for others."""
    for texts, keys in batches:
        found = [(shingle_set(t), k) for t, k in zip(texts, keys, strict=True)]
        yield pd.Series([s.view(np.int64) if _set_key(s) == bytes(k) else None for s, k in found], dtype=object)


def _links_in_block(nodes, labels, sides, sets, threshold: int) -> list[tuple[int, int]]:
    """Links that join classes of different labels; sides -1: all pairs, else only across sides."""
    m = len(nodes)
    parent: dict[int, int] = {}

    def find(x):
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    sizes = np.array([len(s) for s in sets])
    ids, found = None, []
    roots = labels.copy()
    for i in range(m - 1):
        root = find(int(labels[i]))
        near = (roots[i + 1:] != root) & (100 * np.minimum(sizes[i], sizes[i + 1:]) >= threshold * np.maximum(sizes[i], sizes[i + 1:]))
        if sides[i] >= 0:
            near &= sides[i + 1:] != sides[i]
        others = np.flatnonzero(near) + i + 1
        if not len(others):
            continue
        if ids is None:
            values, flat = np.unique(np.concatenate(sets), return_inverse=True)
            ids, mask = np.split(flat.reshape(-1), np.cumsum(sizes)[:-1]), np.zeros(len(values), bool)
        mask[ids[i]] = True
        starts = np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        common = np.add.reduceat(mask[np.concatenate([ids[j] for j in others])].astype(np.int64), starts)
        mask[ids[i]] = False
        linked = others[100 * common >= threshold * (sizes[i] + sizes[others] - common)]
        for j in linked:
            a, b = find(int(labels[i])), find(int(labels[j]))
            if a != b:
                parent[a] = b
                found.append((int(nodes[i]), int(nodes[j])))
        if len(linked):
            roots = np.array([find(int(x)) for x in labels])
    return found


def _block_links(threshold: int):
    """Arrow batches sorted by (key, a, b) -> links; a block may span batches."""

    def links(rows):
        if len(rows) < 2:
            return []
        side, node, label, sets = zip(*rows, strict=True)
        return _links_in_block(np.array(node), np.array(label), np.array(side), list(sets), threshold)

    def out(found):
        return pa.RecordBatch.from_pydict({"u": pa.array([f[0] for f in found], pa.int64()),
                                           "v": pa.array([f[1] for f in found], pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            found = []
            key, a, b, side, node, label = (batch.column(i).to_pylist() for i in range(6))
            shingles = batch.column(6)
            ends, values = shingles.offsets.to_numpy(), shingles.values.to_numpy()
            for i in range(batch.num_rows):
                if (this := (key[i], a[i], b[i])) != block:
                    found += links(rows)
                    block, rows = this, []
                rows.append((side[i] if a[i] != b[i] else -1, node[i], label[i], values[ends[i]:ends[i + 1]]))
            if found:
                yield out(found)
        if found := links(rows):
            yield out(found)

    return run


def components(links: DataFrame) -> DataFrame:
    """(u, v) rows -> (node, component), the smallest node reachable, for every node with a link.

    Each round points a node at its smallest neighbour, follows pointers twice
    and contracts; rounds are few (logarithmic in the length of chains)."""
    edges = materialize(links.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    maps = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        up = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("p"))
                         .select("node", F.least("node", "p").alias("p")), "pointers")
        for _ in range(2):
            nxt = up.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            up = up.join(nxt, "p").select("node", F.col("pp").alias("p"))
        up = materialize(up, "pointers")
        maps.append(up)
        to_u, to_v = up.select(F.col("node").alias("u"), F.col("p").alias("pu")), up.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        moved = edges.join(to_u, "u").join(to_v, "v").where("pu <> pv")
        edges = materialize(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "links")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found = maps[0].select("node", F.col("p").alias("component"))
    for up in maps[1:]:
        found = (found.join(up.select(F.col("node").alias("component"), "p"), "component", "left")
                 .select("node", F.coalesce("p", "component").alias("component")))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles, component_id (smallest id
    reachable by links) and kept (the id is its component's). ``docs`` is read twice and
    must not change between."""
    key = docs.select(F.col(id_col).cast("long").alias("id"), docs[text_col].cast("binary").alias("t"))
    signed = materialize(key.select("id", F.pandas_udf(_signatures, "n_shingles long, set_key binary, bands array<long>")("t").alias("s")).select("id", "s.*"), "signatures")
    by_set = signed.where("set_key IS NOT NULL AND id IS NOT NULL")
    classes = materialize(by_set.groupBy("set_key").agg(
        F.min("id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "classes")

    member = classes.select(F.explode("bands").alias("key"), "node", "n")
    shared = member.groupBy("key").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("m")).where("m > 1")
    member = materialize(member.join(shared, "key"), "bands")

    nodes = member.select("node").distinct()
    wanted = classes.join(nodes, "node").select("node", F.col("set_key").alias("_k"))
    # The set is made after the join, of the joined texts only: it takes the key of the other side.
    sets = key.join(wanted, key["id"] == wanted["node"]).select(
        "node", F.pandas_udf(_sets, "array<long>")("t", "_k").alias("shingles")).where("shingles IS NOT NULL")
    sets = materialize(sets.dropDuplicates(["node"]), "sets")

    # Star: one comparison for each class.
    pair = member.where("center <> node").groupBy("node").agg(F.min("center").alias("center"))
    both = pair.join(sets, "node").join(sets.select(F.col("node").alias("center"), F.col("shingles").alias("other")), "center")
    common = F.size(F.array_intersect("shingles", "other"))
    stars = materialize(both.where(100 * common >= threshold * (F.size("shingles") + F.size("other") - common))
                        .select(F.col("node").alias("u"), F.col("center").alias("v")), "stars")

    # Rest: bands that hold several stars.
    up = stars.select(F.col("u").alias("node"), F.col("v").alias("l1"))
    upper = stars.select(F.col("u").alias("l1"), F.col("v").alias("l2"))
    label = (nodes.join(up, "node", "left").join(upper, "l1", "left")
             .select("node", F.coalesce("l2", "l1", "node").alias("label")))
    labelled = materialize(member.select("key", "node", "n").join(label, "node"), "labels")
    mixed = (labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.sum("n").alias("held"))
             .where("lo <> hi").select("key", F.greatest(F.ceil(F.col("m") / CHUNK), F.ceil(F.col("held") / CHUNK_SHINGLES)).cast("int").alias("chunks")))
    block = labelled.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    block = block.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(
        "key", F.least("side", "o").alias("a"), F.greatest("side", "o").alias("b"), "side", "node", "label")
    block = (block.join(sets, "node").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "node")
             .select("key", "a", "b", "side", "node", "label", "shingles"))
    rest = block.mapInArrow(_block_links(threshold), "u long, v long")

    found = components(stars.unionByName(rest))
    label_of = (classes.select("set_key", "node").join(found, "node", "left")
                .select("set_key", F.coalesce("component", "node").alias("component_id")))
    result = signed.select("id", "n_shingles", "set_key").join(label_of, "set_key", "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return result.select(F.col("id").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` without the rows that near-duplicate another of a smaller id: of each
    component the row of the smallest id stays, and of whole-row copies one."""
    verdict = materialize(near_duplicates(docs, id_col, text_col, threshold), "verdicts")
    ids = verdict.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.bool_and("kept").alias("_kept")).where("_n > 1 OR NOT _kept")
    marked = docs.join(ids, docs[id_col].cast("long") == ids["_id"], "left")
    once = marked.where("_n IS NULL").select(docs.columns)
    again = marked.where("_n > 1 AND _kept").select(docs.columns).dropDuplicates()
    return once.unionByName(again) if not ids.where("_n > 1").isEmpty() else once


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document's component at a similarity of 0.85."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE doc AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[CAST(i AS BIGINT):CAST(i + 4 AS BIGINT)], ' ')) AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS i FROM doc WHERE len(ws) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT u, v FROM pair JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT l.v, reach.r FROM reach JOIN link l ON l.u = reach.doc_id WHERE reach.r < l.v
), comp AS (
  SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM doc LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
