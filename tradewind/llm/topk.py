"""Exact top-k inner products by columnar branch and bound (operator 2).

Vectors are packed into blocks in vertical layout (all values of one dimension
lie together). A block of queries meets a block of candidates: scores are
accumulated dimension block by dimension block, the heaviest dimensions first.
After each, the Cauchy-Schwarz bound of the dimensions that remain (the mass
left in query and candidate) gives every candidate a least and a greatest
possible score; candidates whose greatest lies below the k-th best least score
are dropped and the survivors compacted. Each pair of blocks gives at most k
rows a query, of which a ranked window keeps the best.

Work is dealt by (candidate group, query group): both sides are copied to the
pairs of groups they take part in, so that a task holds a bounded number of
vectors however many there are.

Defined cases: a vector that is null or holds a null or non-finite component
takes no part, nor does a row whose id is null; rows are told apart by id, of
rows that share one the smallest vector counts; vectors of unequal length do
not meet; ties go to the smaller id; fewer candidates than k give fewer rows; an
empty table gives none. Scores are exact integers and saturate at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read

BLOCK_ROWS = 8192
#: Blocks of candidates, and of queries, that one task holds at most (on average).
CANDIDATE_BLOCKS, QUERY_BLOCKS = 4, 4
DIMS = 16
QUERY_CHUNK = 64
BLOCK = "dim int, ids binary, columns binary, width int"


def _pack(batches):
    """(vec_id, v array<bigint>) rows -> vertical blocks, one dimension count each."""
    waiting: dict[int, list] = {}

    def block(dim: int):
        rows = waiting.pop(dim)
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        m = np.array([r[1] for r in rows], dtype=np.int64).reshape(len(rows), dim)
        top = int(max(-int(m.min()), int(m.max()))) if m.size else 0
        width = 2 if top < 2**15 else 4 if top < 2**31 else 8
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()),
            "columns": pa.array([np.ascontiguousarray(m.T.astype(f"i{width}")).tobytes()], pa.binary()),
            "width": pa.array([width], pa.int32())})

    for batch in batches:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(len(v), []).append((i, v))
            if len(waiting[len(v)]) == BLOCK_ROWS:
                yield block(len(v))
    for dim in list(waiting):
        yield block(dim)


def _unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], dtype=np.int64)
    return ids, np.frombuffer(row["columns"], dtype=f"i{row['width']}").reshape(row["dim"], len(ids))


def search(q_ids, q_cols, c_ids, c_cols, k: int):
    """(query ids, candidate ids, scores) of the k best candidates of each query, its own id left out."""
    top = [max((-int(m.min()), int(m.max()))) if m.size else 0 for m in (q_cols, c_cols)]
    if top[0] * top[1] * max(1, len(q_cols)) >= 2**53:  # beyond exact doubles: whole integers, no bounds
        found = [_best(q_ids[j], c_ids, c_cols.T.astype(object) @ q_cols[:, j].astype(object), k)
                 for j in range(len(q_ids))]
    else:
        found = _bounded(q_ids, q_cols.astype(np.float64), c_ids, c_cols.astype(np.float64), k)
    return [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3


def _best(query, ids, scores, k: int):
    keep = np.flatnonzero(ids != query)
    ids, scores = ids[keep], scores[keep]
    if scores.dtype == object:  # ranked as they are, then saturated
        order = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], dtype=np.int64)
        scores = np.clip(scores[order], -2**63, 2**63 - 1).astype(np.int64)
    else:
        order = np.lexsort((ids, -scores))[:k]
        scores = scores[order].astype(np.int64)
    return np.full(len(order), query), ids[order], scores


def _bounded(q_ids, q, c_ids, c, k: int):
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")
    q, c = q[order], c[order]
    edges = list(range(0, max(1, len(c)), DIMS)) + [len(c)]
    rest = lambda m: [np.sqrt((m[e:] ** 2).sum(axis=0)) * (1 + 1e-9) for e in edges]
    q_rest, c_rest = rest(q), rest(c)
    found = []
    for at in range(0, len(q_ids), QUERY_CHUNK):
        first = q[:edges[1], at:at + QUERY_CHUNK].T @ c[:edges[1]]
        for j, partial in enumerate(first, start=at):
            alive = np.flatnonzero(c_ids != q_ids[j])
            partial = partial[alive]
            for b in range(1, len(edges)):
                if b > 1:
                    partial = partial + q[edges[b - 1]:edges[b], j] @ c[edges[b - 1]:edges[b], alive]
                if len(alive) > k:
                    slack = q_rest[b][j] * c_rest[b][alive] + (b + 1 < len(edges)) * 1e-6
                    least = np.partition(partial - slack, len(alive) - k)[len(alive) - k]
                    keep = np.flatnonzero(partial + slack >= least)
                    alive, partial = alive[keep], partial[keep]
            found.append(_best(q_ids[j], c_ids[alive], np.rint(partial), k))
    return found


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Both (vec_id long, v array<bigint>), ids unique, no nulls inside -> query_id, rank, vec_id, score."""
    def blocks(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // BLOCK_ROWS))
        packed = materialize(df.select("vec_id", "v").repartition(n, "vec_id").mapInArrow(_pack, BLOCK), name)
        return packed.withColumn("key", F.xxhash64("ids", "dim")), packed.count()

    (c, n_c), (q, n_q) = blocks(vectors, "candidate-blocks"), blocks(queries, "query-blocks")
    c_groups, q_groups = -(-n_c // CANDIDATE_BLOCKS) or 1, -(-n_q // QUERY_BLOCKS) or 1

    def dealt(df, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
        return (df.withColumn(own, F.pmod("key", F.lit(n_own)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1)))))

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for a in left.to_pylist():
            for b in right.to_pylist():
                if a["dim"] == b["dim"]:
                    out.append(search(*_unpack(a), *_unpack(b), k))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    found = (dealt(q, "qg", q_groups, "cg", c_groups).groupBy("qg", "cg")
             .cogroup(dealt(c, "cg", c_groups, "qg", q_groups).groupBy("qg", "cg"))
             .applyInArrow(pair, "query_id long, vec_id long, score long"))
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def scaled(df: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, embedding) -> the vectors that take part, components floor(scale * x)."""
    fine = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (
        F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return (df.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
            .groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(v).alias("v")))


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the 5 best of all rows for every row whose id is divisible by 50."""
    vectors = materialize(scaled(read(spark, sf_dir, "embeddings").select("vec_id", "embedding")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0), 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, min(v) AS v FROM (
    SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)
  GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""
