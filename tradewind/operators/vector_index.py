"""Stored cells for nearest vectors by cosine similarity.

Build: centres are fitted on a bounded, documented sample of the vectors (scaled
to length 1); every vector is stored in the cell of its nearest centre, with its
length and its residual (distance to the centre). The table is partitioned by
cell, so a search reads the files of the cells that it probes and no others.

Search: cells are ranked by the similarity of their centres to the query. With
``probes`` given, each query looks into so many first cells. With
``probes`` None the result is exact: the first cells give a k-th best distance
for each query, and every further cell is read whose nearest possible vector
(distance to the centre less the cell's largest residual) is not beyond it; in a
cell, a vector whose residual alone puts it beyond is left out before its
similarity is worked out. Scores are those of the plain scan, to the last digit.

A zero vector, or one that is null or has null or non-finite components, has no
direction and is not found.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.operators.privacy import dot, length
from tradewind.session import scratch_dir

#: Vectors that the centres are fitted on, at most; the number of cells; passes of the fit.
SAMPLE, CELLS, PASSES = 20_000, 256, 15
#: Room for rounding in the distance bounds.
SLACK = 1e-9


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def fit_centres(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of the unit vectors in ``sample`` (a bounded number)."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(PASSES):
        nearest = (sample @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
        for j in range(len(centres)):
            mine = sample[nearest == j]
            if len(mine):
                centres[j] = mine.mean(axis=0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 0))


def _with(schema: T.StructType, **more: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, t) for n, t in more.items())])


def _finite(col: str) -> F.Column:
    ok = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(F.col(col).isNotNull() & ok & (length(F.col(col)) > 0), F.lit(False))


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    centres: np.ndarray
    rows: dict[int, int]  # vectors of each cell
    radius: dict[int, float]  # largest residual of each cell

    @staticmethod
    def build(vectors: DataFrame, path: str | None = None, cells: int = CELLS, sample: int = SAMPLE, seed: int = 42,
              id_col: str = "vec_id", vector_col: str = "embedding") -> VectorIndex:
        """Index every row of ``vectors``."""
        spark = vectors.sparkSession
        path = path or scratch_dir(spark, f"vector-index/{uuid.uuid4().hex}")
        v = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding")).where(_finite("embedding"))
        dims = v.select(F.size("embedding").alias("n")).groupBy("n").count().orderBy(F.desc("count"), "n").first()
        if dims is None:
            spark.createDataFrame([], "vec_id bigint, embedding array<float>, length double, residual double, cell int").write.mode("overwrite").parquet(f"{path}/cells")
            return VectorIndex(spark, path, np.empty((0, 0)), {}, {})
        total = v.count()
        v = v.where(F.size("embedding") == dims["n"])
        drawn = v.where(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(max(1, total))) < sample).limit(2 * sample).select("embedding").collect()
        drawn = drawn or v.limit(1).collect()
        centres = fit_centres(_unit(np.array([r["embedding"] for r in drawn], np.float64)), cells, seed)
        shared = spark.sparkContext.broadcast(centres)  # of a size set by parameters

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column("embedding").to_pylist(), np.float64)
                cell, residual = np.empty(len(x), np.int32), np.empty(len(x))
                for a in range(0, len(x), 256):
                    d = distances(_unit(x[a:a + 256]), shared.value)
                    cell[a:a + 256], residual[a:a + 256] = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(residual), pa.array(cell)], names=[*batch.schema.names, "residual", "cell"])

        kept = v.withColumn("length", length(F.col("embedding")))
        schema = _with(kept.schema, residual=T.DoubleType(), cell=T.IntegerType())
        # A file or a few for each cell, of a bounded number of rows: a large cell is spread over tasks.
        (kept.mapInArrow(assign, schema).repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, total // (len(centres) * 500_000) + 1))))
         .write.mode("overwrite").partitionBy("cell").parquet(f"{path}/cells"))
        stats = spark.read.parquet(f"{path}/cells").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("residual").alias("r")).collect()
        index = VectorIndex(spark, path, centres, {r["cell"]: r["n"] for r in stats}, {r["cell"]: r["r"] for r in stats})
        meta = {"centres": centres.tolist(), "rows": index.rows, "radius": index.radius}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
        return index

    @staticmethod
    def load(spark: SparkSession, path: str) -> VectorIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return VectorIndex(spark, path, np.array(meta["centres"]), {int(k): n for k, n in meta["rows"].items()},
                           {int(k): r for k, r in meta["radius"].items()})

    def table(self, cells: set[int]) -> DataFrame:
        """The stored vectors of ``cells``: a filter on the partition column, so only their files are read."""
        return self.spark.read.parquet(f"{self.path}/cells").where(F.col("cell").isin(sorted(cells)))

    def _ranked(self, queries: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """query, q (its vector), order, cell, at (distance to the centre), least (nearest possible distance)."""
        ids, centres = sorted(self.rows), self.centres
        held = self.spark.sparkContext.broadcast((ids, centres[ids], [self.radius[c] for c in ids]))
        q = queries.select(F.col(id_col).alias("query"), F.col(vector_col).cast("array<double>").alias("q")).where(_finite("q")).where(F.size("q") == centres.shape[1])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, points, radius = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = _unit(np.array(batch.column("q").to_pylist()))
                d, norms = distances(q, points), np.sqrt((points * points).sum(axis=1))
                order = (-(q @ points.T) / np.where(norms > 0, norms, 1)).argsort(axis=1, kind="stable")
                n = len(cells)
                take = np.repeat(np.arange(batch.num_rows), n)
                place = order.reshape(-1)
                at = d[take, place]
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(pa.array(take)) for c in batch.columns), pa.array(np.tile(np.arange(n, dtype=np.int32), batch.num_rows)),
                     pa.array(np.array(cells, np.int32)[place]), pa.array(at), pa.array(at - np.array(radius)[place])],
                    names=[*batch.schema.names, "order", "cell", "at", "least"])

        return q.mapInArrow(run, _with(q.schema, order=T.IntegerType(), cell=T.IntegerType(), at=T.DoubleType(), least=T.DoubleType()))

    def _best(self, wanted: DataFrame, k: int, bound: F.Column | None = None) -> tuple[DataFrame, set[int]]:
        cells = {r["cell"] for r in wanted.select("cell").distinct().collect()}  # at most CELLS numbers
        met = self.table(cells).join(wanted, "cell")
        if bound is not None:
            met = met.where(bound)
        score = F.try_divide(dot(F.col("embedding"), F.col("q")), F.col("length") * length(F.col("q")))
        w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc())
        found = met.select("query", "vec_id", score.alias("score"))
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), cells

    def search(self, queries: DataFrame, k: int, probes: int | None = None, first: int = 8,
               id_col: str = "query", vector_col: str = "vector") -> tuple[DataFrame, set[int]]:
        """(query, rank, vec_id, score) and the cells read. ``probes`` None: exact."""
        if not self.rows:
            return self.spark.createDataFrame([], "query string, rank int, vec_id bigint, score double"), set()
        path = scratch_dir(self.spark, f"vector-index/{uuid.uuid4().hex}")
        self._ranked(queries, id_col, vector_col).write.parquet(path)
        ranked = self.spark.read.parquet(path)
        found, cells = self._best(ranked.where(F.col("order") < (probes or first)), k)
        if probes is None:
            found.write.parquet(f"{path}-first")
            found = self.spark.read.parquet(f"{path}-first")
            # Of unit vectors, distance^2 = 2 - 2 * similarity. Fewer than k found: no bound yet.
            reach = found.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.sqrt(F.greatest(2 - 2 * F.min("score"), F.lit(0.0)))).alias("reach"))
            rest = ranked.where(F.col("order") >= first).join(reach, "query", "left")
            rest = rest.where(F.coalesce(F.col("least") <= F.col("reach") + SLACK, F.lit(True)))
            near = F.coalesce(F.abs(F.col("at") - F.col("residual")) <= F.col("reach") + SLACK, F.lit(True))
            more, further = self._best(rest, k, near)
            cells |= further
            w = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc())
            found = (found.select("query", "vec_id", "score").unionByName(more.select("query", "vec_id", "score"))
                     .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        return found.select("query", "rank", "vec_id", "score"), cells

    def share_read(self, cells: set[int]) -> float:
        """The part of all stored vectors that lies in ``cells``."""
        return sum(self.rows[c] for c in cells) / max(1, sum(self.rows.values()))
