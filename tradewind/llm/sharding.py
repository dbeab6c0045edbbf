"""Uniform shuffle into shards of exact size (operator 5, native).

Rows are dealt to input buckets by a hash. The communication matrix, how many
rows of each bucket go to each shard, is drawn exactly: row by row from the
multivariate hypergeometric law of dealing all rows at random into shards of
fixed sizes. Each bucket is permuted locally (a seeded random key) and cut by
its matrix row, rows are exchanged, and each shard is permuted again by a
second key. Only the bucket counts (their number is a parameter, not a share of
the data) pass through the driver.

The second permutation never puts a shard into one task: a shard is cut by the
leading bits of its random key into small ranges, whose counts give offsets.

Law `rows`: shard sizes differ by at most one. Defined cases: equal rows are
interchangeable and each takes a slot of its own; a null key column is a value
like any other; an empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read, small_table

SEED = 20240501
#: A bucket is one sort group of narrow rows; the least number keeps small tables spread.
ROWS_PER_BUCKET = 500_000
MIN_BUCKETS = 64


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One draw by inversion, for populations of any size: the probabilities around
    the mode follow from ratios of neighbours; 40 deviations either side hold all
    mass that a double can represent."""
    lo, hi = max(0, draws - bad), min(draws, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (draws + 1) * (good + 1) // (total + 2)))
    sd = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    reach = int(40 * sd) + 64
    a, b = max(lo, mode - reach), min(hi, mode + reach)
    k = np.arange(a, b, dtype=np.float64)  # log p(k + 1) - log p(k)
    step = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logp = np.concatenate([[0.0], np.cumsum(step)])
    cdf = np.cumsum(np.exp(logp - logp.max()))
    return a + int(np.searchsorted(cdf, rng.random() * cdf[-1], side="right"))


def communication_matrix(bucket_rows: list[int], shard_rows: list[int], seed: int) -> list[list[int]]:
    """Rows from each bucket to each shard; row sums and column sums are exact."""
    rng, left, matrix = np.random.default_rng(seed), list(shard_rows), []
    for n in bucket_rows:
        row, draws, pool = [], n, sum(left)
        for room in left:
            pool -= room
            take = hypergeometric(rng, room, pool, draws)
            row.append(take)
            draws -= take
        left = [r - t for r, t in zip(left, row, strict=True)]
        matrix.append(row)
    return matrix


def shuffle_into_shards(df: DataFrame, n_shards: int, keys: list[str], seed: int = SEED,
                        rows_per_bucket: int = ROWS_PER_BUCKET, min_buckets: int = MIN_BUCKETS) -> DataFrame:
    """``df`` with int ``shard`` (0 to n_shards - 1) and long ``slot`` (gapless from 0
    in each shard); columns of these names are replaced. ``keys`` tell rows apart:
    rows equal in all of them may swap places. ``df`` must give the same rows when
    read twice, as a table does."""
    spark = df.sparkSession
    df = df.drop("shard", "slot")
    names = df.columns
    total = df.count()
    n_buckets = max(min_buckets, -(-total // rows_per_bucket))
    key = [F.col(f"r.`{k}`") for k in keys]
    rows = df.select(F.struct(*[df[c] for c in names]).alias("r"))
    rows = rows.withColumn("k1", F.xxhash64(F.lit(seed), *key)).withColumn("k2", F.xxhash64(F.lit(seed + 1), *key))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("k2", F.lit(seed + 2)), F.lit(n_buckets)).cast("int"))

    count_of = {r["bucket"]: r["count"] for r in rows.groupBy("bucket").count().collect()}
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    matrix = communication_matrix([count_of.get(b, 0) for b in range(n_buckets)], sizes, seed)
    ends = small_table(spark, [{"bucket": b, "ends": np.cumsum(m).tolist()} for b, m in enumerate(matrix)],
                       "bucket int, ends array<bigint>")

    first = W.partitionBy("bucket").orderBy("k1", "k2", *key)
    dealt = (rows.withColumn("at", F.row_number().over(first)).join(ends, "bucket")
             .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("at")))).drop("bucket", "ends", "at"))
    bits = max(1, (n_buckets - 1).bit_length())
    dealt = materialize(dealt.withColumn("part", F.shiftrightunsigned("k2", 64 - bits)), "sharding")

    parts = dealt.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = parts.select("shard", "part", (F.sum("n").over(
        W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("offset"))
    second = W.partitionBy("shard", "part").orderBy("k2", "k1", *key)
    return (dealt.withColumn("at", F.row_number().over(second)).join(offsets, ["shard", "part"])
            .select("r.*", "shard", (F.col("offset") + F.col("at") - 1).alias("slot")))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents into shards 0 to 7 by the law `rows`."""
    text = F.coalesce("text", F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shuffle_into_shards(materialize(docs, "sharding-rows"), 8, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
