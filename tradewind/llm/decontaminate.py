"""Benchmark decontamination by a broadcast hash set of n-grams (operator 7, native).

Words: A-Z lower-cased, then runs of characters outside ASCII control,
punctuation and upper case. A window is 13 consecutive words of a benchmark
item; an item of fewer words, but not none, is one window.

1. Every window of every document is hashed (64 bits, JVM-side) and looked up in
   the set of benchmark window hashes. The set is broadcast behind a check of
   its measured size; beyond the bound Spark joins by shuffle.
2. Only texts with a lookup hit are read again, once per distinct text; there
   the window's words themselves are compared, with the distinct windows only.
   Which items hold a window stands in rows of one item each, joined by shuffle.
3. Every document gets the counts of its text; copies share them.

Defined cases: a null or wordless text has no words and no hits; repeated
documents each get a row; a null item_id takes no part and repeated item_ids
are one item; equal windows of many items count for each of them; an empty
table gives no row (or no hits); other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import ascii_lower, materialize, read

N = 13
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in text that is not lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Most distinct window hashes (8 bytes each, about 40 as rows) to broadcast.
BROADCAST_HASHES = 1_000_000
#: Most bytes of the words of all distinct windows to broadcast.
BROADCAST_BYTES = 128_000_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def windows_of(ws: Column, lengths: list[int], make) -> Column:
    """Array of ``make(words, start, length)`` over all windows of the lengths. ``ws``
    is bound as a lambda variable, so that it is computed once for a text."""

    def one(w: Column, n: int) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(
            F.array().cast("array<int>"))
        return F.transform(starts, lambda i: make(w, i, n))

    return F.element_at(F.transform(F.array(ws), lambda w: F.concat(*[one(w, n) for n in lengths])), 1)


def benchmark_windows(items: DataFrame, n: int = N) -> DataFrame:
    """words, item_id: the windows, one row for each item that holds one."""
    it = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("ws"))
    # Past the last full window slices come out shorter, so only a short item has its one.
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - n + 1))
    return it.where(F.size("ws") > 0).select(
        "item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i, n))).alias("words")).distinct()


def find_hits(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = N) -> DataFrame:
    """One row for each distinct text with hits: text_key (MD5 of the text), hit_words
    (sorted word numbers from 0), item_ids (sorted)."""
    held = materialize(benchmark_windows(items, n), "benchmark-items")
    bench = materialize(held.select("words").distinct().withColumn("h", F.xxhash64("words"))
                        .withColumn("window", F.monotonically_increasing_id()), "benchmark-windows")
    members = held.join(bench, "words").select("window", "item_id")
    hashes = bench.select("h").distinct()
    lengths = sorted(r[0] for r in bench.select(F.size("words")).distinct().collect()) or [n]
    n_bytes = bench.agg(F.sum(F.octet_length(F.array_join("words", " ")).cast("long"))).first()[0] or 0
    small = hashes.count() <= BROADCAST_HASHES
    bounded = F.broadcast if small else (lambda df: df)
    bounded_words = F.broadcast if small and n_bytes <= BROADCAST_BYTES else (lambda df: df)

    text = docs.where(F.col(text_col).isNotNull()).select(
        F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_key"), F.col(text_col).alias("text"))
    hashed = windows_of(words(F.col("text")), lengths, lambda w, i, k: F.xxhash64(F.slice(w, i, k)))
    keys = (text.select("text_key", F.explode(hashed).alias("h"))
            .join(bounded(hashes), "h", "left_semi").select("text_key").distinct())
    keys = materialize(keys, "contaminated-texts")

    found = text.join(keys, "text_key", "left_semi").groupBy("text_key").agg(F.first("text").alias("text"))
    spans = windows_of(words(F.col("text")), lengths, lambda w, i, k: F.struct(
        i.alias("start"), F.slice(w, i, k).alias("words")))
    spans = found.select("text_key", F.explode(spans).alias("s")).select(
        "text_key", "s.start", "s.words", F.xxhash64("s.words").alias("h"))
    hits = materialize(spans.join(bounded_words(bench), ["h", "words"]).select(
        "text_key", "window", "start", F.size("words").alias("n")), "hits")
    hit_words = (hits.select("text_key", F.explode(F.sequence(F.col("start") - 1, F.col("start") + F.col("n") - 2)).alias("word"))
                 .groupBy("text_key").agg(F.sort_array(F.collect_set("word")).alias("hit_words")))
    hit_items = (hits.select("text_key", "window").distinct().join(members, "window").select("text_key", "item_id").distinct()
                 .groupBy("text_key").agg(F.sort_array(F.collect_list("item_id")).alias("item_ids")))
    return hit_words.join(hit_items, "text_key")


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", n: int = N, remove: str = "none") -> DataFrame:
    """Every document with n_words, n_hit, item_ids and contaminated (some word is hit,
    and 20 times the hit words make up the words). Columns of these names are replaced.

    ``remove``: "none"; "documents" drops the contaminated ones; "spans" cuts the
    hit words out of the text of those, the characters between words stay.
    """
    docs = docs.drop("n_words", "n_hit", "item_ids", "contaminated")
    hits = materialize(find_hits(docs, items, text_col, n), "contamination")
    t = docs[text_col]
    keep = docs.withColumn("_key", F.unhex(F.md5(t.cast("binary")))).withColumn(
        "n_words", F.coalesce(F.regexp_count(t, F.lit(RAW_WORD)), F.lit(0)).cast("long"))
    out = (keep.join(hits.withColumnRenamed("text_key", "_key"), "_key", "left").drop("_key")
           .withColumn("n_hit", F.coalesce(F.size("hit_words"), F.lit(0)).cast("long"))
           .withColumn("item_ids", F.coalesce("item_ids", F.array().cast("array<string>")))
           .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))))
    if remove == "documents":
        out = out.where(~F.col("contaminated"))
    elif remove == "spans":
        t = F.col(text_col)
        gaps, parts = F.split(t, RAW_WORD), F.regexp_extract_all(t, F.lit(RAW_WORD), F.lit(0))
        kept = F.element_at(F.transform(F.array(F.struct(gaps.alias("g"), parts.alias("p"), F.map_from_arrays(
            "hit_words", F.transform("hit_words", lambda _: F.lit(True))).alias("hit"))), lambda x: F.array_join(
                F.transform(x["g"], lambda gap, i: F.concat(gap, F.when(
                    x["hit"][i].isNull(), F.coalesce(F.get(x["p"], i), F.lit(""))).otherwise(F.lit("")))), "")), 1)
        out = out.withColumn(text_col, F.when(F.col("contaminated"), kept).otherwise(t))
    return out.drop("hit_words")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the counts of every document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = decontaminate(docs, read(spark, sf_dir, "benchmark").select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


_SQL_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_SQL_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, ws[CAST(i AS BIGINT):CAST(i + {N - 1} AS BIGINT)] AS w
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - {N - 1}) + 1)) AS i FROM item WHERE len(ws) > 0)
), lens AS (
  SELECT DISTINCT len(w) AS n FROM win
), doc AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce({_SQL_WORDS}, []) AS ws FROM documents
), span AS (
  SELECT rid, n, i, ws[CAST(i AS BIGINT):CAST(i + n - 1 AS BIGINT)] AS w
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM doc, lens WHERE len(ws) >= n)
), hit AS (
  SELECT rid, i, n, item_id FROM span JOIN win USING (w)
), hw AS (
  SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) GROUP BY rid
), hi AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id FROM hit) GROUP BY rid
)
SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM doc LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""
