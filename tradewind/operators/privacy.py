"""Masking, anonymisation, outreach queue, weekly seller rollup, retrieval.

These are the table jobs behind the reference's placeholder agents
(privacy masking, win-back messages, weekly seller coaching, retrieval for
the advisor). Text generation itself is an external service and not built.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.functions.money import money_sum
from tradewind.functions.text import mask_email, mask_name
from tradewind.sources.business import Biz

VOUCHER_CODE = "COMEBACK20"  # the reference's default voucher

# Message template per churn rule (our wording); {name} is the masked name.
OUTREACH_TEMPLATES = {
    "rule1_vip": "Hi {name}, enjoy 3 months of free shipping on us.",
    "rule2_comeback": "Hi {name}, we miss you! Use code {voucher} on your next order.",
    "rule3_survey": "Hi {name}, tell us how we can do better in a 1-minute survey.",
    "rule4_missyou": "Hi {name}, it has been a while. Here is what is new for you.",
    "rule5_refund": "Hi {name}, we are sorry about your last order. A refund is on its way.",
    "rule6_suggest": "Hi {name}, new picks in your favourite category are waiting.",
    "rule7_review": "Hi {name}, how was your delivery? Leave a quick review.",
}


def masked_documents(docs: DataFrame) -> DataFrame:
    """Every e-mail address in every whole text masked."""
    return docs.select("doc_id", mask_email(F.col("text")).alias("masked_text"))


def masked_names(customers: DataFrame) -> DataFrame:
    return customers.select("customer_id", mask_name(F.col("customer_name")).alias("masked_name"))


def hmac_sha256(key: bytes, message: F.Column) -> F.Column:
    """HMAC-SHA-256 in hex, by two hashes: without the key nobody can try ids."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in block))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def anonymized_customers(customers: DataFrame, key: bytes) -> DataFrame:
    """Keyed pseudonym (HMAC) plus masked name; raw id and name dropped. The ``key`` is the
    caller's secret."""
    return customers.select(hmac_sha256(key, F.col("customer_id")).alias("anon_id"),
                            mask_name(F.col("customer_name")).alias("masked_name"))


def outreach_queue(hits: DataFrame, customers: DataFrame) -> DataFrame:
    """Rule hits joined to masked customers, one message per (customer, rule)."""
    names = masked_names(customers)
    msg = None
    for code, tpl in OUTREACH_TEMPLATES.items():
        pre, _, post = tpl.replace("{voucher}", VOUCHER_CODE).partition("{name}")
        text = F.concat(F.lit(pre), F.col("masked_name"), F.lit(post))
        msg = F.when(F.col("rule") == code, text) if msg is None else msg.when(F.col("rule") == code, text)
    return (hits.join(names, "customer_id")
                .select("customer_id", "rule", F.lit("email").alias("channel"), msg.alias("message")))


def seller_weekly(b: Biz) -> DataFrame:
    """Per seller and week: orders, revenue, cancel rate, change vs the
    seller's previous active week (window partitioned by seller over weekly
    rows, so a seller's window holds one row per week)."""
    from tradewind.operators.features import seller_order_facts
    f = seller_order_facts(b)
    canceled = F.when(F.col("order_status") == "canceled", 1).otherwise(0)
    wk = f.groupBy("seller_id", "week").agg(
        F.count("order_id").alias("orders"),
        F.sum("price_sum").cast("double").alias("revenue"),
        F.try_divide(F.sum(canceled * F.col("lines")).cast("double"), F.sum("lines")).alias("cancel_rate"))
    w = Window.partitionBy("seller_id").orderBy("week")
    prev = F.lag("revenue").over(w)
    return wk.select("seller_id", "week", "orders", "revenue", "cancel_rate",
                     (F.col("orders") - F.lag("orders").over(w)).alias("orders_change"),
                     (F.try_divide(F.col("revenue") - prev, prev) * F.lit(100.0)).alias("revenue_change_pct"))


# ---------------------------------------------------------------- retrieval

QUERY_BATCH = 256  # query vectors inlined per scoring pass


def dot(a: F.Column, b: F.Column) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
                       F.lit(0.0), lambda acc, v: acc + v)


def length(a: F.Column) -> F.Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")),
                              F.lit(0.0), lambda acc, v: acc + v))


def cosine(a: F.Column, b: F.Column) -> F.Column:
    return F.try_divide(dot(a, b), length(a) * length(b))


def label_centroids(vectors: DataFrame) -> DataFrame:
    """Mean vector per label, computed per (label, dimension) in parallel."""
    ex = vectors.select("label", F.posexplode("embedding").alias("i", "v"))
    g = ex.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return (g.groupBy("label")
             .agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("c"))
             .select(F.col("label").alias("query_label"), F.col("c.m").alias("centroid")))


def retrieve_topk(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k stored vectors by cosine similarity for each query vector.

    Query vectors are inlined as literals, QUERY_BATCH per pass, so scoring
    is a narrow projection over the stored vectors (no join); larger query
    sets take several passes (exact search costs Q x N either way). Per
    query, a window top-k (planned as WindowGroupLimit) keeps only k rows
    per task before the shuffle.
    """
    qs = [(r["query_label"], [float(x) for x in r["centroid"]]) for r in queries.collect()]
    scored = None
    for i in range(0, len(qs), QUERY_BATCH):  # exact search is Q x N work; batches bound the plan
        part = vectors.select("vec_id", F.explode(F.array(*[
            F.struct(F.lit(lbl).alias("query_label"),
                     cosine(F.col("embedding"), F.array(*[F.lit(x) for x in vec])).alias("score"))
            for lbl, vec in qs[i:i + QUERY_BATCH]])).alias("s")).select("vec_id", "s.query_label", "s.score")
        scored = part if scored is None else scored.unionByName(part)
    w = Window.partitionBy("query_label").orderBy(F.col("score").desc(), F.col("vec_id").asc())
    return (scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
                  .select("query_label", "rank", "vec_id", F.round("score", 6).alias("score")))
