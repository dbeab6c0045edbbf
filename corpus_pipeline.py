"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept. All but the last return the columns of ``documents``; ``run`` writes every
stage's result as Parquet to the folder that driver and executors share and
reads it again for the next.

Defined cases. ``docs`` needs the columns doc_id and text; where it has n_chars,
that follows a text which a stage changes. All other columns, whatever their
names, stay as they are: a row travels through a stage as one value. The last
stage adds n_tokens, ids and round_trip; columns of these names are replaced.

- A null or empty text: judged by the classifier like any text without passages;
  near-duplicate of nothing; not contaminated; without secrets; no tokens.
- A very long text is taken as a whole by every stage.
- Repeated rows: near-dedup keeps one; rows without an id are all kept, as no
  smaller id is known. Of documents that share an id and are kept, whole-row copies
  are dropped. Ties go to the smaller id.
- Empty tables: without documents nothing comes out; without labels the classifier
  keeps or drops all alike; without a benchmark nothing is contaminated.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from tradewind.llm import bpe, decontaminate, near_dedup, quality, secrets
from tradewind.llm.common import materialize, read
from tradewind.session import apply_conf

#: SQL cannot express a fitted classifier; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def _stage(fn):
    """A stage may be called by itself: it first sets what the session leaves unset, above
    all the bound on rows of an Arrow batch, which bounds a Python worker's memory."""
    @functools.wraps(fn)
    def staged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return fn(apply_conf(spark), docs, sf_dir)
    return staged


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the whole row as one value beside them: no operator's own
    columns meet the caller's."""
    return docs.select("doc_id", "text", F.struct(*[docs[c] for c in docs.columns]).alias("row"))


@_stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the quality classifier rejects go."""
    model = quality.train(docs, read(spark, sf_dir, "labels").select("doc_id", "quality"))
    return quality.score_quality(_carried(docs), model).where("predicted = 1").select("row.*")


@_stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each group of near duplicates the document of the smallest id stays."""
    return near_dedup.keep_one(_carried(docs)).select("row.*")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents contaminated by the benchmark go."""
    items = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return decontaminate.decontaminate(_carried(docs), items, remove="documents").select("row.*")


@_stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: every secret is replaced by its kind; n_chars follows the text."""
    found = secrets.redact(_carried(docs), out="found")
    row = F.col("row").withField("text", F.col("text"))
    if "n_chars" in docs.columns:
        counted = F.length("text").cast(docs.schema["n_chars"].dataType)
        row = row.withField("n_chars", F.when(F.size("found") > 0, counted).otherwise(F.col("row.n_chars")))
    return found.select(row.alias("row")).select("row.*")


@_stage
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: token ids, their number, and whether they decode to the text again."""
    out = bpe.round_trip(_carried(docs), public_tokenizers.path(bpe.VOCABULARY), cached=CACHED_PIECES)
    same = F.col("decoded") == F.coalesce(F.col("text"), F.lit("")).cast("binary")
    new = {"n_tokens": F.size("ids").cast("long"), "ids": F.col("ids"), "round_trip": same}
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in new], *[v.alias(k) for k, v in new.items()])


#: What a worker of the last stage remembers. Python workers live on from stage to
#: stage, so less than where the operator has them to itself.
CACHED_PIECES = 15_000

STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("byte-level BPE", tokenize),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
