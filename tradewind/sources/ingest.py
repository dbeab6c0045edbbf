"""Catalogue-driven CSV ingest (the reference's ETL step).

For each catalogue entry (file name -> table name): check the file exists,
read it as text with a header, turn pandas' NA words into null, cast the
columns of known type with ``try_cast`` (bad text -> null, the row is kept; all
other columns stay, as text), drop whole-row duplicates and write the table. A load report row
records status and row count per entry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewind.sources import csv_records

# The reference's file -> table catalogue.
CATALOGUE = {
    "olist_customers_dataset.csv": "customers",
    "olist_geolocation_dataset.csv": "geolocation",
    "olist_order_items_dataset.csv": "order_items",
    "olist_order_payments_dataset.csv": "order_payments",
    "olist_order_reviews_dataset.csv": "order_reviews",
    "olist_orders_dataset.csv": "orders",
    "olist_products_dataset.csv": "products",
    "olist_sellers_dataset.csv": "sellers",
    "product_category_name_translation.csv": "category_translation",
}

# Text that pandas.read_csv reads as missing by default.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
            "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

TS = T.TimestampNTZType()
SCHEMAS: dict[str, T.StructType] = {
    "orders": T.StructType([T.StructField(n, t) for n, t in [
        ("order_id", T.StringType()), ("customer_id", T.StringType()), ("order_status", T.StringType()),
        ("order_purchase_timestamp", TS), ("order_approved_at", TS),
        ("order_delivered_carrier_date", TS), ("order_delivered_customer_date", TS),
        ("order_estimated_delivery_date", TS)]]),
    "order_items": T.StructType([T.StructField(n, t) for n, t in [
        ("order_id", T.StringType()), ("order_item_id", T.IntegerType()), ("product_id", T.StringType()),
        ("seller_id", T.StringType()), ("price", T.DoubleType()), ("freight_value", T.DoubleType())]]),
    "order_payments": T.StructType([T.StructField(n, t) for n, t in [
        ("order_id", T.StringType()), ("payment_sequential", T.IntegerType()),
        ("payment_type", T.StringType()), ("payment_value", T.DoubleType())]]),
    "order_reviews": T.StructType([T.StructField(n, t) for n, t in [
        ("order_id", T.StringType()), ("review_score", T.IntegerType()),
        ("review_creation_date", TS), ("review_answer_timestamp", TS)]]),
    "products": T.StructType([T.StructField(n, t) for n, t in [
        ("product_id", T.StringType()), ("product_category_name", T.StringType()),
        ("product_weight_g", T.DoubleType())]]),
    "category_translation": T.StructType([T.StructField(n, t) for n, t in [
        ("product_category_name", T.StringType()), ("product_category_name_english", T.StringType())]]),
    "customers": T.StructType([T.StructField(n, t) for n, t in [
        ("customer_id", T.StringType()), ("customer_unique_id", T.StringType())]]),
    "sellers": T.StructType([T.StructField("seller_id", T.StringType())]),
    "geolocation": T.StructType([]),
}


def file_exists(spark: SparkSession, path: str) -> bool:
    """Hadoop FileSystem check, so it works for any cluster file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


#: Tables with free text, whose quoted fields may hold line breaks: their records are put
#: together across byte ranges. The others are split at line breaks.
FREE_TEXT = {"order_reviews"}


def read_csv_text(spark: SparkSession, path: str, table: str = "") -> DataFrame:
    if table in FREE_TEXT:
        return csv_records.read_csv(spark, path)
    return spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path)


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the file: those of known type via try_cast after NA words ->
    null, the others as text after NA words -> null. Declared columns that the file
    lacks are filled with typed nulls."""
    declared = {f.name: f.dataType for f in schema.fields}
    cols = []
    for name in df.columns:
        txt = F.when(F.col(f"`{name}`").isin(*NA_WORDS), None).otherwise(F.col(f"`{name}`"))
        kind = declared.get(name, T.StringType())
        cols.append((txt if isinstance(kind, T.StringType) else txt.try_cast(kind)).alias(name))
    cols += [F.lit(None).cast(t).alias(n) for n, t in declared.items() if n not in df.columns]
    return df.select(*cols)


def ingest(spark: SparkSession, data_dir: str, catalogue: dict[str, str] = CATALOGUE,
           dedup: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    tables: dict[str, DataFrame] = {}
    report = []
    for file_name, table in catalogue.items():
        path = f"{data_dir.rstrip('/')}/{file_name}"
        if not file_exists(spark, path):
            report.append((table, file_name, "missing", None))
            continue
        df = coerce(read_csv_text(spark, path, table), SCHEMAS.get(table, T.StructType([])))
        if dedup:
            df = df.dropDuplicates()
        tables[table] = df
        report.append((table, file_name, "loaded", None))
    rep = spark.createDataFrame(report, "table string, file string, status string, rows long")
    return tables, rep


def with_row_counts(spark: SparkSession, tables: dict[str, DataFrame], report: DataFrame) -> DataFrame:
    """Fill the report's row counts: one count job per loaded table, unioned."""
    counts = None
    for name, df in tables.items():
        c = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        counts = c if counts is None else counts.unionByName(c)
    if counts is None:
        return report
    return (report.drop("rows").join(counts, "table", "left")
                  .select("table", "file", "status", "rows"))


def load(spark: SparkSession, data_dir: str, out_dir: str, catalogue: dict[str, str] = CATALOGUE) -> DataFrame:
    """The whole ETL: every file of the catalogue coerced, de-duplicated and written as
    the table it names (full replace); the report has the rows of each written table."""
    tables, report = ingest(spark, data_dir, catalogue)
    written = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{out_dir}/{name}")
        written[name] = spark.read.parquet(f"{out_dir}/{name}")
    return with_row_counts(spark, written, report)


def write_extracts(spark: SparkSession, frames: dict[str, DataFrame], out_dir: str,
                   catalogue: dict[str, str] = CATALOGUE) -> None:
    """Write business tables as header CSV files named like the catalogue."""
    by_table = {t: f for f, t in catalogue.items()}
    for table, df in frames.items():
        (df.write.mode("overwrite").option("header", True)
           .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{out_dir}/{by_table[table]}"))
