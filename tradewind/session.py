"""Spark session and job-wide settings.

Everything the library runs is a DataFrame / SQL / Structured Streaming job;
this module only sets the knobs that matter at scale (AQE, skew handling,
shuffle width, file split size) and resolves the shared checkpoint folder.
"""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Knobs that every job in the library relies on.
_SCALE_CONF = {
    # Runtime re-planning: coalesce small shuffle partitions, split skewed
    # join partitions, turn a join into a broadcast only when the measured
    # side is below spark.sql.autoBroadcastJoinThreshold.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Texts can be long: small batches bound what a Python worker holds at once.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 * 1024 * 1024),
    # 128 MiB splits keep scan tasks in memory at any scale factor.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
}


def build_session(master: str | None = None, app: str = "tradewind",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Create (or reuse) a session with the library's settings.

    On a cluster ``master`` is left to spark-submit; tests pass ``local[*]``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def apply_conf(spark: SparkSession) -> SparkSession:
    """Apply the runtime-settable knobs to an existing session. A knob that the
    caller has set, in the session or at submit time, keeps the caller's value."""
    for k, v in _SCALE_CONF.items():
        if k != "spark.ui.enabled" and spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``tradewind`` importable in Python workers (what ``--py-files``
    does): zip the package once per SparkContext and ``addPyFile`` it.
    Needed where workers unpickle library classes by reference (the
    stateful cooldown processor)."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    ckpt = ensure_checkpoint_dir(spark)
    local = ckpt.startswith("/") or ckpt.startswith("file:")
    base = ckpt.replace("file:", "", 1) if local else tempfile.gettempdir()
    out_dir = os.path.join(base, "tradewind", "pyfiles", uuid.uuid4().hex)
    os.makedirs(out_dir, exist_ok=True)
    path = os.path.join(out_dir, "tradewind.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.join("tradewind", os.path.relpath(full, pkg)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


_LOCAL_DIRS: dict[str, str] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting always wins. Only in local mode, where driver and
    executors are one process, an unset value means a scratch folder of our
    own (one per application); on a cluster an unset value is an error.
    """
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if current:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if sc.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="tradewind-ckpt-")
        sc.setCheckpointDir(_LOCAL_DIRS[sc.applicationId])
    return _LOCAL_DIRS[sc.applicationId]


DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_DROPPING: dict[str, list] = {}  # of each session: how many callers are inside, and what the first of them found
_DROP_LOCK = threading.Lock()


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Inside, the shuffle files of a query go when it ends, not when the driver happens to
    collect its garbage. For the library's own writes and counts, whose plans run once."""
    own = spark._jsparkSession.sessionUUID()
    with _DROP_LOCK:
        _DROPPING.setdefault(own, [0, spark.conf.get(DROP_SHUFFLES)])[0] += 1
        spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        with _DROP_LOCK:
            _DROPPING[own][0] -= 1
            if not _DROPPING[own][0]:
                spark.conf.set(DROP_SHUFFLES, _DROPPING.pop(own)[1])


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder: compressed, each later pass reads its own columns
    only, and a lost executor takes nothing of it along."""
    path = scratch_dir(df.sparkSession, f"tables/{uuid.uuid4().hex}")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint location for written tables."""
    base = ensure_checkpoint_dir(spark)
    path = os.path.join(base, "tradewind", name)
    return path
