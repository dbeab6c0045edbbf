"""The bounded alert feed as a log of numbered segments.

A push writes one segment (a folder of Parquet files) and then one small
manifest file with the range of ``seq`` it holds; the segment counts from the
moment its manifest file is there. Nothing that was written before is copied or
read. Pushes are numbered upwards, and one that has been done is never done again,
so a retry changes nothing. An existing table can be taken up as a segment without being copied.

Reading the newest n rows opens only the segments that can hold one of them:
walking the segments from the highest ``least`` down until n rows are sure gives
a number below which no newest row can lie. Trimming drops the manifest files of
all other segments, so the log holds at most n segments after it, and then the
folders that this log wrote. Rows without a number are older than all others.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

OLDEST = -(1 << 63)


@dataclass(frozen=True)
class Segment:
    number: int
    path: str
    own: bool  # written by the log, so deleted with its entry
    rows: int
    least: int
    most: int


class FeedLog:
    """A log at ``path`` whose rows have the columns of ``schema`` (DDL), ordered by ``seq``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, order_col: str = "seq"):
        self.spark, self.path, self.order_col = spark, path.rstrip("/"), order_col
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # ---------------------------------------------------------------- files

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _entry(self, number: int) -> str:
        return f"{self.path}/manifest/{number:018d}.json"

    def segments(self) -> list[Segment]:
        """The manifest, read anew: at most a few entries beyond the rows kept."""
        fs, p = self._fs(f"{self.path}/manifest")
        if not fs.exists(p):
            return []
        if not any(s.getPath().getName().endswith(".json") for s in fs.listStatus(p)):
            return []
        entries = self.spark.read.text(f"{self.path}/manifest/*.json", wholetext=True).collect()
        return sorted((Segment(**json.loads(r.value)) for r in entries), key=lambda s: s.number)

    def _commit(self, segment: Segment) -> None:
        """The manifest file appears whole or not at all: written aside, then renamed."""
        fs, target = self._fs(self._entry(segment.number))
        _, aside = self._fs(f"{self.path}/manifest/.{segment.number:018d}.tmp")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(asdict(segment)).encode()))
        out.close()
        if not fs.rename(aside, target) and not fs.exists(target):
            raise OSError(f"cannot write {self._entry(segment.number)}")

    # ---------------------------------------------------------------- writing

    def conform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the log's columns and types; a column that is lacking or whose type
        cannot be read as the log's is refused."""
        missing = [f.name for f in self.schema if f.name not in rows.columns]
        if missing:
            raise ValueError(f"rows without the columns {missing}")
        out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema])
        for f in self.schema:
            there = rows.schema[f.name].dataType
            if there != f.dataType and there.simpleString() not in _WIDENS.get(f.dataType.simpleString(), ()):
                raise ValueError(f"column {f.name} is {there.simpleString()}, the log holds {f.dataType.simpleString()}")
        return out

    def _measure(self, rows: DataFrame) -> tuple[int, int, int]:
        c = F.coalesce(F.col(self.order_col), F.lit(OLDEST))
        n, least, most = rows.agg(F.count(F.lit(1)), F.min(c), F.max(c)).first()
        return n, least if n else OLDEST, most if n else OLDEST

    def push(self, rows: DataFrame, number: int) -> bool:
        """Write ``rows`` as segment ``number``; False if that push has been done."""
        fs, p = self._fs(self._entry(number))
        if fs.exists(p) or number <= self._trimmed():
            return False
        path = f"{self.path}/segments/{number:018d}"
        self.conform(rows).write.mode("overwrite").parquet(path)
        self._commit(Segment(number, path, True, *self._measure(self.spark.read.schema(self.schema).parquet(path))))
        return True

    def adopt(self, path: str, number: int) -> bool:
        """Take up the Parquet table at ``path`` as segment ``number``, without a copy."""
        fs, p = self._fs(self._entry(number))
        if fs.exists(p) or number <= self._trimmed():
            return False
        table = self.spark.read.parquet(path)
        self.conform(table)
        self._commit(Segment(number, path, False, *self._measure(table)))
        return True

    # ---------------------------------------------------------------- reading

    def needed(self, n: int) -> list[Segment]:
        """The segments that can hold one of the newest ``n`` rows."""
        segments, sure, bound = self.segments(), 0, OLDEST
        for s in sorted(segments, key=lambda s: -s.least):
            sure += s.rows
            if sure >= n:
                bound = s.least  # n rows are at least this new
                break
        return [s for s in segments if s.rows and s.most >= bound]

    def newest(self, n: int) -> DataFrame:
        """The newest ``n`` rows."""
        chosen = self.needed(n)
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        rows = None
        for own in (True, False):  # an adopted table may hold more columns, or narrower types
            paths = [s.path for s in chosen if s.own == own]
            if paths:
                part = self.spark.read.schema(self.schema).parquet(*paths) if own else None
                for path in [] if own else paths:
                    one = self.conform(self.spark.read.parquet(path))
                    part = one if part is None else part.unionByName(one)
                rows = part if rows is None else rows.unionByName(part)
        return rows.orderBy(F.col(self.order_col).desc_nulls_last()).limit(n)

    def last_number(self) -> int:
        """The number of the last push, -1 before the first."""
        return max([self._trimmed(), *(s.number for s in self.segments())], default=-1)

    # ---------------------------------------------------------------- trimming

    def _trimmed(self) -> int:
        """The highest number that has been trimmed away; what lies below it must not come again."""
        fs, p = self._fs(f"{self.path}/trimmed")
        if not fs.exists(p):
            return -1
        return max([int(s.getPath().getName()) for s in fs.listStatus(p)], default=-1)

    def trim(self, n: int) -> list[int]:
        """Drop the segments that hold none of the newest ``n`` rows; their numbers."""
        keep = {s.number for s in self.needed(n)}
        gone = [s for s in self.segments() if s.number not in keep]
        if gone:
            fs, p = self._fs(f"{self.path}/trimmed/{max(s.number for s in gone):018d}")
            fs.mkdirs(p)
        for s in gone:
            fs, p = self._fs(self._entry(s.number))
            fs.delete(p, False)
            if s.own:
                fs, p = self._fs(s.path)
                fs.delete(p, True)
        return [s.number for s in gone]


#: Types that a column of the log takes up without loss.
_WIDENS = {"bigint": ("int", "smallint", "tinyint"), "double": ("float", "int"), "int": ("smallint", "tinyint")}
