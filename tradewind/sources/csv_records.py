"""CSV whose quoted fields hold line breaks, read by many tasks from one file.

Spark splits a file into byte ranges at line breaks. Whether a line begins
inside a quoted field depends on the quotes before it (RFC 4180: a field is
quoted as a whole, a quote in it is doubled), that is, on their number's parity:

1. each range's number of quotes, and one prefix sum over the ranges of a file
   (a row for each range), tell whether a range begins inside quotes;
2. each range's lines are put together to records in one pass over the range;
   the lines before its first record and an unfinished last record stay apart;
3. these few leftovers are joined across range borders;
4. records are parsed by Spark's own CSV parser, as ``from_csv``.

The result is that of the whole-file reader (``multiLine``), which gives a file
to one task. Lines end with a line feed, or a carriage return and a line feed.
A record must fit into one value. Compressed files are one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_KEY = ["file", "start"]
_FOUND = "file string, start bigint, nth bigint, kind string, record string"
#: A record that a range holds as a whole; the lines before a range's first record; its unfinished last record.
WHOLE, HEAD, TAIL = "whole", "head", "tail"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the byte range that holds the line), nth (ascending in a range), value."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                        F.monotonically_increasing_id().alias("nth"), "value")


def _quotes() -> F.Column:
    return (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))).cast("long")


def _pieces(lines: DataFrame) -> DataFrame:
    """Records of each range, given whether it begins inside quotes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, inside, held, kind, first = None, 0, [], HEAD, 0  # the record that has begun and its lines

        def leftover() -> list[tuple]:
            return [(*here, first, TAIL if kind == WHOLE else kind, "\n".join(held))] if held else []

        for batch in batches:
            rows: list[tuple] = []
            files, starts, nths = (batch.column(c).to_pylist() for c in ("file", "start", "nth"))
            begins, values = batch.column("inside").to_pylist(), batch.column("value").to_pylist()
            odd = pc.bit_wise_and(pc.count_substring(batch.column("value"), '"'), 1).to_numpy(zero_copy_only=False)
            ranges = np.flatnonzero(np.r_[True, [(a, b) != (c, d) for a, b, c, d in zip(files[1:], starts[1:], files, starts, strict=False)], True]) if files else []
            for a, b in zip(ranges[:-1], ranges[1:], strict=True):
                if (files[a], starts[a]) != here:
                    rows += leftover()
                    here, inside, held, kind, first = (files[a], starts[a]), begins[a], [], HEAD, nths[a]
                before = (inside + np.r_[0, np.cumsum(odd[a:b])]) % 2  # of each line, and after the last
                for k in range(a, b):
                    if not before[k - a]:
                        if not before[k - a + 1]:
                            rows.append((*here, nths[k], WHOLE, values[k]))  # a line that is a record
                            continue
                        held, kind, first = [values[k]], WHOLE, nths[k]
                        continue
                    held.append(values[k])
                    if not before[k - a + 1]:
                        rows.append((*here, first, kind, "\n".join(held)))
                        held, kind = [], WHOLE
                inside = int(before[-1])
            yield _batch(rows)
        yield _batch(leftover() if here else [])

    return lines.mapInArrow(run, _FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [("file", pa.string()), ("start", pa.int64()), ("nth", pa.int64()), ("kind", pa.string()), ("record", pa.string())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], names=[n for n, _ in types])


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """file, start, nth, record: the CSV records of the file or files at ``path``; (start, nth)
    ascends in the order of a file."""
    lines = read_lines(spark, path)
    ranges = lines.groupBy(*_KEY).agg(F.sum(_quotes()).alias("quotes"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    begins = ranges.select(*_KEY, (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("inside"))
    # Spark broadcasts the ranges where they are few, and the lines then stay where they are read.
    pieces = _pieces(lines.join(begins, _KEY).sortWithinPartitions(*_KEY, "nth"))
    whole = pieces.where(F.col("kind") == WHOLE).select("file", "start", "nth", "record")
    # A tail goes on with the heads of the following ranges, up to the next tail.
    rest = pieces.where(F.col("kind") != WHOLE)
    owner = F.last(F.when(F.col("kind") == TAIL, F.struct("start", "nth")), True).over(
        W.partitionBy("file").orderBy("start", "nth").rowsBetween(W.unboundedPreceding, 0))
    joined = (rest.withColumn("owner", owner).groupBy("file", "owner")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "nth", "record"))), lambda p: p["record"]), "\n").alias("record"))
              .select("file", F.coalesce("owner.start", F.lit(0)).alias("start"), F.coalesce("owner.nth", F.lit(-1)).alias("nth"), "record"))
    return whole.unionByName(joined)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; the first record of each file names them."""
    records = read_records(spark, path).withColumn("record", F.rtrim(F.col("record"), F.lit("\r"))).where("record != ''")
    options = {"escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}
    first = records.where("start = 0").groupBy("file").agg(F.min(F.struct("nth", "record")).alias("h")).orderBy("file").first()
    if first is None:
        return spark.createDataFrame([], "value string")
    header = first["h"]["record"].removeprefix("﻿")
    n = header.count(",") + 1
    schema = ", ".join(f"c{k} string" for k in range(n))
    values = spark.range(1).select(F.from_csv(F.lit(header), schema, options).alias("h")).first()["h"]
    names = [v for v in values if v is not None]
    kind = ", ".join(f"c{k} string" for k in range(len(names)))
    # The header of each file: the record of its first line.
    heads = records.where("start = 0").groupBy("file").agg(F.min("nth").alias("nth"))
    body = records.join(heads.withColumn("start", F.lit(0).cast("long")), ["file", "start", "nth"], "left_anti")
    parsed = body.select(F.from_csv("record", kind, options).alias("r"))
    return parsed.select(*[F.col(f"r.c{k}").alias(name) for k, name in enumerate(names)])
