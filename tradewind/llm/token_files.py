"""Token-id files, coded by an adaptive context-mixing range coder (operator 13).

Texts are put in ascending order of their id by a range partitioning. Each task
encodes its texts with the tokenizers library, word by word (``words``), appends
an end id to each document, cuts the ids into blocks and codes every block by
itself (``id_coder``: order-0 to order-2 id predictions, mixed, drive a range
coder that starts anew in each block). A file holds whole documents:

    "TWIDS001", crc32 of the header, the header: 5 unsigned 64-bit integers
        documents, ids, block length, size of the alphabet, bytes of the index
    index (deflated): doc ids (int64), null flags (1 byte), ids of each (uint64),
        the alphabet in order of frequency (uint32); crc32 of the index
    for each block: bytes (uint32), crc32 of its bytes, crc32 of its ids (as
        uint32), and the bytes

All integers are little-endian. Readers raise on a wrong checksum. A task writes
under a name of its own (attempt id) and reports it; only the files in the
manifest, a table that Spark commits, count, so lost executors and repeated
tasks do no harm. The folder must be one that pyarrow's file systems reach from
every executor; by default it lies in the shared checkpoint folder.

Memory: a task holds the ids of one file (FILE_BYTES of text, or one document if
that is longer) and the models of at most CELLS cells.

Defined cases: a null text is empty, and an empty text is the end id alone; a
null doc_id comes first; documents of one doc_id go by the hash of their text,
and equal rows are told apart by nothing, so their order does not matter; an
empty table gives no file and no row; other columns are ignored.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewind.llm import id_coder
from tradewind.llm.common import materialize, read, shared_path
from tradewind.llm.words import WordEncoder

VOCABULARY = "byte_bpe_50k.json"
END = 2
MAGIC = b"TWIDS001"
#: Bytes of text for each range partition, and ids after which a task begins another file.
FILE_BYTES = 12_000_000
FILE_IDS = 6_000_000
#: Ids of a block. A file of few ids has shorter blocks, so that LANES of them are coded side by side.
BLOCK, SHORT_BLOCK, LANES = 4096, 512, 64
#: Blocks side by side times ids of the alphabet, at most.
CELLS = 8_000_000
MANIFEST = "part int, seq int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"
_HEADER = struct.Struct("<5Q")
_BLOCK = struct.Struct("<3I")


def pack_file(doc_ids: list[int | None], texts_ids: list[bytes]) -> bytes:
    """The file of these documents; ``texts_ids`` are uint32 little-endian."""
    lengths = np.array([len(t) // 4 for t in texts_ids], "<u8")
    ids = np.frombuffer(b"".join(texts_ids), "<u4")
    alphabet, dense, times = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.argsort(-times, kind="stable")
    rank = np.empty(len(alphabet), np.int64)
    rank[order] = np.arange(len(alphabet))
    dense, alphabet = rank[dense], alphabet[order].astype("<u4")
    index = zlib.compress(b"".join([
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), bytes(d is None for d in doc_ids), lengths.tobytes(), alphabet.tobytes()]))
    block = min(BLOCK, max(SHORT_BLOCK, -(-len(ids) // LANES)))
    header = _HEADER.pack(len(doc_ids), len(ids), block, len(alphabet), len(index))
    out = io.BytesIO()
    out.write(MAGIC + struct.pack("<I", zlib.crc32(header)) + header + index + struct.pack("<I", zlib.crc32(index)))
    side = max(1, CELLS // max(1, len(alphabet))) * block
    for at in range(0, len(ids), side):
        blocks = [dense[k:k + block] for k in range(at, min(at + side, len(ids)), block)]
        for k, coded in enumerate(id_coder.encode(blocks, len(alphabet))):
            start = at + k * block
            out.write(_BLOCK.pack(len(coded), zlib.crc32(coded), zlib.crc32(ids[start:start + block])) + coded)
    return out.getvalue()


def _verify(what: str, data, crc: int) -> None:
    if zlib.crc32(data) != crc:
        raise ValueError(f"token file: the checksum of {what} is wrong")


def unpack_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, number of ids of each, all ids) of a file, checked against its checksums."""
    if data[:8] != MAGIC:
        raise ValueError("not a token file")
    header = data[12:12 + _HEADER.size]
    _verify("the header", header, *struct.unpack_from("<I", data, 8))
    n_docs, n_ids, block, size, n_index = _HEADER.unpack(header)
    at = 12 + _HEADER.size
    packed = data[at:at + n_index]
    _verify("the index", packed, *struct.unpack_from("<I", data, at + n_index))
    index = zlib.decompress(packed)
    numbers, nulls = np.frombuffer(index, "<i8", n_docs), index[8 * n_docs:9 * n_docs]
    lengths = np.frombuffer(index, "<u8", n_docs, 9 * n_docs)
    alphabet = np.frombuffer(index, "<u4", size, 17 * n_docs)
    at += n_index + 4
    heads, coded = [], []
    for _ in range(-(-n_ids // block)):
        heads.append(_BLOCK.unpack_from(data, at))
        at += _BLOCK.size
        coded.append(data[at:at + heads[-1][0]])
        at += heads[-1][0]
        _verify(f"block {len(coded) - 1}", coded[-1], heads[-1][1])
    side, ids = max(1, CELLS // max(1, size)), np.empty(n_ids, "<u4")
    for k in range(0, len(coded), side):
        group = coded[k:k + side]
        sizes = [min(block, n_ids - (k + j) * block) for j in range(len(group))]
        for j, dense in enumerate(id_coder.decode(group, sizes, size)):
            start = (k + j) * block
            ids[start:start + sizes[j]] = alphabet[dense]
            _verify(f"the ids of block {k + j}", ids[start:start + sizes[j]], heads[k + j][2])
    return [None if null else int(d) for d, null in zip(numbers, nulls, strict=True)], lengths.astype(np.int64), ids


_ENCODERS: dict[int, WordEncoder] = {}


def _encoder(key: int, definition: str) -> WordEncoder:
    """One encoder for each vocabulary and Python worker."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = WordEncoder(definition)
    return _ENCODERS[key]


def write_files(docs: DataFrame, path: str, folder: str | None = None, text_col: str = "text", end: int = END,
                file_bytes: int = FILE_BYTES, file_ids: int = FILE_IDS) -> DataFrame:
    """Token files of ``docs`` (doc_id, ``text_col``) in ascending order of doc_id; the
    manifest, a row for each file: part and seq give the files' order."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "token-files")
    with open(path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())  # a vocabulary: of fixed size
    key = shared._jbroadcast.id()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    rows = rows.withColumn("text_key", F.xxhash64("text")).withColumn("tie", F.monotonically_increasing_id())
    order = ["doc_id", "text_key", "tie"]
    rows = rows.repartitionByRange(max(1, -(-n_bytes // file_bytes)), *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        part, tail = TaskContext.get().partitionId(), np.uint32(end).tobytes()
        seq, doc_ids, coded, held = 0, [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, doc_ids, coded, held
            name = f"{base}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.twids"
            data = pack_file(doc_ids, coded)
            with store.open_output_stream(name) as out:
                out.write(data)
            row = {"part": part, "seq": seq, "path": name, "n_docs": len(doc_ids), "n_ids": held, "n_bytes": len(data)}
            seq, doc_ids, coded, held = seq + 1, [], [], 0
            return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()),
                                                                ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))

        for batch in batches:
            encoder = _encoder(key, shared.value)
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts), strict=True):
                doc_ids.append(doc_id)
                coded.append(ids + tail)
                held += len(ids) // 4 + 1
                if held >= file_ids:
                    yield flush()
        if doc_ids:
            yield flush()

    return materialize(rows.mapInArrow(run, MANIFEST), "token-manifest")


def read_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """The documents of the manifest's files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32 and, if asked for, ids (array<bigint>)."""
    spark = manifest.sparkSession
    folder = spark.sparkContext.broadcast(shared_path(spark, "").rsplit("/", 1)[0])  # its scheme tells the file system
    schema = "part int, seq int, at bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    n_files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(folder.value)[0]
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_stream(row["path"]) as source:
                    doc_ids, lengths, ids = unpack_file(source.read())
                if (len(doc_ids), len(ids)) != (row["n_docs"], row["n_ids"]):
                    raise ValueError(f"token file {row['path']} is not the one of the manifest")
                ends = np.cumsum(lengths)
                starts = ends - lengths
                columns = {"part": pa.array([row["part"]] * len(doc_ids), pa.int32()), "seq": pa.array([row["seq"]] * len(doc_ids), pa.int32()),
                           "at": pa.array(starts), "doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array(lengths),
                           "ids_crc32": pa.array([zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)], pa.int64())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(starts, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_pydict(columns)

    # A row for each file; the sums of all before it are those of a few numbers a file.
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    offsets = manifest.select("part", "seq", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("offset"))
    found = manifest.repartition(max(1, n_files)).mapInArrow(run, schema)
    return found.join(offsets, ["part", "seq"]).select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op13_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the ids of all documents written to files and read back."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_files(write_files(docs, public_tokenizers.path(VOCABULARY)))
