"""Alignment of two tokenizers by an associative fragment monoid (operator 11).

Tokenizer A (byte-level BPE) and B (pieces with byte fallback) both cover the
bytes of a space and the text. Offsets at which a token of either ends cut the
tokens into groups. A byte range of a document gives a fragment: an open prefix
(the tokens up to its first cut), closed groups, and an open suffix (the tokens
behind its last cut); a range without a cut is open as a whole. A token belongs
to the range in which it ends. Two neighbouring fragments are composed by
closing a group of the left one's suffix and the right one's prefix, or by
lengthening what is open. This is associative, and the empty fragment is its
identity, so any tree of compositions gives the document.

Both tokenizers end a token before every space that follows a character which
is no white space (``words``), so each word is a closed fragment of its own,
which a worker remembers. A document of more than RANGE bytes becomes one
fragment a range, a row each; rounds of composition by FAN_IN neighbours join
them across tasks.

Links are all pairs of an A and a B token in one group, kept as distinct id
pairs with their number. For a pair's count, how many documents hold it, the
distinct pairs of each batch of documents are sorted into BUCKETS; counts are
summed by Spark; then counts and documents' pairs of a bucket meet in one sorted
stream, counts first, and the documents' sums are added up. What a task holds is
a bucket's share of the id pairs, which the two vocabularies bound, and a batch.

Defined cases: a null or empty text, or one whose joined token bytes differ from
space and text for either tokenizer, has no tokens: zeros, and '' as its digest;
repeated rows and rows of one doc_id are documents by themselves; an empty table
gives no row; other columns are ignored. A document's groups, written out, must
fit into one value (2 GB).
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, starmap
from operator import itemgetter

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read
from tradewind.llm.words import REMEMBERED, Remembered, cut, tokenizer

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of a fragment of a long document, and fragments that one composition joins.
RANGE, FAN_IN = 16_384, 8
#: Links of a word that are kept one by one.
MANY_LINKS = 4096
#: Parts of the space of id pairs; and bytes of documents' pairs that one task looks up.
BUCKETS, LOOKUP_BYTES = 32, 64_000_000
#: Pairs after which a task gives out the counts it has summed.
SUMMED = 500_000
DOC, PAIRS, OPEN = 0, 1, 2
_FIELDS = {"kind": pa.int32(), "batch": pa.int64(), "at": pa.int32(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(),
           "n_groups": pa.int64(), "n_links": pa.int64(), "groups_sha256": pa.string(), "part": pa.int32(), "n_parts": pa.int32(),
           "bucket": pa.int32(), "data": pa.binary()}
_DDL = ("kind int, batch bigint, at int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
        "part int, n_parts int, bucket int, data binary")
_OPEN_DDL = "batch bigint, at int, doc_id bigint, part int, n_parts int, data binary"


@dataclass
class Fragment:
    """Of a byte range. Without a cut, all its tokens are in ``prefix``. Tokens are (A ids,
    B ids); ``groups`` has the closed groups written out, ``keys`` and ``times`` their links."""

    has_cut: bool = False
    prefix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    suffix: tuple[list[int], list[int]] = field(default_factory=lambda: ([], []))
    n_a: int = 0  # tokens in closed groups
    n_b: int = 0
    n_groups: int = 0
    groups: bytes = b""
    keys: np.ndarray = field(default_factory=lambda: np.empty(0, "<u8"))
    times: np.ndarray = field(default_factory=lambda: np.empty(0, "<u8"))

    def pack(self) -> bytes:
        arrays = [*(np.array(x, "<u4") for x in (*self.prefix, *self.suffix)), self.keys.astype("<u8"), self.times.astype("<u8"), np.frombuffer(self.groups, "u1")]
        return struct.pack("<?10Q", self.has_cut, self.n_a, self.n_b, self.n_groups, *map(len, arrays)) + b"".join(a.tobytes() for a in arrays)

    @staticmethod
    def unpack(data: bytes) -> Fragment:
        has_cut, n_a, n_b, n_groups, *sizes = struct.unpack_from("<?10Q", data)
        at, arrays = struct.calcsize("<?10Q"), []
        for n, kind in zip(sizes, ("<u4",) * 4 + ("<u8", "<u8", "u1"), strict=True):
            arrays.append(np.frombuffer(data, kind, n, at))
            at += arrays[-1].nbytes
        a, b, c, d = (x.tolist() for x in arrays[:4])
        return Fragment(has_cut, (a, b), (c, d), n_a, n_b, n_groups, arrays[6].tobytes(), arrays[4], arrays[5])


def written(a: Iterable[int], b: Iterable[int]) -> bytes:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}".encode()


def links(a: list[int], b: list[int], size_b: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct id pairs of a group as a * size_b + b, and how often each occurs."""
    if len(a) == 1 and len(b) == 1:
        return np.array([a[0] * size_b + b[0]], "<u8"), np.ones(1, "<u8")
    ids_a, n_a = np.unique(np.array(a, "<u8"), return_counts=True)
    ids_b, n_b = np.unique(np.array(b, "<u8"), return_counts=True)
    return (ids_a[:, None] * np.uint64(size_b) + ids_b).reshape(-1), np.outer(n_a, n_b).reshape(-1).astype("<u8")


def fragment(a: list[tuple[int, int]], b: list[tuple[int, int]], size_b: int) -> Fragment:
    """Of the (id, end offset) tokens that end in one byte range."""
    cuts = sorted({e for _, e in a} & {e for _, e in b})
    if not cuts:
        return Fragment(prefix=([i for i, _ in a], [i for i, _ in b]))
    spans, at_a, at_b = [], 0, 0
    for end in [*cuts, float("inf")]:
        to_a, to_b = at_a, at_b
        while to_a < len(a) and a[to_a][1] <= end:
            to_a += 1
        while to_b < len(b) and b[to_b][1] <= end:
            to_b += 1
        spans.append(([i for i, _ in a[at_a:to_a]], [i for i, _ in b[at_b:to_b]]))
        at_a, at_b = to_a, to_b
    return closed(spans[1:-1], size_b, prefix=spans[0], suffix=spans[-1])


def closed(groups: list[tuple[list[int], list[int]]], size_b: int, **ends) -> Fragment:
    found = [links(a, b, size_b) for a, b in groups]
    none = [np.empty(0, "<u8")]
    return Fragment(True, n_a=sum(len(a) for a, _ in groups), n_b=sum(len(b) for _, b in groups), n_groups=len(groups),
                    groups=b";".join(starmap(written, groups)), keys=np.concatenate(none + [k for k, _ in found]),
                    times=np.concatenate(none + [t for _, t in found]), **ends)


def merged(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their times."""
    if not len(keys):
        return keys, times
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(times[order], first)


def compose(left: Fragment, right: Fragment, size_b: int) -> Fragment:
    """The fragment of two neighbouring ranges."""
    joined = lambda x, y: (x[0] + y[0], x[1] + y[1])
    if not right.has_cut:
        if not left.has_cut:
            return Fragment(prefix=joined(left.prefix, right.prefix))
        return Fragment(**{**vars(left), "suffix": joined(left.suffix, right.prefix)})
    if not left.has_cut:
        return Fragment(**{**vars(right), "prefix": joined(left.prefix, right.prefix)})
    middle = joined(left.suffix, right.prefix)
    parts = [left, *([closed([middle], size_b)] if middle[0] else []), right]
    keys, times = merged(np.concatenate([p.keys for p in parts]), np.concatenate([p.times for p in parts]))
    return Fragment(True, left.prefix, right.suffix, sum(p.n_a for p in parts), sum(p.n_b for p in parts), sum(p.n_groups for p in parts),
                    b";".join(p.groups for p in parts if p.n_groups), keys, times)


def whole(f: Fragment, size_b: int) -> Fragment:
    """The document's fragment, whose first byte follows a cut and whose last byte is one."""
    return compose(Fragment(True), f, size_b)


def token_bytes(made) -> np.ndarray:
    """How many bytes each id of a byte-level vocabulary stands for: one for each character of its token."""
    size = np.zeros(made.get_vocab_size(), np.int64)
    for token, i in made.get_vocab(with_added_tokens=False).items():
        size[i] = len(token)
    return size


class Pair:
    """The two tokenizers; closed fragments of words are remembered in packed form."""

    def __init__(self, definition_a: str, model_b: bytes, limit: int = REMEMBERED // 2):
        import sentencepiece
        self.a, self.b = tokenizer(definition_a, plain=True), sentencepiece.SentencePieceProcessor(model_proto=model_b)
        self.sizes_a = token_bytes(self.a).tolist()
        self.size_b = self.b.vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece with a space after other characters: words are no fragments of their own")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_b = list(map(len, self.bytes_b))
        self.space = self.b.piece_to_id("▁")
        self.text = [str(i) for i in range(max(len(self.sizes_a), self.size_b))]
        self.known = Remembered(self._words, limit)

    def _raw(self, texts: list[str]) -> Iterator[tuple[list[int], list[int], list[int], list[int]] | None]:
        """Ids and end offsets of A's and of B's tokens of a space and each text; None where their bytes differ from it."""
        size_a, size_b, bytes_b = self.sizes_a.__getitem__, self.sizes_b.__getitem__, self.bytes_b.__getitem__
        encoded = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, enc, b in zip(texts, encoded, self.b.encode(texts, num_threads=1), strict=True):
            a, b, data = enc.ids, b if text else [self.space], f" {text}".encode()
            ends_a = list(accumulate(map(size_a, a)))
            # A's tokens are bytes of the text in order, so only lost bytes could make a difference.
            if ends_a[-1] != len(data) or b"".join(map(bytes_b, b)) != data:
                yield None
            else:
                yield a, ends_a, b, list(accumulate(map(size_b, b)))

    def tokens(self, texts: list[str]) -> list[tuple[list[tuple[int, int]], list[tuple[int, int]]] | None]:
        """The same as (id, end offset) of each token."""
        return [raw and (list(zip(raw[0], raw[1], strict=True)), list(zip(raw[2], raw[3], strict=True))) for raw in self._raw(texts)]

    def _words(self, words: list[str]):
        """Of each word, packed: numbers of A tokens, B tokens and groups; the groups; the key
        of every link. A fragment where there are many links; None as in ``tokens``."""
        size_b, text = self.size_b, self.text.__getitem__
        for raw in self._raw(words):
            if raw is None:
                yield None
                continue
            a, ends_a, b, ends_b = raw
            i = j = n_links = 0
            groups, keys = [], []
            while i < len(a):
                first_a, first_b, end_a, end_b = i, j, ends_a[i], ends_b[j]
                while end_a != end_b:
                    if end_a < end_b:
                        i += 1
                        end_a = ends_a[i]
                    else:
                        j += 1
                        end_b = ends_b[j]
                i, j = i + 1, j + 1
                if i - first_a == 1 == j - first_b:
                    groups.append(text(a[first_a]) + "|" + text(b[first_b]))
                    keys.append(a[first_a] * size_b + b[first_b])
                    n_links += 1
                    continue
                ids_a, ids_b = a[first_a:i], b[first_b:j]
                n_links += len(ids_a) * len(ids_b)
                if n_links > MANY_LINKS:
                    break
                groups.append(",".join(map(text, ids_a)) + "|" + ",".join(map(text, ids_b)))
                keys += [x * size_b + y for x in ids_a for y in ids_b]
            if n_links > MANY_LINKS:
                yield whole(fragment(list(zip(a, ends_a, strict=True)), list(zip(b, ends_b, strict=True)), size_b), size_b)
            else:
                yield struct.pack("<3I", len(a), len(b), len(groups)), ";".join(groups).encode(), array("Q", keys).tobytes()

    def _joined(self, pieces: list) -> Fragment:
        """The composition of neighbouring pieces: packed words, which are closed, or fragments."""
        f, run = Fragment(), []
        for piece in [*pieces, None]:
            if isinstance(piece, tuple):
                run.append(piece)
                continue
            if run:
                n = np.frombuffer(b"".join(map(itemgetter(0), run)), "<u4").reshape(-1, 3).sum(axis=0, dtype=np.int64).tolist()
                keys = np.frombuffer(b"".join(map(itemgetter(2), run)), "<u8")
                f = compose(f, Fragment(True, n_a=n[0], n_b=n[1], n_groups=n[2], groups=b";".join(map(itemgetter(1), run)),
                                        keys=keys, times=np.ones(len(keys), "<u8")), self.size_b)
                run = []
            if piece is not None:
                f = compose(f, piece, self.size_b)
        return f

    def documents(self, texts: list[str | None], size: int = RANGE) -> Iterator[list[Fragment]]:
        """The fragments of each text's ranges of ``size`` bytes; none if it has no tokens."""
        lists = []
        for text in texts:
            first, *rest = cut(" " + text) if text else [""]
            lists.append(([first[1:]] if first else []) + rest)
        known = self.known.of({w for ws in lists for w in ws})
        for text, ws in zip(texts, lists, strict=True):
            found = list(map(known.__getitem__, ws))
            if None in found:  # the bytes of a word differ; those of the text decide
                tokens = self.tokens([text])[0]
                yield [] if tokens is None else self._ranges([(tokens, len(text.encode()) + 1)], size)
            elif len(text or "") <= size // 4 or sum(len(w.encode()) + 1 for w in ws) <= size:
                yield [self._joined(found)] if found else []
            else:
                yield self._ranges([(f, len(w.encode()) + 1, w) for f, w in zip(found, ws, strict=True)], size)

    def _ranges(self, parts: list[tuple], size: int) -> list[Fragment]:
        """Fragments of ranges, from (tokens, bytes) or (packed fragment, bytes, word); a word over a range's end is cut by its tokens."""
        n_ranges = -(-sum(p[1] for p in parts) // size)
        pieces: list[list] = [[] for _ in range(n_ranges)]
        start = 0
        for what, length, *word in parts:
            end = start + length
            first, last = start // size, (end - 1) // size
            if word and first == last:
                pieces[first].append(what)  # packed, or a fragment
            else:
                a, b = what if not word else self.tokens(word)[0]
                for r in range(first, last + 1):
                    lo, hi = r * size - start, (r + 1) * size - start
                    pieces[r].append(fragment([t for t in a if lo < t[1] <= hi], [t for t in b if lo < t[1] <= hi], self.size_b))
            start = end
        return [self._joined(found) for found in pieces]


_PAIRS: dict[int, Pair] = {}


def _pair(shared) -> Pair:
    """One pair of tokenizers for each broadcast and Python worker."""
    key, files = shared
    if key not in _PAIRS:
        _PAIRS.clear()
        _PAIRS[key] = Pair(*files.value)
    return _PAIRS[key]


def _rows(rows: list[dict], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in fields.items()], names=list(fields))


def _finished(batch: int, docs: list[tuple[int, int | None, Fragment | None]], size_b: int) -> Iterator[pa.RecordBatch]:
    """The rows of whole documents (place in the batch, doc_id, fragment), and their id pairs by bucket."""
    rows, keys, places, times = [], [], [], []
    for at, doc_id, f in docs:
        f = f and whole(f, size_b)
        row = {"kind": DOC, "batch": batch, "at": at, "doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""}
        if f is not None:
            row |= {"n_a": f.n_a, "n_b": f.n_b, "n_groups": f.n_groups, "n_links": int(f.times.sum()), "groups_sha256": hashlib.sha256(f.groups).hexdigest()}
            k, n = merged(f.keys, f.times)
            keys.append(k)
            places.append(np.full(len(k), at, "<u4"))
            times.append(n)
        rows.append(row)
    if keys:
        key, place, time = np.concatenate(keys), np.concatenate(places), np.concatenate(times)
        bucket = (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(BUCKETS)
        order = np.argsort(bucket << np.uint64(58) | key)  # two vocabularies' ids make far less than 2^58 pairs
        key, place, time, bucket = key[order], place[order], time[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(BUCKETS + 1))
        for k in range(BUCKETS):
            part = slice(edges[k], edges[k + 1])
            if edges[k] < edges[k + 1]:
                first = np.flatnonzero(np.r_[True, key[part][1:] != key[part][:-1]])
                n_docs = np.diff(np.r_[first, edges[k + 1] - edges[k]])
                narrow = bool(time[part].max() < 1 << 16)
                rows.append({"kind": PAIRS, "batch": batch, "bucket": k, "data": b"".join([
                    struct.pack("<2Q?", len(first), edges[k + 1] - edges[k], narrow), key[part][first].astype("<u8").tobytes(), n_docs.astype("<u4").tobytes(),
                    place[part].astype("<u4").tobytes(), time[part].astype("<u2" if narrow else "<u8").tobytes()])})
    yield _rows(rows, _FIELDS)


def _pairs(data: bytes) -> tuple[np.ndarray, ...]:
    """Distinct keys and their numbers of documents; place and times of each document's pair, in order of the keys."""
    n, m, narrow = struct.unpack_from("<2Q?", data)
    at, out = struct.calcsize("<2Q?"), []
    for count, kind in ((n, "<u8"), (n, "<u4"), (m, "<u4"), (m, "<u2" if narrow else "<u8")):
        out.append(np.frombuffer(data, kind, count, at))
        at += out[-1].nbytes
    return tuple(out)


def _composed(open_rows: DataFrame, size_b: int) -> DataFrame:
    """One round: up to FAN_IN neighbouring fragments of a document become one."""
    def run(key, table):
        rows = sorted(table.to_pylist(), key=itemgetter("part"))
        f = Fragment.unpack(rows[0]["data"])
        for r in rows[1:]:
            f = compose(f, Fragment.unpack(r["data"]), size_b)
        first = rows[0] | {"part": rows[0]["part"] // FAN_IN, "n_parts": -(-rows[0]["n_parts"] // FAN_IN), "data": f.pack()}
        return pa.Table.from_batches([_rows([first], {k: _FIELDS[k] for k in ("batch", "at", "doc_id", "part", "n_parts", "data")})])

    return open_rows.groupBy("batch", "at", F.floor(F.col("part") / FAN_IN).alias("group")).applyInArrow(run, _OPEN_DDL)


def _counts(pairs: DataFrame) -> DataFrame:
    """bucket, key, n: in how many documents each id pair is linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PAIRS.clear()  # what this worker remembered of words is of no more use
        held: dict[int, list] = {}
        size = 0

        def summed() -> Iterator[pa.RecordBatch]:
            for bucket, parts in held.items():
                keys, n = merged(np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), bucket, np.int32)), pa.array(keys.astype(np.int64)), pa.array(n)], names=["bucket", "key", "n"])

        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data"), strict=True):
                keys, n, *_ = _pairs(data.as_py())
                held.setdefault(bucket, []).append((keys, n))
                size += len(keys)
                if size > SUMMED:
                    yield from summed()
                    held, size = {}, 0
        yield from summed()

    return pairs.select("bucket", "data").mapInArrow(run, "bucket int, key bigint, n bigint").groupBy("bucket", "key").agg(F.sum("n").alias("n"))


def _looked_up(counts: DataFrame, pairs: DataFrame) -> DataFrame:
    """batch, at, n_best, count_sum: for each document and bucket. Counts come before the
    pairs of their bucket in one sorted stream; a bucket of many pairs is dealt to several
    tasks, each with its counts."""
    n_bytes = pairs.agg(F.sum(F.octet_length("data").cast("long"))).first()[0] or 0
    salts = 1 + n_bytes // (BUCKETS * LOOKUP_BYTES)
    left = counts.select("bucket", F.explode(F.sequence(F.lit(0).cast("int"), F.lit(salts - 1).cast("int"))).alias("salt"), F.lit(0).alias("kind"), "key", "n", "best",
                         F.lit(None).cast("long").alias("batch"), F.lit(None).cast("binary").alias("data"))
    right = pairs.select("bucket", F.pmod(F.xxhash64("batch"), F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key"),
                         F.lit(None).cast("long").alias("n"), F.lit(None).cast("boolean").alias("best"), "batch", "data")
    stream = left.unionByName(right).repartition(int(BUCKETS * salts), "bucket", "salt").sortWithinPartitions("bucket", "salt", "kind", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _PAIRS.clear()
        here, parts, table = None, [], None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            places = np.column_stack([batch.column("bucket").to_numpy(), batch.column("salt").to_numpy(), kinds])
            edges = np.flatnonzero(np.r_[True, (places[1:] != places[:-1]).any(axis=1), True]) if len(places) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                bucket, salt, kind = places[a].tolist()
                if (bucket, salt) != here:
                    here, parts, table = (bucket, salt), [], None
                rows = batch.slice(a, b - a)
                if kind == 0:
                    parts.append([rows.column(c).to_numpy(zero_copy_only=False) for c in ("key", "n", "best")])
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*parts, strict=True)]
                    parts = []
                for number, data in zip(rows.column("batch").to_pylist(), rows.column("data"), strict=True):
                    keys, n_docs, place, times = _pairs(data.as_py())
                    at = np.searchsorted(table[0], keys.astype(np.int64))
                    size, times = int(place.max()) + 1, times.astype(np.int64)
                    total, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
                    np.add.at(total, place, np.repeat(table[1][at], n_docs) * times)
                    np.add.at(best, place, np.repeat(table[2][at].astype(np.int64), n_docs) * times)
                    docs = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number)), pa.array(docs.astype(np.int32)), pa.array(best[docs]), pa.array(total[docs])],
                                                     names=["batch", "at", "n_best", "count_sum"])

    return stream.mapInArrow(run, "batch bigint, at int, n_best bigint, count_sum bigint")


def align(docs: DataFrame, path_a: str, path_b: str, text_col: str = "text", size: int = RANGE) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``."""
    spark = docs.sparkSession
    with open(path_a, encoding="utf-8") as a, open(path_b, "rb") as b:
        files = spark.sparkContext.broadcast((a.read(), b.read()))  # vocabularies: of fixed size
    shared = (files._jbroadcast.id(), files)
    size_b = Pair(*files.value).size_b

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, number = _pair(shared), TaskContext.get().partitionId() << 32
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            done, longer = [], []
            for at, fragments in enumerate(pair.documents(texts, size)):
                if len(fragments) < 2:
                    done.append((at, ids[at], fragments[0] if fragments else None))
                else:
                    longer += [{"kind": OPEN, "batch": number, "at": at, "doc_id": ids[at], "part": k, "n_parts": len(fragments), "data": f.pack()} for k, f in enumerate(fragments)]
            if longer:
                yield _rows(longer, _FIELDS)
            yield from _finished(number, done, size_b)
            number += 1

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (1 << 62) + (TaskContext.get().partitionId() << 32)  # apart from the numbers of `first`
        for batch in batches:
            found = [(at, r["doc_id"], Fragment.unpack(r["data"])) for at, r in enumerate(batch.to_pylist())]
            yield from _finished(number, found, size_b)
            number += 1

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    tokens = materialize(rows.mapInArrow(first, _DDL), "align-tokens")
    left = tokens.where(F.col("kind") == OPEN).select("batch", "at", "doc_id", "part", "n_parts", "data")
    while (left.agg(F.max("n_parts")).first()[0] or 0) > 1:
        left = materialize(_composed(left, size_b), "align-composed")
    composed = materialize(left.mapInArrow(last, _DDL), "align-long")
    tokens = tokens.where(F.col("kind") != OPEN).unionByName(composed)
    pairs = tokens.where(F.col("kind") == PAIRS).select("bucket", "batch", "data")
    counts = materialize(_counts(pairs).withColumn("a", F.floor(F.col("key") / size_b)), "align-counts")
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "a").select("bucket", "key", "n", (F.col("n") == F.col("most")).alias("best"))
    sums = _looked_up(counts, pairs).groupBy("batch", "at").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return (tokens.where(F.col("kind") == DOC).select("batch", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
            .join(sums, ["batch", "at"], "left")
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
                    F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: all documents under both tokenizers."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return align(docs, public_tokenizers.path(VOCABULARY_A), public_tokenizers.path(VOCABULARY_B))
