"""Byte-level BPE by monoid tree reduction (operator 8).

A text is cut into pieces by the tokenizer's pattern; merges never cross a
piece. Encodings of byte strings form a monoid under *joining*: the halves of a
piece are encoded recursively and joined at their boundary. A join re-encodes a
window of the last tokens of the left half and the first of the right half, and
doubles the window until both its ends are stable.

Why stable ends suffice: take a token sequence in which every adjacent pair,
encoded by itself, gives that pair again. If the merges over the whole string
ever crossed a token boundary, look at the first one that does: until then all
merges stayed inside tokens, so the pair at that boundary, encoded alone, does
the same merges in the same order (lowest rank, then leftmost) and crosses as
well, which it does not. So the sequence is the encoding. Inside each half all
pairs are stable already; a join only has to make the pairs at the window's two
ends, and those inside the window, stable.

Pieces are joined up a balanced tree as well, where joining is concatenation;
decoding concatenates bytes up the same kind of tree.

The ranks are read on the driver from a path parameter and broadcast (a
tokenizer's vocabulary, of fixed size).

Defined cases: a null text is empty; an empty text has no ids; every row is
encoded by itself; columns of the results' names are replaced, others stay.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes up to which a string is merged at once instead of by halves.
LEAF_BYTES = 6
#: Entries of each generation of what a Python worker remembers (speed only).
CACHED_PIECES = 150_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Merges by lowest rank, then leftmost, until no adjacent pair is in the vocabulary."""
    n = len(data)
    if n <= 2 * LEAF_BYTES:
        return _merge_short(data, ranks)
    part = [data[i:i + 1] for i in range(n)]
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or (j := after[i]) >= n or len(part[i]) + len(part[j]) != size:
            continue  # one of the two has been merged since
        part[i] += part[j]
        alive[j] = False
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get(part[i] + part[k])) is not None:
                heapq.heappush(heap, (r, i, len(part[i]) + len(part[k])))
        if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
            heapq.heappush(heap, (r, h, len(part[h]) + len(part[i])))
    return [p for p, ok in zip(part, alive, strict=True) if ok]


def _merge_short(data: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The same by a list of the pairs' ranks, quicker for a few bytes."""
    part, none, get = [data[i:i + 1] for i in range(len(data))], 1 << 30, ranks.get
    rank = [get(data[i:i + 2], none) for i in range(len(data) - 1)]
    while rank and (least := min(rank)) < none:
        i = rank.index(least)
        part[i:i + 2] = [part[i] + part[i + 1]]
        del rank[i]
        if i < len(rank):
            rank[i] = get(part[i] + part[i + 1], none)
        if i:
            rank[i - 1] = get(part[i - 1] + part[i], none)
    return part


def _splitter(pattern: str) -> Callable[[str], list[str]]:
    """``pattern``'s findall. Text within Latin-1 goes to the standard library's
    quicker engine, with the pattern's character classes spelt out."""
    latin = [chr(i) for i in range(256)]
    of = {r"\p{L}": "".join(c for c in latin if unicodedata.category(c)[0] == "L"),
          r"\p{N}": "".join(c for c in latin if unicodedata.category(c)[0] == "N"),
          r"\s": "".join(c for c in latin if regex.match(r"\p{White_Space}", c))}
    spelt = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + re.escape("".join(of.values())) + "]")
    for name, chars in of.items():
        spelt = spelt.replace(name, f"[{re.escape(chars)}]")
    quick = re.compile(spelt.replace(r"\S", f"[^{re.escape(of[r'\s'])}]")).findall
    # \s as the Unicode property, which leaves out the separators 1C to 1F.
    full = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}")
                         .replace(r"\S", r"\P{White_Space}")).findall
    beyond = re.compile(r"[^\x00-\xff]").search
    return lambda text: full(text) if beyond(text) else quick(text)


class _Recent(dict):
    """``make(key)`` by key, remembering the last ones: two generations, the older is
    let go when the newer is full. Long keys are not kept."""

    def __init__(self, make, limit: int, longest: int):
        super().__init__()
        self.make, self.limit, self.longest, self.older = make, limit, longest, {}

    def __missing__(self, key):
        if (value := self.older.get(key)) is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Encodes by halves and joins; what has been encoded of short strings is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN, cached: int = CACHED_PIECES):
        self.ranks, self.cached = ranks, cached
        self.pieces = _splitter(pattern)
        self.vocabulary = {r: t for t, r in ranks.items()}
        self._merged = _Recent(lambda data: merge(data, ranks), cached, 2 * LEAF_BYTES)
        self._pairs = _Recent(lambda pair: self._merged[pair[0] + pair[1]] == list(pair), cached, 2)
        self._packed = _Recent(self._pack, cached, 64)

    def join(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        stable = self._pairs
        if stable[left[-1], right[0]]:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self._merged[b"".join(left[len(left) - i:]) + b"".join(right[:j])]
            ok_left = i == len(left) or stable[left[-i - 1], window[0]]
            ok_right = j == len(right) or stable[window[-1], right[j]]
            if ok_left and ok_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def tokens(self, data: bytes) -> list[bytes]:
        """The tokens of a string that is not empty, by halves."""
        if len(data) <= LEAF_BYTES:
            return self._merged[data]
        mid = len(data) // 2
        return self.join(self.tokens(data[:mid]), self.tokens(data[mid:]))

    def _pack(self, piece: str) -> bytes:
        """A piece's ids as native 32-bit integers, whose concatenation is that of the ids."""
        data = piece.encode()
        rank = self.ranks.get(data)
        ids = [rank] if rank is not None else [self.ranks[t] for t in self.tokens(data)]
        return np.array(ids, dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        packed = self._packed.__getitem__
        return np.frombuffer(tree(self.pieces(text), lambda block: b"".join(map(packed, block))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        word = self.vocabulary.__getitem__
        return tree(ids, lambda block: b"".join(map(word, block.tolist())))


def tree(parts, leaf: Callable[..., bytes], block: int = 4096) -> bytes:
    """Reduce ``parts`` by a balanced tree: leaves of ``block`` parts, neighbours concatenated."""
    level = [leaf(parts[i:i + block]) for i in range(0, len(parts), block)]
    while len(level) > 1:
        level = [b"".join(level[i:i + 2]) for i in range(0, len(level), 2)]
    return level[0] if level else b""


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared, cached: int = CACHED_PIECES) -> Encoder:
    """One encoder for each broadcast and Python worker."""
    if shared.id not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.id] = Encoder(shared.value, cached=cached)
    return _ENCODERS[shared.id]


class _Shared:
    """The broadcast ranks with the id that tells them apart in a worker."""

    def __init__(self, spark: SparkSession, path: str):
        self.broadcast = spark.sparkContext.broadcast(load_ranks(path))
        self.id = self.broadcast._jbroadcast.id()

    def __getstate__(self):
        return self.broadcast, self.id

    def __setstate__(self, state):
        self.broadcast, self.id = state

    @property
    def value(self):
        return self.broadcast.value


def encode(docs: DataFrame, path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the token ids of each text as array<int>."""
    shared = _Shared(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(shared)
        for texts in batches:
            yield pd.Series([enc.encode(t or "") for t in texts])

    return docs.withColumn(out, run(docs[text_col]))


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``docs`` with the bytes of each id list as binary (null ids: empty)."""
    shared = _Shared(docs.sparkSession, path)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = _encoder(shared)
        for lists in batches:
            yield pd.Series([enc.decode(ids) if ids is not None else b"" for ids in lists], dtype=object)

    return docs.withColumn(out, run(docs[ids_col]))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", cached: int = CACHED_PIECES) -> DataFrame:
    """``encode`` and ``decode`` in one pass, by one worker a task: columns ids and decoded.
    ``cached`` bounds what the worker remembers; fewer entries cost time, not results."""
    shared = _Shared(docs.sparkSession, path)

    @F.pandas_udf("ids array<int>, decoded binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        enc = _encoder(shared, cached)
        for texts in batches:
            ids = [enc.encode(t or "") for t in texts]
            yield pd.DataFrame({"ids": ids, "decoded": [enc.decode(i) for i in ids]})

    return docs.withColumn("_bpe", run(docs[text_col])).withColumns({"ids": F.col("_bpe.ids"), "decoded": F.col("_bpe.decoded")}).drop("_bpe")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document encoded and decoded again."""
    path = public_tokenizers.path(VOCABULARY)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = round_trip(docs, path)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))
