"""Repeated passages by a sparse suffix array (operator 3).

Finds every passage of at least ``MIN_WORDS`` words that occurs in two documents
of different text, and the whole texts that documents share.

A passage is made of windows of MIN_WORDS words, the beginnings of suffixes. Each
window belongs to the smallest of the hashes of its W consecutive K-word shingles
(its minimiser; W + K - 1 = MIN_WORDS), so equal windows have equal minimisers. Steps:

1. Each distinct text gives its minimisers; only shingles seen in two texts go on.
2. Of those every window goes on, as the hash of its words beside the shingle's.
   They are sorted by hash and id (range partitions, so a common passage spreads over
   tasks), and each window learns the smallest other text that holds it from the two
   smallest ids of its hash. Hashes at the ends of partitions may stand in several;
   their two smallest ids are found in a small second pass.
3. A word's partner is the smallest over the windows that it lies in; runs of words
   with one partner are the spans of the text, and every document gets the spans of
   its text.

No pairs are made, and nothing depends on which copies are neighbours: a window is
missed in no case, and found wrongly only if two 64-bit hashes collide at once.

Words: runs of anything but ASCII white space, as they are. Defined cases: null,
empty and shorter texts have no passage; repeats inside one document do not
count; ids are taken as unique, rows with a null id take no part; repeated rows
are one document; an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W_
from pyspark.sql import functions as F

from tradewind.llm.common import materialize, read

MIN_WORDS = 50
K = 25
W = MIN_WORDS - K + 1
#: Windows of one sorted partition.
SORT_ROWS = 100_000
#: No document: greater than any id that shares a word.
NONE = np.iinfo(np.int64).max

_rng = np.random.default_rng(3)
_PLACE = _rng.integers(0, 2**63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPANS = "array<struct<start_word:int,end_word:int,partner:long>>"


def word_hashes(text: bytes | None) -> np.ndarray:
    words = text.split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _mixed(g: np.ndarray) -> np.ndarray:
    g = (g ^ (g >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return g ^ (g >> np.uint64(29))


def _shingles(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each shingle, and for each window the word number of its smallest one."""
    n = len(h) - K + 1
    if n < W:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    g = h[:n] * _PLACE[0]
    for j in range(1, K):
        g = g + h[j:n + j] * _PLACE[j]
    g = _mixed(g)
    at = np.concatenate([np.lib.stride_tricks.sliding_window_view(g[i:i + 4096 + W - 1], W).argmin(axis=1) + np.arange(
        i, min(i + 4096, n - W + 1)) for i in range(0, n - W + 1, 4096)])
    return g, at


def minimisers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hash, word number) of the kept positions."""
    g, at = _shingles(h)
    pos = np.unique(at)
    return g[pos].view(np.int64), pos.astype(np.int32)


def _minimisers(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        rows = []
        for t in texts:
            h = word_hashes(t)
            rows.append((len(h), *minimisers(h)))
        yield pd.DataFrame(rows, columns=["n_words", "g", "pos"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Text and shared shingles -> the windows of those shingles: shingle hash, hash of all
    words, and the word numbers where the window starts."""
    for batch in batches:
        for node, t, shared in zip(batch.column("node").to_pylist(), batch.column("t").to_pylist(),
                                   batch.column("shared").to_pylist(), strict=True):
            g, at = _shingles(word_hashes(t))
            p = np.flatnonzero(np.isin(g[at], np.array(shared, np.int64).view(np.uint64)))
            # K + K words make a window, so its two shingles hash all of it.
            w = _mixed(g[p] * _PLACE[0] + _mixed(g[p + MIN_WORDS - K] ^ _PLACE[1]) * _PLACE[2])
            of = g[at[p]]
            order = np.lexsort((p, w, of))
            p, w, of = p[order], w[order], of[order]
            new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (of[1:] != of[:-1])])) if len(p) else p
            yield pa.RecordBatch.from_pydict({
                "node": pa.array(np.full(len(new), node, np.int64)), "g": pa.array(of[new].view(np.int64)),
                "w": pa.array(w[new].view(np.int64)), "at": pa.ListArray.from_arrays(
                    pa.array(np.append(new, len(p)), pa.int32()), pa.array(p, pa.int32()))})


def _sharers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted windows of a partition -> those with the smallest other text that holds them.
    Of the first and the last hash, which may stand elsewhere too, all windows without it;
    ``least`` marks the two smallest texts here."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    t = pa.Table.from_batches(got).combine_chunks()
    g, w, node = (t[c].to_numpy() for c in ("g", "w", "node"))
    n = len(g)
    starts = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (w[1:] != w[:-1])]))
    sizes = np.diff(np.append(starts, n))
    run_of = np.repeat(np.arange(len(starts)), sizes)
    lo, after = node[starts], np.where(sizes > 1, node[np.minimum(starts + 1, n - 1)], NONE)
    place = np.arange(n) - starts[run_of]
    partner = np.where(place == 0, after[run_of], lo[run_of])
    edge = (run_of == 0) | (run_of == len(starts) - 1)
    out = t.select(["g", "w", "node", "at"])
    for c, values in (("partner", pa.array(partner, mask=edge)), ("edge", pa.array(edge)), ("least", pa.array(edge & (place < 2)))):
        out = out.append_column(c, values)
    yield from out.filter(pa.array(edge | (partner != NONE))).to_batches()


def _runs(partner: np.ndarray) -> list[dict]:
    """Words' partners -> maximal runs of words with one partner."""
    ends = np.flatnonzero(np.concatenate([partner[1:] != partner[:-1], [True]])) + 1
    starts = np.concatenate([[0], ends[:-1]])
    return [{"start_word": int(a), "end_word": int(b), "partner": int(partner[a])}
            for a, b in zip(starts, ends, strict=True) if partner[a] != NONE]


def _spans(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    """Words of a text, its windows with their partners, its smallest two ids -> spans of the
    document with the smallest id, and spans of the other documents of this text."""
    for n_words, ats, partners, nodes, seconds in batches:
        rows = []
        for n, at, other, node, second in zip(n_words, ats, partners, nodes, seconds, strict=True):
            word = np.full(n, NONE, np.int64)
            if at is not None and len(at):
                word[np.concatenate(list(at))] = np.repeat(np.asarray(other, np.int64), [len(a) for a in at])
                # Smallest of the last MIN_WORDS window starts, by doubling.
                done = 1
                while done < MIN_WORDS:
                    step = min(done, MIN_WORDS - done)
                    word[step:] = np.minimum(word[step:], word[:-step])
                    done += step
            copies = second is not None and second == second
            rows.append((_runs(np.minimum(word, int(second))), _runs(np.minimum(word, int(node)))) if copies
                        else (_runs(word), []))
        yield pd.DataFrame(rows, columns=["least", "others"])


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each repeated span of each document: its id, start_word and end_word
    (end exclusive), n_words, partner_id (the smallest other id among the documents that
    share a passage with these words) and first (no smaller id does). A span ends where
    no passage goes on or the partner changes."""
    key = docs.select(F.col(id_col).cast("long").alias("id"), docs[text_col].cast("binary").alias("t")).where(
        "id IS NOT NULL AND t IS NOT NULL")
    kept = F.pandas_udf(_minimisers, "n_words int, g array<long>, pos array<int>")
    signed = materialize(key.select("id", F.unhex(F.md5("t")).alias("text_key"), kept("t").alias("m"))
                         .select("id", "text_key", "m.n_words", "m.g").where(F.col("n_words") >= MIN_WORDS), "minimisers")
    texts = materialize(signed.groupBy("text_key").agg(F.min("id").alias("node"), F.max("id").alias("last"),
                                                       F.first("n_words").alias("n_words")), "texts")
    one = signed.join(texts.select("text_key", F.col("node").alias("id")), ["text_key", "id"])
    kept_at = one.select(F.col("id").alias("node"), F.explode(F.array_distinct("g")).alias("g"))
    shared = kept_at.groupBy("g").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("g")
    # Written first, so that the join has plain exchanges on both sides and a hot shingle is split.
    shared = materialize(shared, "shared-shingles")
    of_text = kept_at.join(shared, "g").groupBy("node").agg(F.collect_set("g").alias("shared"))

    # Windows, from the text of one document for each text.
    source = key.join(of_text, key["id"] == of_text["node"]).select("node", "t", "shared").dropDuplicates(["node"])
    windows = materialize(source.mapInArrow(_windows, "node long, g long, w long, at array<int>"), "windows")
    partitions = max(windows.sparkSession.sparkContext.defaultParallelism, -(-windows.count() // SORT_ROWS))
    keys = ["g", "w", "node"]
    sharers = materialize(windows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).mapInArrow(
        _sharers, "g long, w long, node long, at array<int>, partner long, edge boolean, least boolean"), "sharers")
    # Two hashes a partition at most.
    ends = (sharers.where("least").groupBy("g", "w").agg(F.array_sort(F.collect_list("node")).alias("n"))
            .where(F.size("n") > 1).select("g", "w", F.col("n")[0].alias("lo"), F.col("n")[1].alias("after")))
    at_ends = sharers.where("edge").drop("partner").join(F.broadcast(ends), ["g", "w"]).withColumn(
        "partner", F.when(F.col("node") == F.col("lo"), F.col("after")).otherwise(F.col("lo")))
    columns = ["node", "at", "partner"]
    found = sharers.where("NOT edge").select(columns).unionByName(at_ends.select(columns)).groupBy("node").agg(
        F.collect_list(F.struct("at", "partner")).alias("found"))

    all_docs = signed.select("id", "text_key").distinct().join(texts, "text_key")
    seconds = all_docs.where("id <> node").groupBy("node").agg(F.min("id").alias("second"))
    spans = F.pandas_udf(_spans, f"least {_SPANS}, others {_SPANS}")
    of_texts = (texts.join(seconds, "node", "left").join(found, "node", "left").where("second IS NOT NULL OR found IS NOT NULL")
                .select("text_key", spans("n_words", "found.at", "found.partner", "node", "second").alias("s")))
    return all_docs.join(materialize(of_texts.select("text_key", "s.*"), "spans"), "text_key").select(
        F.col("id").alias(id_col), F.explode(F.when(F.col("id") == F.col("node"), F.col("least")).otherwise(
            F.col("others"))).alias("s")).select(
        id_col, "s.start_word", "s.end_word", (F.col("s.end_word") - F.col("s.start_word")).alias("n_words"),
        F.col("s.partner").alias("partner_id")).withColumn("first", F.col(id_col) < F.col("partner_id"))


def cut_repeats(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the words of passages that are not a first occurrence."""
    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        import re
        word = re.compile(r"[^\x20\x09-\x0D]+")
        out = []
        for t, found in zip(texts, spans, strict=True):
            if t is not None and found is not None and len(found):
                at = [m.span() for m in word.finditer(t)]
                parts, seen = [], 0
                for s in sorted(found, key=lambda s: s["a"]):
                    parts.append(t[seen:at[s["a"]][0]])
                    seen = at[s["b"] - 1][1]
                t = "".join(parts) + t[seen:]
            out.append(t)
        return pd.Series(out, dtype=object)

    gone = passages.where("NOT first").groupBy(F.col(id_col).alias("_id")).agg(
        F.collect_list(F.struct(F.col("start_word").alias("a"), F.col("end_word").alias("b"))).alias("_spans"))
    joined = docs.join(gone, docs[id_col].cast("long") == gone["_id"], "left")
    return joined.withColumn(text_col, cut(docs[text_col], F.col("_spans"))).drop("_id", "_spans")


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every repeated passage of at least 50 words of every document."""
    return repeated_passages(read(spark, sf_dir, "documents").select("doc_id", "text"))
