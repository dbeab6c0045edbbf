"""Toxicity by noisy-channel deobfuscation (operator 4).

1. A character language model (trigrams over a-z and one class for other
   letters) is counted over all documents.
2. A token that shows signs of disguise (symbols or digits inside letters,
   letters repeated three times or more, letters written apart) becomes a
   lattice: every character may stand for the letters it imitates, for itself, or,
   as a repetition or filler, for nothing. Viterbi finds the likeliest letters
   under the channel and the language model. Other tokens have one path only.
   Three or more pieces of one or two characters in a row are one lattice, whatever
   white space parts them; there a word may end after every letter. Words of evidence
   that it may hold count if the lattice with their edges is about as likely as the
   best one, as trigrams alone do not tell all edges. Hidden letters
   (three or more symbols in a row inside a token) may be any: such a token is also
   held against the words of evidence that have its other letters.
3. Restored words are scored: words and word beginnings carry log odds learned
   from labelled documents, and a document's score is a logistic function of its
   strongest evidence and of the sum of all, found anywhere in its whole text.

Labels are learned from a bounded sample of labelled documents (``train_docs``,
drawn by a hash of the id). Only the text is an input of a score.

Defined cases: a null or empty text has no evidence and gets the score of none;
repeated documents get equal scores; a labelled document with several labels
counts as the greatest; null labels are left out; without labels of both kinds
there is no evidence and all scores are the share of label 1 (0 if there is
none); columns named score or predicted are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.bpe import _Recent
from tradewind.llm.common import materialize, read
from tradewind.llm.quality import held_out, training_sample

TRAIN_DOCS = 6000
CUT = 0.5
#: Training documents that a word or beginning must occur in to count as evidence.
LEAST_DOCS = 4
BEGINNINGS = range(4, 9)
#: Scored tokens, other than plain words, of each of two generations that a worker remembers (speed only).
CACHED_TOKENS = 100_000

# The letters that a character imitates.
IMITATES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y",
    "*": "aeiou", "#": "aeiou", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i",
    "ο": "o", "α": "a", "ε": "e", "ι": "i",
}
FILLERS = set(".-_*'~^`,#")
#: Channel costs (negative log): a letter shown as itself, disguised, left out as filler or as repetition.
SAME, DISGUISED, FILLER, REPEATED = 0.0, 1.0, 0.5, 0.3
#: In letters written apart: white space that is no word edge, and a word edge without white space.
GAP, JOINED = 0.0, 1.0
#: What a reading with a word of evidence may cost more than the likeliest one.
MARGIN = 8.0
#: Letters on both sides of it that are weighed with it.
AROUND = 24
#: Between letters that one word must hold, and where a word must end.
GLUE, MUST_END = "\0", "\n"

SYMBOLS = 28  # 0: edge of a word, 1-26: a-z, 27: any other letter


def _classes() -> bytes:
    return bytes(b - 96 if 97 <= b <= 122 else b - 64 if 65 <= b <= 90 else 27 if b >= 128 else 0 for b in range(256))


_CLASSES = _classes()


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Character trigrams of all texts; what comes back is bounded by the alphabet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for t in batch.column(0):
                data = t.as_py()
                if data:
                    c = np.frombuffer((b" " + data + b" ").translate(_CLASSES), np.uint8).astype(np.int32)
                    total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"t": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())})

    rows = (docs.select(docs[text_col].cast("binary")).mapInArrow(run, "t int, n long")
            .groupBy("t").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(SYMBOLS**3)
    for r in rows:
        total[r["t"]] = r["n"]
    return total


class CharModel:
    """-log P(next | two before), smoothed by the next character's own frequency."""

    def __init__(self, trigrams: np.ndarray):
        n = trigrams.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        single = n.sum(axis=(0, 1)) + 1.0
        mix = 5.0 * single / single.sum()
        self.cost = -np.log((n + mix) / (n.sum(axis=2, keepdims=True) + mix.sum()))
        self.table = self.cost.tolist()

    def restore(self, token: str, apart: bool = False) -> str:
        """The likeliest letters behind a lower-case token, by Viterbi over the lattice.
        A state is the last two letters written. In letters written ``apart`` a word
        may end after each letter; the words come back with a blank between them."""
        return self.likeliest(token, apart)[1]

    def likeliest(self, token: str, apart: bool = False) -> tuple[float, str]:
        """The cost of the likeliest letters, and these."""
        cost = self.table
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for i, ch in enumerate(token):
            options: list[tuple[str, float]] = []
            if ch.isalpha():
                options.append((ch, SAME))
            options += [(x, DISGUISED) for x in IMITATES.get(ch, "")]
            drop = None
            if i and ch == token[i - 1]:
                drop = REPEATED
            elif ch in FILLERS or ch.isspace() or not options:
                drop = GAP if apart and (ch.isspace() or ch == GLUE) else FILLER
            if apart and ch.isspace():
                options = [(" ", SAME)]
                drop = None if ch == MUST_END else drop
            elif apart and i and ch != GLUE and token[i - 1] != GLUE and not token[i - 1].isspace():
                for (a, b), (so_far, path) in list(best.items()):
                    c = so_far + JOINED + cost[a][b][0]
                    if b and ((b, 0) not in best or c < best[b, 0][0]):
                        best[b, 0] = (c, (" ", path))
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (so_far, path) in best.items():
                if drop is not None and ((a, b) not in step or so_far + drop < step[a, b][0]):
                    step[a, b] = (so_far + drop, path)
                for x, channel in options:
                    if x == " " and not b:
                        if ch == MUST_END:
                            step[a, b] = min(step.get((a, b), (math.inf, None)), (so_far, path), key=lambda e: e[0])
                        continue
                    k = ord(x) - 96 if "a" <= x <= "z" else 0 if x == " " else 27
                    c = so_far + channel + cost[a][b][k]
                    if (b, k) not in step or c < step[b, k][0]:
                        step[b, k] = (c, (x, path))
            best = step
        ended = {e: (c + (cost[e[0]][e[1]][0] if e[1] or not apart else 0.0), path) for e, (c, path) in best.items()}
        (total, path), letters = min(ended.items(), key=lambda e: (e[1][0], e[0]))[1], []
        while path:
            letters.append(path[0])
            path = path[1]
        return total, "".join(reversed(letters))


_EDGE = re.compile(r"^[^\w@$!|*#+(<€£¥]+|[^\w@$*#+€£¥]+$")
_SYMBOLS_AT_END = re.compile(r"^[$*#%&+]{3,}|(?<![$*#%&+])[$*#%&+]{3,}$")
_HIDDEN = re.compile(r"[$*#%&+]{3,}")
_WORD = re.compile(r"[^\W\d_]+")
_PLAIN = re.compile(r"[^\W\d_]+\Z")
_RUN = re.compile(r"(\w)\1\1")
_APART = re.compile(r"(?<!\S)\S(?:[ .\-_*]{1,2}\S){3,}(?!\S)")
_PIECE = r"(?:[^\W_]{1,2}(?:[.\-_*]{1,2}[^\W_]{1,2})+[.\-_*]{0,2}|\S{1,2})(?!\S)"
_PIECES = re.compile(rf"(?<!\S){_PIECE}(?:\s+{_PIECE}){{2,}}")


def plain(token: str) -> str | None:
    """The lower-case word of a token of letters alone, none of them three times in a row:
    it stands for itself. None for other tokens."""
    if token.isalpha() and (low := token.lower()).isalpha() and not _RUN.search(low):
        return low
    return None


class Restorer:
    def __init__(self, model: CharModel):
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        """The lower-case words of a token as it stands, and as restored if it looks disguised;
        of pieces, the words that they make together."""
        if " " in token:
            return tuple(self.model.restore(token, apart=True).split())
        if (word := plain(token)) is not None:
            return (word,)
        core = self.core(token)
        if _PLAIN.match(core) and not _RUN.search(core):
            return (core,)
        found = tuple(_WORD.findall(core))
        if found and (_RUN.search(core) or any(c in IMITATES or c in FILLERS for c in core)):
            found += (self.model.restore(core),)
        return found

    @staticmethod
    def core(token: str) -> str:
        """The lower-case token without what stands around it."""
        return _EDGE.sub("", _SYMBOLS_AT_END.sub("", _EDGE.sub("", token.lower())))

    @staticmethod
    def apart(text: str) -> list[str]:
        """Letters written apart, as one token each."""
        return ["".join(m.group().split()) for m in _APART.finditer(text)]

    @classmethod
    def pieces(cls, text: str) -> list[str]:
        """Pieces of one or two characters in a row, with one blank between them."""
        return [p for m in _PIECES.finditer(text) if " " in (p := cls.core(" ".join(m.group().split())))]

    @classmethod
    def tokens(cls, text: str) -> set[str]:
        return {*text.split(), *cls.apart(text), *cls.pieces(text)}


def features(word: str) -> list[str]:
    return [word + "$", *(word[:n] for n in BEGINNINGS if n <= len(word))] if len(word) > 2 else []


@dataclass
class Toxicity:
    model: CharModel
    evidence: dict[str, float]
    weights: list[float]
    _known: dict[str, float] = field(default_factory=dict, repr=False)
    _beginnings: set[str] | None = field(default=None, repr=False)

    def __post_init__(self):
        self._known = _Recent(self._strength, CACHED_TOKENS, 200)
        self._starts = {f[:3] for f in self.evidence}

    def __getstate__(self):
        return self.model, self.evidence, self.weights

    def __setstate__(self, state):
        self.model, self.evidence, self.weights = state
        self._beginnings = None
        self.__post_init__()

    def told(self, word: str) -> float:
        """The strongest evidence of a word: no feature is shorter than three letters."""
        if word[:3] not in self._starts:
            return 0.0
        return max((self.evidence.get(f, 0.0) for f in features(word)), default=0.0)

    def strength(self, token: str) -> float:
        word = plain(token)
        return self.told(word) if word is not None else self._known[token]

    def _strength(self, token: str) -> float:
        s = max((self.told(w) for w in Restorer(self.model).words(token)), default=0.0)
        return max(s, self.spelled(token) if " " in token else self.hidden(token))

    def spelled(self, token: str) -> float:
        """The strongest word of evidence that pieces may hold."""
        if self._beginnings is None:
            self._beginnings = {f[:n] for f in self.evidence if f.endswith("$") for n in range(len(f))}
        letters, starts, strongest, n = token.replace(" ", ""), {0}, 0.0, 0
        for piece in token.split(" "):
            n += len(piece)
            starts.add(n)

        def spaced(a: int, b: int) -> str:
            return "".join((" " if n in starts and n > a else "") + letters[n] for n in range(a, b))

        for i in range(len(letters)):
            begun, j = {""}, i
            while begun and j < len(letters):
                ch = letters[j]
                options = IMITATES.get(ch, "") + (ch if ch.isalpha() else "")
                left_out = j > i and (ch in FILLERS or ch == letters[j - 1])
                begun = {b + x for b in begun for x in options if b + x in self._beginnings} | (begun if left_out else set())
                j += 1
                s = max((self.evidence.get(b + "$", 0.0) for b in begun), default=0.0)
                if s > strongest:
                    a, b = max(0, i - AROUND), min(len(letters), j + AROUND)
                    held = MUST_END.join(x for x in (spaced(a, i), GLUE.join(letters[i:j]), spaced(j, b)) if x)
                    more = self.model.likeliest(held, True)[0] - self.model.likeliest(spaced(a, b), True)[0]
                    if more + JOINED * ((i not in starts) + (j not in starts)) <= MARGIN:
                        strongest = s
        return strongest

    def hidden(self, token: str) -> float:
        """The strongest word of evidence that a token with hidden letters may be."""
        core = Restorer.core(token) if _HIDDEN.search(token) else ""
        shown = _HIDDEN.split(core)
        if len(shown) < 2 or not all(x.isalpha() for x in shown):
            return 0.0
        like = re.compile(_HIDDEN.sub(lambda m: f"[^\\W\\d_]{{{len(m.group())}}}", core) + r"\$\Z")
        return max((s for f, s in self.evidence.items() if like.match(f)), default=0.0)

    def inputs(self, text: str | None) -> tuple[float, float]:
        """The strongest evidence of the text's tokens, and the log of the sum of all."""
        if not text:
            return 0.0, 0.0
        found = [s for t in Restorer.tokens(text) if (s := self.strength(t)) > 0]
        return max(found, default=0.0), math.log1p(sum(sorted(found)))

    def score(self, text: str | None) -> float:
        a, b = self.inputs(text)
        z = self.weights[0] + self.weights[1] * a + self.weights[2] * b
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method, a few parameters."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _explained(docs_of: dict[str, tuple[int, int]]) -> set[str]:
    """Beginnings that stand for one purer longer form: it has most of their toxic
    documents and fewer clean ones, so what else begins like it is no evidence."""
    gone = set()
    for longer, (clean, toxic) in docs_of.items():
        for n in BEGINNINGS:
            f = longer[:n]
            if len(f) == n and f != longer and f in docs_of and docs_of[f][0] > clean and toxic >= 0.8 * docs_of[f][1]:
                gone.add(f)
    return gone


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Toxicity:
    """Language model over all of ``docs``; evidence and weights from the sample."""
    model = CharModel(count_trigrams(docs))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of the alphabet's size
    sample = training_sample(docs, labels, "toxic", train_docs).select("id", "label", F.col("text").cast("string").alias("text"))
    sample = materialize(sample.repartition(12, "id"), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, seen, sizes, of_token = Restorer(shared.value), (Counter(), Counter()), [0, 0], {}
        for batch in batches:
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = set()
                for t in restorer.tokens(text) if text else ():
                    if t not in of_token:
                        of_token[t] = [f for w in restorer.words(t) for f in features(w)]
                    found.update(of_token[t])
                seen[label > 0].update(found)
                sizes[label > 0] += 1
        names = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_pydict({
            "f": pa.array(["", *names]), "clean": pa.array([sizes[0], *(seen[0][n] for n in names)], pa.int64()),
            "toxic": pa.array([sizes[1], *(seen[1][n] for n in names)], pa.int64())})

    counted = sample.mapInArrow(count, "f string, clean long, toxic long").groupBy("f").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # What has no more than chance behind it stays on the executors.
    rows = counted.where((F.col("f") == "") | ((F.col("toxic") >= LEAST_DOCS) & (F.col("toxic") > F.col("clean")))).collect()
    total = next(((r["clean"], r["toxic"]) for r in rows if r["f"] == ""), (0, 0))
    if not total[0] or not total[1]:
        share = total[1] / max(1, sum(total))
        return Toxicity(model, {}, [math.log(max(share, 1e-9) / max(1 - share, 1e-9)), 0.0, 0.0])
    odds = {r["f"]: math.log((r["toxic"] + 0.5) / (total[1] + 1)) - math.log((r["clean"] + 0.5) / (total[0] + 1))
            for r in rows if r["f"]}
    impure = _explained({r["f"]: (r["clean"], r["toxic"]) for r in rows})
    tox = Toxicity(model, {f: s for f, s in sorted(odds.items()) if s > 2 and f not in impure}, [0.0, 0.0, 0.0])
    fitted = docs.sparkSession.sparkContext.broadcast(tox)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            xs = [fitted.value.inputs(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"label": batch.column("label"), "a": pa.array([x[0] for x in xs], pa.float64()),
                                              "b": pa.array([x[1] for x in xs], pa.float64())})

    got = sorted(tuple(r) for r in sample.mapInArrow(inputs, "label int, a double, b double").collect())
    x = np.array([(1.0, a, b) for _, a, b in got])
    tox.weights = _logistic(x, np.array([float(label > 0) for label, _, _ in got])).tolist()
    return tox


def score_toxicity(docs: DataFrame, tox: Toxicity, text_col: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: more toxic) and predicted (1 if score >= 0.5)."""
    shared = docs.sparkSession.sparkContext.broadcast(tox)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    scored = docs.withColumn("score", F.pandas_udf(run, "double")(docs[text_col]))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every document scored with what the labels not held out teach."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    tox = train(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    scored = score_toxicity(docs, tox)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"),
                         "score", "predicted")
