"""Secret scan by one combined deterministic automaton (operator 1).

All rules are compiled into one automaton over bytes: each rule's pattern is
reversed, the rules are joined behind "any bytes", made deterministic by subset
construction and minimised by partition refinement. One pass over a text's
bytes, from the end to the start, then marks every byte at which a match of a
rule begins. From each marked byte that the last match of the rule has not
consumed, the rule's own forward automaton finds the longest match: leftmost
longest matches that do not overlap, for each rule by itself. Only marked
places are visited twice.

A rule is a head and a body pattern; the secret is what the body matches, and a
match whose body is shorter than ``min_body`` is consumed but not reported.
Patterns know literals, escapes (``\\xNN``), classes, groups, ``|`` and the
repeats ``? * + {m} {m,} {m,n}``, over ASCII.

Defined cases: a null text is empty, an empty text has no spans; bytes outside
ASCII match nothing and offsets count code points; every row is scanned by
itself, so repeated rows get equal spans; a column of the result's name is
replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.llm.common import read


@dataclass(frozen=True)
class Rule:
    kind: str
    head: str
    body: str
    min_body: int = 1


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The base patterns.
BASE_RULES = (
    Rule("assign", "(" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
         + ")[\"']?\\x20*[:=]\\x20*[\"']?", "[A-Za-z0-9+/_.=-]+", 12),
    Rule("access", "", "AKIA[A-Z0-9]+", 18),
    Rule("hex", "", "[0-9a-f]{16,}"),  # a run is maximal, so the least length can stand in the pattern
)


# --- pattern -> tree -> nondeterministic automaton ---

class _Parser:
    """Pattern -> ('set', bytes) | ('cat', [..]) | ('alt', [..]) | ('rep', tree, least, most or None)."""

    def __init__(self, pattern: str):
        self.s, self.i = pattern, 0

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        found = [self.sequence()]
        while self.peek() == "|":
            self.take()
            found.append(self.sequence())
        return ("alt", found) if len(found) > 1 else found[0]

    def sequence(self):
        found = []
        while self.peek() not in ("", "|", ")"):
            found.append(self.repeat(self.atom()))
        return ("cat", found)

    def repeat(self, tree):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            if c == "{":
                end = self.s.index("}", self.i)
                least, comma, most = self.s[self.i:end].partition(",")
                self.i = end + 1
                tree = ("rep", tree, int(least), (int(most) if most else None) if comma else int(least))
            else:
                tree = ("rep", tree, int(c == "+"), 1 if c == "?" else None)
        return tree

    def char(self) -> int:
        c = self.take()
        if c == "\\":
            c = self.take()
            if c == "x":
                self.i += 2
                return int(self.s[self.i - 2:self.i], 16)
            if c.isalnum():
                raise ValueError(f"unknown escape \\{c}")
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            tree = self.alternatives()
            self.take()
            return tree
        if self.peek() != "[":
            return ("set", frozenset([self.char()]))
        self.take()
        found = set()
        while self.peek() != "]":
            a = b = self.char()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                b = self.char()
            found.update(range(a, b + 1))
        self.take()
        return ("set", frozenset(found))


def parse(pattern: str):
    p = _Parser(pattern)
    tree = p.alternatives()
    if p.i != len(pattern):
        raise ValueError(f"cannot read {pattern!r} beyond {p.i}")
    return tree


def _reversed(tree):
    kind = tree[0]
    if kind == "cat":
        return ("cat", [_reversed(t) for t in reversed(tree[1])])
    if kind == "alt":
        return ("alt", [_reversed(t) for t in tree[1]])
    return ("rep", _reversed(tree[1]), *tree[2:]) if kind == "rep" else tree


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int) -> int:
        """Build ``tree`` from state ``at``; the state after it."""
        kind = tree[0]
        if kind == "set":
            end = self.state()
            self.moves[at].append((tree[1], end))
            return end
        if kind == "cat":
            for t in tree[1]:
                at = self.add(t, at)
            return at
        end = self.state()
        if kind == "alt":
            for t in tree[1]:
                start = self.state()
                self.empty[at].append(start)
                self.empty[self.add(t, start)].append(end)
            return end
        _, t, least, most = tree
        for _ in range(least):
            at = self.add(t, at)
        self.empty[at].append(end)
        if most is None:
            loop = self.state()
            self.empty[at].append(loop)
            back = self.add(t, loop)
            self.empty[back] += [loop, end]
        else:
            for _ in range(most - least):
                at = self.add(t, at)
                self.empty[at].append(end)
        return end


# --- subset construction and minimisation ---

@dataclass(frozen=True)
class Automaton:
    """``step[state * n_classes + class]`` is the next state times n_classes; states from
    ``first_accepting`` on accept, state ``dead`` (or -1) never will."""
    classes: bytes
    n_classes: int
    step: list[int]
    start: int
    first_accepting: int
    accepts: dict[int, tuple[int, ...]]
    dead: int


def compile_automaton(patterns: list, anywhere: bool) -> Automaton:
    """Trees -> one minimal automaton that tells which of them accept. ``anywhere``:
    a match may begin at any byte of what is read."""
    nfa = _Nfa()
    root = nfa.state()
    if anywhere:
        nfa.moves[root].append((frozenset(range(256)), root))
    ends = {}
    for k, tree in enumerate(patterns):
        start = nfa.state()
        nfa.empty[root].append(start)
        ends[nfa.add(tree, start)] = k

    # Bytes that no set tells apart share a class.
    sets = sorted({m[0] for moves in nfa.moves for m in moves}, key=sorted)
    signature = {b: tuple(b in s for s in sets) for b in range(256)}
    ids = {sig: i for i, sig in enumerate(dict.fromkeys(signature.values()))}
    classes, n = bytes(ids[signature[b]] for b in range(256)), len(ids)
    member = {classes[b]: b for b in range(256)}

    def closure(states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in found:
                    found.add(t)
                    todo.append(t)
        return frozenset(found)

    first = closure([root])
    number, order, table = {first: 0}, [first], []
    for subset in order:
        row = []
        for c in range(n):
            target = closure({t for s in subset for allowed, t in nfa.moves[s] if member[c] in allowed})
            if target not in number:
                number[target] = len(order)
                order.append(target)
            row.append(number[target])
        table.append(row)
    marks = [tuple(sorted(ends[s] for s in subset if s in ends)) for subset in order]

    # Refine: states stay together while marks and the blocks they step to agree.
    t = np.array(table, dtype=np.int64)
    _, block = np.unique(np.array([hash(m) for m in marks]), return_inverse=True)
    while True:
        keys = np.column_stack([block, block[t]])
        _, finer = np.unique(keys, axis=0, return_inverse=True)
        finer = finer.reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    member_of = {int(b): i for i, b in reversed(list(enumerate(block)))}
    ranked = sorted(member_of, key=lambda b: (bool(marks[member_of[b]]), b))
    new = {b: i for i, b in enumerate(ranked)}
    step = [new[int(block[x])] * n for b in ranked for x in table[member_of[b]]]
    dead = next((i * n for i in range(len(ranked)) if not marks[member_of[ranked[i]]]
                 and all(s == i * n for s in step[i * n:(i + 1) * n])), -1)
    accepts = {i * n: marks[member_of[b]] for i, b in enumerate(ranked) if marks[member_of[b]]}
    return Automaton(classes, n, step, new[int(block[0])] * n, min(accepts, default=1 << 60), accepts, dead)


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    starts: Automaton
    whole: tuple[Automaton, ...]
    heads: tuple[Automaton, ...]

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then rule order."""
        a, marked = self.starts, []
        step, limit, s = a.step, a.first_accepting, a.start
        for i, c in enumerate(data[::-1].translate(a.classes)):
            s = step[s + c]
            if s >= limit:
                marked.append((i, s))
        if not marked:
            return []
        size, found = len(data), []
        done = [0] * len(self.rules)
        for i, state in reversed(marked):
            at = size - 1 - i
            for k in a.accepts[state]:
                if at < done[k]:
                    continue
                end = _longest(self.whole[k], data, at)
                done[k] = end
                body = _longest(self.heads[k], data, at)
                if end - body >= self.rules[k].min_body:
                    found.append((at, k, end))
        found.sort()
        out, seen, chars = [], 0, 0
        for at, k, end in found:
            chars += _code_points(data[seen:at])
            seen = at
            out.append((self.rules[k].kind, chars, chars + _code_points(data[at:end])))
        return out


def _code_points(data: bytes) -> int:
    return len(data) if data.isascii() else sum(b & 0xC0 != 0x80 for b in data)


def _longest(a: Automaton, data: bytes, at: int) -> int:
    """End of the longest match of ``a`` that begins at ``at`` (``at`` if there is none)."""
    s, end = a.start, at
    for i in range(at, len(data)):
        s = a.step[s + a.classes[data[i]]]
        if s == a.dead:
            break
        if s >= a.first_accepting:
            end = i + 1
    return end


@cache
def scanner(rules: tuple[Rule, ...] = BASE_RULES) -> Scanner:
    trees = [("cat", [parse(r.head), parse(r.body)]) for r in rules]
    return Scanner(rules, compile_automaton([_reversed(t) for t in trees], True),
                   tuple(compile_automaton([t], False) for t in trees),
                   tuple(compile_automaton([parse(r.head)], False) for r in rules))


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def find_secrets(docs: DataFrame, text_col: str = "text", out: str = "secrets",
                 rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``docs`` with column ``out``: the spans of all rules, by start, then rule order."""

    @F.pandas_udf(SPANS)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        find = scanner(rules)
        for batch in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in find.spans(t)] if t else []
                             for t in batch])

    return docs.withColumn(out, scan(docs[text_col].cast("binary")))


def redact(docs: DataFrame, text_col: str = "text", out: str = "secrets",
           rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``find_secrets`` with every span replaced by ``[KIND]`` in the text, in the same pass;
    of spans that overlap, the first by start (then the longest) names their union."""

    def cut(t: str, found: list[tuple[str, int, int]]) -> str:
        parts, at = [], 0
        for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [t[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        return "".join(parts) + t[at:]

    @F.pandas_udf(f"text string, spans {SPANS}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        find = scanner(rules)
        for batch in batches:
            found = [find.spans(t.encode()) if t else [] for t in batch]
            yield pd.DataFrame({
                "text": [cut(t, s) if s else t for t, s in zip(batch, found, strict=True)],
                "spans": [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]})

    done = docs.withColumn("_redacted", scan(docs[text_col]))
    return done.withColumns({text_col: F.col("_redacted.text"), out: F.col("_redacted.spans")}).drop("_redacted")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the base spans of every document."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = find_secrets(docs).select("doc_id", "secrets")
    joined = F.array_join(F.transform("secrets", lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


# The base patterns as DuckDB reads them.
_SQL_RULES = (
    ("assign", 0, r"((?:" + "|".join(map(_any_case, ("password", "passwd", "secret", "token", "api_?key")))
     + r")[\"'']?\x20*[:=]\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)", 12),
    ("access", 1, r"()(AKIA[A-Z0-9]+)", 18),
    ("hex", 2, r"()([0-9a-f]{16,})", 16),
)


def _sql_spans(kind: str, k: int, pattern: str, least: int) -> str:
    # Pieces between matches and the matches themselves alternate; running sums of lengths give offsets.
    return f"""
  SELECT rid, '{kind}' AS kind, {k} AS k, body, CAST(sum(gap) OVER w + coalesce(sum(n) OVER p, 0) AS BIGINT) AS start, n
  FROM (SELECT rid, i, length(gap) AS gap, length(found) AS n, length(body) AS body
    FROM (SELECT rid, generate_subscripts(gaps, 1) AS i, unnest(gaps) AS gap, unnest(found) AS found, unnest(bodies) AS body
      FROM (SELECT rid, string_split_regex(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}', 0) AS found,
          regexp_extract_all(text, '{pattern}', 2) AS bodies FROM doc))
    WHERE found IS NOT NULL)
  WINDOW w AS (PARTITION BY rid ORDER BY i), p AS (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""


ORACLE = f"""
WITH doc AS (SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id, coalesce(text, '') AS text FROM documents),
span AS (
  SELECT rid, kind, k, start, start + n AS stop FROM ({' UNION ALL '.join(_sql_spans(*r) for r in _SQL_RULES)})
  WHERE body >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 ELSE 16 END
), found AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
    count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k) AS spans
  FROM span GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN found USING (rid)
"""
