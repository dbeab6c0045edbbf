import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tradewind.llm import align

PATHS = P.path(align.VOCABULARY_A), P.path(align.VOCABULARY_B)
SMOKE = "/root/testdata/sf0.001"
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_alphabet():
    """The bytes that the characters of byte-level vocabularies stand for."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def plain_tokens(libraries, text):
    """(id, bytes) of A and B over a space and the text, by the libraries on the whole text."""
    a, b = libraries
    enc = a.encode(" " + text, add_special_tokens=False)
    decode = byte_alphabet()
    of_a = [(i, bytes(decode[c] for c in a.id_to_token(i))) for i in enc.ids]
    of_b = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        of_b.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    return of_a, of_b


def brute_force(libraries, docs):
    per_doc, counts = [], Counter()
    for doc_id, text in docs:
        groups = []
        if text:
            a, b = plain_tokens(libraries, text)
            if b"".join(w for _, w in a) == f" {text}".encode() == b"".join(w for _, w in b):
                ends = []
                for tokens in (a, b):
                    at, out = 0, []
                    for i, w in tokens:
                        at += len(w)
                        out.append((i, at))
                    ends.append(out)
                cuts = sorted({e for _, e in ends[0]} & {e for _, e in ends[1]})
                groups = [[[i for i, e in side if lo < e <= hi] for side in ends] for lo, hi in zip([0, *cuts], cuts, strict=False)]
        pairs = [(x, y) for g in groups for x in g[0] for y in g[1]]
        counts.update(set(pairs))
        per_doc.append((doc_id, groups, pairs))
    highest = {}
    for (x, _), n in counts.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for doc_id, groups, pairs in per_doc:
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(pairs),
                    sum(counts[p] == highest[p[0]] for p in pairs), sum(counts[p] for p in pairs),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


PARTS = ["a", "the", "ing", " ", "  ", "\n", "\t ", " \n", "'s", "é", "漢", "😀", "1", "23", "!", "\x1c", "\xa0", "　", "<|endoftext|>", "<s>",
         "$$$", "\x00", " Wort", "-", "ﬁ", "é"]
DOCS = [(1, None), (2, ""), (3, " "), (4, " a"), (5, "a "), (6, "Hello  world\n\nthis is"), (7, "has ▁ mark"), (8, "x" * 3000), (9, "=" * 700 + " é" * 400),
        (10, "漢字仮名" * 300), (11, "copy of a text"), (11, "copy of a text"), (None, "no id"), (12, "<|endoftext|> </s> <0x41>"), (13, "word other " * 300)]


def random_docs(n, seed=5):
    rng = random.Random(seed)
    return [(100 + k, "".join(rng.choice(PARTS) for _ in range(rng.choice([1, 3, 20, 200])))) for k in range(n)]


def test_any_tree_gives_the_document(libraries):
    with open(PATHS[0], encoding="utf-8") as a, open(PATHS[1], "rb") as b:
        pair = align.Pair(a.read(), b.read())
    rng = random.Random(2)
    for _, text in [*DOCS, *random_docs(40)]:
        for size in (1, 3, 16, 100):
            parts = next(pair.documents([text], size))
            if not parts:
                continue
            flat = align.whole(align.fragment(*pair.tokens([text])[0], pair.size_b), pair.size_b)
            while len(parts) > 1:  # neighbours in any order
                k = rng.randrange(len(parts) - 1)
                parts[k:k + 2] = [align.Fragment.unpack(align.compose(parts[k], parts[k + 1], pair.size_b).pack())]
            f = align.whole(parts[0], pair.size_b)
            assert (f.n_a, f.n_b, f.n_groups, f.groups, f.prefix, f.suffix) == (flat.n_a, flat.n_b, flat.n_groups, flat.groups, ([], []), ([], []))
            assert [x.tolist() for x in align.merged(f.keys, f.times)] == [x.tolist() for x in align.merged(flat.keys, flat.times)]
            empty = align.Fragment()
            assert align.compose(empty, f, pair.size_b).groups == align.compose(f, empty, pair.size_b).groups == f.groups


@pytest.mark.parametrize("size", [align.RANGE, 64])
def test_equal_to_brute_force(spark, libraries, monkeypatch, size):
    monkeypatch.setattr(align, "LOOKUP_BYTES", 1000 if size == 64 else align.LOOKUP_BYTES)  # several tasks a bucket
    monkeypatch.setattr(align, "SUMMED", 50 if size == 64 else align.SUMMED)
    docs = DOCS + random_docs(60)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, n_a string, batch int").repartition(3)
    assert rows_of(align.align(df, *PATHS, size=size)) == brute_force(libraries, docs)


def test_empty_table(spark):
    assert align.align(spark.createDataFrame([], "doc_id long, text string"), *PATHS).count() == 0


def test_query(spark, libraries):
    docs = [tuple(r) for r in spark.read.parquet(f"{SMOKE}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(align.op11_tokenizer_alignment(spark, SMOKE)) == brute_force(libraries, docs)
