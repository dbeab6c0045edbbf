import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tradewind.llm import bpe

PATH = P.path(bpe.VOCABULARY)


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(PATH)
    return bpe.Encoder(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equal_to_the_library(both):
    own, library = both
    rng = random.Random(1)
    parts = ["a", "the", "ing", " ", "\n", "\t", "'s", "é", "ü", "漢", "😀", "1", "23", "!", "\x1c", "\x85", "\xa0", " ",
             "aaaaaaa", "   ", "$$$", "ß", "مر", "̀", "\x00", "<|endoftext|>", "½"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 3, 20, 300]))) for _ in range(1500)]
    texts += ["".join(chr(rng.randrange(256)) for _ in range(40)) for _ in range(500)]
    texts += ["a" * 5000, " " * 3000, "=" * 10001, "é" * 999, "".join(rng.choice("aab") for _ in range(20000)), "漢字仮名" * 2000]
    for t in texts:
        ids = own.encode(t)
        assert ids.tolist() == library.encode_ordinary(t), t[:80]
        assert own.decode(ids) == t.encode()


def test_every_split_joins_to_the_whole(both):
    own, _ = both
    rng = random.Random(2)
    for _ in range(300):
        data = bytes(rng.choice(b"abcehint  th") for _ in range(rng.randrange(2, 60)))
        cut = rng.randrange(1, len(data))
        assert own.join(own.tokens(data[:cut]), own.tokens(data[cut:])) == bpe.merge(data, own.ranks)


def test_operators(spark, both):
    _, library = both
    rows = [(1, None, "x"), (2, "", "x"), (3, "Héllo 😀 world", "x"), (3, "Héllo 😀 world", "x"), (4, "word " * 40000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # the result's name is taken
    one = bpe.round_trip(df, PATH).orderBy("doc_id").collect()
    two = bpe.decode(bpe.encode(df, PATH), PATH).orderBy("doc_id").collect()
    for r, s, (_, t, _) in zip(one, two, rows, strict=True):
        assert r.ids == s.ids == library.encode_ordinary(t or "")
        assert bytes(r.decoded) == bytes(s.decoded) == (t or "").encode()
    assert bpe.encode(df.limit(0), PATH).count() == 0


def test_query(spark, both):
    _, library = both
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for r in bpe.op8_byte_bpe(spark, "/root/testdata/sf0.001").collect():
        ids = library.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids)).encode()), sha(docs[r.doc_id].encode()))
