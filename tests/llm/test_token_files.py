import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tradewind.llm import id_coder, token_files, words

PATH = P.path(token_files.VOCABULARY)
SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def expected(library, docs):
    """start, n_tokens and crc32 of each document in ascending order, by the plainest means."""
    out, start = [], 0
    for doc_id, text in docs:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, token_files.END]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_coder_round_trip(data):
    size = data.draw(st.sampled_from([1, 2, 3, 50, 5000]))
    length = data.draw(st.integers(1, 200))
    rng = np.random.default_rng(data.draw(st.integers(0, 9)))
    blocks = [rng.integers(0, size, length) if k % 2 else np.arange(length) % size for k in range(data.draw(st.integers(1, 5)))]
    blocks.append(rng.integers(0, size, data.draw(st.integers(1, length))))
    coded = id_coder.encode(blocks, size)
    back = id_coder.decode(coded, [len(b) for b in blocks], size)
    assert all((a == b).all() for a, b in zip(blocks, back, strict=True))
    # A block's bytes do not depend on its neighbours.
    assert coded[-1] == id_coder.encode(blocks[-1:], size)[0]


def test_coder_learns():
    repeated = np.tile(np.arange(20), 200)
    noise = np.random.default_rng(1).integers(0, 1000, 4000)
    a, b = (len(id_coder.encode([x], 1000)[0]) * 8 / 4000 for x in (repeated, noise))
    assert a < 1 and b < np.log2(1000) + 2
    carries = np.zeros(4096, np.int64)  # the same id again and again: the interval stays next to a carry
    carries[::700] = 999
    assert (id_coder.decode(id_coder.encode([carries], 1000), [4096], 1000)[0] == carries).all()


def test_words_give_the_librarys_ids(library):
    rng, own = random.Random(3), words.WordEncoder(open(PATH, encoding="utf-8").read(), limit=2000)
    parts = ["a", "the", "ing", " ", "  ", "\n", "\t ", " \n", "'s", "é", "漢", "😀", "1", "23", "!", "\x1c", "\x85", "\xa0", " ",
             "　", "<|endoftext|>", "$$$", "\x00", " Wort", "-", "\r\n"]
    for _ in range(60):
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(40)]
        for text, ids in zip(texts, own.encode(texts), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


DOCS = [(None, "no id"), (-5, "neg ative"), (1, None), (2, ""), (3, "Héllo 😀 world  two\n lines "), (4, "word " * 30000), (5, "x" * 50000),
        (6, "<|endoftext|> inside")] + [(9, "copy of one text")] * 40


def test_files_and_back(spark, library):
    rows = DOCS[:]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n_tokens int, start string")
    for kw in ({}, {"file_bytes": 20_000, "file_ids": 3000}):
        manifest = token_files.write_files(df, PATH, **kw)
        files = manifest.orderBy("part", "seq").collect()
        assert (len(files) > 5) == bool(kw)
        got = token_files.read_files(manifest, with_ids=True).orderBy("start").collect()
        assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == expected(library, DOCS)
        assert all(r.ids[:-1] == library.encode(t or "", add_special_tokens=False).ids for r, (_, t) in zip(got, DOCS, strict=True))
    path = files[0].path
    data = bytearray(open(path, "rb").read())
    for k in (9, 20, 70, len(data) - 3):  # header, index, block
        broken = data[:]
        broken[k] ^= 1
        with pytest.raises(ValueError, match="token file"):
            token_files.unpack_file(bytes(broken))
    assert token_files.read_files(token_files.write_files(df.limit(0), PATH)).count() == 0


def test_query(spark, library):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").orderBy("doc_id").collect()
    got = token_files.op13_token_id_output(spark, SMOKE).orderBy("start").collect()
    assert [tuple(r) for r in got] == expected(library, [(d.doc_id, d.text) for d in docs])
