"""Each query with SQL text against DuckDB, on a whole small data folder and on awkward rows."""
import os

import duckdb
import pytest

SMOKE = "/root/testdata/sf0.001"
KEYS = ["op1_secret_scans", "op2_exact_top_k", "op7_benchmark_decontamination", "op9_chat_formatting",
        "op10_minhash_near_dedup", "op12_prefix_trie"]

P25 = " ".join(f"w{i}" for i in range(25))
LONG = " ".join(f"x{i % 977}" for i in range(30000))
DOCS = [
    (1, P25 + " tail one"), (2, P25 + " tail one"), (3, P25.upper() + " TAIL\tone"), (4, P25 + " tail two three"),
    (5, None), (6, ""), (7, " \n\t "), (8, "two words"), (9, "two words"), (10, "Two\x0bWords"), (11, "é　é é"),
    (12, LONG), (13, LONG + " end"), (14, "password = 'abcdefghijkl' AKIAABCDEFGHIJKLMN0 deadbeefdeadbeef"),
    (15, "token: secret: abcdefghijklmnop; 😀 PassWd:=0123456789abcdef"), (16, "a1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13 n14"),
    (17, "short item here, and A1-b2"), (18, "SHORT item"), (19, "a\x00b c\x7fd"),
]
BENCH = [("i1", "A1 b2 c3 d4 e5 f6 g7 h8 i9 j10 k11 l12 m13"), ("i2", "Short Item!"), ("i2", "Short Item!"),
         ("i10", "short item"), (None, "tail one"), ("i4", None), ("i5", "!!!"), ("i6", LONG[:400])]
CONVS = [(1, 0, "user", "a<|im_end|>\n"), (1, 1, "assistant", "b"), (1, 2, "assistant", "c\\|[INST]"), (1, 2, "assistant", "c\\|[INST]"),
         (2, None, "user", None), (2, 0, None, "x"), (2, 0, "ro\nle", "<|im_sep|>"), (3, 0, "assistant", ""), (None, 0, "assistant", "n"),
         (4, 0, "assistant", "</s><<SYS>>😀" * 500), (4, 1, "system", "\\\\")]
VECS = [(i * 10, [((i * 7 + j * 3) % 11) / 7 - 0.5 for j in range(20)], i) for i in range(40)]
VECS += [(400, VECS[0][1], 0), (401, VECS[0][1], 0), (402, None, 0), (403, [0.1, None], 0), (404, [float("nan")] * 20, 0),
         (405, [float("inf")] * 20, 0), (0, VECS[0][1], 0), (450, [0.5, 1.5], 0), (451, [1.5, 0.5], 0), (None, [1.0] * 20, 0)]


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """The tables with awkward rows, extra columns that clash with the results' names, and copies."""
    d = str(tmp_path_factory.mktemp("odd"))
    docs = [(i, t, "en", "s", None if t is None else len(t), "n_hit", 1) for i, t in DOCS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, item_ids string, score int"
    spark.createDataFrame(docs, schema).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame(CONVS, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    spark.createDataFrame(VECS, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{d}/{t}.parquet")
    return d


def compare(spark, key, d):
    import __spark_entry__ as E
    got = E.queries()[key](spark, d)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        p = f"{d}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    cur = con.execute(E.oracle_sql()[key])
    names = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(names)
    rows = sorted(map(str, (tuple(r[n] for n in names) for r in got.collect())))
    assert rows == sorted(map(str, cur.fetchall()))
    return rows


@pytest.mark.parametrize("key", KEYS)
def test_whole_folder(spark, key):
    assert len(compare(spark, key, SMOKE))


@pytest.mark.parametrize("key", KEYS)
def test_awkward_rows(spark, odd_dir, key):
    assert len(compare(spark, key, odd_dir))


@pytest.mark.parametrize("key", KEYS)
def test_empty_tables(spark, empty_dir, key):
    assert len(compare(spark, key, empty_dir)) == (key == "op9_chat_formatting")
