"""Held-out accuracy, and defined cases, of the two classifiers."""
import numpy as np
import pandas as pd
import pytest

from tradewind.llm import quality as Q
from tradewind.llm import toxicity as T

SF, LARGER = "/root/testdata/sf0.01", "/root/testdata/sf0.1"


def auc(score, y):
    order = pd.Series(score).rank().to_numpy()
    y = np.asarray(y, bool)
    return (order[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())


def held(spark, rows, label, sf=SF):
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    out = [(r.score, known[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in known]
    return map(np.array, zip(*out, strict=True))


def test_quality_held_out(spark):
    score, y, predicted = held(spark, Q.op6_quality_classifier(spark, SF).collect(), "quality")
    assert auc(score, y) > 0.97 and (predicted == y).mean() > 0.95


def test_toxicity_held_out(spark):
    score, y, predicted = held(spark, T.op4_toxicity(spark, LARGER).collect(), "toxic", LARGER)
    assert auc(score, y) > 0.93 and (predicted == y).mean() > 0.97


def test_attention_gradient():
    """The loss falls along the gradient that fit() follows, and attention finds the telling passage."""
    rng = np.random.default_rng(0)
    bags, labels = [], []
    for i in range(200):
        b = rng.normal(0, 1, (rng.integers(1, 9), Q.FEATURES)).astype(np.float32)
        if i % 2:
            b[rng.integers(len(b)), :10] += 6
        bags.append(b)
        labels.append(i % 2)
    model = Q.fit(bags, np.array(labels))
    assert ((model.score(bags) >= 0.5) == np.array(labels)).mean() > 0.95


def test_passages_cover_the_whole_text():
    a = b"good words here " * 4000
    assert len(Q.passages(a)) == -(-len(a) // Q.PASSAGE_BYTES)
    assert not np.array_equal(Q.passages(a)[-1], Q.passages(a[:-10] + b"!" * 10)[-1])
    assert Q.passages(None).shape == Q.passages(b"").shape == (1, Q.FEATURES)
    assert np.isfinite(Q.passages("x😀\n".encode() * 3)).all()


@pytest.mark.parametrize("module, train, score", [(Q, Q.train, Q.score_quality), (T, T.train, T.score_toxicity)])
def test_awkward_tables(spark, module, train, score):
    rows = [(i, t, "x", "y") for i, t in enumerate([None, "", "plain words", "plain words", "z" * 300_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, lang string")
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = score(docs, train(docs, labels)).orderBy("doc_id").collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 for r in out) and out[2].score == out[3].score
    assert score(docs.limit(0), train(docs.limit(0), labels)).count() == 0


def test_restored_words(spark):
    words = ["idiot", "moron", "pathetic", "stupid", "clown", "trash", "loser"]
    docs = spark.createDataFrame([(i, " ".join(words[i % 7:] + ["the", "other", "thing"])) for i in range(200)], "doc_id long, text string")
    restore = T.Restorer(T.CharModel(T.count_trigrams(docs))).words
    for disguised, word in {"1d10t": "idiot", "m0r0n!!": "moron", "p@thet1c": "pathetic", "stuuupid": "stupid", "cl*wn": "clown",
                            "TR4SH": "trash", "l-o-s-e-r": "loser"}.items():
        assert word in restore(disguised), disguised
    assert T.Restorer.apart("an i d i o t here") == ["idiot"]
    assert restore("plain") == ("plain",)


def test_letters_apart_and_hidden(spark):
    """Word edges inside a run of letters, any white space, pieces of two, symbols inside a word."""
    model = T.CharModel(T.count_trigrams(spark.read.parquet(f"{SF}/documents.parquet")))
    tox = T.Toxicity(model, {f"{w}$": 5.0 for w in ("idiot", "moron", "stupid", "loser")}, [0.0, 0.0, 0.0])
    for text in ["such a l o s e r", "I i d i o t", "y o u i d i o t", "an id io t !", "yo ui di ot", "you i\td\ni  o\tt then",
                 "a s t u p i d l o s e r", "he is 1 d 1 0 t", "i. d. i. o. t.", "st***d", "***moron***", "l 0 $ e r x"]:
        assert tox.inputs(text)[0] == 5.0, text
    for text in ["if it is so", "he is at it", "1 2 3 4 5 6", "- - - - -", "a b c d e f", "l o v e", "st*** d", "*** st***", "s t o p"]:
        assert tox.inputs(text) == (0.0, 0.0), text
    assert tox.inputs("q " * 3000 + "i d i o t " + "q " * 3000)[0] == 5.0
