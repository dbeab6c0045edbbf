import random
from collections import defaultdict

from tradewind.llm import suffix_dedup as S


def covered(docs):
    """Words inside 50-word windows that stand in two documents, by brute force."""
    at = defaultdict(set)
    for i, t in docs.items():
        w = t.split()
        for p in range(len(w) - S.MIN_WORDS + 1):
            at[tuple(w[p:p + S.MIN_WORDS])].add(i)
    out = {}
    for i, t in docs.items():
        w = t.split()
        hit = {x for p in range(len(w) - S.MIN_WORDS + 1) if len(at[tuple(w[p:p + S.MIN_WORDS])]) > 1
               for x in range(p, p + S.MIN_WORDS)}
        if hit:
            out[i] = hit
    return out


def found(spark, rows, partitions=None):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = defaultdict(set)
    for r in S.repeated_passages(df).collect():
        out[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert r.n_words == r.end_word - r.start_word and r.partner_id != r.doc_id
        assert r.first == (r.doc_id < r.partner_id)
    return dict(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "SORT_ROWS", 40)  # many partitions, so many edges
    rng = random.Random(4)
    text = lambda n, v=400: " ".join(f"t{rng.randrange(v)}" for _ in range(n))
    common, edge, short = text(73), text(50), text(49)
    docs = {}
    for i in range(40):
        parts = [text(rng.choice([0, 3, 30, 120]))]
        parts += [common] * (i % 3 == 0) + [text(20)] + [edge] * (i % 7 == 0) + [short] * (i % 5 == 0) + [text(15)]
        docs[i] = " ".join(parts)
    docs[50] = docs[51] = text(200)  # whole copies
    docs[52] = docs[50] + " " + text(10)
    docs[53] = " ".join(["same"] * 300)  # repeats inside one document only
    docs[54], docs[55] = "z " + common[: len(common) // 2], "y " + common[len(common) // 2:]
    docs[56] = text(20000, 10**6) + " " + common
    rows = [(i, t, "x") for i, t in docs.items()] + [(None, docs[50], "x"), (90, None, "x"), (91, "", "x"), (0, docs[0], "x")]
    assert found(spark, rows) == covered(docs)


def test_cut_and_empty(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.createDataFrame([(1, "a " + passage), (2, f"b {passage} c"), (3, "other")], "doc_id long, text string")
    cut = {r.doc_id: r.text for r in S.cut_repeats(df, S.repeated_passages(df)).collect()}
    assert cut == {1: "a " + passage, 2: "b  c", 3: "other"}
    assert S.repeated_passages(df.limit(0)).count() == 0


def passages(spark, docs):
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    return df, S.repeated_passages(df)


def words(prefix, n):
    return " ".join(f"{prefix}{i}" for i in range(n))


def test_common_passage_has_one_first(spark, monkeypatch):
    """Whatever words stand around the copies, all but the smallest id are repeats."""
    monkeypatch.setattr(S, "SORT_ROWS", 40)
    rng = random.Random(7)
    noise = lambda: " ".join(f"n{rng.randrange(10**6)}" for _ in range(40))
    common = words("c", 60)
    df, found_rows = passages(spark, {i: f"{noise()} {common} {noise()}" for i in range(1, 301)})
    rows = found_rows.collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.partner_id, r.first) for r in rows} == {
        (i, 40, 100, 1 if i > 1 else 2, i == 1) for i in range(1, 301)}
    assert sum(common in r.text for r in S.cut_repeats(df, found_rows).collect()) == 1


def test_joined_passages_keep_their_own_first(spark):
    """A document that joins passages of two others, side by side and overlapping."""
    p, q, r = words("p", 60), words("q", 60), words("r", 70).split()
    docs = {3: p + " x", 5: f"{p} {q}", 9: "y " + q, 13: " ".join(r[:55]) + " x", 15: " ".join(r), 19: "y " + " ".join(r[15:])}
    df, found_rows = passages(spark, docs)
    assert {tuple(x) for x in found_rows.collect()} == {
        (3, 0, 60, 60, 5, True), (5, 0, 60, 60, 3, False), (5, 60, 120, 60, 9, True), (9, 1, 61, 60, 5, False),
        (13, 0, 55, 55, 15, True), (15, 0, 55, 55, 13, False), (15, 55, 70, 15, 19, True), (19, 1, 56, 55, 15, False)}
    left = " ".join(x.text for x in S.cut_repeats(df, found_rows).collect()).split()
    assert sorted(w for w in left if w not in "xy") == sorted([*p.split(), *q.split(), *r])


def test_smallest_of_several_copies(spark):
    text = words("t", 60)
    _, found_rows = passages(spark, {7: text, 4: text, 9: text, 2: "a " + text[text.index("t5 "):], 11: text + " z"})
    assert {(r.doc_id, r.start_word, r.end_word, r.partner_id) for r in found_rows.collect()} == {
        (2, 1, 56, 4), (4, 0, 5, 7), (4, 5, 60, 2), (7, 0, 5, 4), (7, 5, 60, 2), (9, 0, 5, 4), (9, 5, 60, 2), (11, 0, 5, 4), (11, 5, 60, 2)}


def test_other_texts_between(spark):
    """Repeats whose neighbours in both sort orders share more on one side and less on the other."""
    rng = random.Random(11)
    noise = lambda n: [f"n{rng.randrange(10**6)}" for _ in range(n)]
    docs = {}
    for i in range(25):
        a, x, b = ([f"{c}{i}_{j}" for j in range(n)] for c, n in (("a", 6), ("x", 40), ("b", 6)))
        for j, text in enumerate([a + x + b, a[1:] + x + b[:5], x + b, a + x]):
            # More texts of C's and D's kind stand around A in either order.
            for copy in range(1 if j < 2 else 4):
                docs[100 * i + 10 * j + copy] = " ".join(noise(30) + text + noise(30))
    assert found(spark, [(i, t, "x") for i, t in docs.items()]) == covered(docs)
