import random
import re

from pyspark.sql import functions as F

from tradewind.llm import secrets as S

PATTERNS = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": ("AKIA[A-Z0-9]+", 0, 18), "hex": ("[0-9a-f]+", 0, 16)}


def brute(text):
    found = []
    for k, (kind, (p, group, least)) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text, re.A | (re.I if kind == "assign" else 0)):
            if len(m.group(group)) >= least:
                found.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def test_scan_equals_backtracking_search():
    rng = random.Random(1)
    parts = ["password", "Secret", "token", "api_key", "APIKEY", "passwd", ":", "=", " ", '"', "'", "AKIA", "ABCDEF0123456789XYZ",
             "deadbeef0123456", "abc", "é", "😀", "0123456789abcdef", "-", "_", "/", "x", "\x00", "\n"]
    find = S.scanner().spans
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 6, 40])))
        assert find(text.encode()) == brute(text), text


def test_other_rules_and_minimal_automaton():
    rules = (S.Rule("pair", "(ab|a)", "(bc|c)+", 2), S.Rule("many", "", "[xy]{2,3}z?"))
    find = S.scanner(rules).spans  # "abc" is a match, but its body "c" is too short
    assert find(b"abcbc abc axyz yyyy") == [("pair", 0, 5), ("many", 11, 14), ("many", 15, 18)]
    one, two = (S.compile_automaton([S.parse(p)], False) for p in ("(a|b)c", "ac|bc"))
    assert len(one.step) == len(two.step)


def test_operator_keeps_rows_and_redacts(spark):
    rows = [(1, None, "q"), (2, "", "q"), (3, "é token=abcdefghijklmnop.", "q"), (3, "é token=abcdefghijklmnop.", "q"),
            (4, "x" * 200_000 + " deadbeefdeadbeef", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string")  # the result's name is taken
    out = S.redact(df).orderBy("doc_id").collect()
    assert [len(r.secrets) for r in out] == [0, 0, 1, 1, 1]
    assert [r.text for r in out[:4]] == [None, "", "é [ASSIGN]", "é [ASSIGN]"] and out[4].text.endswith("x [HEX]")
    assert S.find_secrets(df.where(F.lit(False))).count() == 0
