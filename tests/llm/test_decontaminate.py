import pytest

from tradewind.llm import decontaminate as D


@pytest.mark.parametrize("most_bytes", [None, 0])
def test_common_prompt_is_not_broadcast_with_its_items(spark, monkeypatch, most_bytes):
    """Windows that every item holds: what is broadcast has no item ids, the hits have them all."""
    if most_bytes is not None:
        monkeypatch.setattr(D, "BROADCAST_BYTES", most_bytes)
    sent, broadcast = [], D.F.broadcast
    monkeypatch.setattr(D.F, "broadcast", lambda df: sent.append(set(df.columns)) or broadcast(df))
    prompt = " ".join(f"p{i}" for i in range(20))
    items = spark.createDataFrame([(i, f"{prompt} own{i} words{i}") for i in range(50)] + [(50, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {prompt} b"), (2, f"{prompt} own7 words7"), (3, "one short item more"), (4, "none")],
                                 "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in D.decontaminate(docs, items).collect()}
    every = sorted(str(i) for i in range(50))
    assert got == {1: (20, every), 2: (22, every), 3: (2, ["50"]), 4: (0, [])}
    assert sent and not any({"item_id", "item_ids"} & c for c in sent)
    assert most_bytes is None or sent == [{"h"}]
