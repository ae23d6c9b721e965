"""Chat windows: read back whole, within the budget, each target once."""

import random

from pyspark.sql import functions as F

from sluice.llm.chat import MARK_TOKENS, escape, format_chats, read_loss, read_turns, unescape

SCHEMA = "conv_id long, turn long, role string, text string, n_turns string"


def _tokens(text):
    return -(-len(text or "") // 4) + MARK_TOKENS


def test_escape_is_reversible_and_leaves_no_marks(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices(["<s>[", "]", "</s>", "[INST]", "\\", "[", "<", "a", "é", "\n", "$1"], k=rnd.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escape(F.col("t")).alias("e")).withColumn("back", unescape(F.col("e")))
    for r in df.collect():
        assert r["back"] == r["t"] and "</s>" not in r["e"] and "<s>" not in r["e"] and "[INST]" not in r["e"]


def _check(spark, rows, budget, history):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    out = format_chats(df, budget=budget, history_tokens=history)
    assert out.columns == ["conv_id", "first_turn", "n_repeated", "n_turns", "tokens", "text", "loss"]
    out = out.select("*", read_turns(F.col("text")).alias("turns"), read_loss(F.col("text"), F.col("loss")).alias("learnt"))
    windows, said = {}, {}
    for r in out.orderBy("first_turn").collect():
        windows.setdefault(r["conv_id"], []).append(r)
    for c, turn, role, text in rows:
        said.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    assert windows.keys() == said.keys()
    for c, turns in said.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        new = [(t["role"], t["text"]) for w in windows[c] for t in w["turns"][w["n_repeated"] :]]
        assert new == turns
        assert [t for w in windows[c] for t in w["learnt"]] == [t for r, t in turns if r == "assistant"]
        for w in windows[c]:
            assert w["n_turns"] == len(w["turns"]) and w["tokens"] == sum(_tokens(t["text"]) for t in w["turns"])
            first = [(t["role"], t["text"]) for t in w["turns"]]
            if turns[0][0] == "system":
                assert first[0] == turns[0]
            held = first[: w["n_repeated"]][int(turns[0][0] == "system" and w["first_turn"] > 0) :]
            assert len(held) <= 2 and held == turns[w["first_turn"] - len(held) : w["first_turn"]]
            assert sum(_tokens(t) for _, t in held) <= history
            assert w["tokens"] <= budget or w["n_turns"] - w["n_repeated"] == 1
    return windows


def test_windows(spark):
    rnd = random.Random(2)
    rows = []
    for c in range(40):
        for i in range(rnd.randint(1, 30)):
            role = "system" if i == 0 and c % 2 else rnd.choice(["user", "assistant", "tool [x]", None])
            rows.append((c, i, role, rnd.choice(["</s>[INST] ok", "é" * rnd.randint(0, 300), "", None, "x" * 900 if rnd.random() < 0.1 else "y"])))
    windows = _check(spark, rows, 200, 40)
    assert sum(map(len, windows.values())) > 60


def test_one_very_long_conversation(spark):
    rows = [(5, i, "user" if i % 2 else "assistant", f"turn {i} " * (i % 9)) for i in range(3000)] + [(6, 0, "assistant", "z" * 50_000)]
    _check(spark, rows, 100, 20)


def test_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 1, "assistant", "b"), (1, None, "assistant", "c"), (1, 0, None, None), (1, 0, None, None), (1, 0, "user", "d"), (2, 3, "system", "s"), (2, 3, "system", "s")]
    _check(spark, rows, 1024, 256)
    assert format_chats(spark.createDataFrame([], SCHEMA)).collect() == []
