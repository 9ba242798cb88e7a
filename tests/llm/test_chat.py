import hashlib

import pytest
from pyspark.sql import functions as F

from neighborflow.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, valid string"


def run(spark, rows, template=chat.DEFAULT):
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    return {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df, template), template).collect()}, chat.format_chats(df, template)


def test_round_trip_of_anything(spark):
    nasty = ["### Assistant: </turn> ok", "\\", "\\\\b\\0", "</turn>\n", " </turn>\n### User: x", "", "### ### User:: >:", "\\### Assistant: </turn> ok", "<\\b>\\5", "日本 🙂"]
    rows = [(i, j, ("user", "assistant")[j % 2], t) for i in range(3) for j, t in enumerate(nasty[i:] + nasty[:i])]
    rows += [(9, 0, "odd>: role\\", "x"), (9, 1, None, None)]
    got, _ = run(spark, rows)
    for i in range(3):
        want = [t for t in nasty[i:] + nasty[:i]]
        assert [t["text"] for t in got[i]["turns"]] == want
        assert got[i]["loss_text"] == "".join(want[1::2])
    assert [(t["role"], t["text"]) for t in got[9]["turns"]] == [("odd>: role\\", "x"), ("", "")]
    assert got[9]["loss_text"] == ""


def test_machine(spark):
    say = lambda c, roles: [(c, i, r, str(i)) for i, r in enumerate(roles)]
    rows = say(1, ["system", "user", "assistant"]) + say(2, ["assistant"]) + say(3, ["user", "user", "assistant"]) + say(4, ["user"]) + say(5, ["user", "assistant", "system"]) + say(6, ["tool"])
    got, _ = run(spark, rows)
    assert {c: (r["valid"], r["bad_turn"]) for c, r in got.items()} == {1: (True, None), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, 2), 6: (False, 0)}


def test_order_ties_and_segments(spark):
    got, formatted = run(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, "system", "s")])
    assert [t["text"] for t in got[1]["turns"]] == ["s", "a", "a", "z", "b"]
    row = formatted.first()
    assert "".join(s["text"] for s in row["segments"]) == row["formatted"]
    assert [s["text"] for s in row["segments"] if s["loss"]] == ["b"]


def test_empty_and_digests(spark):
    got, formatted = run(spark, [])
    assert got == {}
    df = spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "é\\", "")], SCHEMA)
    d = chat.digests(chat.read_back(chat.format_chats(df))).first()
    assert d["turns_sha256"] == hashlib.sha256("user\nq\nassistant\né\\\n".encode()).hexdigest()
    assert d["loss_chars"] == 2 and d["loss_sha256"] == hashlib.sha256("é\\".encode()).hexdigest()


def test_own_template_and_its_checks(spark):
    t = chat.ChatTemplate(heads={"q": "[Q]", "a": "[A]"}, any_head="[R:", any_end="]", end="[/]", loss=("a",), moves={"start": {"q": "asked"}, "asked": {"a": "done"}}, final=("done",))
    got, _ = run(spark, [(1, 0, "q", "[A] [/] ]"), (1, 1, "a", "[R:x]"), (2, 0, "z]", "[Q]")], t)
    assert [x["text"] for x in got[1]["turns"]] == ["[A] [/] ]", "[R:x]"] and got[1]["valid"]
    assert got[2]["turns"][0]["role"] == "z]"
    for bad in ({"end": "aba"}, {"end": "\\x"}, {"heads": {"q": "[", "a": "[A]"}}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**bad)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 0, "user", "q", "")], SCHEMA)
    plan = chat.digests(chat.read_back(chat.format_chats(df)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
    assert F is not None
