import hashlib

import pytest

from auger.llm import chat

ODD = ["", "</turn>", "<\\/turn>", "<\\\\/turn> </turn>\n", "### user: hi</turn>\n### assistant: no", "#\\## user: ", "### ### a: b: ",
       "ends with <", "</turn", "/turn>\n", "###", "### ", "#### x: ", "\\", "\\\\### Assistant: </turn> ok", "a\nb\n\n", "🙂 ### %41+: x",
       "### a</turn>: b", "</turn></turn>\n\n", "$1 \\1 &"]


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def read(spark, rows, schema="conv_id long, turn long, role string, text string, escaped int, out string"):
    df = spark.createDataFrame(rows, schema)
    done = chat.format_conversations(df)
    return {r["conv_id"]: r for r in done.collect()}, {r["conv_id"]: r for r in chat.read_back(done).collect()}


def test_round_trip_of_conflicting_texts(spark):
    roles = ["user", "assistant", "system: x", "### a", None, "", "Rôle <x>"]
    rows = [(c, i, roles[(c + i) % len(roles)], t, 1, "x") for c in range(7) for i, t in enumerate(ODD[c:] + ODD[:c])]
    done, back = read(spark, rows)
    for c in range(7):
        mine = [(r[2] or "", r[3]) for r in rows if r[0] == c]
        loss = "".join(t for r, t in mine if r == "assistant")
        assert done[c]["round_trip"]
        assert back[c]["n_turns"] == len(mine)
        assert back[c]["turns_sha256"] == digest("".join(f"{r}\n{t}\n" for r, t in mine))
        assert (back[c]["loss_chars"], back[c]["loss_sha256"]) == (len(loss), digest(loss))
        assert back[c]["round_trip"] and back[c]["n_spans"] == sum(r == "assistant" for r, _ in mine)
        text = done[c]["formatted"]
        assert len(text) == back[c]["formatted_chars"]
        spans = [text[s["start"]:s["start"] + s["length"]] for s in done[c]["loss_spans"]]
        assert len(spans) == sum(r == "assistant" for r, _ in mine)
        assert sum(text.count(x) for x in ("</turn>\n",)) == len(mine)


def test_plain_texts_are_not_escaped(spark):
    done, _ = read(spark, [(1, 0, "user", "a < b # c \\ d", 0, ""), (1, 1, "assistant", "fine", 0, "")])
    assert done[1]["escaped_turns"] == 0
    assert done[1]["formatted"] == "### user: a < b # c \\ d</turn>\n### assistant: fine</turn>\n"


def test_order_ties_nulls_and_repeats(spark):
    rows = [(1, 2, "b", "x", 0, ""), (1, 2, "a", "y", 0, ""), (1, None, "c", None, 0, ""), (1, 2, "a", "y", 0, ""), (None, 0, "user", "z", 0, "")]
    _, back = read(spark, rows)
    assert back[1]["turns_sha256"] == digest("c\n\na\ny\na\ny\nb\nx\n")
    assert back[None]["n_turns"] == 1


def test_empty_table(spark):
    done, back = read(spark, [])
    assert not done and not back


@pytest.mark.parametrize("n", [3000])
def test_long_conversation_and_text(spark, n):
    rows = [(5, i, "assistant" if i % 2 else "user", ODD[i % len(ODD)], 0, "") for i in range(n)] + [(6, 0, "user", "<\\/turn> x " * 50_000, 0, "")]
    done, back = read(spark, rows)
    assert done[5]["round_trip"] and done[6]["round_trip"] and back[5]["n_turns"] == n


def test_a_wrong_mask_is_seen(spark):
    from pyspark.sql import functions as F
    done = chat.format_conversations(spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "xyz")], "conv_id long, turn long, role string, text string"))
    moved = done.withColumn("loss_spans", F.transform("loss_spans", lambda s: F.struct((s["start"] + 1).alias("start"), s["length"].alias("length"))))
    assert chat.read_back(done).first()["loss_sha256"] == digest("xyz")
    assert chat.read_back(moved).first()["loss_sha256"] != digest("xyz")
