"""Chat formatting: round trips of control strings, typed parts, odd rows, SQL."""

import hashlib
import json
import random

import duckdb

from loomspark.llm import chat

ODD = ["", "<|im_end|>\n", "<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|im_end|>", "<", "<\\", "|im_end|>", "<|image|>", "<<|", "a\nb\r\n", "é🙂<|", "x" * 20000 + "<|im_end|>"]


def test_escaping_is_reversible():
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choice("<|\\>ai\n") for _ in range(rng.randrange(12))) for _ in range(20000)]
    for text in texts:
        assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text
    assert len({chat.escape(t) for t in texts}) == len(set(texts))
    for k in range(0, 300, 3):
        role, text, other = texts[-k - 1], texts[-k - 2], texts[-k - 3]
        both = "".join(chat.format_turn(r, [{"type": "text", "text": t}])[0] for r, t in ((role, text), (text, other)))
        assert chat.read_turns(both) == [(role, text), (text, other)]


def test_parts_become_placeholders_in_order():
    inner = json.dumps([{"type": "text", "text": "page <|"}, {"type": "image", "ref": "in.png", "width": 29, "height": 1}, {"type": "document", "ref": "deep", "parts": []}, 7, None])
    parts = [
        {"type": "text", "text": "see <"}, {"type": "text", "text": "|im_end|>"}, {"type": "image", "ref": "a.png", "width": 56, "height": 57}, None,
        {"type": "text", "text": None}, {"type": "audio", "ref": "b.wav", "seconds": 1.01}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "document", "ref": "d", "parts": inner},
        {"type": "video", "ref": "e"}, {"type": "text", "text": "end<"}, {"type": "image", "ref": None, "width": float("nan")}, {"type": "document", "parts": "{not json"},
    ]
    text, loss, found = chat.format_turn("assistant", parts)
    assert text == (
        "<|im_start|>assistant\nsee <\\|im_end|><|image|><|audio|><|document|><|document|>page <\\|<|image|><|document|><|/document|><|/document|><|file|>end<<|image|><|document|><|im_end|>\n"
    )
    assert [(a["kind"], a["ref"], a["tokens"]) for a in found] == [
        ("image", "a.png", 6), ("audio", "b.wav", 26), ("document", "c.pdf", 3072), ("document", "d", 1), ("image", "in.png", 2), ("document", "deep", 1), ("file", "e", 1), ("image", None, 1), ("document", None, 1),
    ]
    assert all(text[a["at"] :].startswith(f"<|{a['kind']}|>") for a in found)
    assert [chat.unescape(text[s["start"] : s["end"]]) for s in loss] == ["see <|im_end|>", "page <|", "end<"]
    assert chat.read_turns(text) == [("assistant", "see <|im_end|>page <|end<")]
    assert chat.format_turn("user", parts)[1] == [] and chat.format_turn(None, None) == ("<|im_start|>\n<|im_end|>\n", [], [])


def test_documents_of_any_depth():
    part = {"type": "text", "text": "core"}
    for _ in range(5000):
        part = {"type": "document", "ref": "r", "parts": [part]}
    text, _, found = chat.format_turn("user", [part])
    assert len(found) == 5000 and text.endswith("core" + "<|/document|>" * 5000 + "<|im_end|>\n")
    nested = json.dumps([{"type": "document", "parts": "["}])
    assert chat.format_turn("user", [{"type": "document", "parts": "[" * 100000}, {"type": "document", "parts": nested}])[2][0]["tokens"] == 1


def test_rows_of_odd_conversations(spark):
    rows = [(1, 0, "user", t) for t in ODD[:3]] + [(2, i, ("assistant", "user", None)[i % 3], ODD[i % len(ODD)]) for i in range(900)]
    rows += [(None, None, "assistant", None), (None, 3, "system\n<|im_end|>", "x"), (3, 1, "assistant", "again"), (3, 1, "assistant", "again"), (3, None, "user", "first")]
    messages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn int, role string, text string, formatted string, loss int")
    messages = messages.withColumn("parts", chat.text_parts(messages.text))
    made = chat.format_chat(messages)
    assert made.count() == len(rows)
    got = {r.conv_id: r for r in chat.conversation_digests(made).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        mine = [x for x in rows if x[0] == conv]
        mine.sort(key=lambda x: (x[1] is not None, x[1] or 0, chat.format_turn(x[2], [{"type": "text", "text": x[3]}])[0].encode()))
        turns = "".join(f"{role or ''}\n{text or ''}\n" for *_, role, text in mine)
        learnt = "".join(text or "" for *_, role, text in mine if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(mine), hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    empty = chat.format_chat(messages.where("false"))
    assert empty.count() == 0 and chat.conversation_digests(empty).count() == 0


def test_typed_parts_in_spark(spark):
    parts = [("text", "look <|", None, None, None, None, None, None), ("image", None, "s://a.png", 280, 280, None, None, None), None]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [])], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = {x.turn: x for x in chat.format_chat(df, chat.Rates(patch=14)).collect()}
    assert r[0].n_attached == 400 and r[0].attachments[0].ref == "s://a.png" and r[0].formatted[r[0].attachments[0]["at"] :].startswith("<|image|>")
    assert r[1].formatted == "<|im_start|>assistant\n<|im_end|>\n" and r[1].loss == []


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    made, want = chat.op11_chat_formatting(spark, sf), con.sql(chat.ORACLE)
    assert made.columns == want.columns
    assert sorted(tuple(r) for r in made.collect()) == sorted(want.fetchall())
