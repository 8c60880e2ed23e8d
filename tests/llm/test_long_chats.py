"""Conversations beyond the sizes that a JSON record can have."""

import hashlib
from dataclasses import replace

from termweave.llm import chat


def test_long_text_is_kept(spark, tmp_path):
    long = "<s>" + "a" * 21_000_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "user", "hi")]
    spark.createDataFrame([(*r[:3], r[3] if r[3] != long else "") for r in rows], "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "role", "if(conv_id = 1 and turn = 1, concat('<s>', repeat('a', 21000000)), text) as text").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    whole = "user\nq\nassistant\n" + long + "\n"
    assert (got[1].n_turns, got[1].loss_chars) == (2, len(long))
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest() and got[1].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


def test_turns_are_those_of_records(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<s> x"), (2, 0, "system", None), (2, 1, "user", "a"), (2, 2, "assistant", ""), (3, 5, None, "x"), (3, 5, None, "x"), (4, 0, "user", "b"), (4, 1, "assistant", "c"), (4, 2, "user", "d"), (5, 0, "tool", "e"), (6, 0, "user", "f"), (None, 1, "user", "g")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    as_set = lambda df: {(r.id, r.layout, tuple(map(tuple, r.turns))) for r in df.select("id", "layout", "turns").collect()}
    assert as_set(chat.turns_of(talk)) == as_set(chat.canonical_turns(chat.records_of(talk), "id", "record"))
    assert chat.turns_of(talk.limit(0)).count() == 0


def test_layout_decides_turns(spark, tmp_path, monkeypatch):
    """Turns come through the mapping that a record's fingerprint picks: without it there are none, and another one gives others."""
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (2, 2, "user", "c"), (3, 0, "user,assistant", "d"), (4, 0, "system", "e"), (4, 1, "user", "f"), (4, 2, "assistant", "g")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    talk.write.parquet(str(tmp_path / "conversations.parquet"))
    turns = lambda: {r.id: r.turns and [tuple(t) for t in r.turns] for r in chat.turns_of(talk).collect()}
    assert turns() == {k: [r[2:] for r in rows if r[0] == k] for k in (1, 2, 3, 4)}
    other = {"prompt_response": {"turns": (("assistant", ("prompt",)), ("user", ("response",)))}, "shared": {"names": {}}}
    monkeypatch.setattr(chat, "LAYOUTS", tuple(replace(x, **other.get(x.name, {})) for x in chat.LAYOUTS if x.name != "messages"))
    assert turns() == {1: [("assistant", "hi"), ("user", "yo")], 2: [("human", "a"), ("gpt", "b"), ("human", "c")], 3: None, 4: [r[2:] for r in rows if r[0] == 4]}
    got = {r.conv_id: (r.n_turns, r.loss_sha256) for r in chat.op10_chat(spark, str(tmp_path)).collect()}
    assert got[1] == (2, hashlib.sha256(b"hi").hexdigest()) and got[2] == (3, hashlib.sha256(b"").hexdigest())
