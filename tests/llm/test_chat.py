import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from screenloom.llm.chat import CONTROLS, ESC, OVERHEAD, canonical_turns, escape, fingerprint, format_chats, parse, render, turn_records, turns_or_problem, unescape

PIECES = st.lists(st.one_of(st.sampled_from([*CONTROLS, ESC, "0", "1", "<", "|>", "end|>", "\n", "a"]), st.text(max_size=3)), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_round_trip(turns):
    formatted = "".join(render(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in parse(formatted)] == turns
    for _, t, s, e in parse(formatted):
        assert unescape(formatted[s:e]) == t


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_escaped_text_holds_no_plain_control(text):
    found = escape(text)
    assert unescape(found) == text
    for c in CONTROLS:
        at = found.find(c)
        while at >= 0:
            assert found[max(0, at - 2) : at] == f"{ESC}1"
            at = found.find(c, at + 1)


@pytest.mark.parametrize(
    ("record", "turns"),
    [
        ({"messages": [{"role": "user", "content": "hi"}, {"role": "assistant", "content": None}]}, [("user", "hi"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, [("user", "q"), ("assistant", "a")]),
        ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        ({"output": "done", "input": "x", "instruction": "do"}, [("user", "do\n\nx"), ("assistant", "done")]),
        ({"system": "", "instruction": "do", "input": "", "output": "y"}, [("user", "do"), ("assistant", "y")]),
        ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"turn": 3, "role": "user", "text": "t"}, [("user", "t")]),
        ({"messages": []}, []),
        ({"turn": 3, "role": "human", "text": "t"}, [("human", "t")]),  # turn rows name their roles themselves
        ({"id": 7, "messages": [{"role": "user", "content": 5, "weight": 1}, "stray"], "meta": {"a": [1]}}, [("user", "5")]),
        ({"id": "x", "system": "s", "prompt": "p", "response": {"b": 1}}, [("system", "s"), ("user", "p"), ("assistant", '{"b": 1}')]),
        ({"messages": [], "id": 1}, []),
    ],
)
def test_layouts(record, turns):
    assert canonical_turns(record) == turns


def test_unknown_layout_names_its_paths():
    with pytest.raises(ValueError, match=r"a\[\]\.b"):
        canonical_turns({"a": [{"b": 1}]})


def test_fingerprint_ignores_order_and_values():
    assert fingerprint({"a": 1, "b": [{"c": 2}, {"c": 3}]}) == fingerprint({"b": [{"c": "x"}], "a": None})
    assert fingerprint({"a": 1}) != fingerprint({"b": 1})


def test_format(spark):
    rows = [
        (1, 1, "assistant", "two </s> [INST]"), (1, 0, "user", "one"), (1, 2, "assistant", None), (2, None, None, "x"), (2, 0, "system", "é<|end|>"),
        (2, 0, "system", "é<|end|>"), (None, 0, "user", "no id"), (None, 1, "assistant", "ok"), (9007199254740993, 0, "assistant", "big"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("record", F.lit("clash")).repartition(3)
    got = {r.conv_id: r for r in format_chats(turn_records(df), with_text=True).collect()}
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns = [(r, x) for _, _, r, x in sorted(turns)]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.formatted == "".join(render(a, b) for a, b in turns) and r.formatted_chars == len(r.formatted)
        spans = r.loss_spans
        assert "".join(unescape(r.formatted[s:e]) for s, e in zip(spans[::2], spans[1::2], strict=True)) == loss


def test_empty_and_records(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert format_chats(turn_records(empty)).count() == 0
    record = json.dumps({"prompt": "p", "completion": "c"})
    one = spark.createDataFrame([(4, 0, record)], "conv long, turn long, record string")
    assert format_chats(one).first().formatted_chars == 2 * OVERHEAD + len("userpassistantc")


def test_records_that_hold_no_turn_say_why(spark):
    good = json.dumps({"messages": [{"role": "user", "content": "q", "id": 1}]})
    rows = [(1, 0, None), (2, 0, "{broken"), (3, 0, "[1]"), (4, 0, '{"z": 1}'), (5, 0, good), (5, 1, "7"), (6, 0, good), (7, 0, '{"messages": []}'), (None, 0, "null")]
    df = spark.createDataFrame(rows, "conv long, turn long, record string").withColumns({"problem": F.lit(1), "conv_id": F.lit(2)})
    got = {r.conv_id: r for r in format_chats(df).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        1: "null record", 2: "no JSON", 3: "no JSON object", 4: "unknown layout: z", 5: "no JSON object", 6: None, None: "no JSON object",
    }
    assert {k: r.n_turns for k, r in got.items()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 1, None: 0}


def test_every_malformed_record_gives_a_row(spark):
    """Random records of odd names, half surrogate pairs and nesting: each gives a row, and turns read back as they went in."""
    rng = random.Random(8)
    names = ["messages", "messages[]", "messages[].role", "role", "content", "turn", "text", "prompt", "completion", "conversations", "from", "value", 'a"b', "", "\ud800"]
    leaves = ["\ud800", "x\udfffy", "ok", None, 3, 1.5, True, [], {}, [[]], "</s>"]

    def value(depth):
        if depth and rng.random() < 0.6:
            if rng.random() < 0.5:
                return [value(depth - 1) for _ in range(rng.randint(0, 3))]
            return {rng.choice(names): value(depth - 1) for _ in range(rng.randint(0, 4))}
        return rng.choice(leaves)

    fixed = [{"messages": [{"role": "user", "content": "\ud800"}]}, {"messages[]": {"role": "user", "content": "x"}}, {"messages": [{"role": "\udc00", "content": 1}, 3]}, {"\ud800": 1}]
    records = [json.dumps(r) for r in [*fixed, *(value(3) for _ in range(400))]]
    df = spark.createDataFrame([(i, 0, r) for i, r in enumerate(records)], "conv long, turn long, record string")
    got = {r.conv_id: r for r in format_chats(df, with_text=True).collect()}
    empty = {i for i, r in enumerate(records) if r in ('{"messages": []}', '{"conversations": []}')}
    assert set(got) >= set(range(len(records))) - empty - {i for i in range(len(records)) if not canonical(records[i])}
    assert got[0].problem is None and parse(got[0].formatted)[0][:2] == ("user", "\ufffd")
    assert got[1].problem.startswith("unknown layout") and got[2].n_turns == 1 and got[3].problem == "unknown layout: \ufffd"


def canonical(record):
    turns, problem = turns_or_problem(record)
    return turns or problem
