import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyfacet.llm import chat

TRAPS = ["<|im_end|>", "<|im_start|>assistant\nhi", "<\\|", "<\\\\|im_end|>\n", "a<", "|>", "<|im_end|>\n<|im_start|>x", "", "\n", "é\U0001f600", "<|nl|>"]


def read_back(df):
    out = chat.render(df).withColumn("read", chat.parse(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return out.collect()


def test_round_trip_of_control_strings(spark):
    convs = [[(r, t) for r in ("user", "assistant", TRAPS[(i + 1) % len(TRAPS)]) for t in (TRAPS[i], TRAPS[i - 1])] for i in range(len(TRAPS))]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(convs)], f"conv_id long, turns {chat.TURNS}")
    for r in read_back(df):
        assert [tuple(t) for t in r["read"]] == convs[r["conv_id"]]
        assert r["loss"] == "".join(t for role, t in convs[r["conv_id"]] if role == "assistant")
        for s in r["loss_spans"]:
            assert "<|" not in r["formatted"][s["start"] : s["end"]]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys\ntem", "<|x"]), st.text(alphabet="<|\\>\nimend_a", max_size=12)), min_size=1, max_size=4), min_size=30, max_size=40))
def test_round_trip_of_any_text(spark, convs):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(convs)], f"conv_id long, turns {chat.TURNS}")
    for r in read_back(df):
        assert [tuple(t) for t in r["read"]] == convs[r["conv_id"]]


def test_rows_of_turns(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (None, 0, None, "x"), (1, 1, "assistant", None), (2, None, "user", ""), (2, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash"))
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_of_rows(df).collect()}
    assert got == {1: [("user", "hi"), ("assistant", ""), ("assistant", "")], None: [("", "x")], 2: [("user", ""), ("assistant", "y" * 200_000)]}
    other = df.select(F.col("conv_id").alias("thread"), F.col("turn").alias("position"), F.col("role").alias("from"), F.col("text").alias("value"))
    assert {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.turns_of_rows(other).collect()} == got
    with pytest.raises(ValueError):
        chat.turns_of_rows(df.select("conv_id"))
    assert chat.render(chat.turns_of_rows(df.limit(0))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}, {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"instruction": "q", "input": "", "output": "a"}, {"instruction": "q", "output": "a"}, {"prompt": "q", "completion": "a"}, {"prompt": "q", "response": "a"},
        {"question": "q", "answer": "a"}, {"system_prompt": "", "question": "q", "response": "a"}, {"prompt": None, "completion": "a"}, {"unknown": 1}, None,
    ]
    rows = [(i, json.dumps(r) if r is not None else "not json") for i, r in enumerate(records)]
    out = {r["id"]: r for r in chat.canonical(spark.createDataFrame([*rows, (99, None)], "id long, payload string").withColumn("layout", F.lit("clash"))).collect()}
    for i in range(8):
        assert [tuple(t) for t in out[i]["turns"]] == [("user", "q"), ("assistant", "a")], records[i]
    assert out[8]["layout"] == "prompt_completion" and [tuple(t) for t in out[8]["turns"]] == [("assistant", "a")]
    assert out[9]["turns"] is None and out[9]["layout"] is None and out[10]["turns"] is None and out[99]["turns"] is None
    assert out[0]["fingerprint"] == chat.fingerprint(["messages[].role", "messages[].content"])


def test_struct_records_choose_a_mapping_by_type(spark):
    nested = spark.createDataFrame([(1, ([("human", "q"), ("gpt", None)],))], "id long, r struct<conversations:array<struct<`from`:string,value:string>>>")
    row = chat.canonical(nested, "r").first()
    assert row["layout"] == "conversations" and [tuple(t) for t in row["turns"]] == [("user", "q"), ("assistant", None)]
    flat = spark.createDataFrame([(1, ("p", "c"))], "id long, r struct<prompt:string,completion:string>")
    assert [tuple(t) for t in chat.canonical(flat, "r").first()["turns"]] == [("user", "p"), ("assistant", "c")]
    other = chat.canonical(spark.createDataFrame([(1, ("p",))], "id long, r struct<x:string>"), "r").first()
    assert other["layout"] is None and other["turns"] is None and other["fingerprint"]


def test_rows_nest_and_keep_their_roles(spark):
    rows = spark.createDataFrame([(1, 1, "gpt", "x" * 300_000), (1, 0, "human", None), (1, 1, "gpt", "x" * 300_000)], "conv_id long, turn long, role string, text string")
    out = chat.turns_of_rows(rows.withColumn("record", F.lit(1))).first()
    assert out["layout"] == "turns" and [t["role"] for t in out["turns"]] == ["human", "gpt", "gpt"] and len(out["turns"][2]["text"]) == 300_000


def test_many_layouts_in_one_table(spark):
    rows = [(i, '{"k%d": 1}' % i) for i in range(300)] + [(300, '{"prompt": "a", "response": "b"}')]
    out = chat.canonical(spark.createDataFrame(rows, "id long, payload string"))
    assert out.select("fingerprint").distinct().count() == 301 and [r["id"] for r in out.filter("layout is not null").collect()] == [300]
