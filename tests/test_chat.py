import json

import pytest
from pyspark.sql import functions as F

from quern.operators import chat


def ends(spark, messages):
    df = spark.createDataFrame([(json.dumps(messages),)], "t string").select(chat.normalize(chat.parse_messages(F.col("t"))).alias("m"))
    row = df.select("m", chat.coherent_ends(F.col("m")).alias("e")).first()
    return row["m"], row["e"]


def call(*ids, arguments="{}"):
    return {"role": "assistant", "tool_calls": [{"id": i, "function": {"name": "f", "arguments": arguments}} for i in ids]}


def tool(id):
    return {"role": "tool", "tool_call_id": id, "content": "r"}


USER = {"role": "user", "content": "q"}


@pytest.mark.parametrize(
    "messages,expected",
    [
        ([USER, call("a"), tool("a")], [3]),
        ([USER, call("a", "b"), tool("a")], []),
        ([USER, tool("a")], []),
        ([USER, {"role": "assistant", "content": "x"}, tool("a"), {"role": "assistant", "content": "y"}], [2]),
        ([USER, call("a", "a"), tool("a")], []),
        ([USER, call(""), tool("")], []),
        ([USER, call("a"), tool("a"), call("a"), tool("a"), {"role": "assistant", "content": "z"}], [3, 5, 6]),
    ],
)
def test_coherent_ends(spark, messages, expected):
    assert ends(spark, messages)[1] == expected


def test_normalize(spark):
    kept, _ = ends(spark, [USER, {"role": "assistant", "content": "x", "reasoning": "hidden", "reasoning_content": "hidden"}])
    assert len(kept) == 2 and set(kept[0].asDict()) == {"role", "content", "tool_calls", "tool_call_id", "name"}
    for bad in ([{"role": "critic", "content": "x"}], [{"content": "x"}], [USER, {"role": "assistant", "function_call": "f"}], [USER, call("a", arguments="[]")], [USER, call("a", arguments="{")]):
        assert ends(spark, bad)[0] == []
    assert len(ends(spark, [USER, call("a", arguments='{"x": [1]}')])[0]) == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.createDataFrame([("{oops",)], "t string").select(chat.parse_messages(F.col("t"))).collect()


def test_views(spark):
    df = spark.createDataFrame([("a", "b"), ("", "b"), (None, None)], "a string, b string").select(chat.pair_messages(F.col("a"), F.col("b")).alias("m"))
    assert [None if r["m"] is None else len(r["m"]) for r in df.collect()] == [2, None, None]
    messages, _ = ends(spark, [{"role": "system", "content": "s"}, USER])
    df = spark.createDataFrame([(messages,)], f"m {chat.MESSAGES}")
    row = df.select(F.size(chat.bucket_view(F.col("m"), F.lit("short"))), F.size(chat.bucket_view(F.col("m"), F.lit("long"))), chat.first_prompt(F.col("m"))).first()
    assert tuple(row) == (1, 2, "q")
    assert df.select(chat.first_prompt(F.slice("m", 1, 1))).first()[0] == ""
