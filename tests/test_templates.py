"""Compiled chat templates against plain renderers."""

import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import chat
from quern.operators.templates import TemplateError, compile_template
from quern.plans import catalog


def render(df, template, **more):
    names = {"messages": (F.col("messages"), df.schema["messages"].dataType), "tools": (F.col("tools"), T.ArrayType(T.StringType())), "add_generation_prompt": (F.lit(False), T.BooleanType())} | more
    return [r[0] for r in df.select(compile_template(template, names)).collect()]


def say(role, content, calls=None, id=None):
    return (role, content, calls, id, None)


ROWS = [
    ([say("system", " Be brief. "), say("user", "Hi"), say("assistant", "Hello\n")], None),
    ([say("user", "list"), say("assistant", None, [("c1", "function", ("ls", '{"p": 1}')), ("c2", "function", ("cat", "{}"))]), say("tool", "out", None, "c1"), say("assistant", "done")], ["{\"name\": \"ls\"}", "{\"name\": \"cat\"}"]),
    ([], None),
    ([say("user", "")], []),
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, f"messages {chat.MESSAGES}, tools array<string>")


def plain_marked(messages, tools, prompt=False):
    """What MARKED says."""
    out = ""
    if tools:
        first = messages[0][1].strip() + "\n\n" if messages and messages[0][0] == "system" else ""
        out += "<|im_start|>system\n" + first + "# Tools\n" + "".join(f"{t}\n" for t in tools) + "<|im_end|>\n"
    elif messages and messages[0][0] == "system":
        out += f"<|im_start|>system\n{messages[0][1].strip()}<|im_end|>\n"
    for i, (role, content, calls, id, _) in enumerate(messages):
        if role == "system" and i == 0:
            continue
        if role == "tool":
            out += f"<|im_start|>user\n<result id={id}>\n{content}\n</result><|im_end|>\n"
        else:
            out += f"<|im_start|>{role}\n{content or ''}"
            for k, (_, _, (name, arguments)) in enumerate(calls or []):
                out += ("\n" if content or k else "") + "<call>" + json.dumps({"name": name, "arguments": arguments}, separators=(",", ":")) + "</call>"
            out += "<|im_end|>\n"
    return out + ("<|im_start|>assistant\n" if prompt else "")


def plain_brackets(messages, _):
    """What BRACKETS says: the system message goes into the first user turn."""
    system, rest, out = "", messages, "<s>"
    if messages and messages[0][0] == "system":
        system, rest = messages[0][1], messages[1:]
    for i, (role, content, *_) in enumerate(rest):
        if role == "user":
            out += "[INST] " + (f"<<SYS>>\n{system}\n<</SYS>>\n\n" if i == 0 and system else "") + (content or "").strip() + " [/INST]"
        elif role == "assistant":
            out += " " + (content or "").strip() + "</s>" + ("" if i == len(rest) - 1 else "<s>")
    return out


@pytest.mark.parametrize("prompt", [False, True])
def test_marked(df, prompt):
    got = render(df, catalog.MARKED, add_generation_prompt=(F.lit(prompt), T.BooleanType()))
    assert got == [plain_marked(m, t, prompt) for m, t in ROWS]


def test_brackets(df):
    assert render(df, catalog.BRACKETS) == [plain_brackets(m, t) for m, t in ROWS]


def test_parts_of_the_syntax(df):
    row = df.limit(1)
    assert render(row, "a  {#- note -#}  b {{- ' c ' -}} d") == ["ab c d"]
    assert render(row, "{% for m in messages[1:] %}{{ loop.index }}{{ '.' if not loop.last else '!' }}{% endfor %}") == ["1.2!"]
    assert render(row, "{% set x = messages[0]['content'] | trim %}{{ (x + '?') | upper }}{{ messages | length + 1 }}{{ messages[-1].role }}") == ["BE BRIEF.?4assistant"]
    assert render(row, "{{ 'a' + ' b ' | trim + 'c' }}{{ ('x' + ' y ') | trim }}") == ["abcx y"]
    assert render(row, "{% if nothing is defined %}a{% elif 'Be' in messages[0].content and messages[0].role in ['user', 'system'] %}b{% else %}c{% endif %}{{ nothing | default('d') }}{% for x in nothing %}{{ x }}{% endfor %}") == ["bd"]
    assert render(row, "{{ messages[1].content | tojson }}{{ messages[0].tool_calls is none }}{{ tools | tojson }}") == ['"Hi"truenull']
    assert render(row, "x\n  {% if true %}\n  y\n  {% endif %}\nz") == ["x\n  y\nz"]
    for wrong in ("{{ a ** b }}", "{% if true %}", "{% for x in 3 %}{% endfor %}", "{{ messages }}", "{% macro f() %}", "{{ x | nofilter }}", "{{ 1 +", "{{ loop.first }}"):
        with pytest.raises(TemplateError):
            compile_template(wrong + ("" if "}}" in wrong or "%}" in wrong else " }}"), {"messages": (F.col("messages"), df.schema["messages"].dataType), "x": (F.lit("x"), T.StringType())})
    with pytest.raises(Exception, match="no system"):
        render(row, "{% if messages[0].role == 'system' %}{{ raise_exception('no system') }}{% endif %}")


def test_rendering_stays_in_the_jvm(df):
    plan = df.select(compile_template(catalog.MARKED, {"messages": (F.col("messages"), df.schema["messages"].dataType)}))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables aren't here")
def test_query(spark):
    turns = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet").sort_values(["conv_id", "turn"])
    got = {r["conv_id"]: (r["marked"], r["brackets"]) for r in catalog.chat_templates(spark, "/root/testdata/sf0.001").collect()}
    for conv, own in turns.groupby("conv_id"):
        messages = [say(r, t) for r, t in zip(own.role, own.text, strict=True)]
        assert got[conv] == (plain_marked(messages, None), plain_brackets(messages, None))
