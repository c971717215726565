"""Chat rows: normalisation, coherent prefixes and views of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Schema of a raw chat row's messages. Tool arguments stay JSON text: they are objects of any shape.
RAW_MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string,function_call:string,reasoning:string,reasoning_content:string>>"
#: Schema of normalised messages.
MESSAGES = "array<struct<role:string,content:string,tool_calls:array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>,tool_call_id:string,name:string>>"
ROLES = ("system", "user", "assistant", "tool")


def parse_messages(text: Column) -> Column:
    """Messages from JSON text. Malformed text is an error, as the row can't be trusted to be a chat."""
    return F.from_json(text, RAW_MESSAGES, {"mode": "FAILFAST"})


def is_object(document: Column) -> Column:
    """Whether JSON text holds an object; null and malformed text don't."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(document)).startswith("OBJECT"), F.lit(False))


def normalize(messages: Column) -> Column:
    """Known fields of known roles; an empty array where the row is refused.

    Refused: no list, an unknown or missing role, a legacy function call, a tool call whose arguments aren't an
    object (missing ones count as {}). Separately provided reasoning is dropped.
    """
    calls = lambda m: F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"))
    bad_call = lambda m: F.exists(calls(m), lambda c: ~is_object(F.coalesce(c["function"]["arguments"], F.lit("{}"))))
    refused = F.exists(messages, lambda m: m.isNull() | ~F.coalesce(m["role"].isin(*ROLES), F.lit(False)) | (F.coalesce(m["function_call"], F.lit("")) != "") | bad_call(m))
    kept = F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name")))
    return F.when(messages.isNotNull() & ~refused, kept.cast(MESSAGES)).otherwise(F.array().cast(MESSAGES))


def pair_messages(asked: Column, answered: Column) -> Column:
    """A user and an assistant message of an input/output pair; null unless both are there."""
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id"), F.lit(None).cast("string").alias("name"))
    both = (F.coalesce(asked, F.lit("")) != "") & (F.coalesce(answered, F.lit("")) != "")
    return F.when(both, F.array(message("user", asked), message("assistant", answered)).cast(MESSAGES))


def coherent_ends(messages: Column) -> Column:
    """Lengths of the prefixes that end in an assistant or tool message with no call unanswered.

    A tool result without its call, and a call without an id or with one that is still open, end the search. One
    fold over the messages carries the open ids, whether the search has ended, the place and the ends.
    """
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit(False).alias("dead"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))

    def step(s: Column, m: Column) -> Column:
        ids = F.transform(F.coalesce(m["tool_calls"], F.array().cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>")), lambda c: F.coalesce(c["id"], F.lit("")))
        tool = m["role"] == "tool"
        orphan = tool & ~F.coalesce(F.array_contains(s["open"], m["tool_call_id"]), F.lit(False))
        left = F.when(tool, F.array_remove(s["open"], F.coalesce(m["tool_call_id"], F.lit("")))).otherwise(s["open"])
        clash = F.exists(ids, lambda i: i == "") | (F.size(F.array_distinct(ids)) < F.size(ids)) | F.arrays_overlap(left, ids)
        dead = s["dead"] | orphan | F.coalesce(clash, F.lit(False))
        open_ = F.concat(left, ids)
        at = s["at"] + 1
        ends = F.when(~dead & (F.size(open_) == 0) & m["role"].isin("assistant", "tool"), F.concat(s["ends"], F.array(at))).otherwise(s["ends"])
        return F.struct(open_.alias("open"), dead.alias("dead"), at.alias("at"), ends.alias("ends"))

    return F.aggregate(messages, start, step, lambda s: s["ends"])


def coherent_prefixes(rows: DataFrame, messages: str) -> DataFrame:
    """One row for each coherent prefix: prefix_length and prefix."""
    return rows.withColumn("prefix_length", F.explode(coherent_ends(F.col(messages)))).withColumn("prefix", F.slice(F.col(messages), 1, F.col("prefix_length")))


def bucket_view(messages: Column, bucket: Column) -> Column:
    """The short bucket leaves system messages out."""
    return F.when(bucket == "short", F.filter(messages, lambda m: m["role"] != "system")).otherwise(messages)


def first_prompt(messages: Column) -> Column:
    """The first user message's content, '' if there is none."""
    return F.coalesce(F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(1))["content"], F.lit(""))


def conversation_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, messages) of a table of turns."""
    none = F.lit(None).cast("string")
    one = F.struct(F.col(order).alias("at"), F.struct(F.col(role).alias("role"), F.col(text).alias("content"), F.lit(None).cast("array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>").alias("tool_calls"), none.alias("tool_call_id"), none.alias("name")).alias("message"))
    return turns.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("m")).select(key, F.transform("m", lambda x: x["message"]).cast(MESSAGES).alias("messages"))


def rendered_messages(messages: Column, opening: str = "<|{role}|>", closing: str = "<|end|>") -> Column:
    """The text of each message in a plain chat template: role mark, content, tool calls as JSON, end mark."""
    before, _, after = opening.partition("{role}")
    calls = lambda m: F.when(F.size(m["tool_calls"]) > 0, F.to_json(m["tool_calls"])).otherwise("")
    return F.transform(messages, lambda m: F.concat(F.lit(before), m["role"], F.lit(after + "\n"), F.coalesce(m["content"], F.lit("")), F.coalesce(calls(m), F.lit("")), F.lit(closing + "\n")))


def rendered_tools(tools: Column, opening: str = "<|{role}|>", closing: str = "<|end|>") -> Column:
    """The text of a row's tool definitions before its messages; empty where it has none."""
    before, _, after = opening.partition("{role}")
    return F.when(tools.isNotNull(), F.concat(F.lit(before + "tools" + after + "\n"), tools, F.lit(closing + "\n"))).otherwise("")


def render_template(messages: Column, tools: Column | None = None, opening: str = "<|{role}|>", closing: str = "<|end|>") -> Column:
    """Messages by a plain chat template; tools first if given.

    The model's own template isn't available here; another one is another opening and closing, or a pandas UDF over the
    same messages.
    """
    text = F.array_join(rendered_messages(messages, opening, closing), "")
    return text if tools is None else F.concat(rendered_tools(tools, opening, closing), text)


def raw_messages(messages: Column) -> Column:
    """Messages with the fields that raw rows have and normalised ones don't, empty."""
    none = F.lit(None).cast("string")
    return F.transform(messages, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls"), m["tool_call_id"].alias("tool_call_id"), m["name"].alias("name"), none.alias("function_call"), none.alias("reasoning"), none.alias("reasoning_content"))).cast(RAW_MESSAGES)
