"""Operator 3: tool-call linking for chat records.

Calls and results are joined by conversation and identifier, ordered topologically by the calls
they follow, their arguments validated against schemas, and each linked call is serialised as
canonical JSON: keys sorted, no white space.

DataFrame functions only, and one row a call: no conversation is gathered. A call names the call that it
follows, so that levels are depths in a forest; they are found by doubling, in a logarithmic number
of joins however long a chain is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored

#: JSON types of schema fields, by what a variant's type starts with.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "boolean": "BOOLEAN", "object": "OBJECT", "array": "ARRAY", "null": "VOID"}


def levels(calls: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, level) of calls (conv_id, call_id, after_id): 0 where nothing known is followed,
    else one more than the call that is followed; null in and behind a cycle. Identifiers must be distinct."""
    known = calls.select("conv_id", F.col("call_id").alias("after_id"), F.lit(True).alias("known"))
    start = calls.join(known, ["conv_id", "after_id"], "left").select("conv_id", "call_id", F.when(F.col("known"), F.col("after_id")).alias("up"))
    now = stored(start.withColumn("level", F.col("up").isNotNull().cast("long")))
    for _ in range(max(1, now.count()).bit_length()):
        if now.where("up is not null").isEmpty():
            break
        above = now.select("conv_id", F.col("call_id").alias("up"), F.col("up").alias("upper"), F.col("level").alias("more"))
        following = stored(now.join(above, ["conv_id", "up"], "left").select("conv_id", "call_id", F.col("upper").alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
        dropped(now)
        now = following
    return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))


def errors(arguments: Column, fields: Column) -> Column:
    """What is wrong with a JSON object by the fields of its schema (structs name, type, required), sorted: invalid,
    missing:x, type:x, unknown:x. Null fields: there is no schema."""
    found = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(found).startswith("OBJECT")
    items = F.from_json(F.when(is_object, arguments).otherwise("{}"), "map<string,variant>")
    kinds = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    of = lambda f: F.schema_of_variant(F.element_at(items, f["name"]))
    present = lambda f: F.array_contains(F.map_keys(items), f["name"])
    missing = F.transform(F.filter(fields, lambda f: f["required"] & ~present(f)), lambda f: F.concat(F.lit("missing:"), f["name"]))
    wrong = F.transform(F.filter(fields, lambda f: present(f) & ~F.rlike(F.coalesce(of(f), F.lit("VOID")), F.concat(F.lit("^("), F.element_at(kinds, f["type"]), F.lit(")")))), lambda f: F.concat(F.lit("type:"), f["name"]))
    names = F.transform(fields, lambda f: f["name"])
    unknown = F.transform(F.array_except(F.map_keys(items), names), lambda n: F.concat(F.lit("unknown:"), n))
    bad = F.array(F.lit("invalid"))
    return F.when(fields.isNull(), F.array(F.lit("no schema"))).when(~F.coalesce(is_object, F.lit(False)), bad).otherwise(F.array_sort(F.concat(missing, wrong, unknown)))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Rows (conv_id, call_id, level, status, errors, record), one for each call and each result without a call.

    calls: conv_id, turn, call_id, after_id, name, arguments; results: conv_id, turn, call_id, content; schemas: name, fields
    (array of structs name, type, required), distinct names. Of calls, and of results, with the same
    identifier that of the smallest turn (then content) counts. status is linked, pending (no result)
    or orphan (no call); record is the canonical JSON. Null identifiers and conversations link with
    nothing and are left out.
    """
    first = lambda df, *cols: df.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", *cols)).alias("x"))
    call = stored(first(calls, "name", "arguments", "after_id").select("conv_id", "call_id", *(F.col(f"x.{c}").alias(c) for c in ("name", "arguments", "after_id"))))
    result = first(results, "content").select("conv_id", "call_id", F.col("x.content").alias("content"), F.lit(True).alias("has_result"))
    level = levels(call).withColumn("has_call", F.lit(True))
    checked = call.join(schemas.select("name", "fields"), "name", "left").withColumn("errors", errors(F.col("arguments"), F.col("fields")))
    both = checked.join(level, ["conv_id", "call_id"]).join(result, ["conv_id", "call_id"], "full_outer")
    status = F.when(F.col("has_call").isNull(), "orphan").when(F.col("has_result").isNull(), "pending").otherwise("linked")
    record = F.to_json(
        F.struct(
            F.coalesce(F.try_parse_json("arguments"), F.parse_json(F.lit("null"))).alias("arguments"), F.col("conv_id").alias("conversation"), F.col("errors"), F.col("call_id").alias("id"),
            F.col("level"), F.col("name"), F.col("content").alias("result"), status.alias("status"),
        ),
        {"ignoreNullFields": "false"},
    )
    return both.select("conv_id", "call_id", "level", status.alias("status"), F.array_join("errors", ",").alias("errors"), record.alias("record"))


def exchanges(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas of plain conversations (conv_id, turn, role, text): a user's turn is a call of
    reply, a system's one of instruct; an assistant's turn is the result of the call one turn before it; a call
    follows the one two turns before it. Null texts are null arguments."""
    turn = lambda back: F.concat(F.lit("turn-"), (F.col("turn") - back).cast("string"))
    name = F.when(F.col("role") == "user", "reply").otherwise("instruct")
    asked = conversations.where(F.col("role").isin("user", "system"))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt")), {"ignoreNullFields": "false"})
    calls = asked.select("conv_id", "turn", turn(0).alias("call_id"), turn(2).alias("after_id"), name.alias("name"), arguments.alias("arguments"))
    results = conversations.where(F.col("role") == "assistant").select("conv_id", "turn", turn(1).alias("call_id"), F.col("text").alias("content"))
    field = F.array(F.struct(F.lit("prompt").alias("name"), F.lit("string").alias("type"), F.lit(True).alias("required")))
    schemas = conversations.sparkSession.range(2).select(F.when(F.col("id") == 0, "reply").otherwise("instruct").alias("name"), field.alias("fields"))
    return calls, results, schemas
