"""Chat formatting: link tool calls with their results, order them, validate arguments, and write canonical JSON.

Calls and results are two tables that meet in a hash join on (conversation, call id). A call may name the call that it needs; its
depth is its distance from a call that needs none, found by doubling pointers, so a long chain of dependencies takes few joins.
``position`` numbers the calls of a conversation topologically, from 0 without gaps, by (depth, turn, call id). Each call is a row of
its own, and positions are counted over range partitions, so a conversation of any length is never gathered into one task. JSON is
canonical: keys in code point order, no blanks, nulls written out.

Edge cases: a call without a result has status "no_result", a result without a call is kept as status "no_call"; a null id links
with nothing; of several results for one call the earliest is linked (ties: smallest content) and the rest counted; rows that
repeat a call id keep a row each and share its depth and position, those of its smallest need and earliest turn; calls on a cycle,
or whose need is missing, get neither depth nor position, and status "unordered"; null arguments are invalid; texts of any length
are written whole; an empty table gives no rows; extra columns, of whatever name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qaspark.functions.tables import numbered
from qaspark.llm.common import checkpointed

#: A tool's schema: argument name -> (type, required, least, most). Strings are bounded in length, numbers in value.
Schema = dict[str, tuple[str, bool, int | None, int | None]]

CALL = "conv_id bigint, turn bigint, call_id string, needs string, name string, arguments map<string,string>"
RESULT = "conv_id bigint, turn bigint, call_id string, content string"


def escaped(text: Column) -> Column:
    """JSON string literal of ``text``, ``null`` for null: what stands between ``[`` and ``]`` in a one-element array."""
    return F.coalesce(F.regexp_replace(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", "$1"), F.lit("null"))


def canonical_object(**fields: Column) -> Column:
    """JSON object from columns that hold JSON text, keys in order."""
    parts = [x for i, (k, v) in enumerate(sorted(fields.items())) for x in (F.lit(("," if i else "{") + f'"{k}":'), F.coalesce(v, F.lit("null")))]
    return F.concat(*parts, F.lit("}"))


def canonical_arguments(arguments: Column, schema: Schema) -> Column:
    """The schema's arguments in key order, integers as numbers when they are integers; absent ones are null."""
    fields = {}
    for name, (kind, *_) in schema.items():
        value = F.try_element_at(arguments, F.lit(name))
        fields[name] = F.coalesce(value.try_cast("bigint").cast("string"), escaped(value)) if kind == "integer" else escaped(value)
    return canonical_object(**fields)


def argument_errors(arguments: Column, schema: Schema) -> Column:
    """Messages of what breaks the schema, in order of argument name; unknown arguments last."""
    found = []
    for name, (kind, required, least, most) in sorted(schema.items()):
        value = F.try_element_at(arguments, F.lit(name))
        if required:
            found.append(F.when(value.isNull(), F.lit(f"{name} is required")))
        if kind == "integer":
            found.append(F.when(value.isNotNull() & value.try_cast("bigint").isNull(), F.lit(f"{name} must be an integer")))
            size = value.try_cast("bigint")
        else:
            size = F.length(value)
        if least is not None:
            found.append(F.when(size < least, F.lit(f"{name} is below {least}")))
        if most is not None:
            found.append(F.when(size > most, F.lit(f"{name} is above {most}")))
    unknown = F.array_sort(F.array_except(F.map_keys(arguments), F.array(*[F.lit(n) for n in schema])))
    messages = F.concat(F.array_compact(F.array(*found)), F.transform(unknown, lambda n: F.concat(n, F.lit(" is unknown"))))
    return F.when(arguments.isNull(), F.array(F.lit("arguments are missing"))).otherwise(messages)


def depths(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, turn (the earliest) and depth of the calls that do not hang on a cycle or on a missing call."""
    at = calls.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min("needs").alias("needs"), F.min("turn").alias("turn"))
    at = checkpointed(at.select("conv_id", "call_id", "turn", F.col("needs").alias("_at"), F.when(F.col("needs").isNull(), 0).otherwise(1).alias("depth")))
    total = at.where("_at is not null").count()
    while total:
        up = at.select("conv_id", F.col("call_id").alias("_at"), F.col("_at").alias("_up"), F.col("depth").alias("_depth"))
        at = at.join(up, ["conv_id", "_at"], "left").select(
            "conv_id",
            "call_id",
            "turn",
            F.when(F.col("_depth").isNull(), F.col("_at")).otherwise(F.col("_up")).alias("_at"),
            (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"),
        )
        at = checkpointed(at)
        left = at.where("_at is not null").count()
        if left in (0, total):  # a chain that can be ordered gets shorter in every round
            break
        total = left
    return at.where("_at is null").select("conv_id", "call_id", "turn", "depth")


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row per call (and per result that has no call): position, depth, turns, status, n_errors, n_results and canonical JSON.

    Columns: conv_id, call_id, call_turn, result_turn, position, depth, status, n_errors, n_results, json.
    """
    calls = calls.select("conv_id", F.col("turn").alias("call_turn"), "call_id", "needs", "name", "arguments")
    answers = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content")).alias("_first"), F.count(F.lit(1)).alias("n_results"))
    places = numbered(depths(calls.withColumnRenamed("call_turn", "turn")), ["conv_id"], ["depth", "turn", "call_id"], "position").drop("turn")
    calls = calls.join(places.hint("shuffle_hash"), ["conv_id", "call_id"], "left")
    rows = calls.join(answers.hint("shuffle_hash"), ["conv_id", "call_id"], "full_outer")

    errors, arguments = F.array(F.lit("name is unknown")), escaped(F.lit(None).cast("string"))
    for name, schema in schemas.items():
        known = F.col("name") == name
        errors = F.when(known, argument_errors(F.col("arguments"), schema)).otherwise(errors)
        arguments = F.when(known, canonical_arguments(F.col("arguments"), schema)).otherwise(arguments)
    rows = rows.withColumn("_errors", F.when(F.col("call_turn").isNull(), F.array().cast(T.ArrayType(T.StringType()))).otherwise(errors)).withColumn("_arguments", arguments)
    status = (
        F.when(F.col("call_turn").isNull(), "no_call")
        .when(F.size("_errors") > 0, "invalid")
        .when(F.col("depth").isNull(), "unordered")
        .when(F.col("_first").isNull(), "no_result")
        .otherwise("linked")
    )
    call = canonical_object(arguments=F.col("_arguments"), id=escaped(F.col("call_id")), name=escaped(F.col("name")), needs=escaped(F.col("needs")))
    result = F.when(F.col("_first").isNotNull(), canonical_object(content=escaped(F.col("_first.content")), turn=F.col("_first.turn").cast("string")))
    json = canonical_object(call=F.when(F.col("call_turn").isNotNull(), call), result=result)
    return rows.select(
        "conv_id",
        "call_id",
        "call_turn",
        F.col("_first.turn").alias("result_turn"),
        "position",
        "depth",
        status.alias("status"),
        F.size("_errors").alias("n_errors"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        json.alias("json"),
    )


#: The two tools that a conversation's turns stand for in ``from_turns``.
TURN_TOOLS: dict[str, Schema] = {
    "lookup": {"query": ("string", True, 1, 150), "turn": ("integer", True, 0, None)},
    "compose": {"query": ("string", True, 1, None), "turn": ("integer", True, 0, None)},
}


def with_messages(linked: DataFrame, messages: DataFrame) -> DataFrame:
    """The linked rows, and the messages that are neither call nor result, with status "message" and their turn in ``call_turn``."""
    fields = {"content": escaped(F.col("text")), "role": escaped(F.col("role")), "turn": F.col("turn").cast("string")}
    own = {
        "conv_id": F.col("conv_id"),
        "call_turn": F.col("turn"),
        "status": F.lit("message"),
        "n_errors": F.lit(0),
        "n_results": F.lit(0),
        "json": canonical_object(message=canonical_object(**fields)),
    }
    missing = F.lit(None)
    return linked.unionByName(messages.select(*[own.get(f.name, missing).cast(f.dataType).alias(f.name) for f in linked.schema]))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls and results that plain conversations stand for, and the other messages (conv_id, turn, role, text).

    A user turn calls a tool (a short one "lookup", a longer one "compose") and needs the call two turns before; an assistant turn
    is the result of the call one turn before; turns of any other role, or of none, are messages.
    """
    call = lambda t: F.concat(F.lit("call_"), t.cast("string"))
    turn = F.col("turn")
    calls = turns.where("role = 'user'").select(
        "conv_id",
        "turn",
        call(turn).alias("call_id"),
        F.when(turn >= 2, call(turn - 2)).alias("needs"),
        F.when(F.length(F.coalesce("text", F.lit(""))) < 200, "lookup").otherwise("compose").alias("name"),
        F.create_map(F.lit("query"), F.col("text"), F.lit("turn"), turn.cast("string")).alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select("conv_id", "turn", call(turn - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results, turns.where("role is null or role not in ('user', 'assistant')").select("conv_id", "turn", "role", "text")
