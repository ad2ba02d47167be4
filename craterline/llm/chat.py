"""Chat formatting: tool calls linked to their results, ordered, validated and written as canonical JSON.

Only DataFrame functions are used. Calls and results meet in an equi-join on conversation and call id.
A call may name calls whose results it uses; it is placed after them even if the log has it earlier:
its place is the larger of its own turn and the places it waits for. Waits are led on past calls that
wait for one other call, so the number of rounds grows with the logarithm of a chain of waits; only
calls that wait for several calls, themselves waiting for several, cost a round each. There is no
limit of rounds. Calls that wait in a circle, or at last for one, keep their turn and are marked.
Arguments are parsed as JSON values and held against the parameters of their tool.

Canonical JSON has no white space, keys in alphabetical order and no null members.

Repeated rows count once. Of several calls with one id in a conversation the first is linked; the
others, results without a call and calls without a result stay, with ``linked`` false. Arguments that
are no JSON object are kept as text with an error; null arguments count as {}. A null content is left
out of the JSON. Rows without conversation or turn stay and come first. Ties within a place are broken
by kind, turn, call id and JSON. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from craterline.functions.stage import stage

#: Which JSON values a parameter type allows, by the start of the parsed value's type.
TYPES = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT"), "boolean": ("BOOLEAN",), "object": ("OBJECT",), "array": ("ARRAY",)}
#: Turns of a conversation that are numbered together.
STRETCH = 1000


def argument_errors(arguments: Column, tool: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """What is wrong with a call's arguments, "; " between faults; null if nothing is.

    ``schemas`` gives for each tool its parameters with their type and whether they are required.
    """
    text = F.coalesce(arguments, F.lit("{}"))
    keys = F.json_object_keys(text)
    value = F.try_parse_json(text)
    errors = F.when(tool.isNull(), F.array(F.lit("no tool"))).otherwise(F.array(F.concat(F.lit("unknown tool "), tool)))
    for name, parameters in schemas.items():
        found = [F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, parameters)))), lambda k: F.concat(F.lit("unknown "), k))]
        for parameter, (kind, required) in sorted(parameters.items()):
            given = F.schema_of_variant(F.try_variant_get(value, f"$.{parameter}", "variant"))
            fits = reduce(lambda x, y: x | y, (given.startswith(t) for t in TYPES[kind]))
            missing = ~F.array_contains(keys, parameter)
            found.append(F.array(F.when(missing, F.lit(f"missing {parameter}") if required else F.lit(None))
                                 .otherwise(F.when(~F.coalesce(fits, F.lit(False)), F.lit(f"{parameter} is no {kind}")))))
        errors = F.when(tool == name, F.filter(F.concat(*found), lambda e: e.isNotNull())).otherwise(errors)
    no_object = value.isNull() | keys.isNull()
    return F.nullif(F.array_join(F.when(no_object, F.array(F.lit("arguments are no JSON object"))).otherwise(errors), "; "), F.lit(""))


def _quoted(text: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.array(text)), r"(?s)^\[(.*)\]$", 1)


def call_json(call_id: Column, tool: Column, arguments: Column) -> Column:
    """An assistant's message with one tool call."""
    text = F.coalesce(arguments, F.lit("{}"))
    value = F.when(F.json_object_keys(text).isNotNull(), F.to_json(F.try_parse_json(text)))
    name = F.when(tool.isNotNull(), F.concat(F.lit(',"name":'), _quoted(tool))).otherwise(F.lit(""))
    own = F.when(call_id.isNotNull(), F.concat(F.lit(',"id":'), _quoted(call_id))).otherwise(F.lit(""))
    return F.concat(F.lit('{"role":"assistant","tool_calls":[{"function":{"arguments":'), F.coalesce(value, _quoted(text)), name, F.lit("}"), own,
                    F.lit(',"type":"function"}]}'))


def _later(place: Column, steps: Column) -> Column:
    """A place so many steps on; null stays null."""
    return F.when(place.isNotNull(), F.struct(place["at"].alias("at"), (place["step"] + steps).alias("step")))


def place_calls(calls: DataFrame) -> DataFrame:
    """Calls (conv, call_id, turn, result_turn, after) with their place (``at``, ``step``) and ``circular``.

    A wait (call_id, needs) puts a call at ``least`` or ``steps`` after the place of the other, whichever is later. In a
    round a wait for a placed call becomes part of the call's own place, and a wait for a call that has one wait itself
    is led on to the end of that wait. Waits with the same ends are one. Of waits without a circle each round places at
    least one call, so the calls left by a round that places none wait, at last, for a circle.
    """
    key = ["conv", "call_id"]
    base = calls.select(*key, F.struct(F.col("turn").alias("at"), F.lit(0).alias("step")).alias("own"))
    answered = F.col("result_turn").isNotNull()
    ends = calls.select("conv", F.col("call_id").alias("needs"), (1 + answered.cast("int")).alias("steps"),
                        F.when(answered, F.struct(F.col("result_turn").alias("at"), F.lit(1).alias("step"))).alias("least"))
    waits = stage(calls.select(*key, F.explode("after").alias("needs")).distinct().join(ends, ["conv", "needs"]).select(*key, "needs", "least", "steps"))
    own = stage(base.join(waits.select(*key).union(waits.select("conv", F.col("needs").alias("call_id"))).distinct(), key, "left_semi"))
    pending = waits.select(*key).distinct().count()
    while pending:
        open_ = waits.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct("needs", "least", "steps")).alias("next"))
        other = own.join(open_, key, "left").select("conv", F.col("call_id").alias("needs"), "own", F.coalesce("n", F.lit(0)).alias("n"), "next")
        one = F.col("n") == 1
        led = (waits.join(other, ["conv", "needs"])
               .select(*key, F.when(one, F.col("next.needs")).when(F.col("n") > 1, F.col("needs")).alias("needs"),
                       F.greatest("least", F.when(F.col("n") < 2, _later(F.col("own"), F.col("steps"))),
                                  F.when(one, _later(F.col("next.least"), F.col("steps")))).alias("least"),
                       (F.col("steps") + F.when(one, F.col("next.steps")).otherwise(0)).alias("steps")))
        led = stage(led.groupBy(*key, "needs").agg(F.max("least").alias("least"), F.max("steps").alias("steps")))
        own = stage(own.join(led.where("needs is null").select(*key, "least"), key, "left").select(*key, F.greatest("own", "least").alias("own")))
        waits = led.where("needs is not null")
        before, pending = pending, waits.select(*key).distinct().count()
        if pending == before:
            break
    stuck = waits.select(*key, F.lit(True).alias("circular")).distinct()
    placed = base.withColumnRenamed("own", "turn").join(own, key, "left").join(stuck, key, "left")
    place = F.when(F.col("circular"), F.col("turn")).otherwise(F.coalesce("own", "turn"))
    return stage(placed.select(*key, place["at"].alias("at"), place["step"].alias("step"), F.coalesce("circular", F.lit(False)).alias("circular")))


def format_chats(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """One row for each message, call and result, numbered by ``position`` within its conversation.

    ``messages``: conv, turn, role, content. ``calls``: conv, turn, call_id, tool, arguments (JSON text), after
    (ids of calls). ``results``: conv, turn, call_id, content. Other columns are not looked at.
    """
    messages = messages.select("conv", "turn", "role", "content").distinct()
    calls = calls.select("conv", "turn", "call_id", "tool", "arguments", F.array_sort(F.array_distinct("after")).alias("after")).distinct()
    results = results.select("conv", "turn", "call_id", "content").distinct()

    first_call = calls.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "tool", "arguments", "after")).alias("own"))
    first_result = results.groupBy("conv", "call_id").agg(F.min(F.struct("turn", "content")).alias("own"))
    placed = place_calls(stage(
        first_call.select("conv", "call_id", F.col("own.turn").alias("turn"), F.col("own.after").alias("after"))
        .join(first_result.select("conv", "call_id", F.col("own.turn").alias("result_turn")), ["conv", "call_id"], "left")))

    is_first = F.struct("turn", "tool", "arguments", "after").eqNullSafe(F.col("own"))
    known = placed.join(first_result.select("conv", "call_id", F.lit(True).alias("answered")), ["conv", "call_id"], "left")
    formatted_calls = (
        calls.join(first_call, ["conv", "call_id"], "left").join(known, ["conv", "call_id"], "left")
        .select("conv", "turn", F.lit("call").alias("kind"), "call_id", F.when(is_first, F.col("at")).otherwise(F.col("turn")).alias("at"),
                F.when(is_first, F.coalesce("step", F.lit(0))).otherwise(F.lit(0)).alias("step"),
                (F.coalesce(is_first, F.lit(False)) & F.coalesce("answered", F.lit(False))).alias("linked"),
                F.nullif(F.concat_ws("; ", argument_errors(F.col("arguments"), F.col("tool"), schemas),
                                     F.when(is_first & F.col("circular"), F.lit("waits in a circle"))), F.lit("")).alias("errors"),
                call_json(F.col("call_id"), F.col("tool"), F.col("arguments")).alias("json")))

    is_first = F.struct("turn", "content").eqNullSafe(F.col("own")) & F.col("at").isNotNull()
    later = F.greatest(F.struct(F.col("turn").alias("at"), F.lit(0).alias("step")), F.struct(F.col("at"), (F.col("step") + 1).alias("step")))
    place = F.when(is_first, later).otherwise(F.struct(F.col("turn").alias("at"), F.lit(0).alias("step")))
    formatted_results = (
        results.join(first_result, ["conv", "call_id"], "left").join(placed, ["conv", "call_id"], "left").withColumn("place", place)
        .select("conv", "turn", F.lit("result").alias("kind"), "call_id", F.col("place.at").alias("at"), F.col("place.step").alias("step"),
                F.coalesce(is_first, F.lit(False)).alias("linked"), F.lit(None).cast("string").alias("errors"),
                F.to_json(F.struct("content", F.lit("tool").alias("role"), F.col("call_id").alias("tool_call_id"))).alias("json")))

    plain = messages.select("conv", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.col("turn").alias("at"), F.lit(0).alias("step"),
                            F.lit(None).cast("boolean").alias("linked"), F.lit(None).cast("string").alias("errors"), F.to_json(F.struct("content", "role")).alias("json"))
    rows = stage(plain.unionByName(formatted_calls).unionByName(formatted_results).withColumn("stretch", F.floor(F.col("at") / STRETCH)))
    return _numbered(rows).select("conv", "position", "turn", "kind", "call_id", "linked", "errors", "json")


def _numbered(rows: DataFrame) -> DataFrame:
    """Positions within a conversation; stretches are counted first, so a long conversation is no single group."""
    sizes = rows.groupBy("conv", "stretch").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("conv", "stretch", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("conv", "stretch").orderBy("at", "step", "kind", "turn", "call_id", "json"))
    numbered = rows.withColumn("within", within)
    both = numbered.alias("r").join(starts.alias("s"), F.col("r.conv").eqNullSafe(F.col("s.conv")) & F.col("r.stretch").eqNullSafe(F.col("s.stretch")))
    return both.select("r.*", (F.col("within") + F.col("before")).cast("long").alias("position"))
