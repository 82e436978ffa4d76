"""Tool-call linking for chat data (operator 10).

Inputs are three tables: messages (conv_id, turn, role, text), calls (conv_id, turn,
call_id, name, arguments as JSON text) and results (conv_id, turn, call_id, content).
Calls and results are hash-joined by (conv_id, call_id).  Events of a conversation are
put in topological order: a result comes after its call, and a call after the results
its arguments name (``{"$result": "<call_id>"}``); otherwise the turn decides.
Arguments are validated against the tool's JSON schema, and each event becomes one
line of canonical JSON (sorted keys, no spaces).

A conversation is never gathered into one task: an event's place is a pair (turn,
depth).  Turns are relaxed with joins until none moves, then depths are dealt out in
rounds among the references that stay inside one turn.  Both take as many rounds as the
longest chain of references that point past their call's turn, whatever else the table
holds; references to earlier turns, the usual ones, take none.
numbers within a conversation come from a range sort with carried counts.

Defined results: an event whose conv_id is null belongs to the conversation null; a
null turn counts as before all others; null text is null in the JSON.  A result
without a call, a call without result, further results of one call, arguments that
are no JSON object (numbers beyond a double, NaN and infinities are no JSON), arguments
nested deeper than ``MAX_DEPTH``, unknown tools and schema violations are named in
``error``.  Lone surrogates stay as JSON escapes.  A
call that waits for itself (a cycle) is named too; its references are then ignored.
Repeated rows stay repeated.  Empty tables give an empty result.
"""

from __future__ import annotations

import json
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, record, stored

_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}


MAX_DEPTH = 100          # levels of nested arguments that are taken
_LONE = re.compile("[\ud800-\udfff]")


def sound(text: str) -> str:
    """The text with lone surrogates, which UTF-8 cannot hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return sound(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def violations(value, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` breaks of a JSON schema (the usual structural keywords)."""
    if isinstance(value, dict) and set(value) == {"$result"}:
        return []  # stands for a result that is filled in later
    out = []
    kinds = schema.get("type")
    if kinds and not any(_is(value, k) for k in ([kinds] if isinstance(kinds, str) else kinds)):
        return [f"{at}: not {kinds}"]
    if "enum" in schema and value not in schema["enum"]:
        out.append(f"{at}: not in enum")
    if _is(value, "number"):
        out += [f"{at}: below minimum"] if value < schema.get("minimum", value) else []
        out += [f"{at}: above maximum"] if value > schema.get("maximum", value) else []
    if isinstance(value, str):
        out += [f"{at}: too short"] if len(value) < schema.get("minLength", 0) else []
        out += [f"{at}: too long"] if len(value) > schema.get("maxLength", len(value)) else []
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k in sorted(value):
            if k in known:
                out += violations(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties", True) is False:
                out.append(f"{at}.{k}: not allowed")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            out += violations(x, schema["items"], f"{at}[{i}]")
    return out


def references(value) -> list[str]:
    """Call ids whose results the arguments name."""
    if isinstance(value, dict):
        if set(value) == {"$result"} and isinstance(value["$result"], str):
            return [value["$result"]]
        return [r for k in sorted(value) for r in references(value[k])]
    return [r for x in value for r in references(x)] if isinstance(value, list) else []


def _depth(value) -> int:
    """Levels of nesting, counted without recursion."""
    depth, level = 0, [value]
    while level := [x for v in level if isinstance(v, (dict, list)) for x in (v.values() if isinstance(v, dict) else v)]:
        depth += 1
    return depth


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def _no_number(text: str):
    raise ValueError(text)


def _parsed(text):
    """(arguments, error).  NaN, infinities and numbers that overflow are no JSON."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_no_number)
    except (TypeError, ValueError):
        return None, "arguments are not a JSON object"
    except RecursionError:
        return None, "arguments are nested too deep"
    if not isinstance(value, dict):
        return None, "arguments are not a JSON object"
    return (None, "arguments are nested too deep") if _depth(value) > MAX_DEPTH else (value, "")


def _checked(schemas: dict):
    """Calls with their canonical arguments, references and errors."""
    def run(batches):
        out = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("call_id", pa.string()), ("name", pa.string()),
                         ("args", pa.string()), ("refs", pa.list_(pa.string())), ("error", pa.string())])
        for conv, turn, call, name, args in batches_of(batches, "conv_id", "turn", "call_id", "name", "arguments"):
            parsed = [_parsed(a) for a in args]
            values = [v for v, _ in parsed]
            errors = [error or (f"unknown tool {n}" if n not in schemas else sound("; ".join(violations(v, schemas[n]))))
                      for (v, error), n in zip(parsed, name)]
            yield record(out, [conv, turn, call, name, [None if v is None else canonical(v) for v in values],
                               [sorted({r for r in references(v) if not _LONE.search(r)}) for v in values], errors])
    return run


def _beside(left: DataFrame, right: DataFrame, how: str = "left", on: str = "call_id") -> DataFrame:
    """Join on (conv_id, ``on`` = call_id), null-safe in conv_id; the right side's keys go."""
    right = right.withColumnRenamed("conv_id", "_conv").withColumnRenamed("call_id", "_call")
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col(on) == F.col("_call")), how).drop("_conv", "_call")


def _places(calls: DataFrame, results: DataFrame) -> DataFrame:
    """conv_id, call_id, turn, depth (its place) and cyclic of every call.

    place(call) = max(own (turn, 0), place of each result it names + one step);
    place(result) = max(own (turn, 0), place of its call + one step)."""
    one = calls.groupBy("conv_id", "call_id").agg(F.min("turn").alias("turn"), F.flatten(F.collect_set("refs")).alias("refs"))
    first = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("result_turn"))
    edges = one.select("conv_id", "call_id", F.explode("refs").alias("needs"))
    edges = stored(_beside(edges, first, "inner", "needs").withColumn("result_turn", F.coalesce("result_turn", F.lit(-1)).cast("long"))
                   .distinct(), "references")
    now = stored(one.select("conv_id", "call_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("turn")), "places")
    # Turns first: the latest turn of all that a call waits for.  A maximum also settles on a cycle.
    while True:
        step = (_beside(edges, now, "inner", "needs").groupBy("conv_id", "call_id")
                .agg(F.max(F.greatest("turn", "result_turn")).alias("later")))
        moved = stored(_beside(now, step).select("conv_id", "call_id", F.greatest("turn", "later").alias("turn"),
                                                 (F.coalesce("later", F.lit(-2)) > F.col("turn")).alias("changed")), "places")
        now = moved.select("conv_id", "call_id", "turn")
        if not moved.where("changed").limit(1).count():
            break
    # Depths among calls and results of one turn: only references inside the turn count, and every cycle is among
    # them.  Calls whose references are all placed are placed in rounds; what never comes is on or behind a cycle.
    mine = now.select("conv_id", "call_id", F.col("turn").alias("own"))
    tight = stored(_beside(_beside(edges, now, "inner", "needs"), mine, "inner")
                   .where(F.greatest("turn", "result_turn") == F.col("own"))
                   .select("conv_id", "call_id", "needs", (F.col("turn") == F.col("own")).alias("waits")), "tight")
    start = tight.groupBy("conv_id", "call_id").agg(F.max("waits").alias("waits"))
    placed = stored(_beside(now, start).where(~F.coalesce("waits", F.lit(False)))
                    .select("conv_id", "call_id", F.when(F.col("waits").isNotNull(), 1).otherwise(0).cast("long").alias("depth")), "placed")
    left = stored(start.where("waits").select("conv_id", "call_id"), "waiting")
    n = left.count()
    while n:
        ready = (_beside(_beside(tight, left, "left_semi"), placed, "left", "needs").groupBy("conv_id", "call_id")
                 .agg(F.max(F.col("waits") & F.col("depth").isNull()).alias("open"),
                      F.max(F.when(F.col("waits"), F.col("depth") + 2).otherwise(1)).alias("depth")).where(~F.col("open")))
        placed = stored(placed.unionByName(ready.select("conv_id", "call_id", "depth")), "placed")
        left = stored(_beside(left, placed.select("conv_id", "call_id"), "left_anti"), "waiting")
        n, before = left.count(), n
        if n == before:
            break
    own = one.select("conv_id", "call_id", F.coalesce("turn", F.lit(-1)).cast("long").alias("own"))
    return (_beside(_beside(now, placed), own, "inner")
            .select("conv_id", "call_id", F.when(F.col("depth").isNull(), F.col("own")).otherwise(F.col("turn")).alias("turn"),
                    F.coalesce("depth", F.lit(0)).alias("depth"), F.col("depth").isNull().alias("cyclic")))


def numbered(events: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``seq`` from 0 within each group, without gathering a group: rows are dealt by
    ranges of (group, order) and each range starts from the counts of the earlier ones."""
    dealt = stored(events.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
                   .withColumn("_part", F.spark_partition_id()), "events")
    counts = dealt.groupBy("_part", group).agg(F.count("*").alias("_n"))
    before = counts.select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(
        Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order)) - 1
    left = dealt.withColumn("_inside", inside)
    return (left.join(before, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
            .withColumn("seq", (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_p", "_g", "_before", "_inside"))


def link_tool_calls(messages: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict) -> DataFrame:
    """One row per event: conv_id, seq, kind, call_id, linked, error, json.
    ``schemas``: JSON schema of each tool's arguments, by name."""
    messages = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                               F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    calls = stored(calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", "name", "arguments")
                   .mapInArrow(_checked(schemas), "conv_id long, turn long, call_id string, name string, args string, refs array<string>, error string"), "calls")
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "call_id", "content")
    place = stored(_places(calls.where("call_id is not null"), results.where("call_id is not null")), "call-places")
    place = place.withColumnRenamed("turn", "pt")
    firsts = results.groupBy("conv_id", "call_id").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n_results"))
    call_events = (_beside(_beside(calls, place), firsts).select(
        "conv_id", F.coalesce("pt", "turn", F.lit(-1)).alias("turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
        F.lit(1).alias("rank"), F.lit("call").alias("kind"), "call_id", F.col("n_results").isNotNull().alias("linked"),
        F.concat_ws("; ", F.when(F.col("error") != "", F.col("error")), F.when(F.col("n_results").isNull(), F.lit("no result")),
                    F.when(F.col("cyclic"), F.lit("waits for itself"))).alias("error"),
        F.col("name").alias("label"), F.col("args").alias("body")))
    own = F.struct(F.coalesce("turn", F.lit(-1)).cast("long").alias("turn"), F.lit(0).cast("long").alias("depth"))
    behind = F.struct(F.coalesce("pt", F.lit(-2)).cast("long").alias("turn"), (F.coalesce("depth", F.lit(0)) + 1).cast("long").alias("depth"))
    result_events = (_beside(_beside(results, place), firsts).select(
        "conv_id", F.greatest(own, behind).alias("p"), F.lit(2).alias("rank"), F.lit("result").alias("kind"), "call_id",
        F.col("pt").isNotNull().alias("linked"),
        F.concat_ws("; ", F.when(F.col("pt").isNull(), F.lit("no call")),
                    F.when((F.col("n_results") > 1) & (F.coalesce("turn", F.lit(-1)) > F.coalesce("first_turn", F.lit(-1))), F.lit("further result"))).alias("error"),
        F.lit(None).cast("string").alias("label"), F.col("content").alias("body"))
        .select("conv_id", "p.turn", "p.depth", "rank", "kind", "call_id", "linked", "error", "label", "body"))
    message_events = messages.select("conv_id", F.coalesce("turn", F.lit(-1)).alias("turn"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("rank"),
                                     F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(True).alias("linked"),
                                     F.lit("").alias("error"), F.col("role").alias("label"), F.col("text").alias("body"))
    events = message_events.unionByName(call_events).unionByName(result_events)
    order = ["turn", "depth", "rank", "call_id", "label", "body"]

    def write(batches):
        out = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("call_id", pa.string()),
                         ("linked", pa.bool_()), ("error", pa.string()), ("json", pa.string())])
        for conv, seq, kind, call, linked, error, label, body in batches_of(
                batches, "conv_id", "seq", "kind", "call_id", "linked", "error", "label", "body"):
            lines = []
            for k, c, n, t in zip(kind, call, label, body):
                if k == "message":
                    lines.append(canonical({"role": n, "content": t}))
                elif k == "call":
                    lines.append(canonical({"role": "assistant", "tool_calls": [{"id": c, "type": "function", "function": {
                        "name": n, "arguments": None if t is None else json.loads(t)}}]}))
                else:
                    lines.append(canonical({"role": "tool", "tool_call_id": c, "content": t}))
            yield record(out, [conv, seq, kind, call, linked, error, lines])

    return numbered(events, "conv_id", order).mapInArrow(
        write, "conv_id long, seq long, kind string, call_id string, linked boolean, error string, json string")


# -- tool traffic derived from the conversations table ----------------------

SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 400},
        "after": {"type": "string"}}},
    "translate": {"type": "object", "required": ["text", "to"], "properties": {
        "text": {"type": "string"}, "to": {"type": "string", "enum": ["en", "de", "fr", "es"]}, "after": {"type": "string"}}},
    "summarise": {"type": "object", "required": ["text", "words"], "properties": {
        "text": {"type": "string"}, "words": {"type": "number", "minimum": 10}, "after": {"type": "string"}}},
}


def traffic(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that the turns of ``conversations`` stand for: every user turn
    calls a tool (chosen by its text's crc32), every assistant turn answers the call of
    the turn before; a call names the result of the call two turns before it."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role",
                             F.coalesce("text", F.lit("")).alias("text"))
    ident = lambda turn: F.concat(F.lit("call_"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit("_"),
                                  F.coalesce(turn.cast("string"), F.lit("")))
    size = F.char_length("text")
    tool = F.crc32("text") % 3
    after = F.when(F.col("turn") >= 2, F.struct(ident(F.col("turn") - 2).alias("$result")))
    args = (F.when(tool == 0, F.to_json(F.struct(F.col("text").alias("query"), size.alias("limit"), after.alias("after"))))
            .when(tool == 1, F.to_json(F.struct("text", F.element_at(F.array(*map(F.lit, ["en", "de", "fr", "es", "it"])), (size % 5 + 1).cast("int")).alias("to"), after.alias("after"))))
            .otherwise(F.to_json(F.struct("text", (size / 8).alias("words"), after.alias("after")))))
    name = F.when(tool == 0, "search").when(tool == 1, "translate").otherwise("summarise")
    calls = c.where("role = 'user'").select("conv_id", "turn", ident(F.col("turn")).alias("call_id"), name.alias("name"), args.alias("arguments"))
    results = c.where("role = 'assistant'").select("conv_id", "turn", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return calls, results
