"""Chat formatting: link tool calls to results, order them, check arguments against schemas, and write canonical JSON.

A message whose text is a JSON object with ``tool_calls`` (a list of {id, name, arguments}) makes calls, one with
``tool_call_id`` a result; others are plain. Arguments may name earlier calls by "$ref:<id>" strings. Records without any such JSON can be read
as exchanges: a user's turn is a call of the tool ``reply`` with the id conv:turn, the next turn, if the assistant's, its result.

Calls and results meet in a hash join by (conversation, id). Order follows from depths: a result stands behind its call, a call
behind the results it refers to. Depths are found layer by layer, and a call that waits for one other only takes over what that one
waits for, so a chain of n references takes log2 n rounds. No conversation is gathered in one task.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

REPLY = {
    "reply": {
        "type": "object",
        "required": ["prompt", "turn"],
        "additionalProperties": False,
        "properties": {"prompt": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}},
    }
}
_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


_LONE = re.compile("[\ud800-\udfff]")


def canonical(value: Any) -> str:
    """Keys sorted by code point, no spaces, characters as they are; lone surrogates, which UTF-8 can't hold, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(number: str) -> float:
    if not math.isfinite(float(number)):
        raise ValueError(f"{number} is out of range")
    return float(number)


def _refuse(name: str) -> None:
    raise ValueError(f"{name} isn't JSON")


def load(text: str) -> Any:
    """The value of a JSON text. ValueError if it is malformed, nested too deeply, or holds numbers that aren't finite."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_refuse)
        canonical(value)
    except RecursionError:
        raise ValueError("nested too deeply") from None
    return value


def _plain(text: str) -> str:
    """Lone surrogates replaced, for columns that hold text."""
    return _LONE.sub("\ufffd", text)


def violations(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What in value breaks the schema: type, enum, required, properties, additionalProperties, items and the limits on sizes."""
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind == "number" and not number or kind == "integer" and not (number and value == int(value)) or kind in _TYPES and not isinstance(value, _TYPES[kind]):
        return [f"{at}: not of type {kind}"]
    found = []
    if "enum" in schema and value not in schema["enum"]:
        found.append(f"{at}: not one of the listed values")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in sorted(value.items()):
            if k in known:
                found += violations(v, known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for k, v in enumerate(value):
            found += violations(v, schema["items"], f"{at}[{k}]")
    for least, most, size in (("minLength", "maxLength", len(value) if isinstance(value, str) else None), ("minItems", "maxItems", len(value) if isinstance(value, list) else None), ("minimum", "maximum", value if number else None)):
        if size is not None and ("%s" % least in schema and size < schema[least] or most in schema and size > schema[most]):
            found.append(f"{at}: outside its limits")
    return found


def _references(value: Any) -> set[str]:
    found, todo = set(), [value]
    while todo:
        x = todo.pop()
        if isinstance(x, str) and x.startswith("$ref:"):
            found.add(_plain(x[5:]))
        elif isinstance(x, (dict, list)):
            todo += x.values() if isinstance(x, dict) else x
    return found


def _text_of(value: Any) -> str | None:
    return value if value is None else _plain(value) if isinstance(value, str) else canonical(value)


def _events(conv: int | None, turn: int | None, role: str | None, text: str | None, exchanges: bool) -> Iterator[tuple]:
    """(part, kind, call_id, name, arguments as JSON, references, content)"""
    spec = None
    if text and text.lstrip()[:1] == "{":
        try:
            spec = load(text)
        except ValueError:
            spec = None
    calls = spec.get("tool_calls") if isinstance(spec, dict) else None
    if isinstance(calls, list) and calls and all(isinstance(c, dict) for c in calls):
        for k, c in enumerate(calls):
            args = c.get("arguments", {})
            if isinstance(args, str):
                try:
                    args = load(args)
                except ValueError:
                    pass
            yield k, "call", _text_of(c.get("id")), _text_of(c.get("name")), canonical(args), sorted(_references(args)), None
    elif isinstance(spec, dict) and "tool_call_id" in spec:
        yield 0, "result", _text_of(spec["tool_call_id"]), None, None, [], _text_of(spec.get("content"))
    elif exchanges and role == "user" and conv is not None and turn is not None:
        yield 0, "call", f"{conv}:{turn}", "reply", canonical({"prompt": text or "", "turn": turn}), [], None
    elif exchanges and role == "assistant" and conv is not None and turn:
        yield 0, "result", f"{conv}:{turn - 1}", None, None, [], text
    else:
        yield 0, "message", None, None, None, [], text


_SCHEMA = "conv long, turn long, role string, row long, part int, kind string, call_id string, name string, arguments string, refs array<string>, content string"


def _parse(exchanges: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(c, t, r, n, *e) for c, t, r, x, n in zip(*(k.to_pylist() for k in batch.columns), strict=True) for e in _events(c, t, r, x, exchanges)]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string()]
            names = [f.split()[0] for f in _SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return run


def _write(schemas: dict[str, dict]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid, errors, out = [], [], []
            for r in batch.to_pylist():
                obj: dict[str, Any] = {"kind": r["kind"], "role": r["role"], "turn": r["turn"]}
                error = None
                if r["kind"] == "call":
                    args = json.loads(r["arguments"])
                    wrong = violations(args, schemas[r["name"]]) if r["name"] in schemas else ["unknown tool"]
                    error = "; ".join(wrong) or None
                    obj |= {"arguments": args, "id": r["call_id"], "name": r["name"]}
                elif r["kind"] == "result":
                    obj |= {"content": r["content"], "id": r["call_id"], "linked": r["linked"]}
                else:
                    obj["content"] = r["content"]
                valid.append(None if r["kind"] != "call" else error is None)
                errors.append(error)
                out.append(canonical(obj))
            keep = [batch.column(k) for k in range(11)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(valid, pa.bool_()), pa.array(errors, pa.string()), pa.array(out, pa.string())], names=[*batch.schema.names[:11], "valid", "error", "json"])

    return run


def depths(calls: DataFrame) -> DataFrame:
    """conv, call_id, depth, call_turn of each call: depth 0 without known references, else one more than the deepest; call_turn is the least turn that keeps order.

    calls: conv, call_id, turn, refs, result_turn (null: none). Calls in or behind a circle of references have no row. A call's depth is
    the greatest of a number and, for each call it waits for, that one's depth and a step; its turn likewise. So waits add up along a chain.
    """
    keys, far = ["conv", "call_id"], F.lit(1 << 40)  # steps around a circle add up without end
    ends = calls.select("conv", F.col("call_id").alias("ref"), F.coalesce("result_turn", "turn").alias("turn"))
    wait = cut(calls.select(*keys, F.explode("refs").alias("ref")).join(ends, ["conv", "ref"]).select(*keys, "ref", F.lit(1).cast("long").alias("step"), "turn").distinct())
    node = calls.select(*keys, F.lit(0).cast("long").alias("depth"), F.col("turn").alias("call_turn"))
    done = node.join(wait.select(*keys).distinct(), keys, "left_anti")
    if not wait.take(1):
        return done
    done, node = cut(done), cut(node.join(wait.select(*keys).distinct(), keys, "left_semi"))
    while True:
        met = wait.join(done.select("conv", F.col("call_id").alias("ref"), F.col("depth").alias("d2"), F.col("call_turn").alias("t2")), ["conv", "ref"], "left")
        met = met.select(*keys, F.when(F.col("d2").isNull(), F.col("ref")).alias("ref"), "step", "turn", "d2", "t2")
        gained = met.groupBy(*keys).agg(F.count("ref").alias("open"), F.max(F.when(F.col("ref").isNull(), F.col("d2") + F.col("step"))).alias("d3"), F.max(F.when(F.col("ref").isNull(), F.greatest("turn", "t2"))).alias("t3"))
        state = cut(node.join(gained, keys).select(*keys, F.greatest("depth", F.coalesce("d3", "depth")).alias("depth"), F.greatest("call_turn", F.coalesce("t3", "call_turn")).alias("call_turn"), "open"))
        new = state.filter("open = 0").drop("open")
        if not new.take(1):
            return done
        done, node = cut(done.union(new)), state.filter("open > 0")
        wait = met.filter("ref is not null").select(*keys, "ref", "step", "turn")
        # a call that waits for one other, which itself waits for one, waits for the latter
        single = node.filter("open = 1").select(*keys)
        hop = wait.join(node.filter("open = 1").select(*keys, "depth", "call_turn"), keys)
        hop = hop.select("conv", F.col("call_id").alias("ref"), F.col("ref").alias("far"), F.col("step").alias("far_step"), F.greatest("turn", "call_turn").alias("far_turn"), F.col("depth").alias("far_depth"))
        ahead = wait.join(single, keys, "left_semi").join(hop, ["conv", "ref"], "left")
        ahead = cut(ahead.unionByName(wait.join(single, keys, "left_anti"), allowMissingColumns=True))
        least = ahead.filter("far is not null").select(*keys, F.least(F.col("step") + F.col("far_depth"), far).alias("d4"), F.greatest("turn", "far_turn").alias("t4"))
        node = cut(node.join(least, keys, "left").select(*keys, F.greatest("depth", F.coalesce("d4", "depth")).alias("depth"), F.greatest("call_turn", F.coalesce("t4", "call_turn")).alias("call_turn")))
        wait = ahead.select(*keys, F.coalesce("far", "ref").alias("ref"), F.least(F.col("step") + F.coalesce("far_step", F.lit(0)), far).alias("step"), F.greatest("turn", F.coalesce("far_turn", "turn")).alias("turn"))


def link(conversations: DataFrame, schemas: dict[str, dict] | None = None, exchanges: bool = True, stable: bool = True, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per event, a message or one of its calls: conv_id, turn, role, part, kind, call_id, name, linked, peer_turn, depth, order_turn, valid, error, json.

    Sorted by (conv_id, order_turn, depth, turn, part) a conversation is in topological order; depth is null in circles. linked: a call
    that has a result, a result that has a call; peer_turn is the first such result's, or the call's, turn. The first call with an id, by (turn,
    part), has it, of repeated rows one; later ones and events with null ids stay unlinked. Null texts are empty messages; malformed JSON, numbers that
    aren't finite included, is text; lone surrogates stay escapes in JSON and are replaced in ids and names; null conversations link with nothing.
    Other columns don't matter. An empty table gives an empty result. The input is read more than once: stable=False writes one that isn't a table
    to the checkpoint folder first.
    """
    slim = conversations.select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    slim = slim if stable else cut(slim)
    events = slim.mapInArrow(_parse(exchanges), _SCHEMA)
    named = events.filter("conv is not null and call_id is not null")
    first = named.filter("kind = 'call'").groupBy("conv", "call_id").agg(F.min_by(F.struct("turn", "part", "row", "refs"), F.struct("turn", "part", "row")).alias("f"))
    keys = ["conv", "call_id"]
    results = named.filter("kind = 'result'").groupBy(*keys).agg(F.min("turn").alias("result_turn"))
    calls = first.select(*keys, F.col("f.turn").alias("turn"), F.col("f.part").alias("part"), F.col("f.row").alias("row"), F.col("f.refs").alias("refs"))
    calls = cut(calls.join(results, keys, "left"))
    placed = depths(calls)
    known = calls.select(*keys, F.col("turn").alias("own_turn"), F.col("part").alias("own_part"), F.col("row").alias("own_row"), "result_turn").join(placed, keys, "left")
    joined = events.join(known, keys, "left")
    call, result = F.col("kind") == "call", F.col("kind") == "result"
    owner = call & F.col("own_row").eqNullSafe(F.col("row")) & F.col("own_part").eqNullSafe(F.col("part"))
    has = F.when(call, owner & F.col("result_turn").isNotNull()).when(result, F.col("own_part").isNotNull()).otherwise(F.lit(False))
    out = joined.select(
        "conv", "turn", "role", "part", "kind", "call_id", "name",
        F.coalesce(has, F.lit(False)).alias("linked"),
        F.when(has & call, F.col("result_turn")).when(has & result, F.col("own_turn")).alias("peer_turn"),
        F.when(owner, F.col("depth") * 2).when(has & result, F.col("depth") * 2 + 1).when(~call & ~result | ~has, F.lit(0)).cast("int").alias("depth"),
        F.when(owner | (has & result), F.greatest("turn", "call_turn")).otherwise(F.col("turn")).alias("order_turn"),
        "arguments", "content",
    )
    schema = "conv long, turn long, role string, part int, kind string, call_id string, name string, linked boolean, peer_turn long, depth int, order_turn long, valid boolean, error string, json string"
    return out.mapInArrow(_write(REPLY if schemas is None else schemas), schema).withColumnRenamed("conv", conv_col)
