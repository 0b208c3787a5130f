"""Chat formatting: tool calls and results linked by identifier, ordered, validated and written as canonical JSON."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import dropped, written

#: Message columns: conv, turn, kind (call, result or the role of any other message), call_id, name, arguments, content.
MESSAGE = ("conv", "turn", "kind", "call_id", "name", "arguments", "content")
_TYPES = {"string": str, "object": dict, "array": list, "boolean": bool, "null": type(None)}
#: What a string starts with that names another call's result, where a schema has reference: true.
REFERENCE = "$result:"


def canonical(value: object) -> str:
    """JSON with sorted keys, no blanks and no escapes that UTF-8 does not need."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def fits(value: object, schema: dict, path: str = "") -> str:
    """What a value breaks of a JSON schema, or "". Knows type, enum, properties, required, additionalProperties, items;
    a type that it does not know is reported as schema."""
    kind = schema.get("type")
    if kind:
        number, found = isinstance(value, (int, float)) and not isinstance(value, bool), False
        for k in [kind] if isinstance(kind, str) else kind:
            if k not in _TYPES and k not in ("number", "integer"):
                return f"schema:{path or '.'}"
            found = found or (number and (k == "number" or isinstance(value, int) or value == int(value)) if k in ("number", "integer") else isinstance(value, _TYPES[k]))
        if not found:
            return f"type:{path or '.'}"
    if "enum" in schema and value not in schema["enum"]:
        return f"enum:{path or '.'}"
    if isinstance(value, dict):
        own = schema.get("properties", {})
        for name in sorted(schema.get("required", ())):
            if name not in value:
                return f"missing:{path}.{name}"
        for name in sorted(value):
            if name in own:
                if bad := fits(value[name], own[name], f"{path}.{name}"):
                    return bad
            elif schema.get("additionalProperties") is False:
                return f"extra:{path}.{name}"
    if isinstance(value, list) and "items" in schema:
        for k, x in enumerate(value):
            if bad := fits(x, schema["items"], f"{path}[{k}]"):
                return bad
    return ""


def references(value: object, schema: dict) -> list[str]:
    """Identifiers of the calls whose results a value names, where its schema says that it may."""
    if schema.get("reference") and isinstance(value, str) and value.startswith(REFERENCE):
        return [value[len(REFERENCE) :]]
    if isinstance(value, dict):
        own = schema.get("properties", {})
        return [r for name in sorted(value) if name in own for r in references(value[name], own[name])]
    if isinstance(value, list) and "items" in schema:
        return [r for x in value for r in references(x, schema["items"])]
    return []


def _no_constant(name: str) -> None:
    raise ValueError(name)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(text)
    return value


def checked(name: object, arguments: object, tools: dict[str, dict]) -> tuple[str, str, list[str]]:
    """(status, arguments as canonical JSON, or as they came if they are none, references) of a call.

    Constants and numbers that JSON or a double cannot hold, and strings that UTF-8 cannot, are bad_json too.
    """
    try:
        value = json.loads(arguments, parse_constant=_no_constant, parse_float=_finite)
        text = canonical(value)
        text.encode("utf-8")
    except (TypeError, ValueError, RecursionError):
        return "unknown_tool" if name not in tools else "bad_json", arguments if isinstance(arguments, str) else "", []
    if name not in tools:
        return "unknown_tool", text, []
    return fits(value, tools[name]) or "ok", text, sorted(set(references(value, tools[name])))


def _ordered(edges: DataFrame) -> DataFrame:
    """(ck, call_id, s, l, cycle) of the calls that may have to wait beyond their own turn.

    edges (ck, call_id, turn, ref, dturn, dres): a call, and a call with a result that it names. Only calls that name a
    result that is not earlier than they are, and those that wait for such calls, can move: they are found first. Then
    calls whose named calls all have their places get theirs, round by round; those that are left when none does wait in
    a cycle or for one. So rounds grow with the longest chain of waits among these calls, not with how many they are.
    """

    def wait(s: str, l: str) -> str:
        return f"struct(greatest({s}, dres) as s, case when dres > {s} then 1 else {l} + 2 end as l)"

    spark, k = edges.sparkSession, 0
    late = edges.where("greatest(dturn, dres) >= turn").select("ck", "call_id").distinct()
    reach, path = written(late.withColumn("round", F.lit(0)))
    while True:  # whoever waits for them
        front = reach.where(F.col("round") == k).select("ck", F.col("call_id").alias("ref"))
        if not front.take(1):
            break
        more = edges.join(front, ["ck", "ref"]).select("ck", "call_id").distinct().join(reach.select("ck", "call_id"), ["ck", "call_id"], "left_anti")
        now, now_path = written(reach.union(more.withColumn("round", F.lit(k + 1))))
        dropped(spark, path)
        reach, path, k = now, now_path, k + 1
    moving = reach.select("ck", "call_id")
    inner, _ = written(edges.join(moving, ["ck", "call_id"], "left_semi").join(moving.select("ck", F.col("call_id").alias("ref"), F.lit(1).alias("open")), ["ck", "ref"], "left"))
    start = inner.groupBy("ck", "call_id").agg(F.sum(F.coalesce("open", F.lit(0))).alias("left"), F.max("turn").alias("turn"), F.max(F.expr(f"case when open is null then {wait('dturn', '0')} end")).alias("w"))
    state, path = written(start.selectExpr("ck", "call_id", "left", "greatest(w, struct(turn as s, 0 as l)) as h", "case when left = 0 then 0 end as round"))
    k = 0
    while True:
        front = state.where(F.col("round") == k).selectExpr("ck", "call_id as ref", "h.s as fs", "h.l as fl")
        if not front.take(1):
            return state.selectExpr("ck", "call_id", "h.s", "h.l", "left > 0 as cycle")
        found = inner.join(front, ["ck", "ref"]).groupBy("ck", "call_id").agg(F.count("*").alias("n"), F.max(F.expr(wait("fs", "fl"))).alias("w"))
        gone = "left - coalesce(n, 0L)"
        now, now_path = written(state.join(found, ["ck", "call_id"], "left").selectExpr("ck", "call_id", f"{gone} as left", "greatest(h, w) as h", f"case when round is null and {gone} = 0 then {k + 1} else round end as round"))
        dropped(spark, path)
        state, path, k = now, now_path, k + 1


def link(messages: DataFrame, tools: dict[str, dict]) -> DataFrame:
    """(conv, turn, kind, call_id, linked_turn, status, slot, level, json), a row for each distinct message.

    Calls and results meet in a hash join on (conv, call_id). The first call of an identifier, by turn, and the first
    result own it; later ones are duplicate_id and extra_result. A call without a result is no_result, a result without
    a call orphan_result, and a null identifier no_id. A call's arguments may name other calls' results as
    "$result:<id>" where the tool's schema has reference: true; other text that looks so is text. (slot, level, turn,
    kind) is a topological order within a conversation: a result comes after its call and a call after the results that
    it names, and otherwise turns keep their order: slot is the largest turn that a message has to wait for, its own
    included. Calls that wait for themselves, or for such calls, have status cycle and stay at their turn. Arguments are
    checked against the tool's JSON schema: ok, unknown_tool, bad_json, or what they break. json is canonical; arguments
    that are no JSON stay as they came. Null turns count as -1, and null texts as empty; texts of any length are kept
    whole; ties between calls or results of one identifier and turn fall by name and text; repeated rows count once;
    other columns are not read; an empty table gives no rows. A conversation is never gathered: all joins are on
    (conv, call_id).
    """

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [checked(n, a, tools) if k == "call" else (None, None, []) for k, n, a in zip(pdf["kind"], pdf["name"], pdf["arguments"], strict=True)]
            yield pdf.assign(valid=[f[0] for f in found], given=[f[1] for f in found], refs=[f[2] for f in found])

    conv = messages.schema["conv"].dataType.simpleString()
    rows = messages.select(*[F.col(f"`{c}`") for c in MESSAGE]).withColumn("turn", F.coalesce("turn", F.lit(-1)).cast("long")).distinct()
    kinds = f"conv {conv}, turn long, kind string, call_id string, name string, arguments string, content string, valid string, given string, refs array<string>"
    ck = F.coalesce(F.concat(F.lit("v"), F.col("conv").cast("string")), F.lit("n"))  # a key in place of a null
    base, _ = written(rows.mapInPandas(prepare, kinds).withColumn("ck", ck))
    keyed = base.where("call_id is not null")
    calls = keyed.where("kind = 'call'").groupBy("ck", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "refs")).alias("c"))
    results = keyed.where("kind = 'result'").groupBy("ck", "call_id").agg(F.min(F.struct("turn", "content")).alias("r"))
    nodes, _ = written(calls.join(results.hint("shuffle_hash"), ["ck", "call_id"], "full"))
    named = nodes.where("c is not null and size(c.refs) > 0").select("ck", "call_id", F.col("c.turn").alias("turn"), F.explode("c.refs").alias("ref"))
    whole = nodes.where("c is not null and r is not null").selectExpr("ck", "call_id as ref", "c.turn as dturn", "r.turn as dres")
    edges, _ = written(named.join(whole, ["ck", "ref"]))
    placed = nodes.selectExpr("ck", "call_id", "struct(c.turn, c.name, c.arguments) as c", "c is not null as called", "r").join(_ordered(edges), ["ck", "call_id"], "left")
    spot = placed.selectExpr("ck", "call_id", "c", "called", "r", "coalesce(cycle, false) as cycle", "case when cycle then c.turn else coalesce(s, c.turn) end as slot", "case when cycle then 0 else coalesce(l, 0) end as level")
    got = base.join(spot, ["ck", "call_id"], "left")
    is_call, is_result, called = F.col("kind") == "call", F.col("kind") == "result", F.coalesce("called", F.lit(False))
    own_call = is_call & called & F.struct("turn", "name", "arguments").eqNullSafe(F.col("c"))
    own_result = is_result & F.struct("turn", "content").eqNullSafe(F.col("r"))
    state = (
        F.when((is_call | is_result) & F.col("call_id").isNull(), "no_id")
        .when(is_call & ~own_call, "duplicate_id")
        .when(is_result & ~own_result, "extra_result")
        .when(is_call & F.col("cycle"), "cycle")
        .when(is_call & F.col("r").isNull(), "no_result")
        .when(is_result & ~called, "orphan_result")
        .otherwise("ok")
    )
    waits_call = is_result & called
    shaped = got.select(
        "conv", "turn", "kind", "call_id", "name", "given", "content", "valid", state.alias("state"),
        F.when(own_call, F.col("r.turn")).when(waits_call, F.col("c.turn")).alias("linked_turn"),
        F.when(own_call, F.col("slot")).when(waits_call, F.greatest("turn", "slot")).otherwise(F.col("turn")).alias("slot"),
        F.when(own_call, F.col("level")).when(waits_call & (F.col("turn") <= F.col("slot")), F.col("level") + 1).otherwise(F.lit(0)).cast("int").alias("level"),
    )

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            status, lines = [], []
            for kind, call_id, name, given, content, valid, found in zip(*(pdf[c] for c in ("kind", "call_id", "name", "given", "content", "valid", "state")), strict=True):
                text = content if isinstance(content, str) else ""
                if kind == "call":
                    status.append(found if valid == "ok" else valid if found == "ok" else f"{found},{valid}")
                    lines.append(canonical({"role": "assistant", "tool_calls": [{"id": call_id, "type": "function", "function": {"name": name, "arguments": given}}]}))
                else:
                    status.append(found)
                    lines.append(canonical({"role": "tool", "tool_call_id": call_id, "content": text} if kind == "result" else {"role": kind, "content": text}))
            yield pd.DataFrame({"conv": pdf["conv"], "turn": pdf["turn"], "kind": pdf["kind"], "call_id": pdf["call_id"], "linked_turn": pdf["linked_turn"], "status": status, "slot": pdf["slot"], "level": pdf["level"], "json": lines})

    return shaped.mapInPandas(render, f"conv {conv}, turn long, kind string, call_id string, linked_turn long, status string, slot long, level int, json string")


#: The tool that an exchange of plain turns stands for.
REPLY_TOOL = {"reply": {"type": "object", "properties": {"prompt": {"type": "string"}, "after": {"type": "string", "reference": True}}, "required": ["prompt"], "additionalProperties": False}}
#: What a call does by (conversation * 7 + turn) modulo 12: how many turns on the call is whose result it names, if not
#: two back (None: it names none), and which arguments it gets wrong.
NAMES = {0: None, 2: 2, 4: -4, 5: None, 6: 2, 7: None, 8: 4, 9: 2, 10: 0, 11: -4}
EXTRA, MISSING, TYPED, OTHER_TOOL, CUT = 0, 1, 3, 5, 7


def exchanges(conversations: DataFrame) -> DataFrame:
    """Messages for link() from plain turns (conv_id, turn, role, text).

    A user turn calls the tool reply with its text, and names the reply two turns back; the turn after it, if it is the
    assistant's, is the result. So that a corpus of plain turns has all that calls can have, a rule on conversation and
    turn (NAMES) lets some name later replies, their own or earlier ones, leave the text out, give a number for it, add
    an argument, call a tool that is not there, or break off. Turns of other roles, and assistant turns that answer no
    user turn, stay messages.
    """
    t = conversations.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), "role", "text").withColumn("turn", F.coalesce("turn", F.lit(-1)))
    asked = t.where("role = 'user'").select(F.col("conv").alias("v"), (F.col("turn") + 1).alias("next")).distinct()
    marked = t.join(asked, F.col("conv").eqNullSafe(F.col("v")) & (F.col("turn") == F.col("next")), "left").withColumn("rule", F.pmod(F.coalesce("conv", F.lit(0)) * 7 + F.col("turn"), F.lit(12)))
    call_of = lambda turn: F.concat(F.lit("call_"), turn.cast("string"))
    kind = F.when(F.col("role") == "user", "call").when((F.col("role") == "assistant") & F.col("next").isNotNull(), "result").otherwise(F.coalesce("role", F.lit("unknown")))
    call_id = F.when(kind == "call", call_of(F.col("turn"))).when(kind == "result", call_of(F.col("turn") - 1))
    named = F.col("turn") - 2
    for rule, step in NAMES.items():
        named = F.when(F.col("rule") == rule, F.lit(None).cast("long") if step is None else F.col("turn") + step).otherwise(named)
    after = F.when(named >= 0, F.concat(F.lit(REFERENCE), call_of(named))).alias("after")
    prompt, is_ = F.coalesce("text", F.lit("")).alias("prompt"), lambda rule: F.col("rule") == rule
    made = (
        F.when(is_(EXTRA), F.to_json(F.struct(F.lit(1).alias("tone"), prompt, after)))
        .when(is_(MISSING), F.to_json(F.struct(after)))
        .when(is_(TYPED), F.to_json(F.struct(F.col("turn").alias("prompt"), after)))
        .when(is_(CUT), F.lit('{"prompt":'))
        .otherwise(F.to_json(F.struct(prompt, after)))
    )
    name = F.when(is_(OTHER_TOOL), "answer").otherwise("reply")
    return marked.select("conv", "turn", kind.alias("kind"), call_id.alias("call_id"), F.when(kind == "call", name).alias("name"), F.when(kind == "call", made).alias("arguments"), F.when(kind != "call", F.col("text")).alias("content"))
