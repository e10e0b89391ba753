"""Chat formatting with linked tool calls.

A message's text is plain content, or a JSON object with some of: ``content``,
``tool_calls`` (objects with ``id``, ``name``, ``arguments`` and, where a call
needs the results of others, ``depends_on``: their ids), ``tool_call_id`` (the
message is the result of that call) and ``tools`` (objects with ``name`` and
``parameters``, a JSON schema, for calls of the conversation).

Calls and results meet in a hash join on conversation and identifier. Arguments are
checked against the schema of their tool. Messages are ordered topologically:
a result comes after its call, and a call after the results that it depends on;
otherwise turns decide. The order is (order_turn, order_level, turn): order_turn
is the greatest turn among a message and all that it waits for, order_level the
longest chain to it. Every message becomes one line of canonical JSON (keys
sorted, no spaces, integral numbers without fraction, text unescaped).

Each message is a row, so a conversation is never gathered as a whole; chains
of a conversation with up to ``LOCAL_EDGES`` edges are followed in one group,
those of larger ones in distributed rounds.

Defined results: a null text has null content; an object without any of the
keys above is plain content, and so is what is not JSON, is nested more than
``DEPTH`` deep or has numbers of over 4,300 digits; ``tool_calls`` and ``tools`` that are no lists are none;
lone surrogates become U+FFFD; arguments are not checked (``n_unchecked``, and no
``valid``) where no schema is known, or where it is malformed or has keywords that are not known here; of calls with the same identifier in a
conversation the first (by turn, then place) is linked, of several results the
first, the others being duplicates; results without a call are orphans;
messages on a cycle, or behind one, have in_cycle true and their own turn;
repeated rows are returned each; a null conv_id or turn is passed on, and links
nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections import defaultdict
from fractions import Fraction

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_batches

LOCAL_EDGES, DEPTH = 20_000, 100
KEYS = {"content", "tool_calls", "tool_call_id", "tools"}
_SURROGATE = re.compile("[\ud800-\udfff]").sub
#: Keywords of schemas that are checked, and those that say nothing about a value.
KEYWORDS = {
    "type", "enum", "const", "properties", "patternProperties", "additionalProperties", "required", "items", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties",
    "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "uniqueItems", "pattern", "anyOf", "allOf", "oneOf", "not",
}
NOTES = {"title", "description", "default", "examples", "format", "deprecated", "readOnly", "writeOnly", "$schema", "$id", "$comment"}

_CALL = T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("id", T.StringType()), T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("depends_on", T.ArrayType(T.StringType()))])
_TOOL = T.StructType([T.StructField("name", T.StringType()), T.StructField("schema", T.StringType())])
PARSED = T.StructType([
    T.StructField("mid", T.LongType()), T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
    T.StructField("calls", T.ArrayType(_CALL)), T.StructField("result_of", T.StringType()), T.StructField("tools", T.ArrayType(_TOOL)),
])


def clean(s: str) -> str:
    """Lone surrogates, which UTF-8 can't have, become U+FFFD."""
    return s if s.isascii() else _SURROGATE("\ufffd", s)


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and one form for each number."""

    def plain(x):
        if isinstance(x, float):
            if not math.isfinite(x):
                return None
            return int(x) if x == int(x) and abs(x) < 1e21 else x
        if isinstance(x, dict):
            return {clean(str(k)): plain(v) for k, v in x.items()}
        if isinstance(x, str):
            return clean(x)
        return [plain(v) for v in x] if isinstance(x, list) else x

    return json.dumps(plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def read(text: str):
    """The value of a JSON text, or ValueError: also for numbers of over 4,300 digits and nesting beyond DEPTH."""
    try:
        found = json.loads(text)
    except RecursionError:
        raise ValueError("nested too deep") from None
    level = [found]
    for _ in range(DEPTH):
        level = [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not level:
            return found
    raise ValueError("nested too deep")


class Unchecked(Exception):
    """The schema is malformed, or has a keyword that is not known here."""


def _number(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def _need(right: bool, what: str) -> None:
    if not right:
        raise Unchecked(what)


def _matches(pattern, value: str) -> bool:
    """By RE2, in time linear in the value; patterns that it doesn't know are not checked."""
    _need(isinstance(pattern, str), "pattern")
    try:
        return pc.match_substring_regex(pa.array([clean(value)]), clean(pattern))[0].as_py()
    except pa.ArrowException:
        raise Unchecked("pattern") from None


def errors(value, schema, at: str = "$") -> list[str]:
    """Where a value breaks a JSON schema; raises Unchecked where that cannot be said.

    Known are type, enum, const, properties, patternProperties, additionalProperties, required, items,
    bounds of numbers, lengths and properties, multipleOf, uniqueItems, pattern, anyOf, allOf, oneOf and not.
    """
    if schema is True or schema is None:
        return []
    if schema is False:
        return [f"{at}: not allowed"]
    _need(isinstance(schema, dict), "schema")
    if unknown := sorted(map(str, schema.keys() - KEYWORDS - NOTES)):
        raise Unchecked(", ".join(unknown))
    out = []
    kinds = {
        "object": isinstance(value, dict), "array": isinstance(value, list), "string": isinstance(value, str), "boolean": isinstance(value, bool),
        "null": value is None, "number": _number(value), "integer": _number(value) and (isinstance(value, int) or value.is_integer()),
    }
    if "type" in schema:
        wanted = schema["type"] if isinstance(schema["type"], list) else [schema["type"]]
        _need(bool(wanted) and all(isinstance(k, str) and k in kinds for k in wanted), "type")
        if not any(kinds[k] for k in wanted):
            out.append(f"{at}: not {'/'.join(wanted)}")
    if "enum" in schema:
        _need(isinstance(schema["enum"], list), "enum")
        if canonical(value) not in map(canonical, schema["enum"]):
            out.append(f"{at}: not in enum")
    if "const" in schema and canonical(value) != canonical(schema["const"]):
        out.append(f"{at}: not the constant")
    known, patterns, required = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("required", [])
    _need(isinstance(known, dict) and isinstance(patterns, dict), "properties")
    _need(isinstance(required, list) and all(isinstance(k, str) for k in required), "required")
    if isinstance(value, dict):
        out += [f"{at}.{k}: missing" for k in required if k not in value]
        for k, v in value.items():
            own = [known[k]] if k in known else []
            own += [sub for p, sub in patterns.items() if _matches(p, k)]
            for sub in own or [schema.get("additionalProperties", True)]:
                out += errors(v, sub, f"{at}.{k}")
    if isinstance(value, list):
        for i, v in enumerate(value):
            out += errors(v, schema.get("items", True), f"{at}[{i}]")
        if schema.get("uniqueItems") is True and len(set(map(canonical, value))) < len(value):
            out.append(f"{at}: repeated items")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems"), (dict, "minProperties", "maxProperties")):
        for k in (low, high):
            _need(k not in schema or _number(schema[k]), k)
        if isinstance(value, kind) and not schema.get(low, 0) <= len(value) <= schema.get(high, len(value)):
            out.append(f"{at}: length")
    for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        _need(k not in schema or _number(schema[k]) and math.isfinite(schema[k]) if not isinstance(schema.get(k), int) else True, k)
        _need(not isinstance(schema.get(k), bool), k)
    if _number(value):
        low, high = schema.get("minimum", value), schema.get("maximum", value)
        if not low <= value <= high or ("exclusiveMinimum" in schema and value <= schema["exclusiveMinimum"]) or ("exclusiveMaximum" in schema and value >= schema["exclusiveMaximum"]):
            out.append(f"{at}: range")
        if "multipleOf" in schema:
            _need(schema["multipleOf"] > 0, "multipleOf")
            if not isinstance(value, int) and not math.isfinite(value) or Fraction(str(value)) % Fraction(str(schema["multipleOf"])):
                out.append(f"{at}: no multiple")
    if isinstance(value, str) and "pattern" in schema and not _matches(schema["pattern"], value):
        out.append(f"{at}: pattern")
    for k in ("allOf", "anyOf", "oneOf"):
        _need(isinstance(schema.get(k, []), list), k)
    for sub in schema.get("allOf", []):
        out += errors(value, sub, at)
    if "anyOf" in schema and all([errors(value, sub, at) for sub in schema["anyOf"]]):
        out.append(f"{at}: none of anyOf")
    if "oneOf" in schema and sum(not errors(value, sub, at) for sub in schema["oneOf"]) != 1:
        out.append(f"{at}: not one of oneOf")
    if "not" in schema and not errors(value, schema["not"], at):
        out.append(f"{at}: not")
    return out


def checked(arguments: str, schema: str | None) -> tuple[bool | None, str | None]:
    """(valid, errors) of canonical arguments under the text of a schema; valid is null where they are not checked."""
    if schema is None:
        return None, None
    try:
        wrong = errors(read(arguments), read(schema))
    except (Unchecked, ValueError) as e:
        return None, f"unchecked: {e}"
    return not wrong, clean("; ".join(wrong)) or None


def _name(x) -> str:
    return clean(x) if isinstance(x, str) else canonical(x)


def parse(text: str | None) -> tuple:
    """content, calls, result_of, tools of one message."""
    plain = (text, [], None, [])
    if not text or text.lstrip()[:1] != "{":
        return plain
    try:
        found = read(text)
    except ValueError:
        return plain
    if not isinstance(found, dict) or not KEYS & found.keys():
        return plain
    calls, tools = [], []
    listed = lambda k: x if isinstance(x := found.get(k), list) else []
    for k, call in enumerate(listed("tool_calls")):
        if isinstance(call, dict):
            args = call.get("arguments")
            if isinstance(args, str):
                try:
                    args = read(args)
                except ValueError:
                    pass
            needs = call.get("depends_on")
            calls.append({"pos": k, "id": None if call.get("id") is None else _name(call["id"]), "name": _name(call.get("name", "")), "arguments": canonical(args), "depends_on": [_name(x) for x in needs if x is not None] if isinstance(needs, list) else []})
    for tool in listed("tools"):
        if isinstance(tool, dict) and "name" in tool:
            tools.append({"name": _name(tool["name"]), "schema": canonical(tool.get("parameters", {}))})
    content, result = found.get("content"), found.get("tool_call_id")
    return (None if content is None else _name(content), calls, None if result is None else _name(result), tools)


ORDER = T.StructType([T.StructField("mid", T.LongType()), T.StructField("order_turn", T.LongType()), T.StructField("order_level", T.LongType()), T.StructField("in_cycle", T.BooleanType())])


def topological(edges: list[tuple[int, int]], turns: dict[int, int]) -> list[tuple[int, int, int, bool]]:
    """(node, order_turn, order_level, in_cycle) of every node of the edges (before, after)."""
    after, waits = defaultdict(list), dict.fromkeys((x for e in edges for x in e), 0)
    for a, b in set(edges):
        after[a].append(b)
        waits[b] += 1
    at, level = {n: turns[n] for n in waits}, dict.fromkeys(waits, 0)
    ready = [n for n, k in waits.items() if not k]
    for n in ready:  # grows while it is walked
        for b in after[n]:
            at[b], level[b] = max(at[b], at[n]), max(level[b], level[n] + 1)
            waits[b] -= 1
            if not waits[b]:
                ready.append(b)
    done = set(ready)
    return [(n, at[n] if n in done else turns[n], level[n] if n in done else 0, n not in done) for n in waits]


def _order(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """ORDER of the messages on edges (conv_id, a, a_turn, b, b_turn)."""
    sizes = scratch.keep(edges.groupBy("conv_id").agg(F.count("*").alias("n")))

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        turns = dict(zip(pdf["a"], pdf["a_turn"], strict=True)) | dict(zip(pdf["b"], pdf["b_turn"], strict=True))
        return pd.DataFrame(topological(list(zip(pdf["a"], pdf["b"], strict=True)), turns), columns=ORDER.names)

    small = edges.join(sizes.filter(F.col("n") <= LOCAL_EDGES), "conv_id", "left_semi")
    out = small.groupBy("conv_id").applyInPandas(lambda pdf: local(pdf), ORDER)
    large = sizes.filter(F.col("n") > LOCAL_EDGES)
    if not large.limit(1).count():
        return scratch.keep(out)
    rest = scratch.keep(edges.join(large, "conv_id", "left_semi").select("a", "a_turn", "b", "b_turn").distinct())
    nodes = scratch.keep(rest.select(F.col("a").alias("mid"), F.col("a_turn").alias("turn")).union(rest.select("b", "b_turn")).distinct().select("mid", "turn", F.col("turn").alias("at"), F.lit(0).cast("bigint").alias("level")))
    done = [out]
    while True:  # Kahn's rounds: what waits for nothing is settled and its edges go
        free = scratch.keep(nodes.join(rest.select(F.col("b").alias("mid")).distinct(), "mid", "left_anti"))
        if not free.limit(1).count():
            break
        done.append(free.select("mid", "at", "level", F.lit(False)))
        used = rest.join(free.withColumnRenamed("mid", "a"), "a").groupBy(F.col("b").alias("mid")).agg(F.max("at").alias("x"), F.max("level").alias("y"))
        now = scratch.keep(nodes.join(free.select("mid"), "mid", "left_anti").join(used, "mid", "left").select("mid", "turn", F.greatest("at", F.coalesce("x", "at")).alias("at"), F.greatest("level", F.coalesce(F.col("y") + 1, "level")).alias("level")))
        left = scratch.keep(rest.join(free.select(F.col("mid").alias("a")), "a", "left_anti"))
        scratch.drop(nodes, rest)
        nodes, rest = now, left
    done.append(nodes.select("mid", "turn", F.lit(0).cast("bigint"), F.lit(True)))
    for x in done[1:]:
        out = out.union(x)
    return scratch.keep(out)


CHECKED = T.StructType([*(T.StructField(c, T.LongType()) for c in ("mid", "pos")), T.StructField("valid", T.BooleanType()), T.StructField("errors", T.StringType())])
LINES = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("order_turn", T.LongType()), T.StructField("order_level", T.LongType()), T.StructField("in_cycle", T.BooleanType()),
    T.StructField("link", T.StringType()), T.StructField("n_calls", T.LongType()), T.StructField("n_linked", T.LongType()), T.StructField("n_invalid", T.LongType()), T.StructField("n_unchecked", T.LongType()), T.StructField("json", T.StringType()),
])


def formatted(messages: DataFrame, schemas: DataFrame | None = None) -> DataFrame:
    """LINES of every message of ``messages`` (conv_id, turn, role, text); ``schemas``
    (name, schema) has tools known to all conversations."""
    scratch = Scratch(messages.sparkSession, "chat")
    keyed = messages.select(F.xxhash64("conv_id", "turn", "role", "text").alias("mid"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")

    def parsing():
        return lambda c: [(*r[:4], *parse(r[4])) for r in zip(*(c[k] for k in ("mid", "conv_id", "turn", "role", "text")), strict=True)]

    parsed = scratch.keep(map_batches(keyed, PARSED, parsing))
    calls = parsed.select("mid", "conv_id", "turn", F.explode("calls").alias("c")).select("mid", "conv_id", "turn", "c.*").dropDuplicates(["mid", "pos"])
    calls = scratch.keep(calls)
    place = F.struct("turn", "pos", "mid")
    firsts = calls.filter("id is not null and conv_id is not null and turn is not null").groupBy("conv_id", "id").agg(F.min(place).alias("call"))
    results = parsed.filter("result_of is not null and conv_id is not null and turn is not null").groupBy("conv_id", F.col("result_of").alias("id")).agg(F.min(F.struct("turn", "mid", "content")).alias("result"))
    links = scratch.keep(firsts.hint("shuffle_hash").join(results, ["conv_id", "id"], "full"))
    linked = links.filter("call is not null and result is not null")
    # Edges: call to result, result to the calls that depend on it.
    one = linked.select("conv_id", F.col("call.mid").alias("a"), F.col("call.turn").alias("a_turn"), F.col("result.mid").alias("b"), F.col("result.turn").alias("b_turn"))
    needs = calls.filter("turn is not null").select("conv_id", F.explode("depends_on").alias("id"), F.col("mid").alias("b"), F.col("turn").alias("b_turn"))
    two = needs.join(linked.select("conv_id", "id", F.col("result.mid").alias("a"), F.col("result.turn").alias("a_turn")), ["conv_id", "id"]).select("conv_id", "a", "a_turn", "b", "b_turn")
    order = _order(scratch.keep(one.union(two).filter("a <> b")), scratch)
    # Schemas: those of the conversation first, then those known to all.
    own = parsed.select("conv_id", "turn", F.explode("tools").alias("t")).groupBy("conv_id", F.col("t.name").alias("name")).agg(F.min(F.struct("turn", "t.schema")).getField("schema").alias("own"))
    asked = calls.select("mid", "pos", "conv_id", "name", "arguments").join(own, ["conv_id", "name"], "left")
    if schemas is not None:
        asked = asked.join(schemas.groupBy("name").agg(F.min("schema").alias("common")), "name", "left").withColumn("own", F.coalesce("own", "common"))

    def checking():
        def work(c):
            out = []
            for mid, pos, args, schema in zip(c["mid"], c["pos"], c["arguments"], c["own"], strict=True):
                out.append((mid, pos, *checked(args, schema)))
            return out

        return work

    verdicts = map_batches(asked.select("mid", F.col("pos").cast("bigint").alias("pos"), "arguments", "own"), CHECKED, checking)
    answer = linked.select(F.col("call.mid").alias("mid"), F.col("call.pos").cast("bigint").alias("pos"), F.struct(F.col("result.content").alias("content"), F.col("result.turn").alias("turn")).alias("result"))
    full = calls.select("mid", F.col("pos").cast("bigint").alias("pos"), "id", "name", "arguments").join(verdicts, ["mid", "pos"], "left").join(answer, ["mid", "pos"], "left")
    full = scratch.keep(full.groupBy("mid").agg(F.collect_list(F.struct("pos", "id", "name", "arguments", "valid", "result")).alias("calls")))
    state = links.filter("result is not null").select(F.col("result.mid").alias("mid"), F.when(F.col("call").isNull(), "orphan").otherwise("linked").alias("link"))
    known = links.filter("result is not null").select("conv_id", F.col("id").alias("result_of"), F.lit(True).alias("has"), F.col("call").isNotNull().alias("called"))
    tools = parsed.filter("result_of is not null").select("mid", "conv_id", "result_of").join(state, "mid", "left").join(known, ["conv_id", "result_of"], "left")
    tools = tools.groupBy("mid").agg(F.max(F.coalesce("link", F.when(F.col("called"), "duplicate").otherwise("orphan"))).alias("link"))
    joined = parsed.drop("calls", "tools").join(full, "mid", "left").join(tools, "mid", "left").join(order, "mid", "left")

    def writing():
        def work(c):
            out = []
            for k, conv in enumerate(c["conv_id"]):
                line = {"role": c["role"][k], "content": c["content"][k]}
                calls = sorted(c["calls"][k] or [], key=lambda x: x["pos"])
                if calls:
                    line["tool_calls"] = [{"id": x["id"], "name": x["name"], "arguments": json.loads(x["arguments"])} | ({"result": x["result"]["content"]} if x["result"] else {}) | ({"valid": x["valid"]} if x["valid"] is not None else {}) for x in calls]
                if c["result_of"][k] is not None:
                    line["tool_call_id"] = c["result_of"][k]
                turn, at = c["turn"][k], c["order_turn"][k]
                out.append((conv, turn, c["role"][k], turn if at is None else at, c["order_level"][k] or 0, bool(c["in_cycle"][k]), c["link"][k], len(calls), sum(x["result"] is not None for x in calls), sum(x["valid"] is False for x in calls), sum(x["valid"] is None for x in calls), canonical(line)))
            return out

        return work

    return map_batches(joined, LINES, writing)
