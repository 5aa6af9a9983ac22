"""Chat formatting with tool calls: link results to calls, order them, check
arguments, write canonical JSON.

1. ``link``: calls and results are joined by (conversation, call id) with a
   hash join.  Of several calls of one id the first by (turn, place, arguments)
   is the call, the others are ``duplicate_call``; of several results the first
   is linked, the others are ``extra_result``; a result without a call is an
   ``orphan_result``, a call without a result is ``pending``.
2. ``validate``: a call's arguments must be a JSON object that fits its tool's
   schema (types, required, enum, minimum, maximum, maxLength, items, nested
   properties, additionalProperties).
3. ``order``: calls name the calls they use in ``needs``.  A conversation's
   events come in topological order: Kahn's method, ready calls by (turn,
   place, id), each result right after its call.  Calls on a cycle follow at
   the end, marked; a need that names no call of the conversation is marked.
4. ``conversations``: one row per conversation and block of at most
   ``BLOCK`` messages, in canonical JSON: keys sorted, no blanks, UTF-8,
   numbers as JSON reads them, arguments as objects.

Only calls that are linked by needs, directly or not, with a call that needs a
later one are sorted by Kahn's method, each such component in one task that gets
its calls' identifiers without texts and arguments; for all others the order by
turn is a topological one already.

Defined cases: rows with a null conversation or call id are ``unlinked`` and
keep their place by turn; null texts are empty; arguments that are null or no
JSON object are invalid and stay as the string they are; repeated rows are
duplicates as above; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from souk.llm.common import Scratch
from souk.llm.components import components

#: Messages of a conversation that are serialised into one row.
BLOCK = 4096
#: Turns of a conversation whose messages are numbered together.
SPAN = 256
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, no escapes beyond the needed ones."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def same(a, b) -> bool:
    """Equal as JSON values: true is not 1, but 1 is 1.0."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def _is(value, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int | float) and not isinstance(value, bool) and value == value // 1
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    return isinstance(value, _TYPES[kind])


def problems(value, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a value under a schema, in a fixed order.  Of JSON
    Schema it knows type (one or a list), const, enum, anyOf, the bounds of
    strings, numbers and arrays, pattern, items, properties, required and
    additionalProperties false; other keywords are ignored."""
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "anyOf" in schema and all(problems(value, x, at) for x in schema["anyOf"]):
        out.append(f"{at}: like none of anyOf")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            out.append(f"{at}: too short")
        if len(value) > schema.get("maxLength", len(value)):
            out.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            out.append(f"{at}: not like pattern")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if value < schema.get("minimum", value):
            out.append(f"{at}: below minimum")
        if value > schema.get("maximum", value):
            out.append(f"{at}: above maximum")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in sorted(schema.get("required", [])) if k not in value]
        for k in sorted(value):
            if k in known:
                out += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{at}.{k}: unknown")
    if isinstance(value, list):
        if len(value) < schema.get("minItems", 0):
            out.append(f"{at}: too few items")
        if len(value) > schema.get("maxItems", len(value)):
            out.append(f"{at}: too many items")
        if "items" in schema:
            for i, x in enumerate(value):
                out += problems(x, schema["items"], f"{at}[{i}]")
    return out


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """The calls with ``canonical`` arguments (null if no JSON object) and ``problems`` (array<string>)."""

    @F.pandas_udf("struct<canonical: string, problems: array<string>>")
    def check(tool: pd.Series, arguments: pd.Series) -> pd.DataFrame:
        out = []
        for t, a in zip(tool, arguments, strict=True):
            try:
                value = json.loads(a) if a is not None else None
            except (ValueError, RecursionError):  # not JSON, or nested too deep to be written again
                value = None
            if not isinstance(value, dict):
                out.append((None, ["$: not a JSON object"]))
                continue
            try:
                text = canonical(value)
                text.encode()  # fails on half a surrogate pair, which no text may hold
            except (ValueError, RecursionError):
                out.append((None, ["$: not a JSON object"]))
                continue
            out.append((text, problems(value, schemas[t]) if t in schemas else ["$: unknown tool"]))
        return pd.DataFrame(out, columns=["canonical", "problems"])

    return calls.withColumn("__check", check("tool", "arguments")).select(
        "*", F.col("__check.canonical").alias("canonical"), F.col("__check.problems").alias("problems")).drop("__check")


def link(calls: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """calls with ``role_of`` (call, duplicate_call, unlinked) and ``answered``;
    results with ``role_of`` (result, extra_result, orphan_result, unlinked).

    The first of several is a grouped minimum, so a call id that very many rows
    share is never gathered in one place."""
    key = ["conv_id", "call_id"]
    named = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    mark_c = F.struct("turn", "place", F.coalesce("tool", F.lit("")).alias("t"), F.coalesce("arguments", F.lit("")).alias("a"))
    mark_r = F.struct("turn", "place", F.coalesce("content", F.lit("")).alias("c"))
    first_c = calls.filter(named).groupBy(*key).agg(F.min(mark_c).alias("first"))
    first_r = results.filter(named).groupBy(*key).agg(F.min(mark_r).alias("first_result"))
    both = first_c.hint("shuffle_hash").join(first_r, key, "left")
    c = calls.withColumn("__m", mark_c).join(both, key, "left")
    c = c.withColumn("role_of", F.when(~named, "unlinked").when(F.col("__m") == F.col("first"), "call").otherwise("duplicate_call"))
    c = c.withColumn("answered", (F.col("role_of") == "call") & F.col("first_result").isNotNull()).drop("__m", "first", "first_result")
    r = results.withColumn("__m", mark_r).join(first_r, key, "left").join(first_c.select(*key, F.col("first").alias("call")), key, "left")
    r = r.withColumn("role_of", F.when(~named, "unlinked").when(F.col("call").isNull(), "orphan_result")
                     .when(F.col("__m") == F.col("first_result"), "result").otherwise("extra_result"))
    return c, r.drop("__m", "first_result", "call")


def topological(nodes: list[tuple], needs: dict) -> tuple[list, set]:
    """nodes: sortable tuples whose last item is the identifier.  Their order, and those on (or behind) a cycle."""
    rank = {n[-1]: n for n in nodes}
    waiting = {i: {d for d in needs.get(i, ()) if d in rank and d != i} for i in rank}
    stuck = {i for i in rank if i in set(needs.get(i, ()))}
    for i in stuck:
        waiting[i].add(i)
    used: dict = {}
    for i, ds in waiting.items():
        for d in ds:
            used.setdefault(d, []).append(i)
    ready = [rank[i] for i, ds in waiting.items() if not ds]
    heapq.heapify(ready)
    out = []
    while ready:
        i = heapq.heappop(ready)[-1]
        out.append(i)
        for j in used.get(i, ()):
            waiting[j].discard(i)
            if not waiting[j]:
                heapq.heappush(ready, rank[j])
    rest = sorted(rank[i] for i in set(rank) - set(out))
    return out + [n[-1] for n in rest], {n[-1] for n in rest}


def _wants(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, need, known, back) for each need: it names a call of
    the conversation, and one that is not before the call."""
    wants = calls.select("conv_id", "call_id", F.col("mark").alias("own"), F.explode("needs").alias("need"))
    theirs = calls.select("conv_id", F.col("call_id").alias("need"), F.col("mark").alias("theirs"))
    return wants.join(theirs, ["conv_id", "need"], "left").select(
        "conv_id", "call_id", "need", F.col("theirs").isNotNull().alias("known"), F.coalesce(F.col("theirs") >= F.col("own"), F.lit(False)).alias("back"))


def tangles(calls: DataFrame, wants: DataFrame, scratch: Scratch) -> DataFrame:
    """The calls, with ``root``, of the components of needs (conv_id, root) in
    which a call needs one that is not before it."""
    back = wants.filter("back").select("conv_id", "call_id")
    convs = back.select("conv_id").distinct()
    # two calls of one hash only share a group
    node = lambda c: F.xxhash64("conv_id", c)
    edges = wants.filter("known").join(convs, "conv_id", "left_semi").select(node("call_id").alias("u"), node("need").alias("v"))
    roots = components(edges, scratch).select(F.col("id").alias("node"), "root")
    placed = calls.join(convs, "conv_id", "left_semi").withColumn("node", node("call_id")).join(roots, "node", "left")
    placed = scratch.keep(placed.withColumn("root", F.coalesce("root", "node")).drop("node"), "placed")
    hit = placed.join(back.distinct(), ["conv_id", "call_id"], "left_semi").select("conv_id", "root").distinct()
    return placed.join(hit, ["conv_id", "root"], "left_semi")


def order(spark: SparkSession, linked: DataFrame) -> DataFrame:
    """(conv_id, call_id, step, turn_after, on_cycle, unknown_needs) of the calls
    proper of conversations in which a call needs one that is not before it.

    Everywhere else (turn, place, id) is a topological order already.  Kahn's
    order is sorted by ``until``, the largest (turn, place, id) of a call and all
    that it needs, directly or not; calls of equal ``until`` are in one component
    of needs.  So Kahn's method runs on components, identifiers alone, and
    only on those with a need that is not before its call."""
    scratch = Scratch(spark, "toolcalls-order")
    calls = linked.filter("role_of = 'call'").select(
        "conv_id", "call_id", F.coalesce("turn", F.lit(0)).cast("long").alias("turn"), F.coalesce("place", F.lit(0)).cast("long").alias("place"), "needs")
    calls = scratch.keep(calls.withColumn("mark", F.struct("turn", "place", "call_id")), "calls")
    wants = scratch.keep(_wants(calls), "wants")

    def run(table):
        rows = table.to_pylist()
        mark = {r["call_id"]: (r["turn"], r["place"], r["call_id"]) for r in rows}
        seq, cyclic = topological(list(mark.values()), {r["call_id"]: [n for n in r["needs"] or () if n is not None] for r in rows})
        until, most = [], None
        for i in seq:
            most = mark[i] if most is None else max(most, mark[i])
            until.append(mark[i] if i in cyclic else most)
        turn, place, last = ([u[k] for u in until] for k in range(3))
        return pa.table({"conv_id": pa.array([rows[0]["conv_id"]] * len(seq), pa.int64()), "call_id": pa.array(seq, pa.string()),
                         "until_turn": pa.array(turn, pa.int64()), "until_place": pa.array(place, pa.int64()), "until_id": pa.array(last, pa.string()),
                         "at": pa.array(range(len(seq)), pa.int64()), "on_cycle": pa.array([i in cyclic for i in seq], pa.bool_())})

    local = tangles(calls, wants, scratch).groupBy("conv_id", "root").applyInArrow(
        run, "conv_id long, call_id string, until_turn long, until_place long, until_id string, at long, on_cycle boolean")
    odd = wants.filter("not known or back").select("conv_id").distinct()
    unknown = wants.filter("not known and need is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("unknown_needs"))
    until = F.struct(F.coalesce("until_turn", "turn").alias("turn"), F.coalesce("until_place", "place").alias("place"), F.coalesce("until_id", "call_id").alias("id"))
    all_ = (calls.join(odd, "conv_id", "left_semi").join(local, ["conv_id", "call_id"], "left").join(unknown, ["conv_id", "call_id"], "left")
            .select("conv_id", "call_id", "turn", until.alias("until"), F.coalesce("at", F.lit(0)).alias("at"),
                    F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"), F.coalesce("unknown_needs", F.lit(0)).alias("unknown_needs")))
    all_ = scratch.keep(all_.withColumn("span", F.floor(F.col("until.turn") / SPAN)), "order")
    # numbers inside spans of turns, as in messages; those on a cycle behind all others
    before = Window.partitionBy("conv_id").orderBy("on_cycle", "span").rowsBetween(Window.unboundedPreceding, -1)
    spans = all_.groupBy("conv_id", "on_cycle", "span").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # a call comes no earlier than those it follows
    sorted_ = all_.filter(~F.col("on_cycle")).groupBy("conv_id").agg(F.max("until.turn").alias("latest"))
    step = F.col("base") + F.row_number().over(Window.partitionBy("conv_id", "on_cycle", "span").orderBy("until", "at")) - 1
    return all_.join(spans, ["conv_id", "on_cycle", "span"]).join(sorted_, "conv_id", "left").select(
        "conv_id", "call_id", step.cast("long").alias("step"),
        F.when(F.col("on_cycle"), F.greatest("latest", "turn")).otherwise(F.col("until.turn")).alias("turn_after"), "on_cycle", "unknown_needs")


def messages(spark: SparkSession, turns: DataFrame, calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per turn, call and result: conv_id, seq (from 0 in its
    conversation), kind, call_id, role_of, valid, json (canonical)."""
    c, r = link(calls, results)
    c = validate(c, schemas).join(order(spark, c), ["conv_id", "call_id"], "left")
    proper = F.col("role_of") == "call"
    c = c.withColumn("turn_after", F.coalesce("turn_after", "turn")).withColumn("step", F.when(proper, F.coalesce("step", F.lit(0))))
    slot = lambda turn, kind, step, place, res: F.struct(
        F.coalesce(turn, F.lit(-1)).cast("long").alias("turn"), F.lit(kind).alias("k"), F.coalesce(step, F.lit(1 << 40)).cast("long").alias("s"),
        F.lit(res).alias("r"), F.coalesce(place, F.lit(-1)).cast("long").alias("p"))
    call_rows = c.select("conv_id", slot(F.col("turn_after"), 1, F.col("step"), F.col("place"), 0).alias("slot"), F.lit("call").alias("kind"),
                         "call_id", "role_of", (F.size("problems") == 0).alias("valid"), F.struct(
                             F.col("tool"), F.col("canonical"), F.col("arguments"), F.col("problems"), F.col("answered"),
                             F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"),
                             F.coalesce("unknown_needs", F.lit(0)).cast("long").alias("unknown_needs")).alias("call"),
                         F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"))
    spot = c.filter(proper).select("conv_id", "call_id", F.col("turn_after").alias("ct"), F.col("step").alias("cs"), F.col("place").alias("cp"))
    r = r.join(spot, ["conv_id", "call_id"], "left")
    linked = F.col("role_of").isin("result", "extra_result")
    none = F.lit(None).cast(call_rows.schema["call"].dataType).alias("call")
    result_rows = r.select("conv_id", F.when(linked, slot(F.col("ct"), 1, F.col("cs"), F.col("cp"), 1))
                           .otherwise(slot(F.col("turn"), 2, F.lit(None), F.col("place"), 0)).alias("slot"), F.lit("result").alias("kind"),
                           "call_id", "role_of", linked.alias("valid"), none, F.lit("tool").alias("role"), F.col("content").alias("text"))
    turn_rows = turns.select("conv_id", slot(F.col("turn"), 0, F.lit(None), F.lit(0), 0).alias("slot"), F.lit("turn").alias("kind"),
                             F.lit(None).cast("string").alias("call_id"), F.lit("turn").alias("role_of"), F.lit(True).alias("valid"), none, "role", "text")

    @F.pandas_udf("string")
    def as_json(kind: pd.Series, call_id: pd.Series, role_of: pd.Series, call: pd.DataFrame, role: pd.Series, text: pd.Series) -> pd.Series:
        out = []
        rows = call.to_dict("records")
        for k, i, ro, c, who, t in zip(kind, call_id, role_of, rows, role, text, strict=True):
            if k == "turn":
                out.append(canonical({"content": t or "", "role": who}))
            elif k == "result":
                out.append(canonical({"content": t or "", "role": "tool", "status": ro, "tool_call_id": i}))
            else:
                args = json.loads(c["canonical"]) if c["canonical"] else c["arguments"]
                said = {"arguments": args, "id": i, "name": c["tool"], "status": ro, "answered": bool(c["answered"])}
                if len(c["problems"]):
                    said["problems"] = list(c["problems"])
                if c["on_cycle"]:
                    said["on_cycle"] = True
                if c["unknown_needs"]:
                    said["unknown_needs"] = int(c["unknown_needs"])
                out.append(canonical({"role": "assistant", "tool_call": said}))
        return pd.Series(out)

    rows = turn_rows.unionByName(call_rows).unionByName(result_rows)
    rows = rows.select("conv_id", "slot", "kind", "call_id", "role_of", "valid",
                       as_json("kind", "call_id", "role_of", "call", "role", "text").alias("json"))
    rows = Scratch(spark, "toolcalls").keep(rows.withColumn("span", F.floor(F.col("slot.turn") / SPAN)), "messages")
    # numbers inside spans of turns, behind the rows of the spans before: no conversation is numbered in one place
    before = Window.partitionBy("c").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(F.col("conv_id").alias("c"), F.col("span").alias("s")).agg(F.count("*").alias("n"))
    spans = spans.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    rows = rows.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("span") == F.col("s")))
    seq = F.col("base") + F.row_number().over(Window.partitionBy("conv_id", "span").orderBy("slot", "call_id", "json")) - 1
    return rows.withColumn("seq", seq.cast("long")).drop("slot", "span", "base", "c", "s")


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, block, messages, document): canonical JSON of at most BLOCK messages a row."""
    block = F.floor(F.col("seq") / BLOCK).cast("long").alias("block")
    return rows.groupBy("conv_id", block).agg(
        F.count("*").alias("messages"),
        F.concat(F.lit('{"conversation":'), F.coalesce(F.first("conv_id").cast("string"), F.lit("null")), F.lit(',"messages":['),
                 F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda x: x["json"]), ","), F.lit("]}")).alias("document"))
