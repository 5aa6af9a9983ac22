"""Tool-call linking, ordering, validation and canonical JSON."""

import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souk.llm import registry, standins, toolcalls
from souk.llm.common import Scratch

SCHEMAS = {"f": {"type": "object", "required": ["x"], "additionalProperties": False,
                 "properties": {"x": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string", "enum": ["a", "b"]}}}}}


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)), max_size=20))))
def test_topological_order(case):
    n, edges = case
    needs = {}
    for a, b in edges:
        needs.setdefault(f"c{a}", []).append(f"c{b}")
    seq, cyclic = toolcalls.topological([(0, 0, f"c{i}") for i in range(n)], needs)
    assert sorted(seq) == sorted(f"c{i}" for i in range(n))
    at = {c: i for i, c in enumerate(seq)}
    for a, bs in needs.items():
        for b in bs:
            assert a in cyclic or at[b] < at[a]


def test_problems():
    s = SCHEMAS["f"]
    assert toolcalls.problems({"x": 1, "tags": ["a"]}, s) == []
    assert toolcalls.problems({"x": -1, "y": 2, "tags": ["z", 1]}, s) == [
        "$.tags[0]: not in enum", "$.tags[1]: not string", "$.x: below minimum", "$.y: unknown"]
    assert toolcalls.problems({}, s) == ["$.x: missing"] and toolcalls.problems([], s) == ["$: not object"]
    assert toolcalls.problems({"x": True}, s) == ["$.x: not integer"]


def test_problems_of_other_keywords():
    of = toolcalls.problems
    s = {"type": ["integer", "null"]}
    assert of(None, s) == of(3, s) == of(3.0, s) == [] and of(True, s) == of("x", s) == ["$: not integer or null"]
    assert of(True, {"enum": [1]}) == of(1, {"enum": [True, "1"]}) == ["$: not in enum"] and of(1.0, {"enum": [1]}) == []
    assert of([1, {"a": False}], {"const": [1, {"a": 0}]}) == ["$: not the constant"] and of([1.0], {"const": [1]}) == []
    assert of("", {"minLength": 1}) == ["$: too short"] and of([], {"minItems": 1}) == ["$: too few items"] and of([1, 2], {"maxItems": 1}) == ["$: too many items"]
    either = {"anyOf": [{"type": "string", "minLength": 2}, {"type": "integer"}]}
    assert of("ab", either) == of(7, either) == [] and of("a", either) == ["$: like none of anyOf"]


def test_arguments_that_no_parser_likes(spark):
    """Very deep, cut off, half a surrogate pair, huge numbers: a defined answer, no failure."""
    deep = '{"x":' + "[" * 200_000 + "]" * 200_000 + "}"
    bad = [deep, "[" * 200_000, '{"x": "\\ud800"}', '{"\\udfff": 1}', '{"x": NaN}', '{"x": 1e999}', '{"x": ' + "9" * 5000 + "}", "", None, "7"]
    rows = [(i, "f", a) for i, a in enumerate(bad)] + [(90, "f", '{"x":2}'), (91, "?", "{}"), (92, None, "{}")]
    got = {r["id"]: r for r in toolcalls.validate(spark.createDataFrame(rows, "id int, tool string, arguments string"), SCHEMAS).collect()}
    for i in range(len(bad)):
        assert (got[i]["canonical"], got[i]["problems"]) == (None, ["$: not a JSON object"]), bad[i][:30] if bad[i] else bad[i]
    assert got[90]["canonical"] == '{"x":2}' and got[90]["problems"] == []
    assert got[91]["problems"] == got[92]["problems"] == ["$: unknown tool"]


def test_linking(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 2, "user", ""), (2, 0, "user", "x"), (None, 0, "user", "lost")],
                                  "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame(
        [(1, "b", 1, 0, "f", '{"x": 1, "tags": []}', ["a"]), (1, "a", 2, 0, "f", '{"tags":["b"],"x":2}', []), (1, "a", 2, 1, "f", "{}", []),
         (1, "c", 2, 2, "g", "{}", ["c", "zz"]), (1, "d", 2, 3, "f", "{bad", None), (None, "q", 1, 0, "f", "{}", [])],
        "conv_id long, call_id string, turn long, place long, tool string, arguments string, needs array<string>")
    results = spark.createDataFrame([(1, "a", 2, 0, "ra"), (1, "a", 3, 0, "again"), (1, "nope", 2, 0, None), (2, None, 0, 0, "r")],
                                    "conv_id long, call_id string, turn long, place long, content string")
    rows = toolcalls.messages(spark, turns, calls, results, SCHEMAS).collect()
    one = [r for r in sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: r["seq"])]
    assert [r["seq"] for r in one] == list(range(len(one)))
    proper = [(r["call_id"], r["role_of"]) for r in one if r["kind"] != "turn"]
    # b needs a, so a (with its results) comes first although its turn is later; c needs itself
    assert proper.index(("a", "call")) < proper.index(("a", "result")) < proper.index(("b", "call"))
    assert ("a", "duplicate_call") in proper and ("a", "extra_result") in proper and ("nope", "orphan_result") in proper
    said = {r["call_id"]: json.loads(r["json"])["tool_call"] for r in one if r["role_of"] == "call"}
    assert said["c"]["on_cycle"] and said["c"]["unknown_needs"] == 1 and said["c"]["problems"] == ["$: unknown tool"]
    assert said["d"]["arguments"] == "{bad" and said["a"]["answered"] and not said["b"]["answered"]
    assert '"arguments":{"tags":[],"x":1}' in next(r["json"] for r in one if r["call_id"] == "b")
    assert {r["role_of"] for r in rows if r["conv_id"] is None} == {"turn", "unlinked"}
    docs = toolcalls.conversations(toolcalls.messages(spark, turns, calls, results, SCHEMAS)).collect()
    for d in docs:
        assert toolcalls.canonical(json.loads(d["document"])["messages"]) in d["document"]
    assert toolcalls.messages(spark, turns.limit(0), calls.limit(0), results.limit(0), SCHEMAS).count() == 0


def test_a_large_conversation_is_sorted_in_parts(spark):
    """The order is Kahn's over the whole conversation, though no task holds it."""
    rng, rows = random.Random(6), []
    for conv, n in ((1, 1500), (2, 40)):
        for t in range(n):
            needs = [f"c{t + 2}"] if rng.random() < 0.05 else [f"c{t - 2}"] if t > 5 and t % 9 else []
            if rng.random() < 0.05:
                needs += [f"c{rng.randrange(max(0, t - 9), t + 9)}", "none", None]
            rows.append((conv, f"c{t}", t // 3 if t % 50 else None, t % 3, needs, "call"))
    rows += [(3, "c0", 0, 0, ["c0"], "call"), (3, "c1", 1, 0, None, "call"), (4, "c0", 0, 0, ["none"], "call")]
    linked = spark.createDataFrame(rows, "conv_id long, call_id string, turn long, place long, needs array<string>, role_of string")
    got = toolcalls.order(spark, linked).collect()
    for conv in (1, 2, 3, 4):
        mine = [r for r in rows if r[0] == conv]
        needs = {r[1]: [x for x in r[4] or () if x is not None] for r in mine}
        seq, cyclic = toolcalls.topological([(r[2] or 0, r[3], r[1]) for r in mine], needs)
        turn, after = {r[1]: r[2] or 0 for r in mine}, 0
        out = sorted((r for r in got if r["conv_id"] == conv), key=lambda r: r["step"])
        assert [r["call_id"] for r in out] == seq and [r["step"] for r in out] == list(range(len(seq)))
        for r in out:
            after = max(after, turn[r["call_id"]])
            assert (r["turn_after"], r["on_cycle"]) == (after, r["call_id"] in cyclic)
            assert r["unknown_needs"] == sum(x not in needs for x in needs[r["call_id"]])
        assert conv != 1 or 50 < len(cyclic) < 1000
    scratch = Scratch(spark, "test-order")
    calls = scratch.keep(linked.withColumn("mark", F.struct(F.coalesce("turn", F.lit(0)), "place", "call_id")), "calls")
    sizes = [r["count"] for r in toolcalls.tangles(calls, toolcalls._wants(calls), scratch).groupBy("conv_id", "root").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 300


def test_every_row_of_the_table_is_there(spark):
    sf = "/root/testdata/sf0.001"
    calls, results = standins.tool_calls(spark, sf)
    n = spark.read.parquet(f"{sf}/conversations.parquet").count() + calls.count() + results.count()
    out = registry.op10_tool_calls(spark, sf).collect()
    assert sum(r["messages"] for r in out) == n
    assert sum(len(json.loads(r["document"])["messages"]) for r in out) == n
