"""Tool-call linking against a plain in-memory version."""

import json

from wattline.llm import tool_calls

MESSAGES = "conv_id long, turn long, role string, text string"
CALLS = "conv_id long, turn long, call_id string, name string, arguments string"
RESULTS = "conv_id long, turn long, call_id string, content string"


def run(spark, messages, calls, results):
    df = tool_calls.link_tool_calls(spark.createDataFrame(messages, MESSAGES), spark.createDataFrame(calls, CALLS),
                                    spark.createDataFrame(results, RESULTS), tool_calls.SCHEMAS)
    return sorted(df.collect(), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["seq"]))


def test_order_links_and_errors(spark):
    ok = lambda **more: json.dumps({"query": "q", "limit": 2, **more})
    got = run(spark,
              [(1, 0, "user", "hi"), (1, None, "system", None), (None, 0, "user", "lost"), (1, 0, "user", "hi")],
              [(1, 1, "a", "search", ok(after={"$result": "b"})), (1, 2, "b", "search", ok()), (1, 5, "c", "nope", "{}"),
               (1, 6, "d", "search", "[1]"), (1, 7, "e", "search", '{"limit": 0, "x": 1}'), (2, 0, "a", "search", ok())],
              [(1, 0, "b", "early answer"), (1, 9, "b", "again"), (1, 3, "zz", "no call"), (1, 4, "a", None)])
    one = [r for r in got if r["conv_id"] == 1]
    at = {(r["kind"], r["call_id"], json.loads(r["json"]).get("content")): r["seq"] for r in one}
    assert [r["seq"] for r in one] == list(range(len(one)))
    assert at["call", "b", None] < at["result", "b", "early answer"] < at["call", "a", None] or \
        [r["seq"] for r in one if (r["kind"], r["call_id"]) == ("call", "b")][0] < at["result", "b", "early answer"]
    seq = {(r["kind"], r["call_id"]): r["seq"] for r in one if r["kind"] == "call"}
    assert seq["call", "b"] < at["result", "b", "early answer"] < seq["call", "a"]
    err = {(r["kind"], r["call_id"]): r["error"] for r in one}
    assert err["call", "b"] == "" and err["call", "c"].startswith("unknown tool") and "not a JSON object" in err["call", "d"]
    assert err["call", "e"] == "$.query: missing; $.limit: below minimum; $.x: not allowed; no result"
    assert err["result", "zz"] == "no call"
    assert [r["error"] for r in one if r["call_id"] == "b" and r["kind"] == "result"] == ["", "further result"]
    assert [r["error"] for r in got if r["conv_id"] == 2] == ["no result"]
    assert sum(r["kind"] == "message" for r in one) == 3 and sum(r["conv_id"] is None for r in got) == 1
    for r in got:
        value = json.loads(r["json"])
        assert r["json"] == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_cycle_is_named(spark):
    wait = lambda c: json.dumps({"query": "q", "limit": 1, "after": {"$result": c}})
    got = run(spark, [], [(1, 0, "a", "search", wait("b")), (1, 1, "b", "search", wait("a")), (1, 2, "c", "search", '{"query":"q","limit":1}')],
              [(1, 3, "a", "x"), (1, 4, "b", "y"), (1, 5, "c", "z")])
    err = {r["call_id"]: r["error"] for r in got if r["kind"] == "call"}
    assert err == {"a": "waits for itself", "b": "waits for itself", "c": ""}
    assert len(got) == 6


def test_query_matches_plain_version(spark):
    rows = [(c, t, ("user", "assistant")[t % 2] if t else "system", f"text {c} {t} " + "x" * (t * 7)) for c in range(6) for t in range(9)]
    conv = spark.createDataFrame(rows, MESSAGES)
    calls, results = tool_calls.traffic(conv)
    got = tool_calls.link_tool_calls(conv.where("role <> 'assistant'"), calls, results, tool_calls.SCHEMAS).collect()
    users = [(c, t) for c, t, r, _ in rows if r == "user"]
    assert len(got) == len(rows) + len(users)
    answered = {(c, t) for c, t, r, _ in rows if r == "assistant"}
    for r in got:
        if r["kind"] == "call":
            c, t = map(int, r["call_id"].split("_")[1:])
            assert r["linked"] == ((c, t + 1) in answered)
    for c in range(6):
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["seq"])
        assert [r["seq"] for r in mine] == list(range(len(mine)))
        seen = set()
        for r in mine:
            if r["kind"] == "result" and r["linked"]:
                assert r["call_id"] in seen
            if r["kind"] == "call":
                seen.add(r["call_id"])


def test_arguments_that_are_hard_to_read_are_named(spark):
    """Lone surrogates, deep nesting, numbers that are no JSON, and very long arguments end in a row, not in a crash."""
    deep = '{"query":' + "[" * 100_000 + "]" * 100_000 + "}"
    args = {"surrogate": '{"query":"\\ud800","limit":1}', "deep": deep, "deepish": '{"query":' + '{"a":' * 150 + "1" + "}" * 150 + ',"limit":1}',
            "nan": '{"query":"q","limit":NaN}', "inf": '{"query":"q","limit":1e999}', "minus": '{"query":"q","limit":-Infinity}',
            "long": json.dumps({"query": "x" * 2_000_000, "limit": 1}), "none": None, "key": '{"query":"q","limit":1,"\\udfff":1}',
            "digits": '{"query":"q","limit":' + "9" * 5000 + "}", "ref": '{"query":"q","limit":1,"after":{"$result":"\\ud800"}}'}
    got = run(spark, [], [(1, k, name, "search", a) for k, (name, a) in enumerate(args.items())], [(1, 50, name, "r") for name in args])
    calls = {r["call_id"]: r for r in got if r["kind"] == "call"}
    err = {k: r["error"] for k, r in calls.items()}
    assert err["surrogate"] == "" and err["long"] == "" and err["ref"] == ""
    assert err["deep"] == err["deepish"] == "arguments are nested too deep"
    assert {err[k] for k in ("nan", "inf", "minus", "none", "digits")} == {"arguments are not a JSON object"}
    assert err["key"] == "$.\\udfff: not allowed"
    for r in got:
        json.loads(r["json"], parse_constant=lambda x: 1 / 0)
    assert json.loads(calls["surrogate"]["json"])["tool_calls"][0]["function"]["arguments"]["query"] == "\ud800"


def test_repeated_rows_and_further_columns(spark):
    from pyspark.sql import functions as F
    ok = '{"query":"q","limit":1}'
    add = lambda df: df.select("*", F.lit(1).alias("depth"), F.lit("x").alias("args"), F.lit(2).alias("seq"))
    df = tool_calls.link_tool_calls(add(spark.createDataFrame([(1, 0, "user", "hi")] * 3, MESSAGES)), add(spark.createDataFrame([(1, 1, "a", "search", ok)] * 50, CALLS)),
                                    add(spark.createDataFrame([(1, 2, "a", "r")] * 20, RESULTS)), tool_calls.SCHEMAS)
    got = df.collect()
    assert sorted(r["seq"] for r in got) == list(range(73))
    assert sum(r["kind"] == "call" and r["linked"] for r in got) == 50


def test_rounds_do_not_grow_with_a_cycle_or_a_long_conversation(spark, monkeypatch):
    """One cycle beside a conversation of references to earlier turns: a few rounds in all."""
    wait = lambda c: json.dumps({"query": "q", "limit": 1, "after": {"$result": c}})
    calls = [(1, 0, "a", "search", wait("b")), (1, 1, "b", "search", wait("a")), (1, 2, "c", "search", wait("a"))]
    calls += [(2, 2 * k, f"k{k}", "search", wait(f"k{k - 1}")) for k in range(200)]
    results = [(1, 9, x, "r") for x in "abc"] + [(2, 2 * k + 1, f"k{k}", "r") for k in range(200)]
    names, inner = [], tool_calls.stored
    monkeypatch.setattr(tool_calls, "stored", lambda df, name: names.append(name) or inner(df, name))
    got = run(spark, [], calls, results)
    assert len(names) < 20
    err = {r["call_id"]: r["error"] for r in got if r["kind"] == "call" and r["conv_id"] == 1}
    assert err == {"a": "waits for itself", "b": "waits for itself", "c": "waits for itself"}
    assert [r["call_id"] for r in got if r["conv_id"] == 2 and r["kind"] == "call"] == [f"k{k}" for k in range(200)]


def test_chains_that_point_ahead_are_put_in_order(spark):
    """Random references, also to later turns: every call after the results it names, unless a cycle is among them."""
    import random
    rng = random.Random(5)
    for _ in range(3):
        n = 12
        refs = {k: rng.sample(range(n), rng.randrange(0, 3)) for k in range(n)}
        turn = {k: rng.randrange(6) for k in range(n)}
        calls = [(1, turn[k], f"c{k}", "search", json.dumps({"query": "q", "limit": 1, "x": [{"$result": f"c{r}"} for r in refs[k]]})) for k in range(n)]
        got = run(spark, [], calls, [(1, rng.randrange(6), f"c{k}", "r") for k in range(n)])
        seq = {(r["kind"], r["call_id"]): r["seq"] for r in got}
        good = set()
        while more := {k for k in refs if k not in good and all(r in good for r in refs[k])}:
            good |= more
        cyclic = {r["call_id"] for r in got if r["kind"] == "call" and "waits" in r["error"]}
        ahead = {k: set(refs[k]) for k in refs}
        for _ in refs:
            ahead = {k: v.union(*(ahead[r] for r in v)) if v else v for k, v in ahead.items()}
        # Those on a cycle are named, of those behind one only such as must share its turn.
        assert {f"c{k}" for k in refs if k in ahead[k]} <= cyclic <= {f"c{k}" for k in refs if k not in good}
        for k in good:
            assert seq["call", f"c{k}"] < seq["result", f"c{k}"]
            for r in refs[k]:
                assert seq["result", f"c{r}"] < seq["call", f"c{k}"]


def test_empty(spark):
    assert run(spark, [], [], []) == []
