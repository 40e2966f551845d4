import json

from rollmeter.llm import chat


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string, json string")


def test_links_orders_and_validates(spark):
    call = json.dumps({"tool_calls": [
        {"id": "b", "name": "search", "arguments": {"query": "${a}", "limit": 3}},
        {"id": "a", "name": "calculate", "arguments": {"expression": "1+1", "a": 2}},
        {"id": "c", "function": {"name": "search", "arguments": "{\"limit\": \"x\", \"query\": \"q\"}"}},
    ]})
    data = [
        (1, 0, "user", "hi", "z"), (1, 1, "assistant", call, None), (1, 2, "user", "wait", None),
        (1, 3, "tool", '{"tool_call_id":"a","content":"2"}', None), (1, 4, "tool", '{"tool_call_id":"a","content":"3"}', None),
        (1, 5, "tool", '{"tool_call_id":"zz","content":"?"}', None), (2, 0, None, None, None), (2, 1, "user", "", None), (2, 2, "user", "{broken", None),
    ]
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(rows(spark, data)).collect()}
    assert len(got) == len(data)
    m = got[1, 1]
    assert (m.n_calls, m.n_open, m.n_invalid, m.status) == (3, 2, 2, "open")
    calls = json.loads(m.json)["tool_calls"]
    assert [c["id"] for c in calls] == ["a", "c", "b"]
    assert '"arguments":{"limit":3,"query":"${a}"}' in m.json
    assert [got[1, t].status for t in (0, 3, 4, 5)] == ["plain", "linked", "repeated", "orphan"]
    assert (got[1, 3].order_turn, got[1, 3].order_rank) == (1, 1)
    assert got[2, 2].json == '{"content":"{broken","role":"user"}'
    assert got[2, 0].json == "{}"


def test_cycle_and_empty(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "t", "arguments": {"x": "${b}"}}, {"id": "b", "name": "t", "arguments": {"x": "${a}"}}]})
    got = chat.format_messages(rows(spark, [(1, 1, "assistant", call, None)])).collect()
    assert got[0].n_calls == 2
    assert chat.format_messages(rows(spark, [])).count() == 0


def test_long_chains_are_no_cycles(spark):
    chain = [{"id": f"c{i}", "name": "t", "arguments": {"x": f"${{c{i - 1}}}" if i else "1"}} for i in range(70)]
    call = json.dumps({"tool_calls": chain[::-1]})
    (got,) = chat.format_messages(rows(spark, [(1, 1, "assistant", call, None)])).collect()
    assert [c["id"] for c in json.loads(got.json)["tool_calls"]] == [f"c{i}" for i in range(70)]


def test_null_conversations_and_turns_keep_their_calls(spark):
    call = json.dumps({"tool_calls": [{"id": "b", "name": "t", "arguments": {"x": "${a}"}}, {"id": "a", "name": "t", "arguments": {}}]})
    data = [(None, 1, "assistant", call, None), (None, 2, "tool", '{"tool_call_id":"a","content":"2"}', None), (3, None, "assistant", call, None), (3, 2, "tool", '{"tool_call_id":"b","content":"2"}', None), (4, 1, "tool", '{"tool_call_id":"a"}', None)]
    got = {(r.conv_id, r.turn): r for r in chat.format_messages(rows(spark, data)).collect()}
    assert len(got) == len(data)
    for k in ((None, 1), (3, None)):
        assert (got[k].n_calls, got[k].status) == (2, "open") and [c["id"] for c in json.loads(got[k].json)["tool_calls"]] == ["a", "b"]
    assert (got[None, 1].n_open, got[3, None].n_open) == (1, 2)
    assert [got[k].status for k in ((None, 2), (3, 2), (4, 1))] == ["linked", "early", "orphan"]


def test_early_results_repeated_rows_and_calls_without_identifier(spark):
    call = json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "q"}}, {"name": "search", "arguments": {"query": "r"}}]})
    data = [(1, 0, "tool", '{"tool_call_id":"a","content":"soon"}', None), (1, 1, "assistant", call, None), (1, 1, "assistant", call, None), (2, 1, "assistant", call, None)]
    got = chat.format_messages(rows(spark, data)).collect()
    assert len(got) == 4
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append(r)
    assert [r.status for r in by[1, 0]] == ["early"]
    assert len(by[1, 1]) == 2 and len({r.json for r in by[1, 1]}) == 1
    for r in by[1, 1] + by[2, 1]:
        assert (r.n_calls, r.n_open, r.n_invalid, r.status) == (2, 2, 0, "open")
        assert sorted(c.get("id") or "" for c in json.loads(r.json)["tool_calls"]) == ["", "a"]
