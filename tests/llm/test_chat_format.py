import json
import random

from strandlake.llm.chat_format import format_chats


def test_links_orders_validates_and_serialises(spark):
    call = {"tool_calls": [{"name": "search", "id": "c1", "arguments": {"query": "é\"x", "limit": 3}}, {"id": "c2", "name": "search", "arguments": {"limit": "many", "odd": 1}}, {"id": "c3", "name": "none", "arguments": {}}], "content": "look"}
    rows = [
        (1, 0, "user", "hi\n\"you\"", "extra"),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "found"}), None),  # before its call
        (1, 2, "assistant", json.dumps(call), None),
        (1, 3, "tool", json.dumps({"tool_call_id": "nobody", "content": "?"}), None),
        (1, 4, "assistant", "{broken", None),
        (2, 0, "tool", json.dumps({"tool_call_id": "c1", "content": "other conversation"}), None),
        (None, 0, None, None, None),
        (None, 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, json string")
    out = [r.asDict() for r in format_chats(df).collect()]
    assert len(out) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in out}
    a = by[1, 2]
    assert (a["n_calls"], a["n_linked"], a["n_invalid"]) == (3, 1, 2)
    assert a["json"] == '{"content":"look","role":"assistant","tool_calls":[{"arguments":{"limit":3,"query":"é\\"x"},"id":"c1","name":"search"},{"arguments":{"limit":"many","odd":1},"id":"c2","name":"search"},{"arguments":{},"id":"c3","name":"none"}]}'
    r = by[1, 1]
    assert r["linked"] and (r["order_turn"], r["order_step"], r["order_index"]) == (2, 1, 0) and r["json"] == '{"content":"found","role":"tool","tool_call_id":"c1"}'
    assert by[1, 3]["linked"] is False and by[2, 0]["linked"] is False
    assert json.loads(by[1, 4]["json"]) == {"content": "{broken", "role": "assistant"}
    assert by[1, 0]["json"] == '{"content":"hi\\n\\"you\\"","role":"user"}' and by[1, 0]["linked"] is None
    assert by[None, 0]["json"] == '{"content":"","role":""}'


def brute(rows, schemas):
    """(conv, turn, row) -> (n_calls, n_linked, n_invalid, linked, place), by loops over each conversation."""
    types = {str: "string", bool: "boolean", int: "integer", float: "number", dict: "object", list: "array", type(None): "null"}
    calls, results, out = {}, {}, {}
    for k, (conv, turn, role, text) in enumerate(rows):
        x = json.loads(text) if role in ("assistant", "tool") and text.startswith("{") else {}
        if role == "assistant":
            for i, c in enumerate(x.get("tool_calls", [])):
                calls.setdefault((conv, c["id"]), []).append((turn, i, k, c))
        elif role == "tool" and "tool_call_id" in x:
            results.setdefault((conv, x["tool_call_id"]), []).append(k)
    for k, (conv, turn, role, text) in enumerate(rows):
        own = [(i, c) for group in calls.values() for (_, i, at, c) in group if at == k]
        invalid = 0
        for _, c in own:
            spec = schemas.get(c["name"])
            bad = spec is None
            if not bad:
                args = c["arguments"]
                bad = any(need and p not in args for p, (_, need) in spec.items()) or any(p not in spec or types[type(v)] != spec[p][0] for p, v in args.items())
            invalid += bad
        linked, place = None, (turn, 0, 0)
        for (where, call_id), answers in results.items():
            if k in answers:
                linked = (where, call_id) in calls
                if linked:
                    first = min(calls[where, call_id], key=lambda c: c[:2])
                    place = max(place, (first[0], 1, first[1]))
        out[k] = (len(own), sum((conv, c["id"]) in results for _, c in own), invalid, linked, place)
    return out


def test_linking_equals_brute_force(spark):
    """Random conversations: call ids that repeat, results before their calls, unknown tools, odd arguments."""
    r = random.Random(4)
    schemas = {"search": {"query": ("string", True), "limit": ("integer", False)}, "run": {"flags": ("array", False)}, "none": {}}
    rows = []
    for conv in range(12):
        for turn in range(r.randint(1, 12)):
            role = r.choice(["user", "assistant", "assistant", "tool", "tool"])
            text = "plain"
            if role == "assistant" and r.random() < 0.8:
                made = [{"id": f"c{r.randint(0, 6)}", "name": r.choice(["search", "run", "none", "other"]), "arguments": r.choice([{}, {"query": "q"}, {"query": 3}, {"query": "q", "limit": 2}, {"limit": "x"}, {"flags": [1]}, {"flags": {}}])} for _ in range(r.randint(1, 3))]
                text = json.dumps({"content": "c", "tool_calls": made})
            elif role == "tool":
                text = json.dumps({"content": "x" * r.choice([1, 70000]), "tool_call_id": f"c{r.randint(0, 8)}"})
            rows.append((conv, turn, role, text))
    extra = spark.createDataFrame([(*x, "row", "v", "calls") for x in rows], "conv_id long, turn long, role string, text string, row string, v string, calls string")
    got = {(x["conv_id"], x["turn"]): x for x in format_chats(extra, schemas).collect()}
    for k, want in brute(rows, schemas).items():
        x = got[rows[k][0], rows[k][1]]
        assert (x["n_calls"], x["n_linked"], x["n_invalid"], x["linked"], (x["order_turn"], x["order_step"], x["order_index"])) == want, rows[k]


def test_empty(spark):
    assert format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
