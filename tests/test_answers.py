"""Answers against their rules: one failing answer for every rule, and a plain check of random ones."""

import json
import random

from foliant.plans import answers

GOOD = {
    "facts": {"asset_class": "clo", "deal_name": None, "payment_frequency": "monthly", "extra": [1]},
    "tranches": {"items": [{"class_name": "A", "original_balance": "$1", "interest_rate": "4%", "rating": None}], "stated_total": "$1"},
    "triggers": {"items": [{"trigger_type": "t", "metric": "m", "consequence": "c"}]},
    "coverage": {"items": [{"tranche": "A", "test_type": "interest_coverage", "threshold": "1%"}]},
}
SHOWN = {str: "STRING", int: "BIGINT", bool: "BOOLEAN", list: "ARRAY", dict: "OBJECT", type(None): "VOID", float: "DECIMAL"}


def plain_check(target, answer):
    """(place, rule) of every violation, by recursion."""
    if not (answer or "").strip():
        return {("$", "empty")}
    try:
        root = json.loads(answer)
    except ValueError:
        return {("$", "json")}
    if not isinstance(root, dict):
        return {("$", "type")}
    rules = {path: r for t, path, *r in answers.SCHEMA if t == target}
    out = set()

    def visit(v, place, path):
        if path in rules:
            kind, needed, most, allowed = rules[path]
            if SHOWN[type(v)] != kind and not (v is None and not needed):
                out.add((place, "type"))
            elif isinstance(v, list) and most and len(v) > most:
                out.add((place, "max_items"))
            elif isinstance(v, str) and allowed and v not in allowed:
                out.add((place, "enum"))
        if isinstance(v, dict) and (not path or path in rules):
            for p, (_, needed, *_) in rules.items():
                if needed and not p.endswith("[*]") and answers._parent(p) == path and p.rpartition(".")[2] not in v:
                    out.add((f"{place}.{p.rpartition('.')[2]}", "required"))
            for k, x in v.items():
                visit(x, f"{place}.{k}", f"{path}.{k}" if path else k)
        if isinstance(v, list) and path in rules:
            for k, x in enumerate(v):
                visit(x, f"{place}[{k}]", path + "[*]")

    visit(root, "$", "")
    return out


def test_answers_against_every_rule(spark):
    rng = random.Random(1)
    rows = [(t, json.dumps(g)) for t, g in GOOD.items()] + [(t, a) for t in GOOD for a in (None, " \n", "{not json", "[1]", '"text"', "7", "{}", '{"items": {}}', '{"items": null}', '{"items": [1, null, []]}')]
    for t, path, kind, needed, most, allowed in answers.SCHEMA:  # break every rule in turn
        for bad in ([3] if kind != "OBJECT" else ["x"]) + [None, "drop"] + (["nowhere"] if allowed else []) + ([GOOD[t]["items"] * (most + 1)] if most else []):
            g = json.loads(json.dumps(GOOD[t]))
            at, last = g, path.replace("items[*]", "items.0").split(".")
            for k in last[:-1]:
                at = at[int(k) if k.isdigit() else k]
            k = int(last[-1]) if last[-1].isdigit() else last[-1]
            if bad == "drop":
                at.pop(k) if isinstance(at, list) else at.pop(k, None)
            else:
                at[k] = bad
            rows.append((t, json.dumps(g)))
    for _ in range(150):  # several faults at once
        t = rng.choice(list(GOOD))
        g = json.loads(json.dumps(GOOD[t]))
        for at in [g, *[x for x in g.get("items", []) if rng.random() < 0.5]]:
            for k in list(at):
                if rng.random() < 0.3 and k != "items":
                    at[k] = rng.choice([None, 1, "z", True, [1], {"a": 1}, 1.5])
                elif rng.random() < 0.2:
                    del at[k]
        rows.append((t, json.dumps(g)))
    frame = spark.createDataFrame([(f"d{k}", t, k, a) for k, (t, a) in enumerate(rows)], "doc_id string, target string, seq int, answer string")
    got = {k: set() for k in range(len(rows))}
    for r in answers.violations(frame).collect():
        assert (r.place, r.rule) not in got[r.seq]
        got[r.seq].add((r.place, r.rule))
    assert got == {k: plain_check(t, a) for k, (t, a) in enumerate(rows)}
    assert {rule for x in got.values() for _, rule in x} == {"empty", "json", "type", "required", "max_items", "enum"}
    ok, bad = answers.checked(frame)
    assert {r.seq for r in ok.collect()} == {k for k, x in got.items() if not x}
    assert {(r.seq, (r.place, r.rule), r.raw) for r in bad.collect()} == {(k, min(x), rows[k][1]) for k, x in got.items() if x}
    assert answers.violations(frame.filter("false")).count() == 0


def test_answers_are_read_once(spark):
    frame = spark.createDataFrame([("d", "coverage", 0, '{"items": [{"tranche": 1}, null]}'), ("d", None, 1, "{}"), ("d", "coverage", 2, ' [{"items": []}]')], "doc_id string, target string, seq int, answer string")
    found = answers.violations(frame)
    run = found._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in run and "Join" not in run and run.count("Scan ") == 1
    want = {("$.items[0].tranche", "type", "1"), ("$.items[0].threshold", "required", None), ("$.items[0].test_type", "required", None), ("$.items[1]", "type", "null"), ("$", "type", '[{"items":[]}]')}
    assert {(r.place, r.rule, r.got) for r in found.collect()} == want
