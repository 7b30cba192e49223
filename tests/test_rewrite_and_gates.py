import itertools
import json
import random

from pyspark.sql import functions as F

from tidemark.operators import gates as G, params as P, rewrite as W, specdiff, tiers, usage
from tidemark.sources import specs


def test_apply_edits_equals_slicing(spark):
    rng = random.Random(3)
    files, edits, want = [], [], {}
    for n in range(30):
        text = "".join(rng.choice("abc\n😀é") for _ in range(rng.randint(10, 80)))
        spans, at = [], 0
        while at < len(text) - 3:
            start = at + rng.randint(0, 5)
            end = min(len(text), start + rng.randint(0, 4))
            if start > len(text):
                break
            spans.append((start, end, rng.choice(["", "X", "longer", "'q'"])))
            at = end + 1
        out = text
        for s, e, t in sorted(spans, reverse=True):
            out = out[:s] + t + out[e:]
        files.append(("r", f"f{n}", text))
        edits += [("r", f"f{n}", s, e, t, 0, "k") for s, e, t in spans]
        want[f"f{n}"] = out
    # A repeated edit and one inside an earlier span change nothing.
    edits.append(edits[0])
    f = spark.createDataFrame(files, "repo string, path string, text string")
    e = spark.createDataFrame(edits, "repo string, path string, start long, end long, new_text string, ord long, kind string")
    got = {r.path: r.new_text for r in W.apply_edits(f, e).collect()}
    assert got == want


def test_nested_edit_is_dropped(spark):
    f = spark.createDataFrame([("r", "p", "abcdef")], "repo string, path string, text string")
    rows = [("r", "p", 1, 4, "", 0, "k"), ("r", "p", 2, 3, "Z", 1, "k"), ("r", "p", 4, 5, "Y", 1, "k"), ("r", "p", 1, 2, "no", 5, "k")]
    e = spark.createDataFrame(rows, "repo string, path string, start long, end long, new_text string, ord long, kind string")
    assert W.apply_edits(f, e).first().new_text == "aYf"


EDIT = "repo string, path string, start long, end long, new_text string, ord long, kind string"


def test_an_edit_lost_to_another_blocks_nobody(spark):
    rows = [("r", "p", 0, 10, "A", 0, "k"), ("r", "p", 5, 20, "B", 0, "k"), ("r", "p", 15, 18, "C", 0, "k"),
            ("r", "p", 0, 10, "A", 1, "k"), ("r", "p", 0, 4, "D", 2, "k"), ("r", "p", 18, 19, "E", 0, "k")]
    e = spark.createDataFrame(rows, EDIT)
    assert sorted(r.new_text for r in W.non_overlapping(e).collect()) == ["A", "C", "E"]
    assert sorted((r.new_text, r.ord, r.dropped) for r in W.dropped_edits(e).collect()) == [
        ("A", 1, "repeated"), ("B", 0, "overlaps"), ("D", 2, "same_start")]
    f = spark.createDataFrame([("r", "p", "0123456789abcdefghijk")], "repo string, path string, text string")
    assert W.apply_edits(f, e).first().new_text == "AabcdeCEjk"


def test_choice_equals_a_greedy_loop(spark):
    rng = random.Random(5)
    rows = [("r", f"f{rng.randint(0, 9)}", s, s + rng.randint(0, 9), rng.choice("XYZ"), rng.randint(0, 3), "k")
            for s in (rng.randint(0, 120) for _ in range(600))]
    want = {}
    for path in {r[1] for r in rows}:
        end, last = -1, None
        for r in sorted({r for r in rows if r[1] == path}, key=lambda r: (r[2], r[5], r[3], r[4])):
            first, last = r[2] != last, r[2]
            want[r] = first and r[2] >= end
            end = r[3] if want[r] else end
    got = {tuple(r)[:7]: r.dropped is None for r in W.choose(spark.createDataFrame(rows, EDIT)).collect()}
    assert got == want


def test_prefix_match_equals_theta_join(spark):
    models = ["m-1", "m-1-mini", "m-10", "m", "a-b-c", "a-b", "x"]
    families = ["m-1", "m", "a-b", "a-b-c-d", "x"]
    got = P.family_match(
        spark.createDataFrame([(m,) for m in models], "model string"),
        spark.createDataFrame([(f,) for f in families], "family string"),
        "model", "family",
    ).collect()
    want = {(m, f) for m in models for f in families if m == f or m.startswith(f + "-")}
    assert {(r.model, r.family) for r in got} == want


SPEC = {
    "Charge": {"properties": {
        "amount": {"type": "string"}, "status": {"type": "string", "enum": ["a", "b"]},
        "same": {"type": ["null", "string"], "enum": [1, 2]}, "gone": {"type": "string"},
        "card": {"properties": {"name": {"type": "string"}, "deep": {"properties": {"x": {"properties": {"y": {"type": "string"}}}}}}},
        "free": {}}},
    "OnlyA": {"properties": {"z": {"type": "string"}}},
}
SPEC_B = {
    "Charge": {"properties": {
        "amount": {"type": "number"}, "status": {"type": "string", "enum": ["b", "c"]},
        "same": {"type": ["string", "null"], "enum": [2, 1]},
        "card": {"properties": {"holder": {"type": "string"}, "deep": {"properties": {"x": {"properties": {"q": {"type": "string"}}}}}}},
        "free": {"type": "string"}}},
}


def _specs(spark, a, b):
    doc = lambda s: json.dumps({"components": {"schemas": s}})
    return spark.createDataFrame([("api", "A", doc(a)), ("api", "B", doc(b))], "api string, version string, doc string")


def test_spec_diff_golden(spark):
    got = {(r.kind, r.path, r["from"], r["to"]) for r in specdiff.spec_diff(_specs(spark, SPEC, SPEC_B)).collect()}
    assert got == {
        ("type_change", "Charge.amount", "string", "number"),
        ("enum_value_change", "Charge.status", "[a, b]", "[b, c]"),
        ("field_removed", "Charge.gone", None, None),
        ("field_rename", "Charge.card.name", "name", "holder"),
        ("field_rename", "Charge.card.deep.x.y", "y", "q"),
    }
    shallow = specdiff.compared_objects(specdiff.paired_schemas(_specs(spark, SPEC, SPEC_B), "A", "B"), 3)
    assert sorted(r.path for r in shallow.collect()) == ["Charge", "Charge.card", "Charge.card.deep"]


def _random_object(rng, depth):
    names = rng.sample(["a", "b", "c", "d{", 'e"}'], rng.randint(0, 3))
    node = {}
    for n in names:
        if depth and rng.random() < 0.6:
            node[n] = {"properties": _random_object(rng, depth - 1), "note": "}}{ \\\" {"}
        else:
            node[n] = rng.choice([{"type": "string"}, {"type": "number"}, {}, True, {"type": "string", "enum": ["x"]}])
    return node


def _walk(schema, path):
    """Path of every node below a schema, by plain recursion."""
    for name, node in schema.get("properties", {}).items():
        yield f"{path}.{name}"
        if isinstance(node, dict):
            yield from _walk(node, f"{path}.{name}")


def _diff(a, b, path):
    pa, pb = a.get("properties", {}), b.get("properties", {})
    kind = lambda n: n.get("type", "object" if "properties" in n else "") if isinstance(n, dict) else ""
    lost, gained = [k for k in pa if k not in pb], [k for k in pb if k not in pa]
    if len(lost) == len(gained) == 1 and kind(pa[lost[0]]) == kind(pb[gained[0]]):
        yield "field_rename", f"{path}.{lost[0]}"
    else:
        yield from (("field_removed", f"{path}.{k}") for k in lost)
    for k in pa:
        if k not in pb:
            continue
        x, y = pa[k], pb[k]
        if kind(x) and kind(y) and kind(x) != kind(y):
            yield "type_change", f"{path}.{k}"
        enum = lambda n: n.get("enum") if isinstance(n, dict) else None
        if enum(x) != enum(y):
            yield "enum_value_change", f"{path}.{k}"
        if isinstance(x, dict) and isinstance(y, dict) and "properties" in x and "properties" in y:
            yield from _diff(x, y, f"{path}.{k}")


def test_specs_have_no_depth_limit(spark):
    rng = random.Random(11)
    a = {f"S{i}": {"properties": _random_object(rng, 7)} for i in range(40)}
    b = {f"S{i}": {"properties": _random_object(rng, 7)} for i in range(40)}
    chain_a, chain_b = {"type": "string"}, {"type": "number"}
    for _ in range(30):
        chain_a, chain_b = {"properties": {"n": chain_a}}, {"properties": {"n": chain_b}}
    a["S0"], b["S0"] = chain_a, chain_b
    both = _specs(spark, a, b)
    got = sorted((r.kind, r.path) for r in specdiff.spec_diff(both).collect())
    assert got == sorted(c for name in a for c in _diff(a[name], b[name], name))
    rows = specs.flatten_specs(both.where("version = 'A'")).collect()
    below = sorted(f"{r.parent}.{r.name}" for r in rows if r.depth >= 0)
    assert below == sorted(p for name in a for p in _walk(a[name], name))
    assert max(r.depth for r in rows) == 29
    assert max(r.depth for r in specs.flatten_specs(both, max_depth=2).collect()) == 1


def test_spec_against_itself_is_empty(spark):
    assert specdiff.spec_diff(_specs(spark, SPEC, SPEC)).count() == 0


def test_sites_are_deduplicated_across_spellings(spark):
    changes = spark.createDataFrame([("api", "field_removed", "C.x", None, None)], "api string, kind string, path string, from string, to string")
    # The same path in another API is another field.
    sites = [("Vendor.C.x", "r", "f", 1, 1), ("C.x", "r", "f", 1, 1), ("vendor.C.x", "r", "f", 2, 1), ("C.xy", "r", "f", 3, 1), ("c.x", "r", "f", 4, 1)]
    other = [("C.x", "r", "g", 9, 1, "other")]
    u = spark.createDataFrame([(*s, "api") for s in sites] + other, "path_key string, repo string, file string, line int, col int, api string")
    assert sorted(r.line for r in usage.affected_sites(changes, u, "Vendor").collect()) == [1, 2]
    assert usage.unused_changes(changes, u, "Vendor").count() == 0
    assert usage.unused_changes(changes.withColumn("api", F.lit("third")), u, "Vendor").count() == 1


def test_gate_blocks_truth_table(spark):
    outcomes = ["pass", "fail", "inconclusive", "not-configured", "not-applicable"]
    rows = [("r", o, q) for o, q in itertools.product(outcomes, [True, False])]
    df = spark.createDataFrame(rows, "repo string, outcome string, required boolean")
    for r in df.select("*", G.is_block().alias("b")).collect():
        assert r.b == (r.outcome == "fail" or (r.outcome in ("inconclusive", "not-configured") and r.required))


def test_policy_rules(spark):
    cases = {
        "none": (None, None, (True, False, False), None),
        "eval": ('{"evalCommand": " go "}', None, (True, False, True), "go"),
        "off": ('{"gates": {"eval": {"command": "x", "required": false}, "typecheck": {"required": false}}}', None, (False, False, False), "x"),
        "both": ('{"evalCommand": "a", "gates": {"eval": {"command": "a"}}}', None, (True, False, True), "a"),
        "clash": ('{"evalCommand": "a", "gates": {"eval": {"command": "b"}}}', "commands_disagree", None, None),
        "field": ('{"gates": {"tests": {"needed": true}}}', "unknown_field", None, None),
        "cmd": ('{"gates": {"tests": {"command": "x"}}}', "command_not_supported", None, None),
        "list": ("[1]", "not_an_object", None, None),
        "text": ("{oops", "unparsable", None, None),
        "inert": ('{"other": 1}', None, (True, False, False), None),
        "blank": ('{"evalCommand": " "}', "bad_eval_command", None, None),
        "gate": ('{"gates": {"evals": {}}}', "unknown_gate", None, None),
    }
    df = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "repo string, config string")
    for r in G.policies(df).collect():
        _, problem, required, command = cases[r.repo]
        assert r.problem == problem, r
        if problem is None:
            assert (r.req_typecheck, r.req_tests, r.req_eval) == required, r
            assert r.eval_command == command
    assert {r.eval_command for r in G.policies(df, "cli").collect()} == {"cli"}


def test_new_diagnostics_is_a_multiset(spark):
    rows = [("r", "baseline", "f", 1, "m")] * 2 + [("r", "patched", "f", 1, "m")] * 5 + [("r", "baseline", "f", 2, "m")]
    df = spark.createDataFrame(rows, "repo string, side string, path string, code int, message string")
    assert [(r.code, r.added) for r in G.new_diagnostics(df).collect()] == [(1, 3)]
    v = G.diagnostics_verdict(df).first()
    assert (v.new_diagnostics, v.baseline, v.passed) == (3, 3, False)


def test_strict_collisions_fail(spark):
    import pytest

    df = spark.createDataFrame(
        [("r", "p", 1, 1, "v", "A"), ("r", "p", 1, 1, "v", "C")],
        "repo string, path string, line int, col int, value string, tier string",
    )
    assert tiers.collisions(df).first().tiers == "A+C"
    with pytest.raises(Exception, match="several tiers"):
        tiers.collisions(df, strict=True).collect()


def test_write_plan_all_or_nothing(spark):
    schema = "repo string, path string, text string"
    pending = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), ("b", "2", "y"), ("c", "1", "x"), ("c", "1", "x")], schema)
    current = spark.createDataFrame([("a", "1", "x"), ("a", "2", "﻿y"), ("b", "1", "CHANGED"), ("b", "2", "y"), ("c", "1", "x")], schema)
    got = {(r.repo, r.path): (r.preflight, r.decision) for r in W.write_plan(pending, current).collect()}
    assert got[("a", "2")] == ("ok", "written")
    assert got[("b", "1")] == ("drifted", "refused") and got[("b", "2")] == ("ok", "refused")
    assert got[("c", "1")] == ("listed_twice", "refused")
