"""Truth tables of the position and tier rules against a plain-Python reading."""

import itertools

from tidemark import config as C
from tidemark.operators import occurrences as O

FACTS = (
    "repo string, path string, lang string, line int, col int, value string, enclosure string, "
    "encl_name string, in_call boolean, callee string, cast_type string"
)
NAMES = ["model", "MODEL_ID", "deployment_name", "Deployment", "label", None]
WHERE = [
    "property_value", "property_key", "kwarg", "variable", "class_property", "param_default",
    "call_arg", "array_element", "comparison", "other", "none",
]


def like(name):
    return name is not None and "model" in name.lower()


def expect(lang, where, name, in_call, callee, cast, sunk):
    if where == "property_key":
        return "data", "lookup_key"
    if where == "property_value":
        if name in C.DEPLOYMENT_NAMES:
            return "azure_deployment", None
        if like(name) and in_call:
            return "model_arg", None
        return "data", "catalog_entry"
    if where == "kwarg" and lang == "py":
        if name in C.DEPLOYMENT_NAMES:
            return "azure_deployment", None
        return ("model_arg", None) if like(name) else ("data", "generic")
    binding = ("variable", "class_property") if lang == "ts" else ("variable", "param_default")
    if where in binding:
        if name in C.DEPLOYMENT_NAMES:
            return "azure_deployment", None
        if like(name):
            if lang == "py" and not sunk:
                return "usage_unverified", None
            return "model_arg", None
        return "data", "generic"
    if where == "call_arg":
        known = C.TS_FACTORIES if lang == "ts" else C.PY_FACTORIES
        return ("model_arg", None) if callee in known else ("data", "generic")
    if where == "array_element":
        return "data", "list_entry"
    if where == "comparison":
        return "data", "comparison"
    return "data", "generic"


def rows(lang):
    out = []
    combos = itertools.product(WHERE, NAMES, [True, False, None], ["openai", "GenerativeModel", None], ["Named", "string", None])
    for i, (where, name, in_call, callee, cast) in enumerate(combos):
        path = "sunk.py" if i % 2 else "dry.py"
        out.append(("r", path, lang, i, 0, "v", where, name, in_call, callee, cast))
    return out


def test_typescript_positions(spark):
    got = O.place_ts(spark.createDataFrame(rows("ts"), FACTS)).collect()
    assert len(got) == len(rows("ts"))
    for r in got:
        pos, purpose = expect("ts", r.enclosure, r.encl_name, r.in_call, r.callee, r.cast_type, False)
        masked = pos == "model_arg" and r.cast_type == "Named"
        if masked:
            pos, purpose = "data", "generic"
        assert (r.position, r.purpose, r.cast_masked) == (pos, purpose, masked), r


def test_python_positions(spark):
    sinks = spark.createDataFrame(
        [("r", "sunk.py", n) for n in ("model", "MODEL_ID", "label")] * 2, "repo string, path string, name string"
    )
    got = O.place_py(spark.createDataFrame(rows("py"), FACTS), sinks).collect()
    assert len(got) == len(rows("py"))
    for r in got:
        sunk = r.path == "sunk.py"
        assert (r.position, r.purpose) == expect("py", r.enclosure, r.encl_name, r.in_call, r.callee, None, sunk), r


def test_tiers(spark):
    states = ["verified", "withheld", "unverified", "quarantined", "unverifiable", "unstamped"]
    combos = [
        (p, ok, m, s)
        for p in ("model_arg", "azure_deployment", "usage_unverified", "data")
        for ok in (True, False)
        for m in (True, False)
        for s in states
    ]
    df = spark.createDataFrame(combos, "position string, auto_apply boolean, cast_masked boolean, state string")
    for r in O.with_tier(df).collect():
        if r.position == "model_arg":
            want = ("A", None) if r.auto_apply else ("B", "replacement_unverified")
        elif r.position == "azure_deployment":
            want = ("B", "platform_blocked")
        elif r.position == "usage_unverified":
            want = ("B", "usage_unverified")
        else:
            want = ("B", "type_cast_masked") if r.cast_masked else ("C", None)
        assert (r.tier, r.reason) == want
        assert r.reason not in ("dynamic_model_value", "insufficient_dataflow")
        if r.reason == "replacement_unverified":
            assert r.verdict != "verified"


def test_queue_is_inert():
    """The scan takes the active registry and nothing that could be a queue."""
    import inspect

    from tidemark.plans import code_scan

    for fn in (code_scan.scan, code_scan.fix, O.occurrences):
        assert not {"candidates", "queue"} & set(inspect.signature(fn).parameters)


def test_value_is_matched_whole_and_first_record_wins(spark):
    schema = (
        "ord int, kind string, provider string, deprecated string, replacement string, status string, "
        "shutdown_date string, entry_id string, v_status string, v_official boolean, v_replacement boolean, "
        "v_auto boolean, checked_at string"
    )
    reg = spark.createDataFrame(
        [
            (2, "model_id", "p", "m", "late", None, None, None, "verified", True, True, True, None),
            (1, "model_id", "p", "m", "first", None, None, None, "verified", True, True, True, None),
            (0, "param_removal", "p", "m", "never", None, None, None, None, None, None, None, None),
        ],
        schema,
    )
    facts = spark.createDataFrame([("m",), ("m-1",), ("xm",)], "value string")
    assert [(r.value, r.replacement) for r in O.match_registry(facts, reg).collect()] == [("m", "first")]
