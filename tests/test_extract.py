from evaluate import one

from tidemark.operators import corpus, extract as X, rewrite

TS = '''// "gpt-0" in a comment
import x from "lib";
const model = process.env.M || "gpt-4";
const T = { "gpt-4": 1, other: 'gpt-5' };
client.create({
  model: cond ? "a" : `b`, /* "c" */
  temperature: 0,
  "max_tokens": 5,
});
class A { private readonly modelName: string = "cls"; }
const xs = ["l1", "l2"];
if (m === "cmp") { run(openai("fac" as Foo), "a\\"b"); }
foo({ model, temperature: 1 });
const y: string = "typed"
const t = `tpl ${x}`
const z = "nosemi"
'''
PY = '''# "x" in a comment
import os
model = os.environ.get("M") or "gpt-4"
self.model = 'attr'
def f(model="d", *, engine: str = "k"):
    """doc"""
    return g(model=model, deployment_name="dep")
client.chat({"model": name, "x": "y", "model_id": "lit"})
T = {"gpt-4": "v"}
if m in ("a", "b") or m == "q": pass
xs = ["l1",
  "l2"]
GenerativeModel("fac")
GenerativeModel(NAME)
s = f"gpt{x}" + "other"
t = "a" "b"
m2 = "y" if c else "z"
create(model=self.cfg.model_name, messages=[{"role": "user"}])
é = "ünï"
'''


def files(spark):
    return spark.createDataFrame(
        [("r", "a.ts", "ts", TS), ("r", "b.py", "py", PY)], "repo string, path string, lang string, text string"
    )


def test_native_python_equals_the_parser(spark):
    # The non-ASCII name is a word the native tokens do not know; its literal is the same.
    native = X.literals(X.token_structure(files(spark))).where("lang = 'py' and line < 19")
    exact = X.python_literals(X.python_facts(files(spark))).where("line < 19")
    assert native.exceptAll(exact).collect() == []
    assert exact.exceptAll(native).collect() == []


def test_offsets_count_characters(spark):
    for facts in (X.literals(X.token_structure(files(spark))), X.python_literals(X.python_facts(files(spark)))):
        for r in facts.collect():
            source = TS if r.path == "a.ts" else PY
            cut = source[r.start : r.end]
            assert cut.replace('\\"', '"') == r.value
            assert source.split("\n")[r.line - 1][r.col - 1 :].startswith(r.quote)


def test_typescript_enclosures(spark):
    got = {r.value: r for r in X.literals(X.token_structure(files(spark))).where("lang = 'ts'").collect()}
    assert "gpt-0" not in got and "c" not in got and not any("tpl" in v for v in got)
    assert (got["a"].enclosure, got["a"].encl_name, got["a"].in_call) == ("property_value", "model", True)
    assert (got["b"].enclosure, got["b"].in_call) == ("property_value", True)
    assert (got["gpt-5"].enclosure, got["gpt-5"].in_call) == ("property_value", False)
    assert (got["cls"].enclosure, got["cls"].encl_name) == ("class_property", "modelName")
    assert (got["fac"].enclosure, got["fac"].callee, got["fac"].cast_type) == ("call_arg", "openai", "Foo")
    assert got["cmp"].enclosure == "comparison"
    assert got["l2"].enclosure == "array_element"
    assert (got["typed"].enclosure, got["typed"].encl_name) == ("variable", "y")
    assert got['a"b'].enclosure == "call_arg"


def test_options_and_constants(spark):
    s = X.token_structure(files(spark))
    options = {(r.obj_id, r.key): r for r in X.option_objects(s).collect()}
    kinds = {k[1]: r.key_kind for k, r in options.items() if TS[k[0] :].startswith("{ model,")}
    assert kinds == {"model": "shorthand", "temperature": "property"}
    quoted = next(r for r in options.values() if r.key == "max_tokens")
    assert quoted.key_quote == '"' and TS[quoted.key_start : quoted.key_end] == '"max_tokens"'
    assert TS[quoted.prop_start : quoted.prop_end] == '"max_tokens": 5,'
    assert {r.ident for r in X.const_bindings(s).collect()} == {"y", "z"}


def test_sinks(spark):
    want = {"model", "name", "NAME", "model_name"}
    assert {r.name for r in X.sink_facts(X.token_structure(files(spark))).collect()} == want
    assert {r.name for r in X.python_sinks(X.python_facts(files(spark))).collect()} == want


def test_unparsable_python_is_reported(spark):
    broken = spark.createDataFrame([("r", "x.py", "py", "x = (")], "repo string, path string, lang string, text string")
    facts = X.python_facts(broken)
    assert [r.path for r in X.unreadable_files(facts).collect()] == ["x.py"]
    gate = rewrite.syntax_gate(
        X.syntax_errors(broken.selectExpr("repo", "path", "'x = 1' as text"), "baseline").unionByName(
            X.syntax_errors(broken, "patched")
        )
    )
    assert [(r.baseline_errors, r.patched_errors) for r in gate.collect()] == [(0, 1)]


def test_long_string_does_not_overflow_the_matcher(spark):
    text = 'const a = "' + "x" * 200_000 + '";\n/* ' + "y" * 200_000 + ' */ const b = "q";'
    df = spark.createDataFrame([("r", "a.ts", "ts", text)], "repo string, path string, lang string, text string")
    got = X.literals(X.token_structure(df)).collect()
    assert sorted(len(r.value) for r in got) == [1, 200_000]


def test_reading_shuffles_nothing(spark):
    for step in (X.facts(files(spark)), X.literals(X.token_structure(files(spark)))):
        plan = step._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Window" not in plan


def test_prefilter_runs_nothing_before_it_is_asked(spark):
    tokens = spark.createDataFrame([("gpt-4",), ("nope",)], "token string")
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    found = corpus.prefilter(files(spark), tokens)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before
    assert {r.path for r in found.collect()} == {"a.ts", "b.py"}


def test_prefilter_equals_containment(spark):
    import random

    rng = random.Random(5)
    word = lambda low, high: "".join(rng.choice("ab-.1é") for _ in range(rng.randint(low, high)))
    texts, tokens = [word(0, 40) for _ in range(300)], [word(2, 12) for _ in range(25)]
    rows = spark.createDataFrame([("r", f"f{k}.py", t) for k, t in enumerate(texts)], "repo string, path string, text string")
    got = corpus.prefilter(rows, spark.createDataFrame([(t,) for t in tokens], "token string"))
    assert sorted(r.text for r in got.collect()) == sorted(t for t in texts if any(x in t for x in tokens))


def test_sieve_has_one_size_and_forgets_nothing(spark):
    from pyspark.sql import functions as F

    keys = spark.range(50_000).select(F.format_string("key-%05d", "id").alias("gram"))
    bitmap = corpus.sieve(keys)
    assert bitmap.selectExpr("size(words)").first()[0] == corpus.SIEVE_WORDS
    passed = spark.range(200_000).select("id", F.format_string("key-%05d", "id").alias("gram")).where(corpus._passes("gram", bitmap.scalar()))
    ids = {r.id for r in passed.select("id").collect()}
    assert ids >= set(range(50_000)) and len(ids) < 60_000
    assert corpus.sieve(keys.limit(0)).selectExpr("aggregate(words, 0L, (a, x) -> a | x)").first()[0] == 0


def test_prefilter_and_coverage_are_exact_beyond_every_bound(spark):
    from pyspark.sql import functions as F

    texts = ["x model-0123456 y", "model-0200001", "model-", "gp", "a 😀\n漢字-token-1 b", "é", None, "", "key 😀q", "model-0123456"]
    paths = [f"f{i}.py" for i in range(len(texts) - 1)] + ["dist/f.ts"]
    rows = spark.createDataFrame([("r", p, t) for p, t in zip(paths, texts, strict=True)] + [("r", "f0.py", "none")], "repo string, path string, text string")
    tokens = spark.range(200_001).select(F.format_string("model-%07d", "id").alias("token"))
    tokens = tokens.union(spark.createDataFrame([("\n漢字-token-1",), ("é",), ("😀q",), ("gpt",)], "token string"))
    got = [tuple(r) for r in corpus.prefilter(rows, tokens).select("path", "text").collect()]
    assert sorted(got) == sorted((p, t) for p, t in zip(paths, texts, strict=True) if t in (texts[0], texts[4], "é", "key 😀q", texts[9]))
    plain = spark.range(200_001).select(
        F.lit("model_id").alias("kind"), F.format_string("model-%07d", "id").alias("deprecated"), F.lit(None).cast("array<string>").alias("on_models")
    )
    row = corpus.coverage(rows, plain).first()
    assert (row.files, row.matched) == (10, 1)


def test_annotation_first_five_lines(spark):
    note = lambda s: one(spark, corpus.annotation, s)
    assert note("a\n\n\n\n # scan: ignore-file \nrest") == "ignore-file"
    assert note("a\n\n\n\n\n# scan: ignore-file") is None
    assert note("// scan: model-catalog\r\n") == "model-catalog"
    assert note("x // scan: model-catalog") is None


def test_scan_function(spark):
    X.register_scan_function(spark)
    got = spark.sql("select s.value from values ('m = \"q\"') as f(text), lateral scan_literals(f.text) s").collect()
    assert [r.value for r in got] == ["q"]


def test_regular_expressions_hold_no_strings(spark):
    text = """const a = s.replace(/"/g, ""); create({ model: "m1" });
const b = s.split(/'/), c = x / y / z; create({ model: 'm2' });
const d = [/[/"]\\"/, "e"]; if (/^"$/.test(s)) create({ model: "m3" });
"""
    rows = spark.createDataFrame([("r", "a.ts", "ts", text)], "repo string, path string, lang string, text string")
    found = {(r.value, r.enclosure) for r in X.literals(X.token_structure(rows)).collect()}
    assert {("m1", "property_value"), ("m2", "property_value"), ("m3", "property_value"), ("e", "array_element")} <= found
    assert {v for v, _ in found} == {"", "m1", "m2", "m3", "e"}


def test_cast_compares_the_whole_type(spark):
    text = """create({ model: "m1" as string });
create({ model: "m2" as string | undefined });
create({ model: "m3" as Model[] });
create({ model: "m4" as ns.Id, other: 1 });
"""
    rows = spark.createDataFrame([("r", "a.ts", "ts", text)], "repo string, path string, lang string, text string")
    found = {r.value: r.cast_type for r in X.literals(X.token_structure(rows)).collect()}
    assert found == {"m1": "string", "m2": "string | undefined", "m3": "Model[]", "m4": "ns.Id"}


#: (language, source with the id x, enclosure, name, in a call, callee, cast) of each construct.
CONSTRUCTS = [
    ("ts", 'create({ model: ("x" as LLMID) });', "property_value", "model", True, None, "LLMID"),
    ("ts", 'create({ model: ("x") as LLMID });', "property_value", "model", True, None, "LLMID"),
    ("ts", 'create({ model: (opts.m || "x") });', "property_value", "model", True, None, None),
    ("ts", 'create({ model: ((opts.m ?? ("x"))) });', "property_value", "model", True, None, None),
    ("ts", 'const modelName = ("x")', "variable", "modelName", None, None, None),
    ("ts", 'create(({ model: "x" }));', "property_value", "model", True, None, None),
    ("ts", 'const cfg = { model: "x" };', "property_value", "model", False, None, None),
    ("ts", 'const modelName: Record<string, string> = "x";', "variable", "modelName", None, None, None),
    ("ts", 'const modelName: Map<string, Map<string, A>> = "x";', "variable", "modelName", None, None, None),
    ("ts", 'if (x) /"/.test(y); create({ model: "x" });', "property_value", "model", True, None, None),
    ("ts", 'const f = s => /["]/.exec(s); create({ model: "x" });', "property_value", "model", True, None, None),
    ("ts", 'throw /"/; create({ model: "x" })', "property_value", "model", True, None, None),
    ("ts", 'const r = (a + b) / 2 / c; create({ model: "x" })', "property_value", "model", True, None, None),
    ("ts", 'const m = <LLMID>"x";', "other", None, None, None, None),
    ("ts", 'const t = `a ${f("x")} b`;', "call_arg", None, None, "f", None),
    ("ts", "const t = `don't ${create({ model: \"x\" })} it's`; g('y');", "property_value", "model", True, None, None),
    ("ts", 'create({ model: "x" as string | undefined, n: 1 });', "property_value", "model", True, None, "string | undefined"),
    ("ts", 'create({ model: "x" as Record<string, "a">, n: 1 });', "property_value", "model", True, None, 'Record<string , "a">'),
    ("ts", 'create({ model: "x" as const });', "property_value", "model", True, None, "const"),
    ("ts", 'create({ model: "x" + suffix });', "other", None, None, None, None),
    ("ts", 'create({ model: ("x").trim() });', "other", None, None, None, None),
    ("ts", 'create({ model: "x" satisfies Id });', "other", None, None, None, None),
    ("ts", 'create({ model: ok && "x" });', "other", None, None, None, None),
    ("ts", 'create({ model: ok ? "x" : y });', "property_value", "model", True, None, None),
    ("ts", 'if (m === ("x")) { }', "comparison", None, None, None, None),
    ("ts", 'const p = { "x": 1 };', "property_key", None, None, None, None),
    ("ts", 'const l = ["x"];', "array_element", None, None, None, None),
    ("ts", 'client.create<Foo>({ model: "x" });', "property_value", "model", True, None, None),
    ("ts", 'google?.("x");', "call_arg", None, None, None, None),
    ("ts", 'class A { readonly model: string = "x"; }', "class_property", "model", None, None, None),
    ("ts", '/* "y" */ const a = 1 // "z"\nconst model = `x`', "variable", "model", None, None, None),
    ("py", 'create(model=("x"))', "kwarg", "model", None, None, None),
    ("py", 'model = ("x")', "variable", "model", None, None, None),
    ("py", 'model: dict[str, str] = "x"', "variable", "model", None, None, None),
    ("py", 'create(\n  model=(\n    name\n    or "x"\n  ),\n)', "kwarg", "model", None, None, None),
    ("py", 'create({"model": ("x")})', "property_value", "model", True, None, None),
    ("py", 'def f(model: Optional[str] = "x"): pass', "param_default", "model", None, None, None),
    ("py", 't = ("x", 1)', "array_element", None, None, None, None),
    ("py", 'if m in ("x",): pass', "comparison", None, None, None, None),
    ("py", 'model = "x".lower()', "other", None, None, None, None),
    ("py", 'model = a and "x"', "other", None, None, None, None),
    ("py", '# it is "y"\n\n# more\nmodel = "x"  # z', "variable", "model", None, None, None),
]


def test_constructs(spark):
    rows = [("r", f"f{k}", lang, text) for k, (lang, text, *_) in enumerate(CONSTRUCTS)]
    df = spark.createDataFrame(rows, "repo string, path string, lang string, text string")
    got = {r.path: r for r in X.literals(X.token_structure(df)).where("value = 'x'").collect()}
    for k, (_, text, enclosure, name, in_call, callee, cast) in enumerate(CONSTRUCTS):
        r = got[f"f{k}"]
        shown = r.encl_name if enclosure in ("property_value", "variable", "class_property", "kwarg", "param_default") else None
        assert (r.enclosure, shown, r.in_call, r.callee, r.cast_type) == (enclosure, name, in_call, callee, cast), text
        assert text[r.start : r.end] == "x"
        before = text[: r.start - 1]
        assert (r.line, r.col) == (before.count("\n") + 1, len(before.rpartition("\n")[2]) + 1), text
    assert X.literals(X.token_structure(df)).where("value in ('z')").count() == 0


def test_large_files_keep_every_literal(spark):
    text = "\n".join(f'create({{ model: "m{k}", other: [{k}] }});' for k in range(1500))
    df = spark.createDataFrame([("r", "a.ts", "ts", text), ("r", "e.ts", "ts", ""), ("r", "n.ts", "ts", None)], "repo string, path string, lang string, text string")
    found = X.literals(X.token_structure(df)).collect()
    assert [r.value for r in sorted(found, key=lambda r: r.start)] == [f"m{k}" for k in range(1500)]
    assert {r.enclosure for r in found} == {"property_value"} and [r.line for r in found] == list(range(1, 1501))
