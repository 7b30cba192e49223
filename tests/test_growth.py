"""Steps whose cost must not grow faster than their input."""

from pyspark.sql import functions as F

from tidemark.operators import params, registry, rewrite


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_registry_lookup_broadcasts_nothing(spark):
    records = spark.createDataFrame(
        [(n, "model_id", "p", f"m-{n}", None, None) for n in range(20)],
        "ord long, kind string, provider string, deprecated string, shutdown_date string, entry_id string",
    )
    terms = spark.createDataFrame([("m-3",), ("P/M.4:free",), ("no",)], "term string")
    found = registry.find_records(records, terms)
    assert {(r.term, r.ord) for r in found.collect()} == {("m-3", 3), ("P/M.4:free", 4)}
    assert "Broadcast" not in _plan(registry.find_records(records, terms))


def test_a_site_is_not_multiplied_by_entries_of_its_family(spark):
    """Edits follow the first entry; those behind it never meet the objects."""
    field = "repo string, path string, obj_id long, key string, key_kind string, value_literal string, value_ident string, key_start long"
    objects = []
    for n, model in enumerate(["m-1", "m-1-mini", "m-2-mini", "m", "x-1", "zz"]):
        objects += [("r", "a.ts", n, "model", "property", model, None, 100 * n), ("r", "a.ts", n, "temperature", "property", "0", None, 100 * n + 9)]
    objects = spark.createDataFrame(objects, field)
    for c in ("value_start", "line", "col", "key_end", "prop_start", "prop_end"):
        objects = objects.withColumn(c, F.lit(0).cast("bigint"))
    objects = objects.withColumn("key_quote", F.lit(None).cast("string"))
    constants = spark.createDataFrame([], "repo string, path string, ident string, literal string, literal_start long")
    families = [["m-2", "m-1"], ["m"], ["m-1-mini", "x"], ["x-1"]]
    entries = [
        (90 - k, "param_rename" if k % 3 else "param_removal", "temperature", f"t{k}" if k % 3 else None, families[k % 4]) for k in range(60)
    ]
    entries = spark.createDataFrame(entries, "ord long, kind string, param string, replacement string, on_models array<string>")
    every = params.param_sites(objects, constants, entries)
    first = params.param_sites(objects, constants, entries, first_only=True)
    assert every.count() > 60 and first.count() == 5
    columns = ["start", "end", "new_text", "ord", "kind"]
    want, got = (sorted(map(tuple, rewrite.param_edits(s).select(*columns).fillna("").collect())) for s in (every, first))
    assert got == want


def test_new_documents_are_found_without_their_texts(spark, tmp_path):
    from tidemark.operators import documents
    from tidemark.sources import store

    rows = [(f"u{k % 7}", f"2025-01-0{1 + k % 5}", "<p>a  b</p>" * (1 + k % 3) + " " * (k % 2)) for k in range(40)]
    rows += [("v", "2025-01-01", None), (None, "2025-01-01", "n"), ("w", None, "n")] + rows[:9]
    captured = spark.createDataFrame(rows, "url string, retrieved_at string, text string").repartition(5)
    stored = spark.createDataFrame([], store.DOCUMENT)
    found = documents.new_documents(captured, stored)
    hashes = {tuple(r[:3]): r.doc_key for r in documents.hashed(captured).collect()}
    want = {}
    for row, key in hashes.items():
        rank = tuple((v is not None, v or "") for v in (row[1], row[0]))
        want[key] = min(want.get(key, rank), rank)
    got = [(r.doc_key, tuple((v is not None, v or "") for v in (r.retrieved_at, r.url))) for r in found.collect()]
    assert sorted(got, key=str) == sorted(want.items(), key=str)
    assert all(hashes[(r.url, r.retrieved_at, r.text)] == r.doc_key for r in found.collect())
    # The aggregation that sees every capture doesn't hold texts.
    lines = [line for line in _plan(found).splitlines() if "partial_min_by" in line and "doc_key" in line.split("functions")[0]]
    assert lines and not any("text" in line for line in lines)


def test_costly_readings_are_spread(spark):
    """One input split is read by as many tasks as a shuffle has."""
    from tidemark.operators import discovery
    from tidemark.sources import specs

    raw = spark.range(0, 64, 1, 1)
    checked = registry.check_records(raw.select(F.lit("[1]").alias("record"), "id"))
    pages = raw.select(F.lit("acme").alias("provider"), F.col("id").alias("page_id"), F.lit("<p>").alias("html"))
    docs = raw.select(F.lit("a").alias("api"), F.lit("A").alias("version"), F.lit("{}").alias("doc"))
    for df in (checked, discovery.table_rows(pages), specs.flatten_specs(docs)):
        assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = _plan(registry.split_valid(checked)[1])
    assert "Filter" in plan and plan.index("Filter") < plan.index("Exchange") < len(plan)
    assert "Filter" not in plan[plan.index("Exchange"):]


def test_windows_move_a_text_once_and_find_an_anchor_once(spark):
    from tidemark.operators import documents

    docs = spark.range(40).selectExpr("id", "repeat(concat('word', id, ' some more text '), 100) text").repartition(4)
    quotes = spark.range(40).selectExpr("id", "explode(array(concat('WORD', id), 'more  text', 'nowhere', null)) excerpt").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        windows = documents.excerpt_windows(docs, quotes, "id", 1000, 100, 0, 10)
        plans = [_plan(windows), _plan(documents.snapshot_bodies(docs, quotes, "id", 1000, 100))]
        assert windows.count() == 0 and documents.snapshot_bodies(docs, quotes, "id", 1000, 100).count() == 40
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        assert plan.count("Join") == 1 and "Window" not in plan
        assert plan.count("lower(text") <= 2  # the text itself, and nothing that is found in it a second time


FACTS = "repo string, path string, lang string, line long, col int, value string, enclosure string, encl_name string, in_call boolean, callee string, cast_type string"


def _facts(spark):
    wheres = ["property_key", "property_value", "kwarg", "variable", "param_default", "call_arg", "array_element", "comparison", "class_property", "odd", None]
    names = ["model", "defaultModel", "deployment", "label", None]
    rows = []
    for n, (where, name) in enumerate((w, m) for w in wheres for m in names):
        for k, lang in enumerate(["ts", "py", "go", None]):
            for call in (True, None):
                rows.append(
                    ("r", f"{'tests/' if n % 7 == 6 else 'src/'}f{n % 3}.{lang}", lang, n, k, f"m-{n % 4}", where, name, call,
                     ["openai", "GenerativeModel", None][n % 3], ["Named", "string", "", None][(n + k) % 4])
                )
    return spark.createDataFrame(rows, FACTS)


def _plan_without_broadcast(spark, make):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        return _plan(make())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_all_facts_meet_the_registry_in_one_join(spark, sf):
    from tidemark.operators import occurrences as O
    from tidemark.workload.fixtures import id_registry

    facts = _facts(spark)
    sinks = spark.createDataFrame([("r", "src/f0.py", "model"), ("r", "src/f0.py", "model"), ("r", "src/f1.py", "defaultModel")], "repo string, path string, name string")
    columns = [*facts.columns, "cast_masked", "position", "purpose"]
    ts, py = O.place_ts(facts.where("lang = 'ts'")), O.place_py(facts.where("lang = 'py'"), sinks)
    want = sorted(map(repr, ts.select(columns).unionByName(py.select(columns)).collect()))
    assert want == sorted(map(repr, O.place(facts, sinks).select(columns).collect())) and len(want) == 220
    for keep in ("tier = 'C'", "tier = 'A'", "true"):
        plan = _plan_without_broadcast(spark, lambda k=keep: O.occurrences(facts, sinks, id_registry(spark, sf)).where(k))
        # The registry and the sinks; and no rule is worked out again for the filter.
        assert plan.count("Join") == 2
        assert plan.count("usage_unverified,null") == 2


def test_lines_of_an_id_are_one_shuffle(spark):
    from tidemark.operators import tiers

    rows = [("r", f"f{n % 3}", f"v{n % 2}", n % 11, "C" if n % 5 else "B") for n in range(120)]
    occ = spark.createDataFrame(rows, "repo string, path string, value string, line long, tier string")
    found = tiers.file_id_lines(occ)
    assert _plan_without_broadcast(spark, lambda: tiers.file_id_lines(occ)).count("Exchange") == 1
    for r in found.collect():
        lines = [x[3] for x in rows if x[:3] == (r.repo, r.path, r.value) and x[4] == "C"]
        first = sorted(set(lines))
        assert (r.hits, r.shown, r.more) == (len(lines), ", ".join(f"L{n}" for n in first[:4]), max(len(first) - 4, 0))
    assert found.count() == 6


def test_a_listing_reads_its_files_from_one_computation(spark, sf):
    from tidemark.operators import tiers
    from tidemark.workload import queries

    assert "l_orderkey" not in _plan(queries.capped_listing(spark, sf))
    occ = spark.createDataFrame([], "repo string, path string, value string, purpose string, tier string")
    assert _plan(tiers.file_rollup(occ)).count("Exchange") == 1


def test_pending_files_are_scanned_once(spark, sf):
    from tidemark.workload import queries

    pending, current = queries._pending(spark, sf)
    assert _plan(pending).count("FileScan") == 1
    plan = _plan(rewrite.write_plan(pending, current))
    assert plan.count("FileScan") == 4  # both sides, planned for the rows and again for the verdict per repository
    assert "unhex" in plan


def test_a_report_is_compressed_in_files_of_bounded_size(spark, tmp_path, monkeypatch):
    from tidemark.sources import store

    monkeypatch.setattr(store, "REPORT_ROWS", 300)
    rows = spark.range(0, 1000, 1, 1).selectExpr("'r' repo", "concat('src/f', id) path", "id line")
    store.write_report({"findings": rows, "counts": rows.limit(3)}, str(tmp_path / "report"))
    files = list((tmp_path / "report" / "section=findings").glob("part-*"))
    assert len(files) == 4 and all(f.name.endswith(".json.gz") for f in files)
    read = spark.read.json(str(tmp_path / "report"), schema="repo string, body string, section string")
    assert read.where("section = 'findings'").select(F.from_json("body", "path string, line long").alias("b")).select("b.*").distinct().count() == 1000


def test_a_report_keeps_only_the_columns_it_reads(spark, sf):
    from tidemark.operators import report
    from tidemark.workload.queries import _occ

    kept = _occ(spark, sf).select(*report.COLUMNS)
    assert {"callee", "enclosure", "cast_type"}.isdisjoint(kept.columns) and len(report.sections(kept)) == 5


def test_sites_are_dealt_before_they_are_made_distinct(spark):
    from tidemark.operators import usage

    used = spark.createDataFrame([("r", "a", f"{p}T.x", "f", 1, n % 2) for n in range(4) for p in ("Api.", "API.", "")], "repo string, api string, path_key string, file string, line int, col int")
    sites = usage.locations(used, "Api")
    assert sorted(r.col for r in sites.collect()) == [0, 1]
    plan = _plan(usage.locations(used, "Api"))
    assert "REPARTITION_BY_NUM" in plan and plan.rindex("HashAggregate") < plan.index("REPARTITION_BY_NUM")


def test_captures_that_come_again_are_not_cleaned_again(spark, tmp_path):
    """With their keys at hand no text is cleaned, and no text is moved whose place has no new document."""
    from tidemark.operators import documents
    from tidemark.sources import store

    rows = [(f"u{k % 9}", f"2025-01-0{1 + k % 4}", f"<p>{k % 5}</p><script>t({k})</script>", 1 + k % 4) for k in range(60)]
    rows += [("w", None, None, 1), (None, "2025-01-01", "n", 2), ("u0", "2025-01-01", "<p>twice</p>", 3)] + rows[:5]
    captured = spark.createDataFrame(rows, "url string, retrieved_at string, text string, v int").repartition(3)
    keys = documents.document_keys(captured)
    assert "text" not in keys.columns and keys.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys.write.parquet(str(tmp_path / "keys"))
    keys = spark.read.parquet(str(tmp_path / "keys"))
    assert keys.count() == len(rows)
    stored = {}
    for name in ("at hand", "not at hand"):
        root, known = str(tmp_path / name), spark.createDataFrame([], store.DOCUMENT)
        for batch, version in enumerate((1, 2, 4, 4)):
            seen = F.col("v") <= version
            store.append_documents(captured.where(seen), known, root, batch, keys.where(seen) if name == "at hand" else None)
            known = store.stored_documents(spark, root)
        stored[name] = sorted(map(str, known.where("doc_key is not null").select("doc_key", "url", "retrieved_at", "body").collect()))
    assert stored["at hand"] == stored["not at hand"] and len(stored["at hand"]) == 7
    empty = spark.createDataFrame([], store.DOCUMENT)
    plan = _plan(documents.new_documents(captured, empty, keys))
    assert "script" not in plan and "script" in _plan(documents.new_documents(captured, empty))
    texts = plan[plan.index("ShuffledHashJoin") :]
    assert texts.index("Exchange hashpartitioning(_c1") < texts.index("Filter ((bit_get(") < texts.index("Subquery subquery")


def test_cleaning_looks_at_ascii_before_other_whitespace(spark):
    """A letter is compared with no range of whitespace beyond ASCII; every kind of whitespace still counts."""
    from tidemark.functions import text

    odd = [chr(c) for c in (9, 10, 11, 12, 13, 32, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)]
    cases = [(f"a{w}nonce{w}={w}'1'{w}{w}b{w}c{w}iNtegrity=\"x{w}y\">", "a b c>") for w in odd]
    cases += [(f"a {chr(c)} b", f"a {chr(c)} b") for c in (0x1C, 0x85, 0x200B)]
    cases += [("a  Nonce='1'> d", "a > d"), (" integrity='", "integrity='"), ("", ""), (None, None)]
    cases += [("a inte nonce='1'grity='2' b", "a b"), ("x<script a='>'>y</SCRIPT >z", "x<script></script>z")]
    df = spark.createDataFrame(cases, "text string, want string")
    got = df.select("text", "want", text.normalize_for_hash(F.col("text")).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]
    # The ranges beyond ASCII stand behind a test for ASCII wherever they occur.
    plan = _plan(df.select(text.normalize_for_hash(F.col("text")).alias("x")))
    assert plan.count(chr(0x3000)) == plan.count("&&[") > 0
