"""One registered query per operator, each over whole derived tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, runner
from ..functions import text as tx
from ..functions.paths import in_scan_scope
from ..operators import (
    corpus,
    discovery,
    documents,
    extract,
    gates,
    occurrences,
    params,
    promotion,
    report,
    rewrite,
    specdiff,
    tiers,
    usage,
    verdicts,
)
from ..operators import registry as reg
from ..plans import code_scan, spec_impact
from ..session import durable, shared_path
from ..sources import catalogs, store
from ..sources import registry as source
from ..sources.specs import flatten_specs
from ..streaming import jobs
from .fixtures import SQL, fixture, id_registry, options, registry, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PROVIDERS = ("acme", "borealis", "cirrus")
ID_PATTERNS = {"acme": "^acme-", "borealis": "^borealis-", "cirrus": "^cirrus-"}
ROOT = "Api"
AS_OF = "2025-12-20"
RUN_DATE = "2026-02-01T00:00:00Z"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


# --- shared inputs -----------------------------------------------------------


def _live(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.live_forms(catalogs.first_party(fixture(spark, sf, "catalog_raw"), PROVIDERS))


def _official(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.official_table(fixture(spark, sf, "official"))


def _occ(spark: SparkSession, sf: str) -> DataFrame:
    return occurrences.occurrences(
        fixture(spark, sf, "literal_facts"), fixture(spark, sf, "sink_facts"), id_registry(spark, sf)
    )


def _files(spark: SparkSession, sf: str) -> DataFrame:
    return fixture(spark, sf, "source_files")


def _joined(column: str) -> DataFrame:
    return F.array_join(F.col(column), "|").alias(column)


# --- identifiers and catalogs ------------------------------------------------


@query
def canon_ids(spark, sf):
    i = F.col("id")
    return fixture(spark, sf, "catalog_raw").select(
        "id",
        ids.canonical_id(i).alias("canon"),
        ids.family_id(i).alias("family"),
        ids.ids_equal(i, F.lit("Acme/acme.x1")).alias("equals_x1"),
        ids.ids_family_match(i, F.lit("acme-x1-20250101")).alias("family_of_x1"),
        ids.replacement_family(ids.canonical_id(i)).alias("replacement_family"),
    )


@query
def model_class(spark, sf):
    part = table(spark, sf, "part")
    kinds = ["embedding-3", "embed-x", "tts-1", "whisper", "gpt-audio-mini", "dall-e-3", "Omni.Moderation", "latest"]
    named = part.select(
        F.concat(
            F.replace(F.col("p_name"), F.lit(" "), F.lit("/")),
            F.lit("-"),
            F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("p_partkey") % 8 + 1).cast("int")),
        ).alias("id")
    )
    every = named.unionByName(fixture(spark, sf, "registry_ids").select(F.col("replacement").alias("id")))
    cls = ids.model_class(F.col("id"))
    return every.select("id", cls.alias("class"), ids.catalog_verifiable(cls).alias("verifiable"))


@query
def live_forms(spark, sf):
    return _live(spark, sf)


@query
def catalog_payloads(spark, sf):
    """Ids flattened out of both catalog payload shapes."""
    part = table(spark, sf, "part")
    rows = part.select(
        F.to_json(
            F.struct(F.array(F.struct(F.concat(F.lit("~acme/"), "p_brand", F.lit(":free")).alias("id")),
                             F.struct(F.concat(F.lit("host/"), "p_brand").alias("id")),
                             F.struct(F.col("p_type").alias("id"))).alias("data"))
        ).alias("payload")
    )
    maps = part.select(
        F.to_json(F.create_map(
            F.when(F.col("p_partkey") % 2 == 0, F.lit("borealis")).otherwise(F.lit("other")),
            F.struct(F.create_map(F.lower("p_type"), F.struct(F.col("p_size").alias("n"))).alias("models")),
        )).alias("payload")
    )
    one = catalogs.first_party(catalogs.aggregator_ids(rows), PROVIDERS).withColumn("source", F.lit("aggregator"))
    two = catalogs.provider_map_ids(maps, providers=PROVIDERS).withColumn("source", F.lit("provider_map"))
    return one.unionByName(two).groupBy("source", "id").agg(F.count(F.lit(1)).alias("n"))


# --- registry ----------------------------------------------------------------


@query
def registry_rejects(spark, sf):
    _, rejects = reg.split_valid(reg.check_records(fixture(spark, sf, "registry_raw")))
    return rejects.select("ord", _joined("problems"))


@query
def registry_files(spark, sf):
    """A registry kept in many files of up to 1,000 records, read back in the order of files and records."""
    raw = fixture(spark, sf, "registry_raw").withColumn("_file", F.floor(F.col("ord") / 1000))
    arrays = raw.groupBy("_file").agg(F.array_sort(F.collect_list(F.struct("ord", "record"))).alias("_r"))
    folder = shared_path(spark, "registry_files")
    name = F.format_string("%012d", "_file")
    arrays.select(
        F.concat(F.lit("["), F.array_join("_r.record", ","), F.lit("]")).alias("value"), name.alias("part")
    ).write.partitionBy("part").text(folder)
    records, rejects = source.load_registry(spark, f"{folder}/part=*")
    place = [
        F.shiftright("ord", source.FILE_SHIFT).alias("file"),
        F.col("ord").bitwiseAND(F.lit((1 << source.FILE_SHIFT) - 1)).alias("pos"),
    ]
    kept = records.select(*place, "kind", "deprecated", F.lit("").alias("problems"))
    nothing = F.lit(None).cast("string")
    return kept.unionByName(
        rejects.select(*place, nothing.alias("kind"), nothing.alias("deprecated"), _joined("problems"))
    )


@query
def registry_violations(spark, sf):
    return reg.violations(id_registry(spark, sf))


@query
def violation_tally(spark, sf):
    return reg.violation_tally(reg.violations(id_registry(spark, sf)))


@query
def registry_state(spark, sf):
    return reg.state(registry(spark, sf)).select("ord", "deprecated", "auto_apply", "state", _joined("withheld"))


@query
def registry_provenance(spark, sf):
    return reg.provenance(registry(spark, sf), AS_OF)


@query
def registry_lookup(spark, sf):
    return reg.find_records(registry(spark, sf), fixture(spark, sf, "lookup_terms"))


@query
def registry_first_declared(spark, sf):
    return reg.first_declared(registry(spark, sf)).select("deprecated", "ord", "replacement")


# --- verdicts ----------------------------------------------------------------


@query
def replacement_verdict(spark, sf):
    out = verdicts.classify(id_registry(spark, sf), _live(spark, sf), _official(spark, sf))
    return out.select("ord", "deprecated", "verdict", _joined("verdict_reasons"))


@query
def replacement_chain(spark, sf):
    return verdicts.chain_ends(_official(spark, sf))


@query
def restamp(spark, sf):
    out = verdicts.restamp(id_registry(spark, sf), _live(spark, sf), _official(spark, sf), AS_OF, ["catalog"])
    return out.select(
        "ord", "entry_id", "v_status", "v_official", "v_replacement", "v_auto", "quarantine_reason",
        "checked_at", _joined("reasons"),
    )


@query
def restamp_audit(spark, sf):
    return verdicts.audit(
        verdicts.restamp(id_registry(spark, sf), _live(spark, sf), _official(spark, sf), AS_OF, ["catalog"])
    )


@query
def candidate_stamps(spark, sf):
    out = verdicts.stamp_candidates(fixture(spark, sf, "candidates"), _live(spark, sf), _official(spark, sf), AS_OF)
    return out.select("candidate_id", "v_status", "v_official", "v_replacement", "v_auto")


# --- claims and promotion ----------------------------------------------------


@query
def claim_check(spark, sf):
    out = promotion.claim_reasons(
        fixture(spark, sf, "candidates"), fixture(spark, sf, "evidence_refs"),
        fixture(spark, sf, "stored_docs"), _live(spark, sf),
    )
    return out.select("candidate_id", "unbacked", _joined("claim_reasons"))


@query
def unbacked_evidence(spark, sf):
    return promotion.unbacked_refs(
        fixture(spark, sf, "evidence_refs"), fixture(spark, sf, "stored_docs")
    ).select("candidate_id", "content_hash")


def _decisions(spark, sf):
    return promotion.decide(
        fixture(spark, sf, "requests"), fixture(spark, sf, "candidates"), id_registry(spark, sf),
        fixture(spark, sf, "evidence_refs"), fixture(spark, sf, "stored_docs"), _live(spark, sf), _official(spark, sf),
    )


@query
def promote(spark, sf):
    return _decisions(spark, sf).select("pos", "candidate_id", "decision")


def _next_state(spark, sf):
    decided = code_scan.durable(_decisions(spark, sf), "decisions")
    return promotion.transition(
        decided, fixture(spark, sf, "candidates"), id_registry(spark, sf), _live(spark, sf), _official(spark, sf),
        AS_OF, ["catalog"],
    )


@query
def versioned_state(spark, sf):
    """What readers see before, after a transition that failed half way, and after its repetition."""
    root = shared_path(spark, "state")
    rows = []

    def look(moment):
        records, queue = source.read_transition(spark, root)
        one = records.select(F.lit("registry").alias("state"), F.col("entry_id").alias("id"))
        two = queue.select(F.lit("queue").alias("state"), F.col("candidate_id").alias("id"))
        rows.append(one.unionByName(two).withColumn("moment", F.lit(moment)))

    source.save_transition(id_registry(spark, sf), fixture(spark, sf, "candidates"), root, 1)
    next_registry, next_queue = _next_state(spark, sf)
    broken = next_queue.withColumn("provider", F.raise_error(F.lit("the disk is full")).cast("string"))
    try:
        source.save_transition(next_registry, broken, root, 2)
    except PySparkException as error:
        if "the disk is full" not in str(error):
            raise
    look("failed")
    source.save_transition(next_registry, next_queue, root, 2)
    look("repeated")
    return rows[0].unionByName(rows[1])


@query
def promote_transition(spark, sf):
    """Size and content of the next registry and queue."""
    next_registry, next_queue = _next_state(spark, sf)
    one = next_registry.select(F.lit("registry").alias("state"), F.col("entry_id").alias("id"), "v_status", "v_auto")
    two = next_queue.select(
        F.lit("queue").alias("state"), F.col("candidate_id").alias("id"),
        F.lit(None).cast("string").alias("v_status"), F.lit(None).cast("boolean").alias("v_auto"),
    )
    return one.unionByName(two)


# --- discovery and documents -------------------------------------------------


@query
def discover_rows(spark, sf):
    rows = discovery.readable_rows(fixture(spark, sf, "provider_pages"), ID_PATTERNS)
    return rows.select("page_id", "table_no", "row_no", "deprecated", "replacement", "shutdown_date", "row_text")


@query
def discover_skips(spark, sf):
    rows = discovery.skipped_rows(fixture(spark, sf, "provider_pages"), ID_PATTERNS)
    return rows.select("page_id", "table_no", "row_no", "skip", "row_text")


@query
def discover_new(spark, sf):
    out = discovery.discover(
        fixture(spark, sf, "provider_pages"), fixture(spark, sf, "discovery_registry"),
        fixture(spark, sf, "discovery_queue"), RUN_DATE, ID_PATTERNS,
    )
    return out.select("candidate_id", "deprecated", "replacement", "status", "shutdown_date", "source_url", "excerpt")


@query
def discover_summary(spark, sf):
    pages = fixture(spark, sf, "provider_pages")
    fresh = discovery.discover(
        pages, fixture(spark, sf, "discovery_registry"), fixture(spark, sf, "discovery_queue"), RUN_DATE, ID_PATTERNS
    )
    return discovery.page_summary(pages, fresh, ID_PATTERNS)


@query
def shutdown_dates(spark, sf):
    orders = table(spark, sf, "orders")
    day = F.col("o_orderdate").cast("timestamp")
    cell = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format(day, "MMM d, yyyy"))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("after "), F.date_format(day, "MMMM dd,yyyy")))
        .when(F.col("o_orderkey") % 4 == 2, F.replace(F.date_format(day, "yyyy-MM-dd"), F.lit("-"), F.lit("\u2011")))
        .otherwise(F.col("o_orderpriority"))
    )
    cells = orders.select("o_orderkey", cell.alias("cell"))
    found = dates.shutdown_date(F.col("cell"))
    return cells.select(
        "o_orderkey", found.alias("shutdown_date"), dates.lifecycle_on(found, "1996-01-01").alias("lifecycle")
    )


@query
def doc_hash(spark, sf):
    hashed = documents.hashed(fixture(spark, sf, "captures"))
    return hashed.select("url", "retrieved_at", "content_hash", "doc_key", tx.clamp_excerpt(F.col("text")).alias("excerpt"))


@query
def doc_drift(spark, sf):
    return documents.drift(fixture(spark, sf, "captures"))


@query
def doc_sessions(spark, sf):
    return documents.drift_sessions(documents.drift(fixture(spark, sf, "captures")))


@query
def doc_stale(spark, sf):
    refs = fixture(spark, sf, "evidence_refs").select("candidate_id", "content_hash", "retrieved_at")
    return documents.stale(refs, 90, "2025-07-01")


def _cited(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    flat = F.col("flat")
    size = F.length(flat)
    at = lambda share, n: F.substring(flat, (size * share).cast("int") + 1, F.lit(n))
    quotes = docs.select("doc_id", tx.collapse_ws(F.col("text")).alias("flat")).select(
        "doc_id",
        F.explode(F.array(at(0.1, 60), at(0.62, 80), at(0.66, 40), F.concat(F.lit("zzzz | "), at(0.9, 30)))).alias("excerpt"),
    )
    return docs, quotes


@query
def doc_windows(spark, sf):
    docs, quotes = _cited(spark, sf)
    return documents.excerpt_windows(docs, quotes, "doc_id", max_bytes=4096, window_bytes=512, reserve=64)


@query
def doc_snapshots(spark, sf):
    docs, quotes = _cited(spark, sf)
    body = documents.snapshot_bodies(docs, quotes, "doc_id", max_bytes=4096, window_bytes=512)
    return body.select("doc_id", F.octet_length("body").alias("bytes"), F.sha2("body", 256).alias("digest"))


@query
def doc_store(spark, sf):
    """Append growing sets of captures to a document store; each hash is stored once."""
    # One page in 101 is a book: its text passes a mebibyte. How often the filler stands in it is read from the
    # row; as a constant it would be a mebibyte in every plan that the driver keeps.
    book = F.col("page_id") % 101 == 0
    filler = F.repeat(F.lit("0123456789abcde "), F.when(book, 70000))
    captured = fixture(spark, sf, "captures").withColumn("text", F.when(book, F.concat("text", filler)).otherwise(F.col("text")))
    root = shared_path(spark, "store")
    known = spark.createDataFrame([], store.DOCUMENT)
    keys = durable(documents.document_keys(captured), "keys")
    for batch, version in enumerate((1, 2, 4, 4)):
        seen = F.col("v") <= version
        store.append_documents(captured.where(seen), known, root, batch, keys.where(seen))
        known = store.stored_documents(spark, root)
    return known.select("doc_key", "url", "retrieved_at", F.length("body").cast("bigint").alias("chars"))


# --- specs and usage ---------------------------------------------------------


@query
def spec_properties(spark, sf):
    return flatten_specs(fixture(spark, sf, "spec_docs")).select(
        "api", "version", "parent", "name", "depth", "type", specdiff.enum_label(F.col("enum")).alias("enum"), "is_object"
    )


@query
def spec_diff(spark, sf):
    return specdiff.spec_diff(fixture(spark, sf, "spec_docs")).select("api", "kind", "path", "from", "to")


@query
def change_order(spark, sf):
    """The changes of a report in their order: by kind, then api and path."""
    changes = specdiff.spec_diff(fixture(spark, sf, "spec_docs"))
    return specdiff.ordered(changes).select("kind_rank", "kind", "api", "path")


@query
def spec_change_counts(spark, sf):
    return specdiff.change_counts(specdiff.spec_diff(fixture(spark, sf, "spec_docs")))


@query
def usage_summary(spark, sf):
    return usage.summary(fixture(spark, sf, "usage"))


@query
def usage_prefixes(spark, sf):
    chains = fixture(spark, sf, "usage").withColumnRenamed("path_key", "chain")
    return usage.summary(usage.accesses(chains))


@query
def affected_sites(spark, sf):
    changes = specdiff.spec_diff(fixture(spark, sf, "spec_docs"))
    return usage.affected_sites(changes, fixture(spark, sf, "usage"), ROOT)


@query
def unused_changes(spark, sf):
    changes = specdiff.spec_diff(fixture(spark, sf, "spec_docs"))
    return usage.unused_changes(changes, fixture(spark, sf, "usage"), ROOT).select("api", "kind", "path")


@query
def spec_usage_impact(spark, sf):
    return spec_impact.spec_impact(fixture(spark, sf, "spec_docs"), fixture(spark, sf, "usage"), ROOT)


@query
def rename_targets(spark, sf):
    changes = specdiff.spec_diff(fixture(spark, sf, "spec_docs"))
    return usage.rename_targets(changes, fixture(spark, sf, "usage"), ROOT)


# --- occurrences and tiers ---------------------------------------------------


@query
def occ_match(spark, sf):
    out = occurrences.match_registry(fixture(spark, sf, "literal_facts"), id_registry(spark, sf))
    return out.groupBy("repo", "value", "record_ord", "entry_id", "state").agg(F.count(F.lit(1)).alias("n"))


def _facts_of(spark, sf, lang):
    return fixture(spark, sf, "literal_facts").where(F.col("lang") == lang)


@query
def occ_position_ts(spark, sf):
    out = occurrences.place_ts(_facts_of(spark, sf, "ts"))
    keys = ["enclosure", "encl_name", "in_call", "callee", "cast_type", "position", "purpose", "cast_masked"]
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query
def occ_position_py(spark, sf):
    out = occurrences.place_py(_facts_of(spark, sf, "py"), fixture(spark, sf, "sink_facts"))
    keys = ["repo", "enclosure", "encl_name", "in_call", "callee", "position", "purpose"]
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


@query
def finding_keys(spark, sf):
    """The key of every finding, and how many findings share it."""
    key = ids.finding_key(F.col("path"), F.col("line"), F.col("col"), F.col("value")).alias("key")
    return _occ(spark, sf).groupBy(key).agg(F.count(F.lit(1)).alias("findings"))


@query
def occ_tiers(spark, sf):
    return _occ(spark, sf).select(
        "repo", "path", "lang", "line", "col", "value", "position", "purpose", "tier", "reason", "verdict"
    )


@query
def occ_views(spark, sf):
    return occurrences.view(_occ(spark, sf)).groupBy("lang", "view", "tier").agg(F.count(F.lit(1)).alias("n"))


@query
def occ_swaps(spark, sf):
    return occurrences.swaps(_occ(spark, sf)).select("repo", "path", "line", "col", "value", "replacement")


@query
def tier_rollup(spark, sf):
    return tiers.rollup(_occ(spark, sf))


@query
def tier_gate(spark, sf):
    return tiers.tier_gate(_occ(spark, sf), "A")


@query
def tier_unique(spark, sf):
    return tiers.unique_occurrences(_occ(spark, sf))


@query
def tier_collisions(spark, sf):
    return tiers.collisions(_occ(spark, sf))


@query
def terminal_tier(spark, sf):
    return tiers.terminal_tier(_occ(spark, sf))


@query
def multi_tier_notes(spark, sf):
    return tiers.multi_tier_notes(_occ(spark, sf))


@query
def review_top(spark, sf):
    return tiers.review_top(_occ(spark, sf))


@query
def review_findings(spark, sf):
    return tiers.review_findings(_occ(spark, sf)).select("repo", "path", "line", "col", "value", "reason", "verdict")


@query
def file_rollup(spark, sf):
    return tiers.file_rollup(_occ(spark, sf))


@query
def file_id_lines(spark, sf):
    return tiers.file_id_lines(_occ(spark, sf))


@query
def swap_labels(spark, sf):
    return tiers.swap_labels(_occ(spark, sf))


@query
def mixed_family(spark, sf):
    return tiers.mixed_families(_occ(spark, sf))


@query
def patch_evidence(spark, sf):
    return tiers.patch_evidence(_occ(spark, sf))


# --- parameters and rewriting ------------------------------------------------


@query
def param_sites(spark, sf):
    out = params.param_sites(options(spark, sf), fixture(spark, sf, "const_bindings"), registry(spark, sf))
    return out.select("repo", "path", "obj_id", "model", "param", "kind", "new_name", "entry_ord")


@query
def family_matches(spark, sf):
    models = fixture(spark, sf, "option_objects").where("key = 'model' and value_literal is not null").select(
        F.col("value_literal").alias("model")
    ).distinct()
    families = registry(spark, sf).where(F.col("on_models").isNotNull()).select(F.explode("on_models").alias("family")).distinct()
    return params.family_match(models, families, "model", "family")


def _fixed(spark, sf):
    return code_scan.fix(_files(spark, sf), registry(spark, sf))


@query
def scan_occurrences(spark, sf):
    occ, _ = code_scan.scan(_files(spark, sf), registry(spark, sf))
    return occ.select("repo", "path", "line", "col", "value", "enclosure", "tier", "reason")


@query
def patched_files(spark, sf):
    occ, _ = code_scan.scan(_files(spark, sf), registry(spark, sf))
    patched = rewrite.apply_edits(_files(spark, sf), rewrite.swap_edits(occ))
    return patched.select("repo", "path", "edits", "new_text")


@query
def changed_lines(spark, sf):
    occ, _ = code_scan.scan(_files(spark, sf), registry(spark, sf))
    return rewrite.changed_lines(rewrite.apply_edits(_files(spark, sf), rewrite.swap_edits(occ)))


@query
def edit_order(spark, sf):
    occ, _ = code_scan.scan(_files(spark, sf), registry(spark, sf))
    return rewrite.edit_order(rewrite.swap_edits(occ))


@query
def edit_choice(spark, sf):
    """Which of many overlapping edits are applied, and why the others are not."""
    edits = fixture(spark, sf, "edits").withColumnsRenamed({"pos": "start", "upto": "end"}).withColumn("kind", F.lit("k"))
    return rewrite.choose(edits).select(
        "repo", "path", F.col("start").alias("pos"), F.col("end").alias("upto"), "new_text", "ord",
        F.coalesce("dropped", F.lit("applied")).alias("outcome"),
    )


@query
def combined_fix(spark, sf):
    _, patched = _fixed(spark, sf)
    return rewrite.changed_lines(patched)


@query
def fix_summary(spark, sf):
    _, patched = _fixed(spark, sf)
    return rewrite.change_summary(patched)


@query
def rename_fix(spark, sf):
    """Rename edits of a spec diff applied to sources that use the old names."""
    part = table(spark, sf, "part")
    prefix = F.concat(F.lit("const v = S"), F.col("p_partkey"), F.lit(".card."))
    files = part.select(
        F.concat(F.lit("r"), F.col("p_partkey") % 10).alias("repo"),
        F.concat(F.lit("src/u"), F.col("p_partkey"), F.lit(".ts")).alias("path"),
        F.concat(prefix, F.lit("name;\nlog(v.name);\n")).alias("text"),
        F.length(prefix).cast("bigint").alias("start"),
        F.concat(F.lit("S"), F.col("p_partkey"), F.lit(".card.name")).alias("path_key"),
        F.concat(F.lit("api"), F.col("p_partkey") % 5).alias("api"),
    )
    changes = specdiff.spec_diff(fixture(spark, sf, "spec_docs"))
    used = files.select("repo", F.col("path").alias("file"), F.lit(1).alias("line"), "start", "api", "path_key", F.col("start").alias("col"))
    hits = usage.rename_targets(changes, used, ROOT)
    edits = rewrite.rename_edits(
        hits.select("repo", F.col("file").alias("path"), F.col("col").alias("start"),
                    (F.col("col") + F.length("from")).alias("end"), "to")
    )
    return rewrite.apply_edits(files, edits).select("repo", "path", "new_text")


def _pending(spark, sf):
    files = _files(spark, sf).where(in_scan_scope(F.col("path")))
    number = F.regexp_extract("path", r"f(\d+)", 1).cast("bigint")
    # One file in 4,001 is listed twice.
    listed = F.array_repeat(F.lit(True), F.when(number % 4001 == 0, 2).otherwise(1))
    pending = files.select("repo", "path", "text", F.explode(listed).alias("_")).drop("_")
    current = files.where(number % 5003 != 1).select(
        "repo", "path",
        F.when(number % 2003 == 2, F.concat("text", F.lit("\n"))).when(number % 3 == 0, F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text")).alias("text"),
    )
    return pending, current


@query
def write_plan(spark, sf):
    pending, current = _pending(spark, sf)
    return rewrite.write_plan(pending, current)


@query
def write_disposition(spark, sf):
    pending, current = _pending(spark, sf)
    plan = code_scan.durable(rewrite.write_plan(pending, current), "plan")
    occ = _occ(spark, sf).where(F.col("tier") == "A")
    held = fixture(spark, sf, "gate_config").where(F.col("config").isNull()).select("repo")
    return rewrite.disposition(occ, plan, held, write=True)


# --- corpus ------------------------------------------------------------------


@query
def coverage(spark, sf):
    return corpus.coverage(_files(spark, sf), registry(spark, sf))


@query
def uncovered(spark, sf):
    files = _files(spark, sf)
    number = F.regexp_extract("path", r"f(\d+)", 1).cast("bigint")
    loaded = files.where(number % 10 != 3).select("repo", F.upper(F.replace(F.col("path"), F.lit("/"), F.lit("\\"))).alias("path"))
    return corpus.uncovered(files, loaded)


@query
def annotated_files(spark, sf):
    return corpus.annotated_files(_files(spark, sf), registry(spark, sf))


@query
def catalog_ids(spark, sf):
    return corpus.quoted_ids(_files(spark, sf), registry(spark, sf))


@query
def prefilter(spark, sf):
    return corpus.prefilter(corpus.in_scope(_files(spark, sf)), corpus.registry_tokens(registry(spark, sf))).select("repo", "path")


# --- extraction --------------------------------------------------------------


@query
def extract_native(spark, sf):
    structure = extract.token_structure(corpus.in_scope(_files(spark, sf)))
    return extract.literals(structure).select(
        "repo", "path", "lang", "line", "col", "value", "enclosure", "encl_name", "in_call", "callee"
    )


@query
def extract_options(spark, sf):
    structure = extract.token_structure(corpus.in_scope(_files(spark, sf)))
    return extract.option_objects(structure).select("repo", "path", "key", "key_kind", "value_literal", "prop_start", "prop_end")


@query
def extract_sinks(spark, sf):
    return extract.sink_facts(extract.token_structure(corpus.in_scope(_files(spark, sf))))


@query
def extract_ast(spark, sf):
    facts = extract.python_facts(corpus.in_scope(_files(spark, sf)))
    return extract.python_literals(facts).select("repo", "path", "line", "col", "value", "enclosure", "encl_name")


@query
def scan_function(spark, sf):
    """The SQL table function over Python sources that hold a registry token."""
    extract.register_scan_function(spark)
    files = code_scan.relevant_files(_files(spark, sf), registry(spark, sf)).where(F.col("lang") == "py")
    return spark.sql(
        "select f.repo, f.path, s.line, s.value, s.enclosure from {files} f, lateral scan_literals(f.text) s",
        files=files,
    )


# --- gates -------------------------------------------------------------------


def _policy(spark, sf):
    return gates.policies(fixture(spark, sf, "gate_config"))


@query
def gate_policy(spark, sf):
    return _policy(spark, sf)


@query
def gate_blocks(spark, sf):
    return gates.blocks(fixture(spark, sf, "gate_outcomes"), _policy(spark, sf))


@query
def gate_first_block(spark, sf):
    return gates.first_block(fixture(spark, sf, "gate_outcomes"), _policy(spark, sf))


@query
def gate_tier(spark, sf):
    return gates.gate_tiers(fixture(spark, sf, "gate_outcomes"), _policy(spark, sf))


@query
def gate_downgrade(spark, sf):
    held = gates.gate_tiers(fixture(spark, sf, "gate_outcomes"), _policy(spark, sf))
    out = gates.downgrade(_occ(spark, sf), held)
    return out.groupBy("repo", "lang", "applied_tier").agg(F.count(F.lit(1)).alias("n"))


@query
def diagnostics_new(spark, sf):
    return gates.new_diagnostics(fixture(spark, sf, "diagnostics"))


@query
def diagnostics_verdict(spark, sf):
    return gates.diagnostics_verdict(fixture(spark, sf, "diagnostics"))


@query
def syntax_gate(spark, sf):
    """Python files that no longer parse after a (deliberately broken) rewrite."""
    files = corpus.in_scope(_files(spark, sf)).where(F.col("lang") == "py")
    number = F.regexp_extract("path", r"f(\d+)", 1).cast("bigint")
    patched = files.withColumn("text", F.when(number % 9 == 0, F.concat("text", F.lit("x = (\n"))).otherwise(F.col("text")))
    both = extract.syntax_errors(files, "baseline").unionByName(extract.syntax_errors(patched, "patched"))
    return rewrite.syntax_gate(both)


@query
def test_counts(spark, sf):
    log = F.col("log")
    return fixture(spark, sf, "run_logs").select(
        "event_id", runner.passed_count(log).alias("passed"), runner.failed_count(log).alias("failed")
    )


@query
def clipped_logs(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", tx.clip_log(F.col("text"), 400).alias("log"))


# --- report ------------------------------------------------------------------


@query
def report_doc(spark, sf):
    occ = code_scan.durable(_occ(spark, sf).select(*report.COLUMNS), "occurrences")
    root = shared_path(spark, "report")
    store.write_report(report.sections(occ), root)
    return spark.read.json(root, schema="repo string, body string, section string")


@query
def capped_listing(spark, sf):
    # Written once: the listing and its totals both start from it.
    per_file = code_scan.durable(tiers.file_rollup(_occ(spark, sf)).select("repo", "path", "hits"), "files")
    return tiers.capped(per_file, ["repo"], [F.col("hits").desc(), F.col("path")], 10)


# --- streaming ---------------------------------------------------------------


def _arriving(spark, sf, name, by):
    """A table as three files that arrive one by one, in no order of time."""
    folder = shared_path(spark, f"arriving_{name}")
    table(spark, sf, name).repartitionByRange(3, by).write.parquet(f"{folder}/{name}.parquet")
    return jobs.file_stream(spark, folder, name, 1)


@query
def stream_discover(spark, sf):
    # The page stream is the customer table, read as it arrives.
    pages = spark.sql(SQL["provider_pages"], customer=_arriving(spark, sf, "customer", "c_custkey"))
    known = [lambda n=n: fixture(spark, sf, f"discovery_{n}") for n in ("registry", "queue")]
    out = jobs.discovery_log(pages, *known, RUN_DATE, shared_path(spark, "discover"), ID_PATTERNS)
    return out.select("canon")


@query
def stream_drift(spark, sf):
    captures = spark.sql(SQL["captures"], pages=_arriving(spark, sf, "pages", F.xxhash64("page_id")))
    out = jobs.drift_monitor(captures, shared_path(spark, "drift"))
    return out.select("url", "retrieved_at", "content_hash", "previous_hash")


@query
def stream_scan(spark, sf):
    stream = jobs.file_stream(spark, sf, "orders")
    files = spark.sql(SQL["source_files"], orders=stream)
    out = jobs.continuous_scan(files, registry(spark, sf), shared_path(spark, "scan"))
    return out.select("repo", "path", "line", "col", "value", "tier", "reason")


def _windows(spark, sf, label, aggregate):
    """All windows of the feed: the stream's own and those open at its end."""
    folder = shared_path(spark, label)
    feed = spark.sql(SQL["finding_feed"], events=jobs.file_stream(spark, sf, "events"))
    run = jobs.run_append(aggregate(feed), folder)
    emitted = spark.read.parquet(f"{folder}/out")
    return jobs.with_open_windows(emitted, run, aggregate(fixture(spark, sf, "finding_feed")))


@query
def stream_rates(spark, sf):
    return _windows(spark, sf, "rates", jobs.rate_windows)


@query
def stream_sliding(spark, sf):
    return _windows(spark, sf, "sliding", lambda feed: jobs.rate_windows(feed, "2 hours", "30 minutes"))


@query
def stream_sessions(spark, sf):
    return _windows(spark, sf, "sessions", jobs.rate_sessions)
