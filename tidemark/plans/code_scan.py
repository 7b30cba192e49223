"""Scan source files for retired identifiers and compute the edits.

The engine's scan takes the active registry only. Queued candidates are inert:
nothing here accepts them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import corpus, extract, occurrences, params, rewrite
from ..session import durable


@dataclass
class Facts:
    literals: DataFrame
    sinks: DataFrame
    options: DataFrame
    constants: DataFrame


def native_facts(files: DataFrame, wanted: Callable[[DataFrame], DataFrame] | None = None) -> Facts:
    """All facts from one reading of every text that is wanted, which is written once."""
    structure = extract.token_structure(files, wanted)
    return Facts(
        extract.literals(structure),
        extract.sink_facts(structure),
        extract.option_objects(structure),
        extract.const_bindings(structure),
    )


def relevant_files(files: DataFrame, registry: DataFrame, marker: str = "scan") -> DataFrame:
    """In scope, not annotated, and containing a registry token."""
    return corpus.prefilter(corpus.scannable(files, marker), corpus.registry_tokens(registry))


def scan(files: DataFrame, registry: DataFrame, marker: str = "scan") -> tuple[DataFrame, Facts]:
    """(tiered occurrences, facts) of a corpus; annotations and tokens are looked for once in each different text."""
    tokens = corpus.registry_tokens(registry)
    facts = native_facts(corpus.in_scope(files), lambda texts: corpus.prefilter(corpus.unannotated(texts, marker), tokens))
    return occurrences.occurrences(facts.literals, facts.sinks, registry), facts


def combined_edits(occ: DataFrame, facts: Facts, registry: DataFrame) -> DataFrame:
    """Identifier swaps, then parameter edits judged on the swapped models."""
    swapped = occurrences.swaps(occ).select("repo", "path", "start", "replacement")
    sites = params.param_sites(facts.options, facts.constants, registry, swapped, first_only=True)
    return rewrite.swap_edits(occ).unionByName(rewrite.param_edits(sites))


def fix(files: DataFrame, registry: DataFrame, marker: str = "scan") -> tuple[DataFrame, DataFrame]:
    """(occurrences, patched files): every edit of a file applied in one pass."""
    occ, facts = scan(files, registry, marker)
    occ = durable(occ, "occurrences")
    edits = combined_edits(occ, facts, registry)
    return occ, rewrite.apply_edits(files.select("repo", "path", "text"), edits)


def edit_counts(edits: DataFrame) -> DataFrame:
    return edits.groupBy("repo", "kind").agg(F.count(F.lit(1)).alias("edits"))
