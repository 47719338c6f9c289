"""The whole evidence audit: population, classes, gate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evidence as ev
from ..params import DEFAULTS, Params


def population(
    events: DataFrame, conflicts: DataFrame, imported: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Nights to audit and the registry rows held back.

    Imported and event-derived nights pass the conflict registry; dense note sequences are
    evidence of their own and do not.
    """
    kept, removed = ev.quarantine(ev.strong_nights(events), conflicts)
    sources, held = [kept], [removed]
    if imported is not None:
        kept_imported, removed_imported = ev.quarantine(imported, conflicts)
        sources.insert(0, kept_imported)
        held.insert(0, removed_imported)
    return ev.merge_nights(*sources, ev.dense_nights(events)), ev.merge_quarantine(*held)


def evidence_audit(
    points: DataFrame,
    events: DataFrame,
    history: DataFrame | None,
    conflicts: DataFrame,
    imported: DataFrame | None = None,
    rules: ev.AuditRules = ev.RULES,
    p: Params = DEFAULTS,
) -> DataFrame:
    nights, _ = population(events, conflicts, imported)
    return ev.gpx_gate(ev.night_audit(points, events, history, nights, rules, p), points, p)
