"""What the experiment fixes: representations, question types, axes, thresholds. Small tables that joins broadcast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

@dataclass(frozen=True)
class Axis:
    """One reading of a comparison. family: readings of one axis share a heading; secondary: a reading outside the axes."""

    id: str
    label: str
    host: str
    ladder: tuple[str, ...]
    probes: tuple[str, ...]
    headline: tuple[str, str] | None = None
    note: str = ""  # a terminology test that caps consistent verdicts
    note_reps: tuple[str, ...] = ()
    note_kind: str = ""
    family: str = ""
    secondary: bool = False

    @property
    def heading(self) -> str:
        return self.family or (FURTHER if self.secondary else self.label)


# ---- Fixed values -----------------------------------------------------------------
NON_SPATIAL_ANCHOR = "inventory"
FULL_RECORD_ANCHOR = "json_mini"
CANDIDATE = "synthesis"
NOT_EVALUATED = ["prose", "synthesis", "metric_relations"]

MIN_OBSERVATIONS = 6
MIN_COVERAGE = 0.80
PRACTICAL_MARGIN = 0.10
MIN_SCENES_SHOWING = 2
MIN_SCENES_A_HOST = 3

CONSISTENT = "consistent advantage"
DIRECTIONAL = "directional"
MIXED = "mixed"
NO_SEPARATION = "no practically meaningful separation"
NOT_LICENSED = "not licensed"
VERDICT_ORDER = [CONSISTENT, DIRECTIONAL, MIXED, NO_SEPARATION, NOT_LICENSED]

PRESERVED = "ordering preserved"
REVERSED = "REVERSED"
LEANS_SAME = "below margin there, leans same way"
LEANS_OPPOSITE = "below margin there, leans opposite way"
ONLY_THERE = "no separation here, separates there"
NULL_BOTH = "no separation in either"

FURTHER = "Further readings"
CONTEXT_EXCEEDED = "CONTEXT_EXCEEDED"
STYLES = ["natural", "constructed"]
HOSTS = ["procthor", "3rscan", "gibson"]

CAPABILITIES = ["inventory", "connectivity", "metric", "metric_edges", "object_relations_raw", "object_relations_support", "object_relations_derived"]

#: Representation -> what it tells.
REP_CAPS = {
    "inventory": ["inventory"],
    "topology_inventory": ["inventory", "connectivity"],
    "topology": ["connectivity"],
    "graph_digest": ["connectivity"],
    "room_tree": ["connectivity"],
    "topology_metric": ["connectivity", "metric_edges"],
    "narrative": ["inventory", "connectivity"],
    "prose": ["inventory", "connectivity", "object_relations_raw", "object_relations_support", "object_relations_derived"],
    "metric_relations": ["inventory", "metric", "metric_edges"],
    "navigation": ["connectivity", "metric_edges"],
    "metric_framing": ["metric_edges"],
    "relations_flat": ["object_relations_raw", "object_relations_support", "object_relations_derived"],
    "relations_subject": ["object_relations_raw", "object_relations_support", "object_relations_derived"],
    "relations_predicate": ["object_relations_raw", "object_relations_support", "object_relations_derived"],
    "relations_tree": ["object_relations_support"],
    "relations_digest": ["object_relations_derived"],
    "json_mini": CAPABILITIES,
    "json_pretty": CAPABILITIES,
    "synthesis": CAPABILITIES,
}

#: (question type, host or None for every host, alternative, what it needs)
TYPE_NEEDS = [
    ("connectivity", None, 0, ["connectivity"]),
    ("proximity", None, 0, ["metric"]),
    ("direction", None, 0, ["metric_edges"]),
    ("route", None, 0, ["connectivity", "metric_edges"]),
    ("object_relation", None, 0, ["object_relations_raw"]),
    ("relation_structure", None, 0, ["object_relations_support"]),
    ("relation_structure", None, 1, ["object_relations_derived"]),
    ("relation_aggregate", None, 0, ["object_relations_derived"]),
    ("containment", None, 0, ["inventory"]),
    ("aggregation", None, 0, ["inventory"]),
    ("set_logic", None, 0, ["inventory"]),
    ("planning", "procthor", 0, ["inventory"]),
    ("planning", "gibson", 0, ["inventory"]),
    ("planning", "3rscan", 0, ["object_relations_raw"]),
]


AXES = [
    Axis("format", "Formatting", "procthor", ("topology_inventory", "narrative"), ("connectivity",), ("topology_inventory", "narrative")),
    Axis("json_formatting", "Formatting (JSON)", "procthor", ("json_pretty",), ("connectivity", "direction", "route", "aggregation", "set_logic", "containment"), family="Formatting"),
    Axis("json_formatting_gibson", "Formatting (JSON, Gibson)", "gibson", ("json_pretty",), ("aggregation", "set_logic", "direction", "containment"), family="Formatting"),
    Axis("structure", "Graph-structure representation", "procthor", ("topology", "room_tree", "graph_digest"), ("connectivity",), ("topology", "graph_digest"),
         "vocabulary mirrors graph_digest's computed output; see re-cut analyses", ("graph_digest",), "vocabulary"),
    Axis("relation_linearization", "Relation organization and abstraction", "3rscan", ("relations_flat", "relations_subject", "relations_predicate", "relations_tree", "relations_digest"),
         ("object_relation", "relation_structure", "relation_aggregate"), ("relations_subject", "relations_predicate"),
         "vocabulary mirrors relations_digest's output; see re-cut analyses", ("relations_digest",), "vocabulary"),
    Axis("framing", "Relational vs. navigational framing", "procthor", ("topology_metric", "navigation"), ("route", "direction", "connectivity"), ("topology_metric", "navigation")),
    Axis("framing_gibson", "Relational vs. navigational framing (Gibson)", "gibson", ("metric_framing", "navigation"), ("direction",), ("metric_framing", "navigation"), family="Relational vs. navigational framing"),
]

#: Planning comparisons that reuse an axis: (host, a, b, axis).
PLANNING_PAIRS = [
    ("procthor", "topology_inventory", "narrative", "format"),
    ("3rscan", "relations_subject", "relations_predicate", "relation_linearization"),
    ("3rscan", "relations_flat", "relations_subject", "relation_linearization"),
    ("3rscan", "relations_flat", "relations_predicate", "relation_linearization"),
]

#: Of planning, the comparison of json_pretty with the full record is one of these axes.
JSON_AXES = {"procthor": "json_formatting", "gibson": "json_formatting_gibson"}
# -----------------------------------------------------------------------------------


def role(rep: str) -> str:
    return {NON_SPATIAL_ANCHOR: "non_spatial_anchor", FULL_RECORD_ANCHOR: "full_record_anchor", CANDIDATE: "candidate"}.get(rep, "pole")


def rep_caps(spark: SparkSession, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(rep, caps array); rows can be added for representations of one's own."""
    return spark.createDataFrame([(r, c) for r, c in {**REP_CAPS, **(extra or {})}.items()], "rep string, caps array<string>")


def type_needs(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """(qt, need_host, alt, needs array): within a row all are needed, between alternatives one row is enough."""
    return spark.createDataFrame([(q, h, a, n) for q, h, a, n in [*TYPE_NEEDS, *(extra or [])]], "qt string, need_host string, alt int, needs array<string>")


def axis_rungs(spark: SparkSession, axes: list[Axis] | None = None) -> DataFrame:
    """(axis_id, host, qt, rung, rep): ladders by probe type, the anchors left out."""
    rows = [(a.id, a.host, qt, i, r) for a in axes or AXES for qt in a.probes for i, r in enumerate(a.ladder) if r not in (NON_SPATIAL_ANCHOR, FULL_RECORD_ANCHOR)]
    return spark.createDataFrame(rows, "axis_id string, host string, qt string, rung int, rep string")


def axis_heads(spark: SparkSession, axes: list[Axis] | None = None) -> DataFrame:
    """(axis_id, host, qt, rep_a, rep_b): headline pairs by probe type."""
    rows = [(a.id, a.host, qt, *a.headline) for a in axes or AXES if a.headline for qt in a.probes]
    return spark.createDataFrame(rows, "axis_id string, host string, qt string, rep_a string, rep_b string")


def axis_notes(spark: SparkSession, axes: list[Axis] | None = None) -> DataFrame:
    """(axis_id, note, note_reps, note_kind)"""
    return spark.createDataFrame([(a.id, a.note, list(a.note_reps), a.note_kind) for a in axes or AXES], "axis_id string, note string, note_reps array<string>, note_kind string")


def axis_headings(spark: SparkSession, axes: list[Axis] | None = None) -> DataFrame:
    """(axis_id, label, heading, heading_ord): cards of one heading stand together, headings in order of their first axis."""
    axes = axes or AXES
    order = list(dict.fromkeys(a.heading for a in axes))
    return spark.createDataFrame([(a.id, a.label, a.heading, order.index(a.heading)) for a in axes], "axis_id string, label string, heading string, heading_ord int")


def registry_order(spark: SparkSession) -> DataFrame:
    """(rep, block, rank): inventory, poles in ladder order, candidate, full record; then by name."""
    ladder: list[str] = []
    for a in AXES:
        ladder += [r for r in a.ladder if r not in ladder]
    blocks = {"non_spatial_anchor": 0, "pole": 1, "candidate": 2, "full_record_anchor": 3}
    rows = [(r, blocks[role(r)], ladder.index(r) if r in ladder else len(ladder)) for r in REP_CAPS]
    return spark.createDataFrame(rows, "rep string, block int, rank int")
