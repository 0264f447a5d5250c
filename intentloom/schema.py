"""Vocabulary of the intent graph: kinds, edge kinds, clauses and which clause may stand on which kind."""

from __future__ import annotations

KINDS = ["module", "service", "workflow", "step", "state", "event", "type", "error", "function", "external"]
EDGE_KINDS = ["Affects", "Reads", "Triggers", "Emits", "Handles", "DependsOn", "Contains", "Sequence", "Calls"]
SCOPES = ["module", "service", "workflow"]
OWNERS = ["module", "service", "external"]
CAUSES = ["Triggers", "Calls"]
REACH = ["Contains", "Sequence", "Triggers", "Calls", "Affects", "Reads", "DependsOn"]
USES = ["Affects", "Reads", "Triggers", "Emits", "Handles"]

NODES = "qname string, kind string, origin string, file string, line int, annotated boolean, ord bigint"
EDGES = "edge_id bigint, src string, dst string, kind string, layer string, status string, confidence string, file string, line int"
CLAUSES = "qname string, clause string, ord int, value string, file string, line int"
FINDINGS = "code string, severity string, file string, line int, node string, message string"

#: clause -> edge kind and the kinds that it may point to
REFERENCES = {
    "affects": ("Affects", ["state"]), "reads": ("Reads", ["state"]), "triggers": ("Triggers", ["function"]),
    "emits": ("Emits", ["event"]), "on": ("Handles", ["event"]), "depends_on": ("DependsOn", ["module", "service", "external"]),
}
SINGULAR = ["purpose", "owner", "route", "enforcement"]
CLAUSE_NAMES = ["purpose", "owner", "because", "unknown", "assumes", *REFERENCES, "route", "enforcement"]


def _rows() -> list[tuple[str, str, str]]:
    legal = {
        "purpose": {"required": "module service workflow event external", "recommended": "state", "optional": "step type function"},
        "owner": {"required": "module service workflow external", "optional": "function", "inherited": "state event"},
        "because": {"required": "error", "optional": "module service workflow step state event type function external"},
        "unknown": {"optional": "module service workflow step state event type function external"},
        "assumes": {"optional": "workflow step function external"},
        **{c: {"optional": "step function"} for c in ("affects", "reads", "triggers", "emits", "on")},
        "depends_on": {"optional": "module service workflow"},
        "route": {"required": "service", "optional": "function"},
        "enforcement": {"optional": "module"},
    }
    return [(c, k, next((r for r, kinds in legal[c].items() if k in kinds.split()), "illegal")) for c in CLAUSE_NAMES for k in KINDS]


#: (clause, kind, requirement): required, recommended, optional, inherited or illegal
APPLICABILITY = _rows()
LEGAL = {(c, k) for c, k, r in APPLICABILITY if r not in ("illegal", "inherited")}
