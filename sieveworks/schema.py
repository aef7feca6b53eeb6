"""Schemas of the tables, and the closed vocabularies of their string columns."""

from __future__ import annotations

from typing import Any

#: The answer that a mention has no concept, verdicts, zones, and what is still open.
CONCEPT_LESS = "CONCEPT_LESS"
ACCEPT, BAND, REJECT = "ACCEPT", "BAND", "REJECT"
ABSTAIN, ESCALATE, RESOLVED, VERIFIED, NEW = "ABSTAIN", "ESCALATE", "RESOLVED", "VERIFIED", "NEW"
VERDICTS = (ACCEPT, BAND, REJECT)
OPEN_ZONES = (NEW, BAND, REJECT)
ENTITY_TYPES = ("reaction", "drug")
#: Reasons for a rejection, in the order of the checks.
REASONS = ("schema_invalid", "span_out_of_range", "span_ungrounded", "negated", "code_unknown", "code_inactive", "wrong_semantic_type", "meddra_unknown")
#: Corpus types by record type, and the shapes of gold annotations.
TYPE_MAP = {"ADR": "reaction", "Disease": "reaction", "Symptom": "reaction", "Finding": "reaction", "Drug": "drug"}
GOLD_KINDS = ("single", "any_of", "all_of", "concept_less")
GRADABLE_KINDS = ("single", "any_of", "all_of")

SPANS = "array<struct<s:int,e:int>>"
DOC = "doc_id string, grp string, text string"
GOLD = f"doc_id string, idx int, record_id string, entity_type string, src_type string, text string, spans {SPANS}, sct array<string>, gold_kind string, meddra array<string>"
RECORD = (
    f"doc_id string, entity_type string, text string, spans {SPANS}, sct string, meddra string, confidence double, zone string, reason string, record_id string, "
    "provenance array<struct<rung:int,`from`:string,`to`:string,reason:string>>"
)
CONCEPT = "id string, active boolean, is_finding boolean, is_finding_hist boolean"
DESCRIPTION = "concept_id string, term string, norm string, fsn boolean, rowid long"
LEDGER = (
    "run_id string, rung int, doc_id string, record_id string, zone string, outcome string, reason string, tokens_in long, tokens_out long, api_calls long, "
    "latency_ms double, usd double, human_minutes double, ts double, extra map<string,string>, verdict string"
)

#: Parameters of the two stages.
CHECK_DEFAULTS: dict[str, Any] = {
    "mode": "observe", "reject_inactive": False, "meddra_check": "flag", "check_negation": True, "negation_action": "flag", "negation_window": 6,
    "finding_check": True, "finding_scope": "reaction", "lexical_mode": "exact",
}
ABSTAIN_DEFAULTS: dict[str, Any] = {"tau": 0.0, "abstain_zones": (BAND,), "abstain_on_reject": True}


def merge(defaults: dict[str, Any], given: dict[str, Any] | None) -> dict[str, Any]:
    """The defaults with what is given, without unknown names."""
    return defaults | {k: v for k, v in (given or {}).items() if k in defaults}
