"""Schemas and the closed ontology of the property graph."""

from __future__ import annotations

from dataclasses import dataclass

VERSION = "1.0.0"

SCHEMAS = {
    "repository": "path STRING, name STRING",
    "file": "path STRING, language STRING, repo STRING, name STRING",
    "symbol": "qualified_name STRING, name STRING, symbol_type STRING, file_path STRING, line_start INT, line_end INT",
    "variable": "qualified_name STRING, name STRING, scope_qname STRING, file_path STRING, line_number INT, role STRING, parameter_index INT",
    "edge": "src STRING, dst STRING",
    "flows_to": "src STRING, dst STRING, scope_qname STRING, line_number BIGINT, flow_type STRING",
}

#: Key column of each node label.
KEYS = {"repository": "path", "file": "path", "symbol": "qualified_name", "variable": "qualified_name"}


@dataclass(frozen=True)
class Relation:
    name: str
    source: str
    target: str
    evidence: tuple[str, ...] = ()


RELATIONS = {r.name: r for r in (
    Relation("contains", "repository", "file"), Relation("defines", "file", "symbol"), Relation("imports", "file", "file"),
    Relation("calls", "symbol", "symbol"), Relation("uses_variable", "symbol", "variable"),
    Relation("flows_to", "variable", "variable", ("scope_qname", "line_number", "flow_type")))}

DIRECTIONS = ("outgoing", "incoming")


def checked(relation: str, identity: str, direction: str, limit: int) -> Relation:
    """The relation, once all arguments of a one-hop query are valid; raises ValueError before anything is read."""
    if relation not in RELATIONS:
        raise ValueError(f"relation must be one of {sorted(RELATIONS)}")
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    if not isinstance(identity, str) or not 1 <= len(identity) <= 4096:
        raise ValueError("identity must have 1 to 4096 characters")
    if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
        raise ValueError("limit must be a whole number from 1 to 100")
    return RELATIONS[relation]
