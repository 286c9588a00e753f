"""The data model: closed vocabularies, ranks and schemas of the property graph."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The closed vocabularies of the data model.
NODE_KINDS = (
    "repository", "application", "module", "package", "directory", "file",
    "class", "interface", "enum", "function", "method",
    "component", "service", "controller", "handler", "endpoint",
    "route", "guard", "interceptor", "state",
    "event", "queue", "topic", "job", "schedule",
    "database", "table", "view", "query", "procedure", "sequence",
    "collection", "cache", "cache-key", "entity", "stereotype",
    "external-service", "configuration", "environment", "configuration-key",
    "deployment-unit", "test", "test-case", "migration", "ci-job",
    "capability", "requirement", "concept", "slice", "decision", "non-goal",
)
EDGE_TYPES = (
    "contains", "imports", "references", "calls", "implements", "extends",
    "depends-on", "injects", "exposes", "consumes", "publishes",
    "reads", "writes", "queries", "invokes", "transforms",
    "configures", "authenticates", "authorizes", "tests", "deploys-to",
    "defines", "handled-by", "guarded-by", "navigates", "creates",
    "modifies", "seeds", "triggered-by", "maps-to",
    "realizes", "part-of", "denotes", "motivated-by", "delivered-in",
)
CONFIDENCES = ("HIGH", "MEDIUM", "LOW", "UNKNOWN")
PROVENANCES = ("derived", "asserted")
INTENT_KINDS = ("capability", "requirement", "concept", "slice", "decision", "non-goal")
INTENT_EDGE_TYPES = ("realizes", "part-of", "denotes", "motivated-by", "delivered-in")
INTENT_STATUSES = ("active", "superseded", "needs-review")
SIGNIFICANT_KINDS = (
    "controller", "service", "handler", "endpoint", "route",
    "class", "interface", "component", "table", "view", "procedure",
    "collection", "queue", "topic", "event", "job", "migration",
    "external-service", "database", "deployment-unit",
)
PLACEHOLDER_PREFIXES = (
    "unresolved:", "table:", "entity:", "env:", "config-key:",
    "sequence:", "stereotype:", "schedule:",
)
MAX_ID_LENGTH = 512
ENTRY_KINDS = ("endpoint", "route", "queue", "topic", "event", "job", "schedule")
CONSUMER_KINDS = ("component", "service", "route")
LOGIC_KINDS = (
    "service", "controller", "handler", "component", "function",
    "method", "class", "interface", "guard", "interceptor",
)
DATA_KINDS = (
    "table", "view", "collection", "query", "procedure",
    "sequence", "cache", "cache-key", "entity", "migration",
)
STORE_KINDS = ("table", "view", "collection", "entity", "database")
REACH_EDGE_TYPES = (
    "calls", "handled-by", "injects", "consumes", "navigates", "defines",
    "references", "reads", "writes", "queries", "invokes", "exposes",
    "transforms", "publishes", "extends", "implements",
)
FLOW_SEEDS = ("queue", "topic", "event", "job", "route")
FLOW_WALK_TYPES = (
    "calls", "reads", "writes", "queries", "invokes",
    "injects", "consumes", "publishes", "transforms",
    "handled-by", "navigates", "guarded-by",
)
DATA_EDGES = (
    "reads", "writes", "queries", "transforms", "publishes",
    "consumes", "creates", "modifies", "seeds", "invokes",
)
CALL_EDGES = ("calls", "handled-by", "injects", "invokes", "implements", "extends", "defines")
DEP_EDGES = (
    "depends-on", "imports", "injects", "calls", "references",
    "exposes", "consumes", "configures", "deploys-to", "tests",
    "extends", "implements",
)
ACCESS_TYPES = ("reads", "writes", "queries", "creates", "modifies", "seeds", "transforms")
CONF_RANK = {"HIGH": 0, "MEDIUM": 1, "LOW": 2, "UNKNOWN": 3}
KIND_RANK = {
    "application": 0, "deployment-unit": 1, "database": 2,
    "external-service": 3, "endpoint": 4, "route": 5, "controller": 6,
    "service": 7, "handler": 8, "component": 9, "queue": 10, "topic": 10,
    "event": 10, "job": 11, "table": 12, "collection": 12, "view": 13,
    "class": 14, "interface": 15, "function": 16, "method": 17,
}
LAYERS = ("clients", "endpoints", "handlers", "services", "data-access", "stores")
LAYER_OF = {
    "component": "clients",
    "endpoint": "endpoints", "route": "endpoints", "queue": "endpoints",
    "topic": "endpoints", "event": "endpoints", "job": "endpoints",
    "schedule": "endpoints",
    "controller": "handlers", "handler": "handlers", "guard": "handlers",
    "interceptor": "handlers",
    "service": "services", "function": "services", "method": "services",
    "class": "services", "interface": "services", "enum": "services",
    "query": "data-access", "procedure": "data-access",
    "table": "stores", "view": "stores", "collection": "stores",
    "entity": "stores", "cache": "stores", "cache-key": "stores",
    "sequence": "stores", "migration": "stores", "database": "stores",
    "external-service": "stores", "deployment-unit": "stores",
}

NODE_SCHEMA = (
    "id string, kind string, name string, file string, line int, evidence string, confidence string, provenance string,"
    " lang string, framework string, package string, namespace string, handler string, columns array<string>,"
    " meta map<string,string>, title string, body string, source string, author string, asserted_at string,"
    " asserted_commit string, status string, last_verified_commit string, node_seq long"
)
EDGE_SCHEMA = (
    "src string, dst string, type string, file string, line int, evidence string, confidence string, provenance string,"
    " via string, resolved string, binding string, why string, review string, review_reason string,"
    " meta map<string,string>, author string, asserted_at string, asserted_commit string, last_verified_commit string,"
    " edge_seq long"
)


def rank(col: Column, table: dict[str, int], default: int) -> Column:
    ranks = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(ranks, col), F.lit(default))


def conf_rank(col: Column) -> Column:
    return rank(col, CONF_RANK, 3)


def kind_rank(col: Column) -> Column:
    return rank(col, KIND_RANK, 50)


def layer_of(kind: Column, fallback: Column | None = None) -> Column:
    """Layer of a kind; else the clamped fallback level, else services."""
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LAYER_OF.items() for x in kv]), kind)
    if fallback is None:
        return F.coalesce(known, F.lit("services"))
    level = F.least(F.greatest(fallback, F.lit(0)), F.lit(len(LAYERS) - 1))
    by_level = F.element_at(F.array(*[F.lit(x) for x in LAYERS]), level + 1)
    return F.coalesce(known, by_level, F.lit("services"))


def is_unresolved(dst: Column) -> Column:
    return dst.startswith("unresolved:")


def bare_placeholder(dst: Column) -> Column:
    """A bare-name reference, which dangles only where no node has that id."""
    out = F.lit(False)
    for p in PLACEHOLDER_PREFIXES[1:]:
        out = out | dst.startswith(p)
    return out
