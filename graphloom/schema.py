"""Table schemas and the closed sets of node and edge types."""

from __future__ import annotations

NODES = "id string, type string, name string, qualified_name string, file_path string, line_number int, code_snippet string, last_modified bigint"
EDGES = "type string, source_id string, target_id string"
METHODS = "node_id string, name string, return_type string, parameters string, annotations string, visibility string"
INDEXED_FILES = "file_path string, last_modified bigint, checksum string"
ENTRY_POINTS = "node_id string"
RETURN_CLASSES = "method_id string, class_id string"
FILE_SHAPES = "file_path string, shape_hash string"
CO_CHANGE = "file_a string, file_b string, count bigint"
CONFIG = "key string, value string"

# Node types, by family.
JAVA_TYPES = ("CLASS", "INTERFACE", "RECORD", "ENUM", "CONTROLLER", "SERVICE", "REPOSITORY", "ENTITY", "CONFIGURATION", "MAPPER")
SPRING_TYPES = ("VIEW", "EVENT_PUBLISHER")
DDD_TYPES = ("COMMAND", "COMMAND_HANDLER", "QUERY", "QUERY_HANDLER", "AGGREGATE", "DOMAIN_EVENT", "EVENT_APPLIER", "PROJECTION_HANDLER", "EVENT_LISTENER")
FRONTEND_TYPES = ("FE_SERVICE", "FE_COMPONENT", "FE_MODEL", "FE_CLASS", "FE_ENUM", "FE_PIPE", "FE_GUARD", "FE_INTERCEPTOR", "FE_VALIDATOR", "FE_CONSTANT")
SCRIPT_TYPES = ("GROOVY_SCRIPT", "PY_MODULE", "PY_CLASS", "SHELL_SCRIPT", "SHELL_COMMAND", "SQL_TABLE", "SQL_VIEW", "SQL_ROUTINE")
NODE_TYPES = (*JAVA_TYPES, *SPRING_TYPES, *DDD_TYPES, "METHOD", *FRONTEND_TYPES, *SCRIPT_TYPES, "LIBRARY")

# Edge types.
EDGE_TYPES = (
    "INJECTS", "CALLS_METHOD", "IMPLEMENTS", "EXTENDS", "RETURNS_TYPE", "DECLARES_METHOD", "CALLS", "OVERRIDES",
    "READS_VIEW", "UPDATES_VIEW", "PUBLISHES_EVENT", "DISPATCHES_COMMAND", "DISPATCHES_QUERY", "HANDLES", "LOADS_AGGREGATE",
    "EMITS_EVENT", "APPLIES_EVENT", "PROJECTS_EVENT", "LISTENS_TO", "CALLS_API", "USES_SERVICE", "USES_LIBRARY",
    "IMPORTS", "REFERENCES_TABLE", "DERIVES_FROM", "REFERENCES_FK", "SOURCES", "RUNS",
)

# How dead-code rules see the types.
FRAMEWORK_ENTRY_TYPES = ("CONTROLLER", "EVENT_LISTENER", "PROJECTION_HANDLER", "EVENT_APPLIER", "COMMAND_HANDLER", "QUERY_HANDLER")
ROOT_TYPES = ("CONFIGURATION", "SHELL_SCRIPT", "SHELL_COMMAND", "PY_MODULE")
SQL_TYPES = ("SQL_TABLE", "SQL_VIEW", "SQL_ROUTINE")
HIGH_CONFIDENCE_TYPES = ("CLASS", "SERVICE", "REPOSITORY", "MAPPER", "VIEW", "EVENT_PUBLISHER", "AGGREGATE", "FE_SERVICE", "FE_CLASS", "FE_CONSTANT")
TIERS = ("HIGH", "MEDIUM", "LOW", "USED_ONLY_BY_TESTS", "TEST_SOURCE")
