"""The record contract: types, enums and weight tables."""

from __future__ import annotations

# fixed values: the contract's enums, versions and required fields
RECORD_VERSION = 2
REQUIRED = ["schemaVersion", "id", "tool", "type", "title", "source", "scope", "memory_level"]
SCOPES = ["user", "feedback", "project", "reference", "summary", "task", "run"]
DURABLE_SCOPES = ["user", "feedback", "project", "reference"]
VISIBILITIES = ["shared", "private"]
SOURCE_KINDS = ["writeback", "hook", "session", "event", "blackboard", "run", "cron", "task"]
LEVELS = ["durable", "session", "event", "task"]
TIERS = [1, 2, 3, 4, 5]

# fixed values: tier budgets; tier 3 counts by project and tier 4 by type
TIER_BUDGETS = {1: 200, 2: 200, 3: 100, 4: 200, 5: 500}

# fixed values: weights of a search route by intent
LAYER_WEIGHTS = {
    "mixed": {"durable": 1.0, "session": 1.0, "event": 0.96, "task": 1.0},
    "durable": {"durable": 1.35, "session": 0.94, "event": 0.82, "task": 0.72},
    "task": {"durable": 0.76, "session": 0.92, "event": 0.84, "task": 1.35},
    "recent": {"durable": 0.8, "session": 1.16, "event": 1.35, "task": 0.96},
    "reference": {"durable": 1.18, "session": 0.92, "event": 0.82, "task": 0.9},
}
SCOPE_WEIGHTS = {
    "mixed": {"user": 1.06, "feedback": 1.04, "project": 1.03, "reference": 1.03, "summary": 1.0, "task": 0.98, "run": 0.98},
    "durable": {"user": 1.22, "feedback": 1.18, "project": 1.1, "reference": 1.12, "summary": 0.88, "task": 0.76, "run": 0.72},
    "task": {"user": 0.88, "feedback": 0.94, "project": 1.08, "reference": 0.96, "summary": 0.92, "task": 1.2, "run": 1.24},
    "recent": {"user": 0.92, "feedback": 0.96, "project": 1.0, "reference": 0.94, "summary": 1.06, "task": 1.02, "run": 1.04},
    "reference": {"user": 0.92, "feedback": 0.96, "project": 1.14, "reference": 1.28, "summary": 0.9, "task": 0.9, "run": 0.88},
}
SOURCE_KIND_WEIGHTS = {
    "mixed": {"writeback": 1.04, "session": 1.0, "hook": 0.98, "blackboard": 1.0, "run": 1.02, "cron": 1.01},
    "durable": {"writeback": 1.12, "session": 1.02, "hook": 0.9, "blackboard": 0.84, "run": 0.82, "cron": 0.8},
    "task": {"writeback": 0.86, "session": 0.96, "hook": 0.88, "blackboard": 1.16, "run": 1.18, "cron": 1.12},
    "recent": {"writeback": 0.96, "session": 1.08, "hook": 1.14, "blackboard": 1.0, "run": 1.02, "cron": 1.04},
    "reference": {"writeback": 1.06, "session": 0.98, "hook": 0.9, "blackboard": 0.9, "run": 0.9, "cron": 0.9},
}
FRESHNESS_WEIGHTS = {
    "mixed": {"hot": 1.02, "warm": 1.0, "cold": 0.98, "unknown": 1.0},
    "durable": {"hot": 1.01, "warm": 1.0, "cold": 1.0, "unknown": 1.0},
    "task": {"hot": 1.1, "warm": 1.04, "cold": 0.96, "unknown": 0.98},
    "recent": {"hot": 1.12, "warm": 1.05, "cold": 0.92, "unknown": 0.96},
    "reference": {"hot": 1.0, "warm": 1.0, "cold": 0.99, "unknown": 1.0},
}
# fixed values: quality of a record's source, 0.5 for others
SOURCE_QUALITY = {"writeback": 1.0, "session": 0.9, "hook": 0.7, "blackboard": 0.6, "run": 0.5, "cron": 0.5, "task": 0.7, "event": 0.5, "heuristic": 0.4}
# fixed values: how specific an entity type is
TYPE_RANK = {"person": 5, "project": 4, "concept": 3, "tool": 2, "unknown": 1}

#: A record as it stands in a line of JSON, for spark.read.schema(); malformed lines end up in _corrupt.
RECORD = (
    "schemaVersion int, id string, t string, tool string, session string, session_id string, type string, project string, agent string, title string, name string, "
    "description string, content string, facts array<string>, concepts array<string>, decisions array<string>, tags array<string>, files_read array<string>, "
    "files_modified array<string>, source string, scope string, visibility string, source_kind string, memory_level string, workspace string, task_state string, "
    "freshness string, confidence double, content_hash string, tier int, "
    "lifecycle struct<tier:int,expires_at:string,last_access_at:string,access_count:int,promotion_count:int,archived:boolean,freshness_score:double,promoted_at:string,"
    "last_promotion_reason:string,simplified:boolean,original_content_hash:string>, "
    "metadata struct<promotion:struct<version:int,durable_type:string,key:string,reason:string,source_type:string,source_confidence:double,source_record_id:string,"
    "is_refresh:boolean,refresh_of_id:string,refresh_of_t:string,conflict_with:array<string>,supersedes:string,source_layer:string,cross_session_refs:array<string>>>, "
    "_corrupt string"
)
