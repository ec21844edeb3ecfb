"""Ladders of cases: layers, scopes, tiers, freshness, query intent, weights."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, functions as F

from memoglyph.functions.text import normalize_spaces
from memoglyph.schema import DURABLE_SCOPES, FRESHNESS_WEIGHTS, LAYER_WEIGHTS, SCOPE_WEIGHTS, SOURCE_KIND_WEIGHTS

DAY_MS = 86_400_000


def lowered(x) -> Column:
    return F.lower(normalize_spaces(x))


def first_case(cases: list[tuple[Column, object]], otherwise) -> Column:
    """The value of the first condition that holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(cases[0][0], lit(cases[0][1]))
    for condition, value in cases[1:]:
        out = out.when(condition, lit(value))
    return out.otherwise(lit(otherwise))


def layer(memory_level, source_kind, scope) -> Column:
    level, kind, where = lowered(memory_level), lowered(source_kind), lowered(scope)
    return first_case([
        ((level == "durable") | (kind == "writeback"), "durable"),
        (kind.isin("hook", "event") | (level == "event"), "event"),
        ((level == "task") | kind.isin("blackboard", "run", "cron", "task") | where.isin("task", "run"), "task"),
    ], "session")


# fixed values: patterns of the scope ladder, with type and confidence
SCOPE_LADDER = [
    ("user", "preference", 0.70, "偏好|喜欢|中文|language|style|reply|沟通|用户|user prefers|简洁"),
    ("feedback", "workflow-rule", 0.72, r"必须|不要|避免|always|\bnever\b|\bmust\b|\bshould\b|workflow|rule|约定|规范"),
    ("project", "project-context", 0.68, r"\bissue\b|\bpr\b|\brepo\b|\bproject\b|\btask\b|cron|blackboard|queue|workspace|任务|项目"),
    ("reference", "reference", 0.66, r"\bpath\b|\burl\b|\blink\b|\bdashboard\b|\blinear\b|\bslack\b|路径|链接|位置"),
]
TASK_TOOL, TASK_PATTERN = "openclaw", r"\brun\b|\bsubagent\b|\bcron\b|\bjob\b"


def scope_of(text, tool) -> Column:
    """struct(scope, type, visibility, confidence): the first step of the ladder that the text matches."""
    low = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    pack = lambda scope, kind, sure: F.struct(F.lit(scope).alias("scope"), F.lit(kind).alias("type"), F.lit("shared").alias("visibility"), F.lit(sure).alias("confidence"))
    cases = [(low.rlike(p), pack(s, k, c)) for s, k, c, p in SCOPE_LADDER]
    cases.append(((F.col(tool) if isinstance(tool, str) else tool).eqNullSafe(F.lit(TASK_TOOL)) & low.rlike(TASK_PATTERN), pack("task", "task-note", 0.6)))
    return first_case(cases, pack("summary", "summary", 0.45))


def tier_of(memory_level, source_kind, scope) -> Column:
    level, kind, where = lowered(memory_level), lowered(source_kind), lowered(scope)
    return first_case([
        ((level == "event") | (where == "event"), 1),
        (((kind == "writeback") | (level == "durable")) & (where == "project"), 3),
        ((kind == "writeback") | (level == "durable"), 4),
    ], 2)


def target_layer(memory_level, source_kind, scope) -> Column:
    """The layer file that a record is written to."""
    return F.concat(F.element_at(F.create_map(*(F.lit(x) for x in ("durable", "shared-inbox", "event", "shared-events", "task", "task-memory", "session", "session-memory"))), layer(memory_level, source_kind, scope)), F.lit(".jsonl"))


def freshness(age_ms, future: str = "hot") -> Column:
    """hot to a day, warm to a week, else cold; unknown without an age. A future time is hot, or as given."""
    age = F.col(age_ms) if isinstance(age_ms, str) else age_ms
    return first_case([(age.isNull(), "unknown"), (age < 0, future), (age <= DAY_MS, "hot"), (age <= 7 * DAY_MS, "warm")], "cold")


# fixed values: how sure a promotion must be, and types that are never promoted
LEAST_SURE = 0.6
NOT_PROMOTED = ["summary", "session-summary", "daily-summary", "session-response", "task-note", "task-run", "task-job", "task-journal"]


def promotion_reason(scope, type_, source_kind, memory_level, confidence, text) -> Column:
    """struct(durable_type, reason): the target scope of a promotion, empty with the reason against it."""
    where, kind, source, level = lowered(scope), lowered(type_), lowered(source_kind), lowered(memory_level)
    sure = F.coalesce(F.col(confidence) if isinstance(confidence, str) else confidence, F.lit(0.0))
    pack = lambda durable, reason: F.struct((durable if isinstance(durable, Column) else F.lit(durable)).alias("durable_type"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    return first_case([
        (where == "", pack("", "missing-scope")),
        (normalize_spaces(text) == "", pack("", "missing-content")),
        (~where.isin(DURABLE_SCOPES), pack("", F.concat(F.lit("non-promotable-scope:"), where))),
        ((source == "writeback") | (level == "durable"), pack(where, F.concat(F.lit("scope:"), where))),
        (kind == "", pack("", "missing-type")),
        (kind.isin(NOT_PROMOTED), pack("", F.concat(F.lit("non-promotable-type:"), kind))),
        ((sure > 0) & (sure < LEAST_SURE), pack("", F.concat(F.lit("low-confidence:"), F.format_number(sure, 2)))),
    ], pack(where, F.concat(F.lit("scope+type:"), where)))


# fixed values: words of a query that tell its intent
INTENT_WORDS = [
    ("recent", r"(最新|最近|刚刚|今天|\b(?:recent|latest|today|current|newest|new)\b)"),
    ("task", r"(任务|运行|工单|队列|\b(?:issue|pr|run|job|cron|queue|blackboard|pending|failed|status)\b)"),
    ("reference", r"(路径|链接|文档|参考|\b(?:path|url|link|reference|doc|docs|file)\b)"),
    ("durable", r"(偏好|规则|长期|记忆|全局|\b(?:preference|rule|workflow|durable|global|remember)\b)"),
]
ROUTES = ["mixed", "durable", "task", "recent", "reference"]


def intent(query, route="", scope="", source_kind="", task_state="") -> Column:
    """The intent of a query: its explicit route, else its filters, else its words, else mixed. Arguments are columns or literals."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    query, route, scope, kind, state = (lowered(as_column(v)) for v in (query, route, scope, source_kind, task_state))
    cases = [
        (route.isin(ROUTES), route),
        (kind.isin("blackboard", "run", "cron", "task") | (state != "") | scope.isin("task", "run"), "task"),
        (scope == "reference", "reference"),
        (scope.isin(DURABLE_SCOPES), "durable"),
    ]
    return first_case([*cases, *((query.rlike(p), name) for name, p in INTENT_WORDS)], "mixed")


def intent_of(query: str, **filters) -> str:
    """intent() of literals, on the driver."""
    route, scope, kind, state = (re.sub(r"\s+", " ", str(filters.get(k) or "")).strip().lower() for k in ("route", "scope", "source_kind", "task_state"))
    if route in ROUTES:
        return route
    if kind in ("blackboard", "run", "cron", "task") or state or scope in ("task", "run"):
        return "task"
    if scope == "reference" or scope in DURABLE_SCOPES:
        return "reference" if scope == "reference" else "durable"
    return next((name for name, p in INTENT_WORDS if re.search(p, query.lower())), "mixed")


# fixed values: technical words and question words of the query analysis
TECHNICAL_PATTERN = (
    r"(?i)\b("
    r"python|javascript|typescript|java|cpp|golang|rust|sql|html|css|regex|api|cli|gui|orm|devops|json|yaml|toml|xml|markdown|useeffect|usememo|usestate|usecontext|useref|usecallback|"
    r"context|reducer|middleware|websocket|restful|graphql|grpc|npm|pip|maven|gradle|docker|kubernetes|ansible|terraform|http|https|tcp|udp|dns|cache|redis|memcached|postgres|mysql|"
    r"mongodb|async|await|promise|callback|closure|decorator|class|function|method|interface|type|enum|struct|trait|generic|inheritance|polymorphism|encapsulation|abstraction|monad|"
    r"functor|lambda|curry|higher.order|git|commit|push|pull|merge|rebase|branch|tag|diff|patch|ci|cd|pipeline|jenkins|github|gitlab|bitbucket|oop|fp|tdd|bdd|ddd|cqrs|event.sourcing|"
    r"microservice|monolith|serverless|faas|paas|saas|jwt|oauth|ssl|tls|ssh|gpg|rsa|aes|kernel|thread|process|goroutine|channel|actor|virtual.dom|reconcile|scheduler|fiber|hook|effect|"
    r"ref|mcp|protocol|schema|endpoint|route|handler|index|shard|partition|replica|leader|follower|splitbrain|llm|embedding|vector|token|rag|rerank|bm25|dense|crud|create|read|update|"
    r"delete|upsert"
    r"|[a-z]{2,}[_][a-z]{2,})\b"
)
SEMANTIC_PATTERN = r"(?i)(怎么|如何|为什么|什么|哪个|哪些|何时|哪里|怎样|多少|why|how|what|which|when|where|can i|could i|should i|explain|describe|compare|contrast|difference between|的最佳实践|最佳方案|推荐|建议|思路|方案|告诉我|教我|帮我|给我|概念|原理)"
SYMBOL_PATTERN = r"[`\[\]{}()=+\-*/<>!&|^%$#@~]"
BLENDS = {"keyword_heavy": (0.72, 0.28), "semantic_heavy": (0.28, 0.72), "balanced": (0.55, 0.45)}


def query_type(query) -> Column:
    """struct(query_type, keyword_score, semantic_score, bm25_weight, dense_weight) of a query text."""
    q = F.trim(F.coalesce(query, F.lit("")))
    n_words = F.greatest(F.size(F.filter(F.split(q, r"\s+"), lambda w: w != "")), F.lit(1))
    short = F.regexp_extract_all(q, F.lit(r"\b([a-z]{2,6})\b"), 1)
    mean = F.when(F.size(short) > 0, F.aggregate(short, F.lit(0), lambda a, w: a + F.length(w)) / F.size(short)).otherwise(0.0)
    words = F.regexp_count(q, F.lit(TECHNICAL_PATTERN)) / n_words * 5 + F.regexp_count(q, F.lit(SYMBOL_PATTERN)) / F.greatest(F.length(q), F.lit(1)) * 3 + F.least(mean / 8.0, F.lit(1.0))
    long_text = (F.length(q) > 30) & (F.regexp_count(q, F.lit(" ")) > 5)
    meaning = F.when(q.rlike(SEMANTIC_PATTERN), 1.5).otherwise(0.0) + F.when(q.rlike("[？?]"), 1.0).otherwise(0.0) + F.when(long_text, 1.0).otherwise(0.0)
    total = words + meaning
    keyword, semantic = F.when((q == "") | (total <= 0), 0.5).otherwise(words / total), F.when((q == "") | (total <= 0), 0.5).otherwise(meaning / total)
    kind = first_case([(q == "", "balanced"), (keyword > 0.65, "keyword_heavy"), (semantic > 0.65, "semantic_heavy")], "balanced")
    blend = lambda i: first_case([(kind == k, v[i]) for k, v in BLENDS.items()], 0.5)
    return F.struct(kind.alias("query_type"), F.round(keyword, 4).alias("keyword_score"), F.round(semantic, 4).alias("semantic_score"), blend(0).alias("bm25_weight"), blend(1).alias("dense_weight"))


def _weight(values: dict[str, dict[str, float]], intent_: str, key: Column, add: dict[str, float] | None = None) -> Column:
    own = dict(values.get(intent_, values["mixed"]))
    for k, v in (add or {}).items():
        own[k] = own.get(k, 1.0) + v
    return first_case([(key == k, v) for k, v in own.items()], 1.0)


def task_state_weight(state, intent_: str) -> Column:
    low = lowered(state)
    busy, done, broken = low.isin("processing", "active", "pending"), low.isin("ok", "pr_submitted", "pr_created"), low.isin("failed", "timeout", "dev_error", "report_error", "build_fail")
    if intent_ == "task":
        return first_case([(busy, 1.12), (done, 1.06), (broken, 1.01)], 1.0)
    if intent_ == "recent":
        return first_case([(busy, 1.06), (done, 1.04)], 1.0)
    return F.lit(1.0)


def route_weight(intent_: str, layer_, scope, source_kind, freshness_, state, prefer_summaries: bool = False) -> Column:
    """Product of a route's weights for an entry."""
    return (
        _weight(LAYER_WEIGHTS, intent_, layer_, {"session": 0.04} if prefer_summaries else None)
        * _weight(SCOPE_WEIGHTS, intent_, lowered(scope), {"summary": 0.08} if prefer_summaries else None)
        * _weight(SOURCE_KIND_WEIGHTS, intent_, lowered(source_kind))
        * _weight(FRESHNESS_WEIGHTS, intent_, freshness_)
        * task_state_weight(state, intent_)
    )


# fixed values: words that make a text time-sensitive
TIME_WORDS = ["deadline", "freeze", "release", "deploy", "launch", "milestone", "sprint", "roadmap", "v1", "v2", "v3"]


def is_time_sensitive(text) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (low.contains(w) for w in TIME_WORDS))


def drift_risk(*signals: Column) -> Column:
    """low without a signal, medium with one, high with more."""
    n = reduce(lambda a, b: a + b, (s.cast("int") for s in signals))
    return first_case([(n == 0, "low"), (n == 1, "medium")], "high")


# fixed values: files that hold records of another one by design
DERIVED_FROM = {
    "session-memory.jsonl": ["claude-code.jsonl", "openclaw.jsonl"],
    "task-memory.jsonl": ["openclaw-blackboard.jsonl", "openclaw-runs.jsonl", "openclaw-jobs.jsonl", "openclaw-journal.jsonl"],
}


def is_expected_pair(first: Column, second: Column) -> Column:
    """Whether two layer files hold the same record by design: one of DERIVED_FROM and one of its sources.

    A pair with session-memory.jsonl is judged by that file alone.
    """
    a, b = normalize_spaces(first), normalize_spaces(second)
    session, task = DERIVED_FROM
    has = lambda name: (a == name) | (b == name)
    any_of = lambda name: a.isin(DERIVED_FROM[name]) | b.isin(DERIVED_FROM[name])
    return F.when(has(session), any_of(session)).otherwise(has(task) & any_of(task))


def artifact_state(signature: Column, stored_signature: Column, digest: Column, stored_digest: Column, written_ms: Column, newest_ms: Column) -> Column:
    """Whether a generated file is current: by signature, else by hash, else missing, else by time."""
    return first_case([
        (signature.isNotNull() & stored_signature.isNotNull(), F.when(signature == stored_signature, "current").otherwise("stale-signature")),
        (digest.isNotNull() & stored_digest.isNotNull(), F.when(digest == stored_digest, "current").otherwise("stale-hash")),
        (written_ms.isNull(), "missing"),
        (written_ms >= newest_ms, "current"),
    ], "stale-time")
