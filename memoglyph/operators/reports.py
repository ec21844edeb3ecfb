"""Counts, health, budgets, histograms, context packs and other reports over records and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memoglyph.functions.classify import first_case, freshness, lowered
from memoglyph.functions.numeric import value_at
from memoglyph.functions.text import normalize_spaces
from memoglyph.operators.lifecycle import positions
from memoglyph.schema import TIER_BUDGETS

DAY_MS = 86_400_000


def counts_with_zeros(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """column, n for each known value, 0 where there is none, and for other values that occur."""
    found = df.groupBy(column).agg(F.count("*").alias("n"))
    base = df.sparkSession.createDataFrame([(k,) for k in known], f"{column} string")
    return base.join(found, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def count_map(df: DataFrame, column: str, blank: str | None = None) -> DataFrame:
    """column, n with the commonest first, then by name; blanks are left out or, where given, counted under a name."""
    value = F.lower(F.trim(F.coalesce(F.col(column), F.lit(""))))
    named = df.select((F.when(value == "", F.lit(blank)).otherwise(value) if blank else value).alias(column)).where(F.col(column) != "")
    return named.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def grouped_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """dimension, value, n for each of several columns, by grouping sets in one pass."""
    named = df.select(*(F.coalesce(F.lower(F.trim(F.col(c).cast("string"))), F.lit("unknown")).alias(c) for c in columns))
    sets = [[F.col(c)] for c in columns]
    found = named.groupingSets(sets, *(F.col(c) for c in columns)).agg(F.count("*").alias("n"), *(F.grouping(c).alias(f"_{c}") for c in columns))
    return found.select(first_case([(F.col(f"_{c}") == 0, c) for c in columns], "").alias("dimension"), F.coalesce(*(F.when(F.col(f"_{c}") == 0, F.col(c)) for c in columns)).alias("value"), "n")


def hygiene(df: DataFrame, as_of_ms: int, scopes: list[str]) -> DataFrame:
    """One row of counters over records (id, title, scope, content_hash, t_ms, source_kind)."""
    age = (F.lit(as_of_ms) - F.col("t_ms")) / DAY_MS
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    totals = df.agg(
        F.count("*").alias("total"), F.count_if(blank("content_hash")).alias("missing_hash"), F.count_if(blank("title")).alias("missing_title"), F.count_if(blank("scope")).alias("missing_scope"),
        F.count_if(~blank("scope") & ~lowered("scope").isin(scopes)).alias("invalid_scopes"), F.count_if(lowered("source_kind") == "writeback").alias("promoted"),
        F.count_if(age <= 7).alias("last_7_days"), F.count_if((age > 7) & (age <= 30)).alias("last_30_days"), F.count_if(age > 90).alias("older_than_90_days"),
    )
    twice = df.where(~blank("id")).groupBy("id").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_ids"))
    return totals.crossJoin(twice)


def health(counters: DataFrame, index_ok: bool = False) -> DataFrame:
    """hygiene() with score (0 to 100) and grade."""
    capped = lambda c, each, most: F.least(F.col(c) * each, F.lit(most))
    lost = capped("missing_hash", 5, 20) + capped("missing_title", 5, 10) + capped("invalid_scopes", 5, 15) + F.least(F.least("duplicate_ids", F.lit(12)) * 3, F.lit(15))
    lost = lost + F.when(F.try_divide("older_than_90_days", "total") > 0.10, 10).otherwise(0) + F.when(F.col("last_7_days") == 0, 5).otherwise(0)
    score = F.when(F.col("total") == 0, F.lit(100)).otherwise(F.lit(100) - lost) + (10 if index_ok else 0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")
    return counters.withColumn("score", score).withColumn("grade", first_case([(score >= 90, "A"), (score >= 75, "B"), (score >= 60, "C"), (score >= 40, "D")], "F"))


def recommendations(counters: DataFrame) -> DataFrame:
    """severity, issue of each rule that the counters meet."""
    rules = [
        (F.col("missing_hash") > 0, "medium", "missing-content-hash"), (F.col("missing_title") > 0, "low", "missing-title"), (F.col("missing_scope") > 0, "medium", "missing-scope"),
        (F.col("invalid_scopes") > 0, "medium", "invalid-scope"), (F.col("duplicate_ids") > 0, "high", "duplicate-ids"),
        (F.try_divide("older_than_90_days", "total") > 0.10, "low", "many-old-records"), ((F.col("total") > 0) & (F.col("last_7_days") == 0), "medium", "no-recent-records"),
    ]
    return counters.select(F.inline(F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for c, s, i in rules)))))


def tier_budgets(df: DataFrame, default_tier: int = 1) -> DataFrame:
    """tier, n, most, over for each tier; records without a tier, or with another, count for the default."""
    tier = F.when(F.col("tier").isin(list(TIER_BUDGETS)), F.col("tier")).otherwise(F.lit(default_tier))
    found = df.groupBy(tier.alias("tier")).agg(F.count("*").alias("n"))
    base = df.sparkSession.createDataFrame(list(TIER_BUDGETS.items()), "tier int, most int")
    joined = F.broadcast(base).join(found, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "most")
    return joined.withColumn("over", F.col("n") > F.col("most"))


def cold_in_tier_4(df: DataFrame) -> DataFrame:
    """n of never read records in tier 4, those without a tier among them."""
    return df.agg(F.count_if((F.col("tier").isNull() | (F.col("tier") == 4)) & (F.coalesce("access_count", F.lit(0)) == 0)).alias("n"))


def layer_summary(df: DataFrame, layer: str = "layer", samples: int = 12) -> DataFrame:
    """layer, n, valid, invalid, newest, samples (the first invalid ids) of checked records (id, ok, t_ms).

    The samples come from a rank cut to `samples` rows in each task, not from a collected group.
    """
    totals = df.groupBy(layer).agg(F.count("*").alias("n"), F.count_if("ok").alias("valid"), F.count_if(~F.col("ok")).alias("invalid"), F.max("t_ms").alias("newest"))
    bad = df.where(~F.col("ok")).withColumn("_r", F.row_number().over(W.partitionBy(layer).orderBy("id"))).where(F.col("_r") <= samples).groupBy(layer).agg(F.array_sort(F.collect_list("id")).alias("samples"))
    return totals.join(bad, layer, "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def index_state(rows: DataFrame, config: str = "config") -> DataFrame:
    """n, configs, state of an embedding index: missing, unknown (no configuration), mixed or aligned."""
    found = rows.agg(F.count("*").alias("n"), F.count_distinct(F.nullif(F.col(config), F.lit(""))).alias("configs"))
    return found.withColumn("state", first_case([(F.col("n") == 0, "missing"), (F.col("configs") == 0, "unknown"), (F.col("configs") > 1, "mixed")], "aligned"))


def token_estimates(df: DataFrame, text: str = "content") -> DataFrame:
    """n, tokens: a quarter of each record's characters, rounded up, summed."""
    return df.agg(F.count("*").alias("n"), F.sum(F.ceil(F.length(text) / 4)).cast("long").alias("tokens"))


def latency(df: DataFrame, value: str, shares: dict[str, float], *keys: str) -> DataFrame:
    """n, mean and, for each name in shares, the value at index floor(n * share) of the sorted values.

    Ranks come from a window over keys and values with the counts joined, so no group is collected.
    """
    k = list(keys)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*k).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    by_value = df.where(F.col(value).isNotNull()).groupBy(*k, value).agg(F.count("*").alias("c"))
    window = W.partitionBy(*k).orderBy(value)
    upto = by_value.withColumn("_hi", F.sum("c").over(window)).withColumn("_lo", F.col("_hi") - F.col("c"))
    both = upto.join(sizes, k) if k else upto.crossJoin(F.broadcast(sizes))
    at = lambda s: F.least(F.floor(F.col("n") * F.lit(s)), F.col("n") - 1)
    return both.groupBy(*k).agg(F.first("n").alias("n"), F.first("mean").alias("mean"), *(F.max(F.when((F.col("_lo") <= at(s)) & (F.col("_hi") > at(s)), F.col(value))).alias(name) for name, s in shares.items()))


def cumulative_histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """le, n: how many values are at most each bound; the last bound is null for infinity."""
    one = df.agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count(value).alias("all"))
    rows = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("all").alias("n"))]
    return one.select(F.inline(F.array(*rows)))


def budgeted(df: DataFrame, segment: str, budgets: dict[str, int], *order) -> DataFrame:
    """segment, id, rank, truncated: the first rows of each segment up to its budget, and how many are left out."""
    most = first_case([(F.col(segment) == k, v) for k, v in budgets.items()], 0)
    df = df.where(F.col(segment).isin(list(budgets)))
    sizes = df.groupBy(segment).agg(F.count("*").alias("total"))  # as many rows as there are budgets
    ranked = df.withColumn("rank", F.row_number().over(W.partitionBy(segment).orderBy(*order))).where(F.col("rank") <= max(budgets.values())).where(F.col("rank") <= most)
    return ranked.join(F.broadcast(sizes), segment).select(segment, "id", "rank", F.greatest(F.col("total") - most, F.lit(0)).cast("long").alias("truncated"))


def around(df: DataFrame, anchor: Column, depth: int, key: str, *order: str) -> DataFrame:
    """The rows up to `depth` places before and after anchor rows, in the order of each key."""
    w = W.partitionBy(key).orderBy(*order)
    marked = df.withColumn("place", F.row_number().over(w)).withColumn("_hit", anchor.cast("int"))
    near = F.max("_hit").over(w.rowsBetween(-depth, depth))
    return marked.withColumn("_near", near).where(F.col("_near") == 1).drop("_near", "_hit")


def line_context(df: DataFrame, key: str, order: str, text: str, hit: Column, reach: int = 3, bucket: int = 5) -> DataFrame:
    """key, line, context: for the first hit of every `bucket` lines, the lines around it joined."""
    w = W.partitionBy(key).orderBy(order)
    lines = df.withColumn("line", F.row_number().over(w) - 1).withColumn("context", F.concat_ws("\n", F.collect_list(text).over(w.rowsBetween(-reach, reach))))
    first = W.partitionBy(key, F.floor(F.col("line") / bucket)).orderBy("line")
    return lines.where(hit).withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, F.col("line").cast("int").alias("line"), "context")


def select_unique(df: DataFrame, match: Column, key: Column, limit: int, *order) -> DataFrame:
    """The first `limit` rows that match, one for each key, in the given order."""
    one = df.where(match).withColumn("_k", key).withColumn("_r", F.row_number().over(W.partitionBy("_k").orderBy(*order))).where("_r = 1")
    return one.orderBy(*order).limit(limit).drop("_k", "_r")


# fixed values: words and states that put a record into a section of a handoff, and the sections' limits
HANDOFF_WORDS = {
    "rule": r"\bmust\b|\balways\b|\bshould\b|不要|必须|避免",
    "done": r"\bcompleted\b|\bvalidated\b|\bpassed\b|\bfinished\b|完成|已验证",
    "next": r"\bnext\b|\btodo\b|\bfollow[- ]?up\b|\bcontinue\b|待办|下一步|继续",
    "blocked": r"\bblocked\b|\bfailed\b|\berror\b|\btimeout\b|阻塞|失败|报错",
}
HANDOFF_STATES = {"done": ["ok", "pr_submitted", "done", "completed"], "next": ["pending", "processing", "active", "queued"], "blocked": ["failed", "error", "timeout", "blocked"]}
HANDOFF_LIMITS = {"tool_invariants": 8, "goal": 1, "done": 6, "next": 6, "blocked": 5, "open_threads": 8}


def handoff(df: DataFrame, newest: int = 300) -> DataFrame:
    """section, id, title, rank of a handoff pack over the newest records (id, tool, scope, type, source, task_state, title, content, t_ms).

    Records without title and content are passed over, and those of one tool and title count once in a section. Without a
    goal the newest record is one. Open threads are those of next and blocked that are tasks or runs, then any others.
    """
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("content", F.lit("")))
    name = F.coalesce(*(F.when(F.coalesce(F.col(c), F.lit("")) != "", normalize_spaces(c)) for c in ("title", "content")), F.col("id"))
    recent = df.where(F.trim(text) != "").orderBy(F.desc("t_ms"), "id").limit(newest).withColumn("place", F.row_number().over(W.orderBy(F.desc("t_ms"), "id")))
    rows = recent.select("id", "title", "place", low("tool").alias("tool"), low("scope").alias("scope"), low("type").alias("type"), low("source").alias("source"), low("task_state").alias("state"), F.lower(text).alias("hay"), F.lower(F.concat(F.coalesce("tool", F.lit("")), F.lit("|"), name)).alias("key"))
    says = lambda k: F.col("hay").rlike(HANDOFF_WORDS[k])
    is_ = lambda k: F.col("state").isin(HANDOFF_STATES[k]) | says(k)
    personal = F.col("scope").isin("feedback", "user")
    parts = [
        ("tool_invariants", 0, personal | (F.col("type") == "workflow-rule") | ((F.col("source") == "shared-inbox") & says("rule"))),
        ("goal", 0, (F.col("tool") != "openclaw") & F.col("scope").isin("summary", "project", "reference") & (F.col("type") != "workflow-rule")), ("goal", 1, F.col("place") == 1),
        ("done", 0, is_("done")), ("next", 0, is_("next") & ~personal), ("blocked", 0, is_("blocked")),
    ]

    def first(rows: DataFrame) -> DataFrame:
        once = rows.withColumn("_n", F.row_number().over(W.partitionBy("section", "key").orderBy("part", "place"))).where("_n = 1").drop("_n")
        ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("section").orderBy("part", "place")))
        return ranked.where(F.col("rank") <= first_case([(F.col("section") == k, v) for k, v in HANDOFF_LIMITS.items()], 0))

    sections = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("section"), F.lit(p).alias("part"))) for s, p, c in parts)))
    chosen = first(rows.select("*", F.inline(sections)))
    threads = chosen.where(F.col("section").isin("next", "blocked")).withColumn("part", F.when(F.col("section") == "next", 0).otherwise(1)).drop("rank", "section")
    threads = threads.unionByName(rows.withColumn("part", F.lit(2))).withColumn("section", F.lit("open_threads"))
    tasks = F.col("scope").isin("task", "run") | F.col("type").isin("task-state", "task-run")
    return chosen.unionByName(first(threads.where(tasks)), allowMissingColumns=True).select("section", "id", "title", "rank")


def files_of(df: DataFrame, column: str = "files", most: int = 12) -> DataFrame:
    """file, rank of the first files by the order in which records (seq, files) name them, each once."""
    seen = df.select("seq", F.posexplode(column).alias("pos", "file")).where(F.trim("file") != "").groupBy("file").agg(F.min(F.struct("seq", "pos")).alias("at"))
    return seen.orderBy("at").limit(most).withColumn("rank", F.row_number().over(W.orderBy("at"))).select("file", "rank")


def compact_unique(df: DataFrame, column: str, most: int, length: int) -> DataFrame:
    """text, rank: the items of an array column in row order (seq), cut to `length`, once regardless of case, the first `most`."""
    items = df.select("seq", F.posexplode(column).alias("pos", "text")).select("seq", "pos", F.when(F.length("text") > length, F.concat(F.substring("text", 1, length - 1), F.lit("…"))).otherwise(F.col("text")).alias("text")).where(F.trim("text") != "")
    once = items.groupBy(F.lower("text").alias("_k")).agg(F.min(F.struct("seq", "pos", "text")).alias("at"))
    return once.orderBy("at").limit(most).select("at.text", F.row_number().over(W.orderBy("at")).alias("rank"))


def freshness_order(age_ms: Column) -> Column:
    """3 for hot, 2 for warm, 1 for cold, 0 for unknown."""
    f = freshness(age_ms)
    return first_case([(f == "hot", 3), (f == "warm", 2), (f == "cold", 1)], 0)


def hit_rate(log: DataFrame, kind: str = "event_type", hit: str = "hit", miss: str = "miss") -> DataFrame:
    """hits, misses, rate of a cache log."""
    found = log.agg(F.count_if(F.col(kind) == hit).alias("hits"), F.count_if(F.col(kind) == miss).alias("misses"))
    return found.withColumn("rate", F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(0.0))


def regression(now: DataFrame, before: DataFrame, warn: float = -0.05, fail: float = -0.10) -> DataFrame:
    """metric, now, before, delta, verdict of two metric tables (metric, value)."""
    both = now.select("metric", F.col("value").alias("now")).join(before.select("metric", F.col("value").alias("before")), "metric")
    delta = F.col("now") - F.col("before")
    return both.withColumn("delta", delta).withColumn("verdict", first_case([(delta <= fail, "fail"), (delta <= warn, "warn")], "ok"))


def prometheus(metrics: DataFrame) -> DataFrame:
    """line: text exposition of metrics (name, kind, label, value), sorted by name and label."""
    labels = F.when(F.coalesce(F.col("label"), F.lit("")) == "", "").otherwise(F.concat(F.lit("{"), F.col("label"), F.lit("}")))
    return metrics.orderBy("name", "label").select(F.concat(F.col("name"), labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def markdown_pages(df: DataFrame, key: str, lines: int = 500) -> DataFrame:
    """key, part, page: a line for each record (id, title) of a key, in order of ids, in parts of `lines` lines.

    Places in a key count from its first place in the whole order, so a key of any size is spread.
    """
    placed = positions(df.select(key, "id", "title"), F.asc(key), F.asc("id"))
    begin = placed.groupBy(F.col(key).alias("_of")).agg(F.min("position").alias("_first"))
    place = F.col("position") - F.col("_first")
    ranked = placed.join(begin, F.col(key).eqNullSafe(F.col("_of"))).select(key, "id", "title", place.alias("_r"), F.floor(place / lines).alias("_part"))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("id"), F.lit(".md)"))
    pages = ranked.groupBy(key, "_part").agg(F.sort_array(F.collect_list(F.struct("_r", line.alias("line")))).alias("l"))
    mark = F.when(F.col("_part") > 0, F.concat(F.lit(" ("), (F.col("_part") + 1).cast("string"), F.lit(")"))).otherwise("")
    page = F.concat(F.lit("# "), F.col(key), mark, F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return pages.select(key, (F.col("_part") + 1).alias("part"), page.alias("page"))


def p95(values: Column) -> Column:
    return value_at(values, 0.95)
