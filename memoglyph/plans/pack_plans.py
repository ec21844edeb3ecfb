"""Projections, packs, importers and lookups."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memoglyph.functions import classify as C
from memoglyph.operators import packs as P
from memoglyph.operators.lifecycle import shared_folder
from memoglyph.plans.catalog import query
from memoglyph.sources import external, jsonl, texts as T
from memoglyph.sources.commits import Store, dual_write
from memoglyph.sources.lookup import Lookup
from memoglyph.views import AS_OF_MS, DAY_MS, records, signature, table

#: Of written stores; those of another one are made anew.
FORMAT = 1


@query("prefix_scan", " SELECT id FROM records WHERE starts_with(id, 'r1')", records=True)
def prefix(spark, sf):
    return jsonl.prefix(records(spark, sf), "r1").select("id")


@query("point_lookup", " SELECT id, md5(content) AS digest FROM records WHERE id = 'r7'", records=True)
def point(spark, sf):
    return jsonl.point(records(spark, sf), "r7").select("id", F.md5("content").alias("digest"))


@query("ordered_lookup", " SELECT place, r.id FROM (VALUES (0, 'r5'), (1, 'missing'), (2, 'r3')) v(place, id) JOIN records r ON r.id = v.id", records=True)
def lookup(spark, sf):
    return jsonl.in_order(records(spark, sf).select("id"), ["r5", "missing", "r3"])


@query("run_ledger", "SELECT event_id FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 120")
def ledger(spark, sf):
    return P.last_rows(table(spark, sf, "events").where("event_type = 'purchase'"), 120, F.desc("ts"), "event_id").select("event_id")


@query("recent_sessions", "SELECT conv_id, max(turn) AS turns FROM conversations GROUP BY conv_id ORDER BY turns DESC, conv_id LIMIT 6")
def sessions(spark, sf):
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turns"))
    return P.last_rows(g, 6, F.desc("turns"), "conv_id")


@query("session_summaries", "WITH a AS (SELECT conv_id, max(turn) AS t, 'editor' AS kind FROM conversations WHERE role = 'user' GROUP BY 1), b AS (SELECT conv_id, max(turn) AS t, 'cli' AS kind FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT conv_id, t, kind FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY t DESC, conv_id, kind LIMIT 8")
def summaries(spark, sf):
    c = table(spark, sf, "conversations")
    of = lambda role, kind: c.where(F.col("role") == role).groupBy("conv_id").agg(F.max("turn").alias("t")).withColumn("kind", F.lit(kind))
    return P.last_rows(T.union_sources([(of("user", "editor"), {}), (of("assistant", "cli"), {})]), 8, F.desc("t"), "conv_id", "kind")


@query("cli_sessions", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) SELECT conv_id, arg_max(md5(text), turn) FILTER (role = 'assistant') AS model, arg_max(md5(text), turn) FILTER (role = 'user') AS message FROM r WHERE n <= 40 GROUP BY conv_id")
def cli(spark, sf):
    kind = F.when(F.col("role") == "assistant", "model").when(F.col("role") == "user", "user").otherwise("other")
    e = table(spark, sf, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line"), kind.alias("kind"), F.md5("text").alias("value"))
    return T.latest_of(e).withColumnRenamed("session", "conv_id")


@query("last_prompts", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY conv_id DESC, turn DESC) AS r FROM conversations) WHERE r <= 8")
def prompts(spark, sf):
    return P.last_rows(table(spark, sf, "conversations"), 8, F.desc("conv_id"), F.desc("turn"), keys=["role"]).select("conv_id", "turn")


@query("newest_files", "SELECT doc_id FROM documents WHERE source IN (SELECT DISTINCT source FROM documents ORDER BY source DESC LIMIT 2)")
def newest(spark, sf):
    return T.newest_files(table(spark, sf, "documents").select("doc_id", "source"), 2, "source").select("doc_id")


@query("ring_buffer", "SELECT event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 100")
def ring(spark, sf):
    return P.last_rows(table(spark, sf, "events"), 100, F.desc("ts"), F.desc("event_id"), keys=["event_type"]).select("event_id")


@query("fallback_union", "SELECT 'main' AS origin, count(*)::BIGINT AS n FROM benchmark UNION ALL SELECT 'other', count(*) FROM labels WHERE false HAVING count(*) > 0")
def fallback(spark, sf):
    row = lambda t, name: table(spark, sf, t).select(F.lit(name).alias("origin"))
    return P.first_or_else(row("benchmark", "main"), row("labels", "other")).groupBy("origin").agg(F.count("*").alias("n"))


@query("fallback_union_empty", "SELECT 'other' AS origin, count(*)::BIGINT AS n FROM labels")
def fallback_empty(spark, sf):
    row = lambda t, name: table(spark, sf, t).select(F.lit(name).alias("origin"))
    return P.first_or_else(row("benchmark", "main").where("false"), row("labels", "other")).groupBy("origin").agg(F.count("*").alias("n"))


@query("pattern_match", r" SELECT sum(regexp_matches(title || chr(10) || content, '\blicense|\bpassword')::INT)::BIGINT AS n FROM records", records=True)
def pattern(spark, sf):
    return records(spark, sf).agg(F.count_if(P.any_pattern([r"\blicense", r"\bpassword"], F.col("title"), F.col("content"))).alias("n"))


@query("orphaned_records", "SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_custkey % 7 = 0")
def orphaned(spark, sf):
    path = lambda c: F.concat(F.lit("/f/"), F.col(c).cast("string"))
    r = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.array(F.struct(path("o_custkey").alias("path"))).alias("files"))
    return P.orphans(r, table(spark, sf, "customer").where("c_custkey % 7 <> 0").select(path("c_custkey").alias("path")))


@query("write_check", ", n AS (SELECT * FROM records ORDER BY t_ms DESC, id LIMIT 25) SELECT r.id FROM records r WHERE (r.content, r.title) IN (SELECT (content, title) FROM n)", records=True)
def write_check(spark, sf):
    return P.written(records(spark, sf), records(spark, sf).select("id", "content", "title")).select("id")


@query("expires_at", f" SELECT id, CASE WHEN scope = 'user' THEN NULL ELSE t_ms + CASE scope WHEN 'feedback' THEN 90 WHEN 'project' THEN 30 WHEN 'reference' THEN 180 ELSE 7 END * {DAY_MS}::BIGINT END AS expires FROM records", records=True)
def expires(spark, sf):
    return records(spark, sf).select("id", P.expires_ms(F.col("t_ms"), F.col("scope")).alias("expires"))


@query("date_partitions", "SELECT strftime(ts, '%Y-%m') AS month, strftime(ts, '%Y-%m-%d') AS day, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def dates(spark, sf):
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf, "events").groupBy(F.substring(day, 1, 7).alias("month"), day.alias("day")).agg(F.count("*").alias("n"))


@query("result_format", ", x AS (SELECT id, title, content, row_number() OVER (ORDER BY confidence DESC, id) AS r, confidence / 3 AS s FROM records) SELECT r::INTEGER AS rank, id, round(s, 6) AS score, substr(title, 1, 120) AS title, md5(substr(content, 1, 240)) AS excerpt, floor((length(title) + length(content)) / 4)::BIGINT AS est_tokens FROM x WHERE r <= 20", records=True)
def result_format(spark, sf):
    from pyspark.sql import Window as W

    top = records(spark, sf).orderBy(F.desc("confidence"), "id").limit(20).withColumn("rank", F.row_number().over(W.orderBy(F.desc("confidence"), "id")))
    return P.formatted(top.withColumn("score", F.col("confidence") / 3).withColumn("search_text", F.col("title"))).withColumn("excerpt", F.md5("excerpt"))


@query("compact_results", " SELECT id, substr(title, 1, 120) AS title, CASE WHEN length(content) > 200 THEN rtrim(substr(content, 1, 197)) || '...' ELSE content END AS summary FROM records", records=True)
def compact(spark, sf):
    return P.compact(records(spark, sf))


@query("boot_context", ", f AS (SELECT num, title FROM records WHERE num % 9 <> 0 ORDER BY num DESC LIMIT 20) SELECT md5(substr(string_agg('- ' || title, chr(10) ORDER BY num DESC), 1, 32768)) AS digest FROM f", records=True)
def boot(spark, sf):
    f = records(spark, sf).select(F.col("num").alias("line"), F.col("title").alias("fact"), (F.col("num") % 9 == 0).alias("extraction_failed"))
    return P.boot_context(f).select(F.md5("context").alias("digest"))


@query("summary_boost", " SELECT id, round(confidence + CASE WHEN scope = 'summary' THEN 0.05 ELSE 0 END + CASE WHEN source_kind = 'session' THEN 0.03 ELSE 0 END, 6)::DOUBLE AS score FROM records", records=True)
def boost(spark, sf):
    return records(spark, sf).select("id", F.round(P.summary_boost(F.col("confidence"), F.col("scope"), F.col("source_kind")), 6).alias("score"))


_FILES = ["shared-inbox.jsonl", "session-memory.jsonl", "task-memory.jsonl", "claude-code.jsonl", "openclaw.jsonl", "openclaw-blackboard.jsonl", "openclaw-runs.jsonl", "openclaw-jobs.jsonl", "openclaw-journal.jsonl"]


@query("expected_pairs", f""", x AS (SELECT DISTINCT ['{"', '".join(_FILES)}'][num % 9 + 1] AS a, ['{"', '".join(_FILES)}'][num // 9 % 9 + 1] AS b FROM records)
SELECT a, b, (a = 'session-memory.jsonl' AND b IN ('claude-code.jsonl', 'openclaw.jsonl')) OR (b = 'session-memory.jsonl' AND a IN ('claude-code.jsonl', 'openclaw.jsonl'))
  OR (a = 'task-memory.jsonl' AND b IN ('openclaw-blackboard.jsonl', 'openclaw-runs.jsonl', 'openclaw-jobs.jsonl', 'openclaw-journal.jsonl')) OR (b = 'task-memory.jsonl' AND a IN ('openclaw-blackboard.jsonl', 'openclaw-runs.jsonl', 'openclaw-jobs.jsonl', 'openclaw-journal.jsonl')) AS expected FROM x""", records=True)
def pairs(spark, sf):
    pick = lambda n: F.element_at(F.array(*(F.lit(x) for x in _FILES)), (n % 9 + 1).cast("int"))
    x = records(spark, sf).select(pick(F.col("num")).alias("a"), pick(F.floor(F.col("num") / 9)).alias("b")).distinct()
    return x.select("a", "b", C.is_expected_pair(F.col("a"), F.col("b")).alias("expected"))


@query("artifact_state", f" SELECT CASE WHEN num % 4 = 0 THEN CASE WHEN num % 8 = 0 THEN 'current' ELSE 'stale-signature' END WHEN num % 4 = 1 THEN CASE WHEN num % 5 = 0 THEN 'current' ELSE 'stale-hash' END WHEN access_ms IS NULL THEN 'missing' WHEN access_ms >= t_ms THEN 'current' ELSE 'stale-time' END AS state, count(*)::BIGINT AS n FROM records GROUP BY 1", records=True)
def artifacts(spark, sf):
    n = F.col("num")
    state = C.artifact_state(F.when(n % 4 == 0, "s"), F.when(n % 8 == 0, "s").when(n % 4 == 0, "t"), F.when(n % 4 == 1, "h"), F.when((n % 4 == 1) & (n % 5 == 0), "h").when(n % 4 == 1, "g"), F.col("access_ms"), F.col("t_ms"))
    return records(spark, sf).groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("agent_sections", ", x AS (SELECT tool AS agent, CASE num % 3 WHEN 0 THEN 'durable' WHEN 1 THEN 'imported' ELSE 'inbox' END AS kind, num AS seq, title AS text, lower(trim(title)) AS k FROM records), a AS (SELECT *, row_number() OVER (PARTITION BY agent, kind, k ORDER BY seq) AS r FROM x), b AS (SELECT *, row_number() OVER (PARTITION BY agent, kind ORDER BY seq) AS q FROM a WHERE r = 1), c AS (SELECT *, CASE kind WHEN 'durable' THEN 'durable' ELSE 'working' END AS section, (kind = 'inbox')::INT AS o FROM b WHERE q <= CASE kind WHEN 'durable' THEN 6 WHEN 'imported' THEN 4 ELSE 3 END), d AS (SELECT *, row_number() OVER (PARTITION BY agent, section, k ORDER BY o, seq) AS z FROM c), e AS (SELECT *, row_number() OVER (PARTITION BY agent, section ORDER BY o, seq) AS place FROM d WHERE z = 1) SELECT agent, section, text, place::INTEGER AS place FROM e WHERE place <= 6", records=True)
def sections(spark, sf):
    kind = F.element_at(F.array(F.lit("durable"), F.lit("imported"), F.lit("inbox")), (F.col("num") % 3 + 1).cast("int"))
    return P.agent_sections(records(spark, sf).select(F.col("tool").alias("agent"), kind.alias("kind"), F.col("num").alias("seq"), F.col("title").alias("text")))


@query("global_context", ", x AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY t_ms DESC, id) AS r FROM records WHERE scope IN ('user', 'project')) SELECT scope, '- ' || CASE WHEN length(title) > 60 THEN rtrim(substr(title, 1, 57)) || '...' ELSE title END AS line FROM x WHERE r <= 3", records=True)
def context(spark, sf):
    return P.global_context(records(spark, sf), ["user", "project"])


@query("overview", f" SELECT count(*)::BIGINT AS records, sum((task_state <> '' AND task_state NOT IN ('completed', 'aborted', 'failed'))::INT)::BIGINT AS open_tasks, sum(({AS_OF_MS} - t_ms <= {DAY_MS})::INT)::BIGINT AS hot, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM records", records=True)
def overview(spark, sf):
    return P.overview(records(spark, sf), AS_OF_MS)


@query("routing_evaluation", "WITH e AS (SELECT event_type, (user_id % 5)::BIGINT AS route, round(avg(value), 6) AS score, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT event_type, arg_max(route, score) AS best, round(max(score), 6) AS score FROM e GROUP BY 1) SELECT event_type, best, score FROM b")
def routing(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 5).alias("route")).agg(F.round(F.avg("value"), 6).alias("score"))
    return e.groupBy("event_type").agg(F.max_by("route", "score").alias("best"), F.max("score").alias("score"))


@query("composite_score", " SELECT id, round(0.3 * confidence + 0.25 * freshness_score + 0.2 * (access_count / 30.0) + 0.15 * (promotion_count / 4.0) + 0.1 * (cross_refs / 6.0), 6)::DOUBLE AS score FROM records", records=True)
def composites(spark, sf):
    return records(spark, sf).select("id", F.round(P.composite({"a": F.col("confidence"), "b": F.col("freshness_score"), "c": F.col("access_count") / 30, "d": F.col("promotion_count") / 4, "e": F.col("cross_refs") / 6}), 6).alias("score"))


@query("pre_annotation", "WITH r AS (SELECT label AS query, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rank FROM embeddings) SELECT query::VARCHAR AS query, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids FROM r WHERE rank <= 10 AND query % 2 = 0 GROUP BY query")
def annotation(spark, sf):
    from pyspark.sql import Window as W

    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("query"), F.col("vec_id").alias("id"), F.row_number().over(W.partitionBy("label").orderBy("vec_id")).alias("rank"), F.lit(1.0).alias("score"))
    q = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("query"), (F.col("label") % 2 == 1).alias("annotated")).distinct()
    return P.pre_annotations(q, e).select("query", F.array_join(F.transform("proxies", lambda p: p["id"].cast("string")), ",").alias("ids"))


@query("event_windows", "SELECT epoch_ms(time_bucket(INTERVAL 1 HOUR, ts)) AS start_ms, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def windows(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return g.select(F.unix_millis("w.start").alias("start_ms"), "event_type", "n")


@query("dual_projection", " SELECT 'canonical' AS projection, source_kind, count(*)::BIGINT AS n FROM records GROUP BY ALL UNION ALL SELECT 'compat', 'none', count(*)::BIGINT FROM records", records=True)
def dual_projection(spark, sf):
    """Records committed as two projections in two batches, of which one comes twice: what the store then has."""
    store = Store(spark, f"{shared_folder(spark)}/dual-{uuid.uuid4().hex}")
    rows = records(spark, sf)
    halves = [rows.where(F.col("source_kind").isin("hook", "run")), rows.where(~F.col("source_kind").isin("hook", "run"))]
    for batch in (0, 1, 1):
        dual_write(store, halves[batch], stream="records", batch=batch)
    whole = store.read("canonical").groupBy("source_kind").agg(F.count("*").alias("n")).select(F.lit("canonical").alias("projection"), "source_kind", "n")
    return whole.unionByName(store.read("compatible").groupBy("projection").agg(F.count("*").alias("n")).select("projection", F.lit("none").alias("source_kind"), "n"))


#: Items as another program keeps them, of the record of a document: fields of many forms, some missing.
_ITEM = {
    "id": "num",
    "project": "CASE num % 4 WHEN 0 THEN NULL WHEN 1 THEN 'home' ELSE project END",
    "type": "CASE WHEN num % 5 = 4 THEN NULL ELSE type END",
    "title": "CASE WHEN num % 3 = 0 THEN NULL ELSE title END",
    "content": "content",
    "facts": "CASE num % 4 WHEN 0 THEN concat('[\"', tool, '\",\"', id, '\"]') WHEN 1 THEN concat(' ', id, ' ') WHEN 2 THEN concat('\"', tool, '\"') ELSE NULL END",
    "created_at": "CASE WHEN num % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE NULL END",
    "t": "'2023-01-01T00:00:00Z'",
    "memory_session_id": "CASE WHEN num % 2 = 0 THEN session ELSE '' END",
    "session": "id",
}


def _observations(spark, sf):
    """A folder store with an item a document, written when the table is first met in its present state."""
    path = f"{shared_folder(spark)}/observations{FORMAT}-{signature(spark, sf, 'documents')}"
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{1:012d}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        external.write_pages(records(spark, sf).selectExpr(*(f"{e} AS {c}" for c, e in _ITEM.items())), path, 1)
    external.register(spark)
    return spark.read.format(external.FORMAT).option("path", path).load()


@query("external_records", r""", i AS (SELECT num, id AS rid, tool, session, project AS own, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c, trim(regexp_replace(title, '\s+', ' ', 'g')) AS tt, CASE WHEN num % 5 = 4 THEN '' ELSE type END AS kind,
  CASE num % 4 WHEN 0 THEN '' WHEN 1 THEN 'home' ELSE project END AS project FROM records),
c AS (SELECT *, CASE WHEN c <> '' THEN c WHEN num % 3 = 0 THEN '' ELSE tt END AS content FROM i)
SELECT CAST(num AS VARCHAR) AS id, CASE WHEN num % 2 = 0 THEN '2024-01-01T00:00:00Z' ELSE '2023-01-01T00:00:00Z' END AS t, CASE WHEN num % 2 = 0 THEN session ELSE rid END AS session, CASE WHEN kind = '' THEN 'memory' ELSE kind END AS type, project,
  md5(CASE WHEN num % 3 <> 0 AND tt <> '' THEN tt WHEN content <> '' THEN content ELSE CAST(num AS VARCHAR) END) AS title, sha256(content) AS content_hash,
  CASE num % 4 WHEN 0 THEN tool || ',' || rid WHEN 1 THEN rid WHEN 2 THEN tool ELSE '' END AS facts,
  CASE WHEN regexp_matches(kind, 'preference|decision|workflow|rule') THEN 'feedback' WHEN project NOT IN ('', 'home') THEN 'project' ELSE 'summary' END AS scope, CASE WHEN project = '' THEN 'import' ELSE project END AS workspace
FROM c""", records=True)
def external_records(spark, sf):
    r = external.structured(_observations(spark, sf), "notes", home="home")
    return r.select("id", "t", "session", "type", "project", F.md5("title").alias("title"), "content_hash", F.array_join("facts", ",").alias("facts"), "scope", "workspace")


@query("external_by_project", " SELECT project, count(*)::BIGINT AS n FROM records WHERE num % 4 >= 2 AND project IN ('p1', 'p3') GROUP BY project", records=True)
def external_by_project(spark, sf):
    return _observations(spark, sf).where("project IN ('p1', 'p3')").groupBy("project").agg(F.count("*").alias("n"))


@query("pruned_lookup", " SELECT id, md5(content) AS digest FROM records WHERE id IN ('r7', 'r50', 'r123', 'r999999999')", records=True)
def pruned_lookup(spark, sf):
    store = Lookup(spark, f"{shared_folder(spark)}/lookup{FORMAT}-{signature(spark, sf, 'documents')}")
    if not store.store.has("bounds"):
        store.build(records(spark, sf).select("id", "content"))
    return store.get(["r7", "r50", "r123", "r999999999"]).select("id", F.md5("content").alias("digest"))
