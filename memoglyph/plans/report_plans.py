"""Counts, health, budgets, histograms, packs and importers."""

from __future__ import annotations

from pyspark.sql import functions as F

from memoglyph.functions import classify as C
from memoglyph.operators import lifecycle as L, reports as R
from memoglyph.plans.catalog import query
from memoglyph.schema import SCOPES
from memoglyph.sources import texts as T
from memoglyph.views import AS_OF_MS, DAY_MS, records, table


@query("counts_by_layer", ", x AS (SELECT CASE WHEN memory_level = 'durable' OR source_kind = 'writeback' THEN 'durable' WHEN source_kind IN ('hook', 'event') OR memory_level = 'event' THEN 'event' ELSE 'session' END AS layer FROM records) SELECT k.layer, count(x.layer)::BIGINT AS n FROM (VALUES ('durable'), ('session'), ('event'), ('task')) k(layer) LEFT JOIN x ON x.layer = k.layer GROUP BY k.layer", records=True)
def by_layer(spark, sf):
    layer = C.layer("memory_level", "source_kind", "scope")
    rows = records(spark, sf).select(F.when(layer == "task", "session").otherwise(layer).alias("layer"))
    return R.counts_with_zeros(rows, "layer", ["durable", "session", "event", "task"])


@query("counts_by_scope", " SELECT CASE WHEN num % 9 = 0 THEN 'summary' ELSE scope END AS scope, count(*)::BIGINT AS n FROM records GROUP BY 1", records=True)
def by_scope(spark, sf):
    return R.count_map(records(spark, sf).withColumn("scope", F.when(F.col("num") % 9 == 0, " ").otherwise(F.col("scope"))), "scope", "summary")


@query("counts_by_state", " SELECT task_state, count(*)::BIGINT AS n FROM records WHERE task_state <> '' GROUP BY 1", records=True)
def by_state(spark, sf):
    return R.count_map(records(spark, sf), "task_state")


@query("counts_grouping_sets", " SELECT 'scope' AS dimension, scope AS value, count(*)::BIGINT AS n FROM records GROUP BY scope UNION ALL SELECT 'tool', tool, count(*) FROM records GROUP BY tool UNION ALL SELECT 'memory_level', memory_level, count(*) FROM records GROUP BY memory_level UNION ALL SELECT 'tier', coalesce(tier::VARCHAR, 'unknown'), count(*) FROM records GROUP BY 2", records=True)
def grouping(spark, sf):
    return R.grouped_counts(records(spark, sf), ["scope", "tool", "memory_level", "tier"])


_HYGIENE = f"""
, x AS (SELECT *, CASE WHEN num % 50 = 0 THEN '' ELSE 'h' END AS h, CASE WHEN num % 97 = 0 THEN 'team' ELSE scope END AS sc, ({AS_OF_MS} - t_ms) / 86400000.0 AS age FROM records),
h AS (SELECT count(*)::BIGINT AS total, sum((h = '')::INT)::BIGINT AS missing_hash, sum((trim(title) = '')::INT)::BIGINT AS missing_title, sum((sc = '')::INT)::BIGINT AS missing_scope, sum((sc = 'team')::INT)::BIGINT AS invalid_scopes, sum((source_kind = 'writeback')::INT)::BIGINT AS promoted,
  sum((age <= 7)::INT)::BIGINT AS last_7_days, sum((age > 7 AND age <= 30)::INT)::BIGINT AS last_30_days, sum((age > 90)::INT)::BIGINT AS older_than_90_days, (count(*) - count(DISTINCT id))::BIGINT AS duplicate_ids FROM x)"""


def _hygiene(spark, sf):
    rows = records(spark, sf).withColumn("content_hash", F.when(F.col("num") % 50 == 0, "").otherwise("h")).withColumn("scope", F.when(F.col("num") % 97 == 0, "team").otherwise(F.col("scope")))
    return R.hygiene(rows, AS_OF_MS, SCOPES)


@query("hygiene_counters", _HYGIENE + " SELECT * FROM h", records=True)
def hygiene(spark, sf):
    return _hygiene(spark, sf)


@query("health_score", _HYGIENE + ", s AS (SELECT *, greatest(0, least(100, CASE WHEN total = 0 THEN 100 ELSE 100 - least(missing_hash * 5, 20) - least(missing_title * 5, 10) - least(invalid_scopes * 5, 15) - least(least(duplicate_ids, 12) * 3, 15) - CASE WHEN older_than_90_days / total::DOUBLE > 0.1 THEN 10 ELSE 0 END - CASE WHEN last_7_days = 0 THEN 5 ELSE 0 END END + 10))::INTEGER AS score FROM h) SELECT score, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C' WHEN score >= 40 THEN 'D' ELSE 'F' END AS grade FROM s", records=True)
def health(spark, sf):
    return R.health(_hygiene(spark, sf), index_ok=True).select("score", "grade")


@query("recommendations", _HYGIENE + " SELECT 'medium' AS severity, 'missing-content-hash' AS issue FROM h WHERE missing_hash > 0 UNION ALL SELECT 'low', 'missing-title' FROM h WHERE missing_title > 0 UNION ALL SELECT 'medium', 'invalid-scope' FROM h WHERE invalid_scopes > 0 UNION ALL SELECT 'high', 'duplicate-ids' FROM h WHERE duplicate_ids > 0 UNION ALL SELECT 'low', 'many-old-records' FROM h WHERE older_than_90_days / total::DOUBLE > 0.1 UNION ALL SELECT 'medium', 'no-recent-records' FROM h WHERE last_7_days = 0", records=True)
def recommend(spark, sf):
    return R.recommendations(_hygiene(spark, sf))


@query("tier_budgets", ", x AS (SELECT coalesce(tier, 1) AS tier, count(*) AS n FROM records GROUP BY 1) SELECT b.tier, coalesce(x.n, 0)::BIGINT AS n, b.most, coalesce(x.n, 0) > b.most AS over FROM (VALUES (1, 200), (2, 200), (3, 100), (4, 200), (5, 500)) b(tier, most) LEFT JOIN x ON x.tier = b.tier", records=True)
def budgets(spark, sf):
    return R.tier_budgets(records(spark, sf))


@query("cold_tier_4", " SELECT sum(((tier IS NULL OR tier = 4) AND access_count = 0)::INT)::BIGINT AS n FROM records", records=True)
def cold(spark, sf):
    return R.cold_in_tier_4(records(spark, sf))


@query("layer_integrity", ", x AS (SELECT memory_level AS layer, id, num % 10 <> 0 AS ok, t_ms FROM records), b AS (SELECT layer, id, row_number() OVER (PARTITION BY layer ORDER BY id) AS r FROM x WHERE NOT ok) SELECT x.layer, count(*)::BIGINT AS n, sum(ok::INT)::BIGINT AS valid, sum((NOT ok)::INT)::BIGINT AS invalid, max(t_ms) AS newest, (SELECT string_agg(id, ',' ORDER BY id) FROM b WHERE b.layer = x.layer AND r <= 12) AS samples FROM x GROUP BY x.layer", records=True)
def integrity(spark, sf):
    rows = records(spark, sf).select(F.col("memory_level").alias("layer"), "id", (F.col("num") % 10 != 0).alias("ok"), "t_ms")
    return R.layer_summary(rows).withColumn("samples", F.array_join("samples", ","))


@query("index_state", "SELECT count(*)::BIGINT AS n, count(DISTINCT label)::BIGINT AS configs, CASE WHEN count(*) = 0 THEN 'missing' WHEN count(DISTINCT label) = 0 THEN 'unknown' WHEN count(DISTINCT label) > 1 THEN 'mixed' ELSE 'aligned' END AS state FROM embeddings")
def index(spark, sf):
    return R.index_state(table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("config")))


@query("token_sums", " SELECT count(*)::BIGINT AS n, sum(ceil(length(content) / 4.0))::BIGINT AS tokens FROM records", records=True)
def token_sums(spark, sf):
    return R.token_estimates(records(spark, sf))


@query("p95_by_index", "WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY event_type) SELECT event_type, len(v)::BIGINT AS n, round(list_avg(v), 6) AS mean, v[1 + least(floor(len(v) * 0.5), len(v) - 1)::BIGINT] AS p50, v[1 + least(floor(len(v) * 0.95), len(v) - 1)::BIGINT] AS p95 FROM s")
def p95(spark, sf):
    return R.latency(table(spark, sf, "events"), "value", {"p50": 0.5, "p95": 0.95}, "event_type").withColumn("mean", F.round("mean", 6))


@query("latency_histogram", "SELECT le, (SELECT count(*) FROM events WHERE value <= le)::BIGINT AS n FROM (VALUES (5.0::DOUBLE), (25.0), (100.0), (500.0)) b(le) UNION ALL SELECT NULL, count(value) FROM events")
def histogram(spark, sf):
    return R.cumulative_histogram(table(spark, sf, "events"), "value", [5, 25, 100, 500])


@query("topn_per_scope", " SELECT id, scope, r::INTEGER AS rank FROM (SELECT id, scope, row_number() OVER (PARTITION BY scope ORDER BY t_ms DESC, id) AS r FROM records) WHERE r <= 3", records=True)
def topn(spark, sf):
    return L.top_per_key(records(spark, sf), ["scope"], 3, F.desc("t_ms"), "id").select("id", "scope", "rank")


@query("budgeted_segments", ", x AS (SELECT id, memory_level AS segment, row_number() OVER (PARTITION BY memory_level ORDER BY t_ms DESC, id) AS r, count(*) OVER (PARTITION BY memory_level) AS n, CASE memory_level WHEN 'durable' THEN 5 ELSE 8 END AS b FROM records) SELECT segment, id, r::INTEGER AS rank, greatest(n - b, 0)::BIGINT AS truncated FROM x WHERE r <= b", records=True)
def budgeted(spark, sf):
    return R.budgeted(records(spark, sf).withColumnRenamed("memory_level", "segment"), "segment", {"durable": 5, "session": 8, "event": 8, "task": 8}, F.desc("t_ms"), "id")


@query("anchor_timeline", "WITH x AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events), a AS (SELECT user_id, p FROM x WHERE event_type = 'signup') SELECT DISTINCT x.event_id FROM x JOIN a ON a.user_id = x.user_id AND x.p BETWEEN a.p - 2 AND a.p + 2")
def anchor(spark, sf):
    return R.around(table(spark, sf, "events"), F.col("event_type") == "signup", 2, "user_id", "ts", "event_id").select("event_id")


@query("line_context", "WITH x AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line, string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS c FROM conversations), y AS (SELECT *, row_number() OVER (PARTITION BY conv_id, line // 5 ORDER BY line) AS r FROM x WHERE role = 'assistant') SELECT conv_id, line::INTEGER AS line, md5(c) AS digest FROM y WHERE r = 1")
def context(spark, sf):
    out = R.line_context(table(spark, sf, "conversations"), "conv_id", "turn", "text", F.col("role") == "assistant")
    return out.select("conv_id", "line", F.md5("context").alias("digest"))


@query("recent_unique", " SELECT id FROM (SELECT *, row_number() OVER (PARTITION BY lower(tool || '|' || project) ORDER BY t_ms DESC, id) AS r FROM records WHERE confidence > 0.3) WHERE r = 1 ORDER BY t_ms DESC, id LIMIT 12", records=True)
def recent(spark, sf):
    return R.select_unique(records(spark, sf), F.col("confidence") > 0.3, F.lower(F.concat_ws("|", "tool", "project")), 12, F.desc("t_ms"), F.col("id")).select("id")


_ANY = lambda words: f"regexp_matches(hay, '{words}')"
_SECTIONS = f"""
  SELECT 'tool_invariants' AS section, 8 AS most, 0 AS part, * FROM k WHERE scope IN ('feedback', 'user') OR type = 'workflow-rule' OR (source = 'shared-inbox' AND {_ANY('\\bmust\\b|\\balways\\b|\\bshould\\b|不要|必须|避免')})
  UNION ALL SELECT 'goal', 1, 0, * FROM k WHERE tool <> 'openclaw' AND scope IN ('summary', 'project', 'reference') AND type <> 'workflow-rule'
  UNION ALL SELECT 'goal', 1, 1, * FROM k WHERE place = 1
  UNION ALL SELECT 'done', 6, 0, * FROM k WHERE task_state IN ('ok', 'pr_submitted', 'done', 'completed') OR {_ANY('\\bcompleted\\b|\\bvalidated\\b|\\bpassed\\b|\\bfinished\\b|完成|已验证')}
  UNION ALL SELECT 'next', 6, 0, * FROM k WHERE (task_state IN ('pending', 'processing', 'active', 'queued') OR {_ANY('\\bnext\\b|\\btodo\\b|\\bfollow[- ]?up\\b|\\bcontinue\\b|待办|下一步|继续')}) AND scope NOT IN ('feedback', 'user')
  UNION ALL SELECT 'blocked', 5, 0, * FROM k WHERE task_state IN ('failed', 'error', 'timeout', 'blocked') OR {_ANY('\\bblocked\\b|\\bfailed\\b|\\berror\\b|\\btimeout\\b|阻塞|失败|报错')}"""
_FIRST = "SELECT section, id, title, row_number() OVER (PARTITION BY section ORDER BY part, place) AS rank, most, part, place FROM (SELECT *, row_number() OVER (PARTITION BY section, key ORDER BY part, place) AS n FROM {0}) WHERE n = 1"


@query("handoff_pack", f""", k AS (SELECT id, lower(tool) AS tool, scope, type, task_state, CASE WHEN num % 9 = 0 THEN 'shared-inbox' ELSE 'hook' END AS source, title, lower(title || ' ' || content) AS hay,
  lower(tool || '|' || CASE WHEN title <> '' THEN trim(regexp_replace(title, '\\s+', ' ', 'g')) WHEN content <> '' THEN trim(regexp_replace(content, '\\s+', ' ', 'g')) ELSE id END) AS key, row_number() OVER (ORDER BY t_ms DESC, id) AS place FROM records WHERE trim(title) <> '' OR trim(content) <> '' QUALIFY place <= 300),
s AS ({_SECTIONS}), f AS ({_FIRST.format('s')}),
o AS (SELECT 'open_threads' AS section, 8 AS most, CASE WHEN f.section = 'next' THEN 0 ELSE 1 END AS part, k.* FROM f JOIN k USING (id) WHERE f.section IN ('next', 'blocked') AND f.rank <= f.most UNION ALL SELECT 'open_threads', 8, 2, k.* FROM k),
g AS ({_FIRST.format("(SELECT * FROM o WHERE scope IN ('task', 'run') OR type IN ('task-state', 'task-run'))")})
SELECT section, id, title, rank::INTEGER AS rank FROM (SELECT * FROM f UNION ALL SELECT * FROM g) WHERE rank <= most""", records=True)
def handoff(spark, sf):
    rows = records(spark, sf).withColumn("source", F.when(F.col("num") % 9 == 0, "shared-inbox").otherwise("hook"))
    return R.handoff(rows)


@query("first_files", ", x AS (SELECT num, unnest([tool, lang]) AS file, unnest([0, 1]) AS pos FROM records), m AS (SELECT file, min(num * 10 + pos) AS place FROM x GROUP BY file) SELECT file, row_number() OVER (ORDER BY place)::INTEGER AS rank FROM m ORDER BY place LIMIT 12", records=True)
def first_files(spark, sf):
    return R.files_of(records(spark, sf).select(F.col("num").alias("seq"), F.array("tool", "lang").alias("files")))


@query("compact_unique", ", x AS (SELECT num, unnest([upper(tool), tool || ' a long name that is cut']) AS s, unnest([0, 1]) AS pos FROM records), c AS (SELECT num, pos, CASE WHEN length(s) > 12 THEN substr(s, 1, 11) || '…' ELSE s END AS s FROM x), m AS (SELECT lower(s) AS k, min(num * 10 + pos) AS place, arg_min(s, num * 10 + pos) AS text FROM c GROUP BY 1) SELECT text, row_number() OVER (ORDER BY place)::INTEGER AS rank FROM m ORDER BY place LIMIT 8", records=True)
def compact(spark, sf):
    rows = records(spark, sf).select(F.col("num").alias("seq"), F.array(F.upper("tool"), F.concat("tool", F.lit(" a long name that is cut"))).alias("items"))
    return R.compact_unique(rows, "items", 8, 12)


@query("freshness_sort", f", x AS (SELECT id, t_ms, {AS_OF_MS} - t_ms AS age FROM records) SELECT id FROM x ORDER BY CASE WHEN age <= {DAY_MS} THEN 3 WHEN age <= {7 * DAY_MS} THEN 2 ELSE 1 END DESC, t_ms DESC, id LIMIT 25", records=True)
def fresh_first(spark, sf):
    return records(spark, sf).orderBy(F.desc(R.freshness_order(F.lit(AS_OF_MS) - F.col("t_ms"))), F.desc("t_ms"), "id").limit(25).select("id")


@query("hit_rate", "SELECT sum((event_type = 'view')::INT)::BIGINT AS hits, sum((event_type = 'error')::INT)::BIGINT AS misses, round(sum((event_type = 'view')::INT) / sum((event_type IN ('view', 'error'))::INT)::DOUBLE, 6) AS rate FROM events")
def hits(spark, sf):
    return R.hit_rate(table(spark, sf, "events"), "event_type", "view", "error").withColumn("rate", F.round("rate", 6))


@query("regression_deltas", "WITH n AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM events WHERE event_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT metric, round(n.v - b.v, 6) AS delta, CASE WHEN n.v - b.v <= -0.1 THEN 'fail' WHEN n.v - b.v <= -0.05 THEN 'warn' ELSE 'ok' END AS verdict FROM n JOIN b USING (metric)")
def regressions(spark, sf):
    of = lambda k: table(spark, sf, "events").where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))
    return R.regression(of(0), of(1)).select("metric", F.round("delta", 6).alias("delta"), "verdict")


@query("prometheus_text", "SELECT 'events_total{type=\"' || event_type || '\"} ' || count(*) AS line FROM events GROUP BY event_type")
def prometheus(spark, sf):
    m = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("value")).select(F.lit("events_total").alias("name"), F.concat(F.lit('type="'), "event_type", F.lit('"')).alias("label"), "value")
    return R.prometheus(m)


@query("markdown_pages", ", x AS (SELECT scope, id, title, row_number() OVER (PARTITION BY scope ORDER BY id) AS r FROM records), p AS (SELECT *, (r - 1) // 500 AS part FROM x) SELECT scope, md5('# ' || scope || CASE WHEN part > 0 THEN ' (' || (part + 1) || ')' ELSE '' END || chr(10) || chr(10) || string_agg('- [' || title || '](' || id || '.md)', chr(10) ORDER BY r)) AS digest FROM p GROUP BY scope, part", records=True)
def pages(spark, sf):
    return R.markdown_pages(records(spark, sf), "scope").select("scope", F.md5("page").alias("digest"))


@query("board_query", " SELECT id FROM records WHERE task_state IN ('pending', 'processing') ORDER BY t_ms DESC, id LIMIT 120", records=True)
def board(spark, sf):
    return T.board_tasks(records(spark, sf).withColumnRenamed("task_state", "state").withColumn("updated_at", F.col("t_ms")), ["pending", "processing"], 120).select("id")


@query("board_sync", " SELECT CASE WHEN num % 3 = 0 AND task_state NOT IN ('completed', 'aborted', 'failed') THEN 'completed' ELSE task_state END AS state, count(*)::BIGINT AS n FROM records GROUP BY 1", records=True)
def sync(spark, sf):
    tasks = records(spark, sf).select("id", "title", "num", F.col("task_state").alias("state"))
    done = T.checked_ids(T.render_board(tasks.where("num % 3 = 0").withColumn("state", F.lit("completed")).withColumn("title", F.lit("t"))).withColumnRenamed("line", "value"))
    return T.complete(tasks, done).groupBy("state").agg(F.count("*").alias("n"))


_TOPIC = "text || CASE conv_id % 5 WHEN 0 THEN ' Based on this message, call x' ELSE '' END"
_TOPIC = f"CASE WHEN turn = 0 THEN CASE conv_id % 7 WHEN 0 THEN '<environment_context> ' || text WHEN 1 THEN '# AGENTS.md instructions for x' WHEN 2 THEN 'Based on this message, call x' ELSE {_TOPIC} END ELSE {_TOPIC} END"


@query("first_topic", rf"""
WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace({_TOPIC}, '\s+', ' ', 'g')) AS t FROM conversations),
m AS (SELECT conv_id, turn, role, CASE WHEN regexp_matches(t, '^(.*?)\s+Based on this message, call .*$') THEN trim(regexp_extract(t, '^(.*?)\s+Based on this message, call .*$', 1)) ELSE t END AS t FROM c),
f AS (SELECT conv_id, arg_min(t, turn) AS t FROM m WHERE role = 'user' AND turn < 160 AND t <> '' AND NOT starts_with(t, '<environment_context>') AND NOT regexp_matches(t, '^# AGENTS\.md instructions\b') AND NOT starts_with(t, 'Based on this message, call ') GROUP BY conv_id)
SELECT c.conv_id, CASE WHEN length(coalesce(t, '(none)')) > 140 THEN rtrim(substr(t, 1, 137)) || '...' ELSE coalesce(t, '(none)') END AS topic FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id)""")
def topic(spark, sf):
    c = table(spark, sf, "conversations").withColumn("text", F.expr(_TOPIC)).withColumnRenamed("conv_id", "session")
    return T.first_relevant(c, c).withColumnRenamed("session", "conv_id")


@query("inbox_parse", " SELECT id AS t, project, trim(substr(regexp_replace(title, '\\s+', ' ', 'g'), 1, 40)) AS content FROM records WHERE trim(substr(regexp_replace(title, '\\s+', ' ', 'g'), 1, 40)) <> '' AND NOT starts_with(trim(title), '[')", records=True)
def inbox(spark, sf):
    short = F.substring(F.regexp_replace("title", r"\s+", " "), 1, 40)
    kept = records(spark, sf).where((F.trim(short) != "") & ~F.trim("title").startswith("["))
    return T.inbox(kept.select(F.concat(F.lit("- ["), "id", F.lit("] ["), "project", F.lit("] "), short).alias("value")))


# a quarter of a token for each character: the tables have no Chinese text, of which the tests have some
@query("transcript_slices", r"""
WITH t AS (SELECT conv_id AS session, string_agg(coalesce(text, ''), chr(10) ORDER BY turn NULLS LAST, coalesce(text, '')) AS t FROM conversations GROUP BY conv_id),
c AS (SELECT session, t, substr(t, 1, 2000) AS a, substr(t, length(t) - 1999) AS b FROM t)
SELECT session, CASE WHEN length(t) <= 2000 OR NOT regexp_matches(a, '[.\n]') THEN a ELSE regexp_extract(a, '(?s)^(.*[.\n])', 1) END AS head,
  CASE WHEN length(t) <= 2000 THEN t WHEN NOT regexp_matches(b, '[.\n]') THEN b ELSE regexp_extract(b, '(?s)^[^.\n]*[.\n](.*)$', 1) END AS tail FROM c""")
def slices(spark, sf):
    return T.slice_transcripts(table(spark, sf, "conversations").withColumnRenamed("conv_id", "session"))


@query("extraction_parse", "SELECT conv_id, turn, 'work' AS session_type, 2 AS n_facts, least(1.0, turn / 2.0)::DOUBLE AS confidence FROM conversations")
def parse(spark, sf):
    c = table(spark, sf, "conversations")
    text = F.concat(F.lit("<session_type>work</session_type><fact>"), "role", F.lit("</fact><fact>b</fact><confidence>"), F.format_number(F.least(F.col("turn") / 2.0, F.lit(9.0)), 1), F.lit("</confidence>"))
    return T.parse_extractions(c.withColumn("text", text)).select("conv_id", "turn", "session_type", F.size("facts").alias("n_facts"), "confidence")


@query("session_join", "SELECT c_custkey, o_orderkey, count(*)::BIGINT AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1, 2")
def session_join(spark, sf):
    l = table(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    return l.join(o, "o_orderkey").join(table(spark, sf, "customer").select("c_custkey"), "c_custkey", "left_semi").select("c_custkey", "o_orderkey", "n")


@query("edit_history", "SELECT l_partkey AS resource, count(*)::BIGINT AS revisions, max(strftime(l_shipdate, '%Y-%m-%d')) AS latest FROM lineitem GROUP BY 1 ORDER BY latest DESC, revisions DESC, resource LIMIT 6")
def history(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("resource")).agg(F.count("*").alias("revisions"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("latest"))
    return g.orderBy(F.desc("latest"), F.desc("revisions"), "resource").limit(6)
