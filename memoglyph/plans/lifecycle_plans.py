"""Contract, deduplication, promotion, conflicts, archival, consolidation and the change queue."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from memoglyph.functions import numeric as N, text as X
from memoglyph.operators import embedding as E, layers as B, lifecycle as L
from memoglyph.operators.lifecycle import shared_folder
from memoglyph.plans.catalog import query
from memoglyph.sources.commits import Store
from memoglyph.streaming import changes as M
from memoglyph.views import AS_OF_MS, DAY_MS, records, table

_FP = r"""list_filter(regexp_split_to_array(lower(trim(regexp_replace(coalesce(content, ''), '\s+', ' ', 'g'))), '[\s\-_.,;:!?()\[\]{}''"#@$%^&*+=|\\~`]+'), lambda w: length(w) >= 3)[1:18]"""


@query("contract_errors", """
, f AS (SELECT id, CASE WHEN num % 10 = 0 THEN 1 ELSE 2 END AS v, CASE WHEN num % 9 = 0 THEN 'team' ELSE scope END AS scope, CASE WHEN num % 8 = 0 THEN '' ELSE 'x' END AS title, CASE WHEN num % 6 = 0 THEN 9 ELSE tier END AS tier, CASE WHEN num % 4 = 0 THEN 'abc' ELSE sha256(id) END AS h FROM records)
SELECT id, array_to_string(list_filter([CASE WHEN v <> 2 THEN 'unexpected-schema-version:' || v END, CASE WHEN scope = 'team' THEN 'unknown-scope:team' END, CASE WHEN tier = 9 THEN 'invalid-tier:9' END, CASE WHEN h = 'abc' THEN 'invalid-content-hash:abc' END, CASE WHEN title = '' THEN 'missing-fields:title' END], lambda x: x IS NOT NULL), ';') AS errors FROM f""", records=True)
def contract(spark, sf):
    bad = records(spark, sf).select(
        "id", F.when(F.col("num") % 10 == 0, 1).otherwise(2).alias("schemaVersion"), F.col("id").alias("tool"), "type", F.when(F.col("num") % 8 == 0, "").otherwise("x").alias("title"), F.lit("s").alias("source"),
        F.when(F.col("num") % 9 == 0, "team").otherwise(F.col("scope")).alias("scope"), "memory_level", F.when(F.col("num") % 6 == 0, 9).otherwise(F.col("tier")).alias("tier"), F.when(F.col("num") % 4 == 0, "abc").otherwise(F.sha2("id", 256)).alias("content_hash"),
    )
    return L.contract_errors(bad).select("id", F.array_join("errors", ";").alias("errors"))


@query("promotion_errors", """
SELECT id, array_to_string(list_filter([CASE WHEN num % 5 = 0 THEN 'unknown-promotion-version:3' END, CASE WHEN scope NOT IN ('user', 'feedback', 'project', 'reference') THEN 'unknown-promotion-durable-type:' || scope END,
  CASE WHEN num % 6 = 0 THEN 'missing-promotion-key' END, CASE WHEN num % 4 = 0 THEN 'missing-promotion-refresh-of-id' END, CASE WHEN num % 4 = 0 THEN 'missing-promotion-refresh-of-t' END], lambda x: x IS NOT NULL), ';') AS errors FROM records""".join([" ", ""]), records=True)
def promotion_contract(spark, sf):
    none = F.lit(None).cast("string")
    p = F.struct(
        F.when(F.col("num") % 5 == 0, 3).otherwise(1).alias("version"), F.col("scope").alias("durable_type"), F.when(F.col("num") % 6 == 0, " ").otherwise("k").alias("key"), F.lit("r").alias("reason"), F.col("id").alias("source_record_id"),
        (F.col("num") % 4 == 0).alias("is_refresh"), none.alias("refresh_of_id"), none.alias("refresh_of_t"), F.array(F.lit("c")).alias("conflict_with"),
    )
    return records(spark, sf).withColumn("p", p).select("id", F.array_join(L.promotion_errors(F.col("p")), ";").alias("errors"))


@query("fact_errors", "SELECT id, array_to_string(list_filter([CASE WHEN trim(content) = '' THEN 'content-required' WHEN length(content) > 2000 THEN 'content-too-long' END, CASE WHEN confidence * 1.5 > 1 THEN 'confidence-out-of-range' END], lambda x: x IS NOT NULL), ';') AS errors FROM records".join([" ", ""]), records=True)
def facts(spark, sf):
    return L.fact_errors(records(spark, sf).withColumn("confidence", F.col("confidence") * 1.5)).select("id", F.array_join("errors", ";").alias("errors"))


@query("tier_filter", " SELECT coalesce(tier, CASE memory_level WHEN 'event' THEN 1 WHEN 'durable' THEN 3 ELSE 2 END)::INTEGER AS tier, count(*)::BIGINT AS n FROM records WHERE coalesce(tier, CASE memory_level WHEN 'event' THEN 1 WHEN 'durable' THEN 3 ELSE 2 END) IN (2, 3, 4) GROUP BY 1", records=True)
def tier_filter(spark, sf):
    level = F.when(F.col("memory_level") == "event", 1).when(F.col("memory_level") == "durable", 3).otherwise(2)
    kept = records(spark, sf).withColumn("tier", F.coalesce("tier", level)).where(F.col("tier").isin(2, 3, 4))
    return kept.groupBy("tier").agg(F.count("*").alias("n"))


@query("open_tasks", " SELECT task_state, count(*)::BIGINT AS n FROM records WHERE task_state <> '' AND task_state NOT IN ('completed', 'aborted', 'failed') GROUP BY task_state", records=True)
def open_tasks(spark, sf):
    return records(spark, sf).where((F.col("task_state") != "") & ~F.col("task_state").isin("completed", "aborted", "failed")).groupBy("task_state").agg(F.count("*").alias("n"))


@query("dedup_first_wins", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def first_wins(spark, sf):
    return L.one_per_key(table(spark, sf, "events"), ["user_id", "event_type"], "ts", "event_id").select("user_id", "event_type", "event_id")


@query("dedup_last_wins", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def last_wins(spark, sf):
    return L.one_per_key(table(spark, sf, "events"), ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id")


@query("dedup_window", "WITH x AS (SELECT event_id, epoch_ms(ts) AS t, lag(epoch_ms(ts)) OVER (PARTITION BY user_id % 50, event_type ORDER BY epoch_ms(ts), event_id) AS b FROM events) SELECT event_id FROM x WHERE b IS NULL OR t - b > 600000")
def window_dedup(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("t"), F.concat_ws("|", (F.col("user_id") % 50).cast("string"), "event_type").alias("h"))
    return L.within_window_dedup(e, "h", "t", "event_id", 600_000).select("event_id")


_PROMO = f"""
p AS (SELECT id, coalesce(tier, 2) AS tier_from, pow(2, -(greatest({AS_OF_MS} - coalesce(access_ms, t_ms), 0) / 86400000.0) / 30) AS rec, greatest(0, least(1, coalesce(source_confidence, confidence)))::DOUBLE AS conf,
  HITS AS cross_s, CASE source_kind WHEN 'writeback' THEN 1.0 WHEN 'session' THEN 0.9 WHEN 'hook' THEN 0.7 WHEN 'blackboard' THEN 0.6 WHEN 'task' THEN 0.7 ELSE 0.5 END::DOUBLE AS qual FROM records WHERE coalesce(tier, 2) BETWEEN 2 AND 3),
s AS (SELECT *, rec * 0.3::DOUBLE + conf * 0.35::DOUBLE + cross_s * 0.25::DOUBLE + qual * 0.1::DOUBLE AS raw FROM p)"""
_PROMO_ROWS = " SELECT id, floor(raw * 10000 + 0.5) / 10000 AS score, tier_from, least(tier_from + 1, 4)::INTEGER AS tier_to, CASE WHEN raw >= 0.65 THEN 'auto' WHEN raw >= 0.4 THEN 'review' ELSE 'none' END AS decision FROM s"


@query("promotion_score", "," + _PROMO.replace("HITS", "least(1.0, (cross_refs + access_count) / 5.0)::DOUBLE") + _PROMO_ROWS, records=True)
def promotion(spark, sf):
    return L.promotion_scores(records(spark, sf), AS_OF_MS).select("id", "score", "tier_from", "tier_to", "decision")


@query("promotion_score_library", "," + _PROMO.replace("HITS", "least(1.0, cross_refs + access_count)::DOUBLE / 5") + _PROMO_ROWS, records=True)
def promotion_library(spark, sf):
    return L.promotion_scores(records(spark, sf), AS_OF_MS, library=True).select("id", "score", "tier_from", "tier_to", "decision")


@query("promotion_buckets", "," + _PROMO.replace("HITS", "least(1.0, (cross_refs + access_count) / 5.0)::DOUBLE") + " SELECT floor(floor(raw * 10000 + 0.5) / 1000)::BIGINT AS bucket, count(*)::BIGINT AS n, sum((raw >= 0.65)::INT)::BIGINT AS auto FROM s GROUP BY 1", records=True)
def promotion_buckets(spark, sf):
    s = L.promotion_scores(records(spark, sf), AS_OF_MS)
    return s.groupBy(F.floor(F.col("score") * 10).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(F.col("decision") == "auto").alias("auto"))


_PAIRS = f"""
fp AS (SELECT num, list_sort(list_distinct({_FP})) AS t FROM records), sets AS (SELECT t, min(num) AS num FROM fp WHERE len(t) > 0 GROUP BY t),
w AS (SELECT num, len(t) AS n, unnest(t) AS term FROM sets), c AS (SELECT a.num AS a, b.num AS b, any_value(a.n) AS m, any_value(b.n) AS n, count(*) AS k FROM w a JOIN w b ON a.term = b.term AND a.num < b.num GROUP BY 1, 2),
pairs AS (SELECT a, b, k / (m + n - k)::DOUBLE AS overlap FROM c WHERE k / (m + n - k)::DOUBLE >= 0.7 UNION ALL SELECT s.num, f.num, 1.0 FROM fp f JOIN sets s ON f.t = s.t AND f.num > s.num)"""


def _fingerprints(spark, sf):
    return records(spark, sf).select(F.col("num").alias("id"), X.fingerprint_tokens("content").alias("tokens"))


def _pairs(spark, sf):
    return L.overlapping_pairs(_fingerprints(spark, sf))


@query("jaccard_conflicts", f""",{_PAIRS}, f AS (SELECT s.num AS of, fp.num FROM fp JOIN sets s ON fp.t = s.t)
SELECT least(x.num, y.num) AS a, greatest(x.num, y.num) AS b, round(k / (m + n - k)::DOUBLE, 6) AS overlap FROM c JOIN f x ON x.of = c.a JOIN f y ON y.of = c.b WHERE k / (m + n - k)::DOUBLE >= 0.7
UNION ALL SELECT x.num, y.num, 1.0 FROM f x JOIN f y ON x.of = y.of AND x.num < y.num""", records=True)
def conflicts(spark, sf):
    return L.every_pair(_fingerprints(spark, sf)).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("conflict_components", f",{_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(x, y) AS (SELECT a, a FROM e UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y) SELECT x AS id, min(y) AS component FROM r GROUP BY x", records=True)
def components(spark, sf):
    return L.components(_pairs(spark, sf))


@query("conflict_resolution", f""",{_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), r(x, y) AS (SELECT num, num FROM records UNION SELECT r.x, e.b FROM r JOIN e ON e.a = r.y),
k AS (SELECT x AS id, min(y) AS component FROM r GROUP BY x), s AS (SELECT k.*, q.confidence AS score, q.access_ms FROM k JOIN records q ON q.num = k.id),
o AS (SELECT *, max(score) OVER (PARTITION BY component) - score AS gap, row_number() OVER (PARTITION BY component ORDER BY score DESC, coalesce(access_ms, 0) DESC, id) AS r FROM s)
SELECT CASE WHEN r = 1 THEN 'winner' WHEN gap <= 0.1 + 1e-9 THEN 'human_review' ELSE 'dropped' END AS outcome, count(*)::BIGINT AS n, sum(id)::BIGINT AS ids FROM o GROUP BY 1""", records=True)
def resolution(spark, sf):
    scored = records(spark, sf).select(F.col("num").alias("id"), F.col("confidence").alias("score"), "access_ms")
    return L.resolve_conflicts(scored, _pairs(spark, sf)).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("apply_promotions", ", " + _PROMO.replace("HITS", "least(1.0, (cross_refs + access_count) / 5.0)::DOUBLE").strip() + " SELECT r.id, CASE WHEN s.id IS NOT NULL THEN least(s.tier_from + 1, 4) ELSE r.tier END::INTEGER AS tier, (r.promotion_count + (s.id IS NOT NULL)::INT)::INTEGER AS promotion_count FROM records r LEFT JOIN (SELECT * FROM s WHERE raw >= 0.65) s ON s.id = r.id", records=True)
def apply_(spark, sf):
    up = L.promotion_scores(records(spark, sf), AS_OF_MS).where("decision = 'auto'").select("id", "tier_to", F.lit("auto").alias("reason"))
    return L.apply_promotions(records(spark, sf), up, "2024-02-01").select("id", F.col("tier").cast("int").alias("tier"), F.col("promotion_count").cast("int").alias("promotion_count"))


_ARCHIVE = f"""
a AS (SELECT id, tier, scope, type, CASE WHEN archived OR coalesce(tier = 5, false) THEN NULL WHEN (tier IS NULL OR tier = 1) AND {AS_OF_MS} - t_ms > {DAY_MS} THEN 'tier1-expired'
  WHEN tier = 2 AND {AS_OF_MS} - t_ms > {30 * DAY_MS} AND promotion_count < 2 THEN 'tier2-cold' WHEN tier = 3 AND expires_ms > 0 AND {AS_OF_MS} > expires_ms THEN 'tier3-expired'
  WHEN tier = 4 AND scope <> 'user' AND expires_ms > 0 AND {AS_OF_MS} > expires_ms THEN 'tier4-ttl' WHEN tier = 4 AND {AS_OF_MS} - coalesce(access_ms, 0) > {60 * DAY_MS} AND access_count = 0 AND {AS_OF_MS} - t_ms > {60 * DAY_MS} THEN 'tier4-cold-access' END AS reason FROM records)"""


@query("archive_rules", f",{_ARCHIVE} SELECT reason, count(*)::BIGINT AS n FROM a GROUP BY reason", records=True)
def archive(spark, sf):
    return records(spark, sf).select(L.archive_reason(AS_OF_MS).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("archive_manifest", f",{_ARCHIVE} SELECT id, tier AS tier_from, reason, scope AS original_scope, type AS original_type FROM a WHERE reason IS NOT NULL", records=True)
def manifest(spark, sf):
    return L.split_archive(records(spark, sf), AS_OF_MS)[1]


@query("archive_kept", f",{_ARCHIVE} SELECT id FROM a WHERE reason IS NULL", records=True)
def kept(spark, sf):
    return L.split_archive(records(spark, sf), AS_OF_MS)[0].select("id")


@query("tier_evict", """
, k AS (SELECT *, coalesce(tier, 1) AS q FROM records), o AS (SELECT q, CASE q WHEN 3 THEN 15 ELSE 20 END AS most FROM k WHERE q <> 5 GROUP BY q HAVING count(*) > CASE q WHEN 3 THEN 15 ELSE 20 END),
i AS (SELECT k.id, k.tier, q, most, freshness_score, CASE q WHEN 3 THEN project WHEN 4 THEN type ELSE 'all' END AS bucket FROM k JOIN o USING (q)),
n AS (SELECT *, count(*) OVER (PARTITION BY q, bucket) AS n, row_number() OVER (PARTITION BY q, bucket, tier IS NULL ORDER BY freshness_score, id) AS r FROM i)
SELECT q::INTEGER AS tier, bucket, id FROM n WHERE tier IS NOT NULL AND r <= n - most""", records=True)
def evict(spark, sf):
    return L.evictions(records(spark, sf), {1: 20, 2: 20, 3: 15, 4: 20, 5: 500})


@query("simplify", r" SELECT id, (coalesce(tier = 4, false) AND access_count > 20 AND length(content) > 2000) AS simplified, CASE WHEN coalesce(tier = 4, false) AND access_count > 20 AND length(content) > 2000 THEN md5(substr(string_split(content, chr(10) || chr(10))[1], 1, 500) || chr(10) || chr(10) || '<!-- SIMPLIFIED: original ' || length(content) || ' chars, access_count=' || access_count || ' -->') ELSE md5(content) END AS digest FROM records", records=True)
def simplify(spark, sf):
    return L.simplified(records(spark, sf)).select("id", "simplified", F.md5("content").alias("digest"))


_CONSOLIDATE = """
c AS (SELECT id, type || '|' || project AS key, scope, confidence, t_ms, num FROM records), base AS (SELECT key, max(t_ms) AS base_t FROM c WHERE num % 3 = 0 GROUP BY key),
m AS (SELECT c.*, CASE WHEN base_t IS NULL THEN 'promote' WHEN t_ms > base_t THEN 'refresh' END AS action FROM c LEFT JOIN base USING (key) WHERE num % 3 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY action, key ORDER BY confidence DESC, id) AS r1 FROM m WHERE action IS NOT NULL),
p AS (SELECT *, row_number() OVER (PARTITION BY action, scope ORDER BY confidence DESC, id) AS r2, CASE action WHEN 'promote' THEN CASE scope WHEN 'user' THEN 3 WHEN 'feedback' THEN 3 WHEN 'project' THEN 4 WHEN 'reference' THEN 2 ELSE 0 END ELSE CASE scope WHEN 'user' THEN 2 WHEN 'feedback' THEN 2 WHEN 'project' THEN 3 WHEN 'reference' THEN 1 ELSE 0 END END AS cap FROM o WHERE r1 = 1),
z AS (SELECT *, row_number() OVER (PARTITION BY action ORDER BY confidence DESC, id) AS r3 FROM p WHERE r2 <= cap)"""


@query("consolidation", f",{_CONSOLIDATE} SELECT id, key, scope, action FROM z WHERE r3 <= 8", records=True)
def consolidation(spark, sf):
    c = records(spark, sf).select("id", F.concat_ws("|", "type", "project").alias("key"), "scope", "confidence", "t_ms", "num")
    return L.consolidate(c.where("num % 3 <> 0").drop("num"), c.where("num % 3 = 0").drop("num"))


@query("novel_records", ", c AS (SELECT id, type || '|' || workspace || '|' || session AS key, num FROM records) SELECT id FROM c WHERE num % 3 <> 0 AND key NOT IN (SELECT key FROM c WHERE num % 3 = 0)", records=True)
def novel(spark, sf):
    c = records(spark, sf).select("id", F.concat_ws("|", "type", "workspace", "session").alias("key"), "num")
    return c.where("num % 3 <> 0").join(c.where("num % 3 = 0").select("key"), "key", "left_anti").select("id")


@query("write_back", """
, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session ORDER BY t_ms DESC, id) AS r FROM records WHERE num % 2 = 0) WHERE r = 1)
SELECT n.id, n.session AS key, CASE WHEN s.id IS NULL THEN 'append' WHEN s.type = n.type THEN 'skip-identical' ELSE 'append-conflict' END AS action, CASE WHEN s.id IS NOT NULL AND s.type <> n.type AND n.confidence > s.confidence THEN s.id END AS supersedes
FROM records n LEFT JOIN s ON s.session = n.session WHERE n.num % 2 = 1""", records=True)
def write_back(spark, sf):
    r = records(spark, sf).select("id", F.col("session").alias("key"), F.col("type").alias("content_hash"), "confidence", "t_ms", "num")
    return L.write_back(r.where("num % 2 = 1"), r.where("num % 2 = 0"))


@query("merge_patches", ", b AS (SELECT id, [tool] AS f FROM records WHERE num % 2 = 0), p AS (SELECT id, [lang, tool, project] AS f FROM records WHERE num % 3 = 0) SELECT coalesce(b.id, p.id) AS id, array_to_string(CASE WHEN b.id IS NULL THEN p.f WHEN p.id IS NULL THEN b.f ELSE list_concat(b.f, list_filter(p.f, lambda x: x <> b.f[1])) END, ',') AS facts FROM b FULL JOIN p ON b.id = p.id", records=True)
def patches(spark, sf):
    r = records(spark, sf)
    base = r.where("num % 2 = 0").select("id", F.array("tool").alias("facts"))
    added = r.where("num % 3 = 0").select("id", F.lit(2).alias("seq"), F.array("project").alias("facts")).unionByName(r.where("num % 3 = 0").select("id", F.lit(1).alias("seq"), F.array("lang", "tool").alias("facts")))
    return L.merge_patches(base, added).select("id", F.array_join("facts", ",").alias("facts"))


@query("snapshot_diff", ", a AS (SELECT id, md5(title) AS h FROM records WHERE num % 5 <> 0), b AS (SELECT id, CASE WHEN num % 4 = 0 THEN 'changed' ELSE md5(title) END AS h FROM records WHERE num % 7 <> 0) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'delete' ELSE 'upsert' END AS op FROM a FULL JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.h <> b.h", records=True)
def diff(spark, sf):
    r = records(spark, sf)
    return L.snapshot_diff(r.where("num % 5 <> 0").select("id", F.md5("title").alias("hash")), r.where("num % 7 <> 0").select("id", F.when(F.col("num") % 4 == 0, "changed").otherwise(F.md5("title")).alias("hash")))


@query("embedding_reuse", ", s AS (SELECT id, md5(title) AS h, num % 2 AS c FROM records WHERE num % 5 <> 0) SELECT r.id, CASE WHEN s.id IS NULL THEN 'build' WHEN s.h <> md5(r.title) THEN 'rebuild' WHEN s.c <> 0 THEN 'rebuild' ELSE 'reuse' END AS action FROM records r LEFT JOIN s ON s.id = r.id", records=True)
def reuse(spark, sf):
    r = records(spark, sf)
    stored = r.where("num % 5 <> 0").select("id", F.md5("title").alias("h"), (F.col("num") % 2).alias("c"))
    fits = (F.col("h") == F.md5("title")) & (F.col("c") == 0)
    return r.join(stored, "id", "left").select("id", F.when(F.col("h").isNull(), "build").when(fits, "reuse").otherwise("rebuild").alias("action"))


@query("migrate_records", " SELECT id, (num % 2 = 0 AND num % 3 = 0) OR archived AS archived, 2 AS \"schemaVersion\" FROM records", records=True)
def migrate(spark, sf):
    r = records(spark, sf).select("id", F.when(F.col("num") % 2 == 0, 1).otherwise(2).alias("schemaVersion"), (F.col("num") % 3 == 0).alias("tombstone"), "archived")
    return L.migrate(r)


@query("layers_union", ", u AS (SELECT id, 'a' AS layer, 0 AS o FROM records WHERE num % 2 = 0 UNION ALL SELECT id, 'b', 1 FROM records WHERE num % 3 = 0) SELECT id, layer FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS r FROM u) WHERE r = 1", records=True)
def union(spark, sf):
    r = records(spark, sf)
    both = r.where("num % 2 = 0").select("id", F.lit("a").alias("layer"), F.lit(0).alias("o")).unionByName(r.where("num % 3 = 0").select("id", F.lit("b").alias("layer"), F.lit(1).alias("o")))
    return L.one_per_key(both, ["id"], "o").select("id", "layer")


@query("tools_without_records", "SELECT p_brand AS tool FROM part EXCEPT SELECT p_brand FROM part JOIN lineitem ON l_partkey = p_partkey WHERE l_quantity > 49 AND l_discount > 0.09")
def without(spark, sf):
    hit = table(spark, sf, "lineitem").where("l_quantity > 49 AND l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey"))
    part = table(spark, sf, "part")
    return part.select(F.col("p_brand").alias("tool")).distinct().join(part.join(hit, "p_partkey", "left_semi").select(F.col("p_brand").alias("tool")).distinct(), "tool", "left_anti")


@query("best_per_session", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn DESC) AS r FROM conversations) WHERE r = 1")
def best(spark, sf):
    return L.one_per_key(table(spark, sf, "conversations"), ["conv_id"], F.col("role") != "user", F.desc("turn")).select("conv_id", "turn")


@query("session_last_k", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE length(text) >= 40) WHERE r <= 6")
def last_k(spark, sf):
    from memoglyph.sources.texts import last_per_session

    return last_per_session(table(spark, sf, "conversations").withColumnRenamed("conv_id", "session")).select(F.col("session").alias("conv_id"), "turn")


@query("consecutive_collapse", "WITH x AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, event_id FROM x WHERE p IS NULL OR p <> event_type")
def collapse(spark, sf):
    e = table(spark, sf, "events").select(F.lit("e").alias("source"), F.col("user_id").alias("entry_id"), F.col("event_id").alias("lsn"), F.col("event_type").alias("digest"), F.lit("upsert").alias("op"))
    return M.collapse(e).select(F.col("entry_id").alias("user_id"), F.col("lsn").alias("event_id"))


@query("claim_batch", "SELECT event_id AS lsn FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 50")
def claim(spark, sf):
    return M.claim(_queue(spark, sf)).select("lsn")


def _queue(spark, sf):
    status = F.when(F.col("event_type") == "error", "pending").otherwise("done")
    return table(spark, sf, "events").select(F.col("event_id").alias("lsn"), status.alias("status"), F.unix_millis(F.col("ts").cast("timestamp")).alias("done_ms"), F.lit(2).alias("tries"))


@query("settle_batch", "SELECT CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'done' WHEN event_type = 'error' AND event_id % 3 = 1 THEN 'failed' WHEN event_type = 'error' THEN 'pending' ELSE 'done' END AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def settle(spark, sf):
    q = _queue(spark, sf)
    results = q.where("status = 'pending' AND lsn % 3 < 2").select("lsn", (F.col("lsn") % 3 == 0).alias("ok"))
    return M.settle(q, results).groupBy("status").agg(F.count("*").alias("n"))


@query("prune_queue", f"SELECT count(*)::BIGINT AS n FROM events WHERE event_type = 'error' OR {AS_OF_MS} - epoch_ms(ts) <= {7 * DAY_MS}")
def prune(spark, sf):
    return M.prune(_queue(spark, sf), AS_OF_MS).agg(F.count("*").alias("n"))


@query("queue_stats", "SELECT sum((event_type = 'error')::INT)::BIGINT AS pending, min(CASE WHEN event_type = 'error' THEN event_id END) AS next_lsn FROM events")
def queue_stats(spark, sf):
    return M.queue_stats(_queue(spark, sf))


@query("backpressure", "SELECT CASE WHEN l < 0.85 THEN 1 WHEN l < 0.95 THEN 2 ELSE 4 END AS factor, count(*)::BIGINT AS n FROM (SELECT (event_id % 100) / 100.0::DOUBLE AS l FROM events) GROUP BY 1")
def backpressure(spark, sf):
    return table(spark, sf, "events").groupBy(M.backpressure((F.col("event_id") % 100) / 100.0).alias("factor")).agg(F.count("*").alias("n"))


@query("circuit_breaker", """
WITH RECURSIVE c AS (SELECT 'u' || user_id % 20 AS service, event_id AS seq, floor(epoch(ts))::BIGINT AS ts_s, event_type <> 'error' AS ok, (event_id % 23 = 0)::INT * 6.0::DOUBLE AS seconds, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events),
r(service, i, seq, ts_s, ok, state, allowed, failed, since) AS (
  SELECT DISTINCT service, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 'closed', true, 0, 0.0::DOUBLE FROM c
  UNION ALL
  SELECT service, i, seq, ts_s, ok,
    CASE WHEN was = 'open' THEN 'open' WHEN NOT ok THEN CASE WHEN was = 'half-open' OR failed + 1 >= 5 THEN 'open' ELSE 'closed' END WHEN was = 'half-open' THEN 'closed' WHEN seconds >= 5 THEN 'open' ELSE 'closed' END,
    was <> 'open',
    CASE WHEN was = 'open' THEN failed WHEN NOT ok THEN CASE WHEN was = 'half-open' OR failed + 1 >= 5 THEN 0 ELSE failed + 1 END ELSE 0 END,
    CASE WHEN was = 'open' THEN since WHEN NOT ok OR (was = 'closed' AND seconds >= 5) THEN ts_s + seconds ELSE since END
  FROM (SELECT c.*, r.failed, r.since, CASE WHEN r.state = 'open' AND c.ts_s - r.since >= 30 THEN 'half-open' ELSE r.state END AS was FROM r JOIN c ON c.service = r.service AND c.i = r.i + 1))
SELECT service, seq, ts_s, ok, state, allowed FROM r WHERE i > 0""")
def breaker(spark, sf):
    calls = table(spark, sf, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("service"), F.col("event_id").alias("seq"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"), (F.col("event_type") != "error").alias("ok"), F.when(F.col("event_id") % 23 == 0, 6).otherwise(0).alias("seconds"))
    return M.breaker(calls)


@query("pending_sessions", "SELECT session FROM (SELECT user_id AS session, min(ts) AS t FROM events GROUP BY user_id HAVING user_id % 4 <> 0) ORDER BY t, session LIMIT 3")
def pending(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("session"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_ms"))
    return M.pending_sessions(e, e.where("session % 4 = 0")).select("session")


_NOISE = r"^(?i:Sender\s*\(|System:|Subagent Context|\[Subagent Context\]|Exec completed|Exec failed|A new session was started|\[(Mon|Tue|Wed|Thu|Fri|Sat|Sun)\s|Run your Session Startup)"
#: Fields of records with three facts, as embedding.fields gives them.
_FIELDS = rf""", rec AS (SELECT *, trim(regexp_replace(title || ' ' || content, '\s+', ' ', 'g')) AS raw, list_filter([trim(regexp_replace(coalesce(tool, ''), '\s+', ' ', 'g')), session, 'fact of ' || id], lambda x: x <> '') AS facts,
  coalesce(tier, CASE memory_level WHEN 'session' THEN 2 WHEN 'durable' THEN 4 WHEN 'task' THEN 2 END, CASE scope WHEN 'project' THEN 3 ELSE 2 END) AS level FROM records WHERE NOT archived),
open AS (SELECT * FROM rec WHERE level IN (2, 3, 4) AND length(raw) >= 5 AND NOT regexp_matches(raw, '{_NOISE}')),
fields AS (SELECT num, id AS entry_id, 'content' AS field, substr(trim(regexp_replace(concat_ws(' ', title, content, project, type, coalesce(tool, '')), '\s+', ' ', 'g')), 1, 6000) AS text FROM open UNION ALL
  SELECT num, id || '__fact_' || (i - 1)::VARCHAR, 'fact_' || (i - 1)::VARCHAR, v FROM (SELECT num, id, unnest(facts) AS v, generate_subscripts(facts, 1) AS i FROM open) WHERE length(v) >= 5 AND NOT regexp_matches(v, '{_NOISE}'))"""


def _fields(spark, sf):
    r = records(spark, sf).select("id", "title", "content", "project", "type", "tool", "archived", "tier", "memory_level", "scope", F.array("tool", "session", F.concat(F.lit("fact of "), "id")).alias("facts"))
    return E.fields(r)


@query("embedding_fields", _FIELDS + " SELECT entry_id, field, sha256(text) AS hash FROM fields", records=True)
def embedding_fields(spark, sf):
    return _fields(spark, sf).select("entry_id", "field", F.sha2("text", 256).alias("hash"))


@query("embedding_changes", _FIELDS + r""", b AS (SELECT entry_id, CASE WHEN num % 4 = 0 THEN 'old' ELSE sha256(text) END AS hash, CASE WHEN num % 3 = 0 THEN 'k0' ELSE 'k1' END AS config, num % 7 <> 0 AS filled FROM fields WHERE num % 5 <> 0
  UNION ALL SELECT 'x' || entry_id, 'old', 'k1', true FROM fields WHERE num % 6 = 0)
SELECT coalesce(f.entry_id, b.entry_id) AS entry_id, CASE WHEN f.entry_id IS NULL THEN 'gone' WHEN b.hash IS NULL OR NOT filled THEN 'new' WHEN b.hash <> sha256(f.text) THEN 'changed' WHEN config <> 'k1' THEN 'config' ELSE 'kept' END AS action FROM fields f FULL JOIN b ON f.entry_id = b.entry_id""", records=True)
def embedding_changes(spark, sf):
    texts = _fields(spark, sf)
    num = F.substring("record_id", 2, 30).cast("long")
    stored = texts.where(num % 5 != 0).select("entry_id", F.when(num % 4 == 0, "old").otherwise(F.sha2("text", 256)).alias("hash"), F.when(num % 3 == 0, "k0").otherwise("k1").alias("config"), (num % 7 != 0).alias("filled"))
    left = texts.where(num % 6 == 0).select(F.concat(F.lit("x"), "entry_id").alias("entry_id"), F.lit("old").alias("hash"), F.lit("k1").alias("config"), F.lit(True).alias("filled"))
    return E.change_set(texts, stored.unionByName(left), "k1").select("entry_id", "action")


@query("embedding_build", r""", e AS (SELECT num, id AS entry_id, trim(regexp_replace(title || ' ' || project, '\s+', ' ', 'g')) AS text, trim(regexp_replace(title, '\s+', ' ', 'g')) AS raw FROM records)
SELECT entry_id, sha256(text) AS hash, CASE WHEN num % 4 = 0 OR num % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS build, 384 AS dimensions FROM e WHERE length(raw) >= 5 AND NOT regexp_matches(raw, '""" + _NOISE + "') AND num % 6 <> 0", records=True)
def embedding_build(spark, sf):
    store = E.Embeddings(spark, f"{shared_folder(spark)}/embeddings-{uuid.uuid4().hex}")
    config = E.config_hash("hash", "hashing-v1")
    embed = lambda df: N.hash_embeddings(df.select("id", X.hash_features("text").alias("features")), X.fnv1a32_each)
    now = records(spark, sf).select("id", "title", "project", "num")
    before = now.where("num % 5 <> 0").withColumn("project", F.when(F.col("num") % 4 == 0, "an old name").otherwise(F.col("project")))
    store.build(E.fields(before), embed, config)
    store.build(E.fields(now.where("num % 6 <> 0")), embed, config)
    return store.vectors().select("entry_id", "hash", "build", F.size("embedding").alias("dimensions"))


@query("layer_build", f""", r AS (SELECT num, id, content, sha256(content) AS h, t_ms, scope FROM records),
back AS (SELECT id, h, {AS_OF_MS} - (num % 60) * 1000 AS t_ms, scope FROM r WHERE num % 12 = 0), recent AS (SELECT h FROM (SELECT h, t_ms FROM r WHERE num % 8 = 1 UNION ALL SELECT h, t_ms FROM back) GROUP BY h HAVING {AS_OF_MS} - max(t_ms) <= 30000),
kept AS (SELECT id, scope, min(id) OVER (PARTITION BY h) <> max(id) OVER (PARTITION BY h) AS collides FROM r WHERE num % 8 = 0 AND h NOT IN (SELECT h FROM recent)),
made AS (SELECT 'shared' AS layer, id, scope, collides FROM kept UNION ALL SELECT 'shared', id, scope, false FROM back WHERE id NOT IN (SELECT id FROM kept)
  UNION ALL SELECT 'session', id, scope, NULL FROM r WHERE num % 8 IN (1, 2) UNION ALL SELECT 'session', id, 'project', NULL FROM r WHERE num % 8 = 3 AND content <> ''
  UNION ALL SELECT 'event', id, scope, NULL FROM r WHERE num % 8 = 7 UNION ALL SELECT 'task', id, scope, NULL FROM r WHERE num % 8 IN (4, 5, 6)) SELECT layer, id, scope, collides FROM made""", records=True)
def layer_build(spark, sf):
    """The layers of records of all documents, built twice into a new store: the second build finds nothing to do."""
    r = records(spark, sf).select("num", "id", "content", F.lit(None).cast("string").alias("content_hash"), "t_ms", "scope")
    part = lambda *kinds: B.source(r.where((F.col("num") % 8).isin(*kinds)))
    dreams = r.where("num % 12 = 0").withColumn("t_ms", F.lit(AS_OF_MS) - (F.col("num") % 60) * 1000)
    sources = {"inbox": part(0), "dreams": B.source(dreams), "stored": part(1), "sessions_stored": part(1), "sessions": part(2), "projects": part(1, 3), "events": part(7), "tasks": part(4, 5, 6)}
    layers = {n: layer for n, layer in B.memory_layers(AS_OF_MS).items() if n in ("shared", "session", "event", "task", "records")}
    store = Store(spark, f"{shared_folder(spark)}/layers-{uuid.uuid4().hex}")
    B.build(store, sources, layers)
    if again := {n for n, done in B.build(store, sources, layers).items() if done != "kept"}:
        raise AssertionError(f"made again: {sorted(again)}")
    return B.read(store, "records").select("layer", "id", "scope", "collides")
