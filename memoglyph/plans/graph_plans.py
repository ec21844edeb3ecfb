"""The graph: customers, nations and orders as entities and dated triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from memoglyph.operators import entities as E, graph as G
from memoglyph.plans.catalog import query
from memoglyph.views import records, table

AS_OF = "1996-01-01"
#: For DuckDB: triples of customers with the priority of their orders, each open until the customer's next order.
_T = """t AS (SELECT 'c' || o_custkey AS subject, 'has_priority' AS predicate, lower(split_part(o_orderpriority, '-', 2)) AS object, strftime(o_orderdate, '%Y-%m-%d') AS valid_from,
  strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), '%Y-%m-%d') AS valid_to, (o_orderkey % 10) / 10.0::DOUBLE AS confidence, o_orderkey AS id FROM orders),
e AS (SELECT 'c' || c_custkey AS id, c_name AS name, 'person' AS type FROM customer UNION ALL SELECT DISTINCT lower(split_part(o_orderpriority, '-', 2)), 'P ' || split_part(o_orderpriority, '-', 2), 'concept' FROM orders)"""


def triples(spark, sf):
    o = table(spark, sf, "orders")
    from pyspark.sql import Window as W

    w = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return o.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("subject"), F.lit("has_priority").alias("predicate"), F.lower(F.coalesce(F.get(F.split("o_orderpriority", "-"), 1), F.lit(""))).alias("object"), day("o_orderdate").alias("valid_from"), day(F.lead("o_orderdate").over(w)).alias("valid_to"), ((F.col("o_orderkey") % 10) / 10.0).alias("confidence"), F.col("o_orderkey").alias("id"))


def entities(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_name").alias("name"), F.lit("person").alias("type"))
    p = F.coalesce(F.get(F.split("o_orderpriority", "-"), 1), F.lit(""))
    o = table(spark, sf, "orders").select(F.lower(p).alias("id"), F.concat(F.lit("P "), p).alias("name"), F.lit("concept").alias("type")).distinct()
    return c.unionByName(o)


@query("kg_asof", f"WITH {_T} SELECT subject, object, valid_from, valid_to FROM t WHERE (valid_from IS NULL OR valid_from <= '{AS_OF}') AND (valid_to IS NULL OR valid_to >= '{AS_OF}')")
def as_of(spark, sf):
    return triples(spark, sf).where(G.valid_at(AS_OF)).select("subject", "object", "valid_from", "valid_to")


@query("kg_asof_times", f"WITH {_T}, m AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m-01') AS at FROM orders) SELECT m.at, object, count(*)::BIGINT AS n FROM t JOIN m ON valid_from <= m.at AND (valid_to IS NULL OR valid_to >= m.at) GROUP BY ALL")
def as_of_times(spark, sf):
    """How many triples of each object are valid at the first of each month."""
    months = table(spark, sf, "orders").select(F.date_format("o_orderdate", "yyyy-MM-01").alias("at")).distinct()
    return G.as_of_join(triples(spark, sf), months).groupBy("at", "object").agg(F.count("*").alias("n"))


@query("kg_entity_both", f"WITH {_T}, k AS (SELECT subject FROM t GROUP BY subject ORDER BY count(*) DESC, subject LIMIT 1), o AS (SELECT object FROM t GROUP BY object ORDER BY count(*) DESC, object LIMIT 1) SELECT 'outgoing' AS direction, e.name AS other, t.valid_from, t.valid_to IS NULL AS current FROM t JOIN k USING (subject) JOIN e ON e.id = t.object UNION ALL SELECT 'incoming', e.name, t.valid_from, t.valid_to IS NULL FROM t JOIN o USING (object) JOIN e ON e.id = t.subject")
def entity(spark, sf):
    t, e = triples(spark, sf), entities(spark, sf)
    top = lambda c: t.groupBy(c).count().orderBy(F.desc("count"), c).first()[c]
    out = G.entity_edges(t, e, top("subject"), "outgoing").select("direction", F.col("object").alias("other"), "valid_from", "current")
    return out.unionByName(G.entity_edges(t, e, top("object"), "incoming").select("direction", F.col("subject").alias("other"), "valid_from", "current"))


@query("kg_relationship", f"WITH {_T} SELECT s.name AS subject, o.name AS object, t.valid_from, t.valid_to FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object WHERE t.predicate = 'has_priority' AND t.valid_from <= '{AS_OF}' AND (t.valid_to IS NULL OR t.valid_to >= '{AS_OF}')")
def relationship(spark, sf):
    return G.relationships(triples(spark, sf), entities(spark, sf), "Has Priority", AS_OF).select("subject", "object", "valid_from", "valid_to")


@query("kg_timeline", f"WITH {_T} SELECT t.id, s.name AS subject_name, o.name AS object_name, t.valid_from FROM t JOIN e s ON s.id = t.subject JOIN e o ON o.id = t.object ORDER BY t.valid_from NULLS LAST, t.id LIMIT 200")
def timeline(spark, sf):
    return G.timeline(triples(spark, sf), entities(spark, sf)).select("id", "subject_name", "object_name", "valid_from")


@query("kg_current", f"WITH {_T} SELECT id, subject, confidence FROM t WHERE (valid_to IS NULL OR valid_to > '{AS_OF}') AND contains(subject, 'c1') ORDER BY confidence DESC, valid_from DESC NULLS LAST, id LIMIT 50")
def current(spark, sf):
    return G.current_triples(triples(spark, sf), AS_OF, "c1").select("id", "subject", "confidence")


@query("kg_stats", f"WITH {_T} SELECT (SELECT count(*) FROM e)::BIGINT AS entities, count(*)::BIGINT AS triples, sum((valid_to IS NULL)::INT)::BIGINT AS current_facts, sum((valid_to IS NOT NULL)::INT)::BIGINT AS expired_facts, 'has_priority' AS types FROM t")
def stats(spark, sf):
    return G.stats(triples(spark, sf), entities(spark, sf)).select("entities", "triples", "current_facts", "expired_facts", F.array_join("relationship_types", ",").alias("types"))


@query("kg_entities_by_type", f"WITH {_T} SELECT type, count(*)::BIGINT AS n FROM e GROUP BY type")
def by_type(spark, sf):
    return entities(spark, sf).groupBy("type").agg(F.count("*").alias("n"))


@query("kg_search", f"WITH {_T}, f AS (SELECT * FROM e ORDER BY name, id LIMIT 200) SELECT id, CASE WHEN starts_with(lower(name), 'customer 00') THEN 3 WHEN starts_with(lower(name), 'customer') THEN 2 ELSE 1 END AS relevance FROM f WHERE contains(lower(name), 'customer') AND contains(lower(name), '00') ORDER BY relevance DESC, name, id LIMIT 20")
def search(spark, sf):
    return G.search_entities(entities(spark, sf), "customer 00").select("id", "relevance")


@query("kg_add_triples", "WITH r AS (SELECT o_custkey, o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey AS seq FROM r WHERE n = 1 AND (o_custkey, o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 = 0)")
def add(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderstatus").alias("object"))
    stored = o.where("seq % 2 = 1").withColumn("valid_to", F.when(F.col("seq") % 3 != 0, "2000-01-01"))
    return G.new_triples(stored, o.where("seq % 2 = 0")).select("seq")


@query("kg_upsert", "SELECT o_orderkey AS seq, strftime(o_orderdate, '%Y-%m-%d') AS valid_from, strftime(lead(o_orderdate) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey), '%Y-%m-%d') AS valid_to, substr(sha1(o_custkey || '|has|' || o_orderstatus || '|' || strftime(o_orderdate, '%Y-%m-%d')), 1, 20) AS id FROM orders")
def upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").cast("string").alias("subject"), F.lit("has").alias("predicate"), F.col("o_orderstatus").alias("object"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("valid_from"))
    return G.upsert_triples(o).select("seq", "valid_from", "valid_to", "id")


@query("kg_invalidate", f"WITH {_T}, k AS (SELECT subject, object FROM t WHERE valid_to IS NULL ORDER BY id LIMIT 1) SELECT t.id, CASE WHEN t.valid_to IS NULL AND t.subject = k.subject AND t.object = k.object THEN '2001-01-01' ELSE t.valid_to END AS valid_to FROM t, k")
def invalidate(spark, sf):
    t = triples(spark, sf)
    k = t.where("valid_to IS NULL").orderBy("id").first()
    return G.invalidate(t, k["subject"], "has_priority", k["object"], "2001-01-01").select("id", "valid_to")


@query("kg_confidence", f"WITH {_T}, k AS (SELECT object FROM t GROUP BY object ORDER BY count(*) DESC, object LIMIT 1) SELECT id, round(least(1.0, confidence + 0.05), 6)::DOUBLE AS confidence FROM t JOIN k USING (object) WHERE valid_to IS NULL OR valid_to > '{AS_OF}' ORDER BY id LIMIT 100")
def confidence(spark, sf):
    t = triples(spark, sf)
    k = t.groupBy("object").count().orderBy(F.desc("count"), "object").first()["object"]
    return G.raise_confidence(t, k, AS_OF).select("id", F.round("confidence", 6).alias("confidence"))


@query("kg_upsert_entities", "WITH s AS (SELECT 'c' || c_nationkey AS id, c_custkey AS seq, CASE c_custkey % 3 WHEN 0 THEN 'tool' WHEN 1 THEN 'project' ELSE 'unknown' END AS type, c_mktsegment AS v FROM customer) SELECT id, arg_min(type, CASE type WHEN 'project' THEN 0 WHEN 'tool' THEN 1 ELSE 2 END) AS type, arg_max(v, seq) AS segment FROM s GROUP BY id")
def upsert_entities(spark, sf):
    c = table(spark, sf, "customer").select(F.concat(F.lit("C"), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_custkey").alias("seq"), F.element_at(F.array(F.lit("tool"), F.lit("project"), F.lit("unknown")), (F.col("c_custkey") % 3 + 1).cast("int")).alias("type"), F.create_map(F.lit("segment"), F.col("c_mktsegment")).alias("properties"))
    return G.upsert_entities(c).select("id", "type", F.col("properties")["segment"].alias("segment"))


@query("kg_fact_triples", " SELECT id AS source_id, CASE WHEN num % 3 = 0 THEN tool ELSE lang END AS subject, CASE WHEN num % 3 = 0 AND num % 2 = 0 THEN 'uses' ELSE 'is_a' END AS predicate, CASE WHEN num % 3 = 0 THEN project ELSE 'concept' END AS object, CASE WHEN num % 3 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS confidence FROM records WHERE num % 3 <> 2", records=True)
def facts(spark, sf):
    n = F.col("num") % 3
    none = F.lit(None).cast("string")
    fact = F.struct(F.when(n == 0, F.col("tool")).alias("subject"), F.when((n == 0) & (F.col("num") % 2 == 0), "uses").alias("predicate"), F.when(n == 0, F.col("project")).alias("object"), F.when(n == 1, F.col("lang")).alias("name"), F.when(n == 1, "concept").otherwise(none).alias("entity_type"), F.lit(None).cast("double").alias("confidence"))
    return G.fact_triples(records(spark, sf).select("id", F.array(fact).alias("facts"))).select("source_id", "subject", "predicate", "object", "confidence")


_STOP = "['" + "', '".join(E.STOPWORDS) + "']"
_SPACED = "trim(regexp_replace(content, '\\s+', ' ', 'g'))"
_BODY = f"body AS (SELECT id, CASE WHEN length({_SPACED}) >= 10 THEN {_SPACED} ELSE '' END AS t FROM records)"
_ANCHORED = " UNION ".join(f"SELECT id, unnest(regexp_extract_all(t, '([\\x{{4e00}}-\\x{{9fff}}]{{1,4}}|[A-Za-z0-9_.-]{{1,20}}){after}', 1)) AS name FROM body" for after in ("版本", " v", "\\.py", "\\.js"))


# names at Chinese patterns of persons aren't in the SQL, as the tables have no Chinese text; the tests have
@query("entity_candidates", f""", {_BODY}, w AS (
  SELECT id, unnest(regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9]{{1,24}})\\b', 1)) AS name, 1 AS kind FROM body
  UNION ALL SELECT id, unnest(regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9]+(?:\\s+[A-Z][a-zA-Z0-9]+){{1,4}})\\b', 1)), 2 FROM body
  UNION ALL SELECT id, name, 3 FROM ({_ANCHORED}) WHERE length(name) >= 2)
SELECT id, name, count(*)::BIGINT AS frequency FROM w WHERE kind = 3 OR NOT list_has_any(string_split(lower(name), ' '), {_STOP}) GROUP BY id, name""", records=True)
def candidates(spark, sf):
    return E.candidates(records(spark, sf))


def _relation_sql(pattern: str, middle: str, end: str) -> str:
    of = lambda g: f"unnest(regexp_extract_all(t, '(?i){pattern}', {g}))"
    return f"SELECT id, {of(1)} AS s, {of(2)} AS p, {of(3 if end else 2)} AS o, '_{middle}_' AS m, '{end}' AS e FROM body"


_CUT = lambda c: f"regexp_replace(trim({c}), '[.,;!?。，；]+$', '')"


@query("entity_relations", f""", {_BODY}, f AS ({' UNION ALL '.join(_relation_sql(*r) for r in E.RELATIONS)}),
x AS (SELECT id, {_CUT('s')} AS subject, regexp_replace(lower({_CUT('s')}), '\\s+', '_', 'g') || m || regexp_replace({_CUT('lower(p)')}, '\\s+', '_', 'g') || e AS predicate, {_CUT('o')} AS object FROM f)
SELECT id, subject, predicate, object, 0.7::DOUBLE AS confidence FROM x WHERE length(subject) >= 3 AND length(object) >= 3 AND NOT list_contains({_STOP}, lower(subject)) AND NOT list_contains({_STOP}, lower(object))""", records=True)
def relations(spark, sf):
    return E.relations(records(spark, sf).select("id", "content"))


@query("entity_types")
def types(spark, sf):
    return E.score_types(records(spark, sf).select("id", "content"))


@query("coreference")
def coreference(spark, sf):
    return E.resolve_pronouns(records(spark, sf).select("id", "content"))


@query("entity_pipeline")
def pipeline(spark, sf):
    return E.extract(records(spark, sf).select("id", "content"))


@query("entity_backfill")
def backfill(spark, sf):
    none = F.array().cast("array<string>")
    rows = records(spark, sf).select("id", "content", none.alias("facts"), none.alias("concepts"), (F.col("num") % 3 == 0).alias("extracted"))
    return E.backfill(rows).select("id", "facts", "concepts", "extracted")


@query("kg_path_match", r"""
WITH p AS (SELECT page_id, regexp_replace(url, '/+$', '') AS p FROM pages WHERE url IS NOT NULL), d AS (SELECT DISTINCT regexp_replace(p, '/[^/]*$', '') AS d FROM p)
SELECT page_id, d AS folder, length(p) - length(d) AS below FROM p JOIN d ON p = d OR starts_with(p, d || '/') OR starts_with(d, p || '/')""")
def paths(spark, sf):
    """Every page with each folder that holds it, is it or lies within it."""
    from memoglyph.sources.texts import path_join

    p = table(spark, sf, "pages").where("url IS NOT NULL").select("page_id", F.regexp_replace("url", "/+$", "").alias("p"))
    d = p.select(F.regexp_replace("p", "/[^/]*$", "").alias("folder")).distinct()
    return path_join(p, d, "p", "folder").select("page_id", "folder", (F.length("p") - F.length("folder")).alias("below"))
