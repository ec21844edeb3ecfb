"""Entities and a graph of triples with validity intervals."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memoglyph.functions.classify import first_case
from memoglyph.functions.text import entity_id
from memoglyph.schema import TYPE_RANK


def valid_at(as_of, start="valid_from", end="valid_to") -> Column:
    """Validity at a time as text, both ends included; a null end is open."""
    t = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return (F.col(start).isNull() | (F.col(start) <= t)) & (F.col(end).isNull() | (F.col(end) >= t))


#: Days from 1970-01-01 that the bins of as_of_join() count from (year 1), and their levels: 2 ** LEVELS days.
FIRST_DAY, LEVELS = -719_162, 22


def _day(text: Column) -> Column:
    """Days since FIRST_DAY of a text that begins with a date; null for others."""
    day = F.unix_date(F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")) - F.lit(FIRST_DAY)
    return F.when(day.between(0, (1 << LEVELS) - 1), day)


def covering_bins(start: Column, end: Column) -> Column:
    """array<struct<level, bin>>: the fewest bins of 2 ** level days that make up start..end, at most two a level."""
    begin = F.struct(start.cast("long").alias("lo"), (end + 1).cast("long").alias("hi"), F.array().cast("array<struct<level:int,bin:bigint>>").alias("bins"))

    def step(s, level):
        piece = lambda b: F.struct(level.cast("int").alias("level"), b.alias("bin"))
        open_ = s["lo"] < s["hi"]
        low, high = open_ & (s["lo"] % 2 == 1), open_ & (s["hi"] % 2 == 1)
        found = F.filter(F.array(F.when(low, piece(s["lo"])), F.when(high, piece(s["hi"] - 1))), lambda x: x.isNotNull())
        lo, hi = s["lo"] + low.cast("long"), s["hi"] - high.cast("long")
        return F.struct(F.shiftright(lo, 1).alias("lo"), F.shiftright(hi, 1).alias("hi"), F.concat(s["bins"], F.array_distinct(found)).alias("bins"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), begin, step, lambda s: s["bins"])


def as_of_join(triples: DataFrame, times: DataFrame, at: str = "at") -> DataFrame:
    """triples joined with the times (column `at`, text that begins with a date) at which they are valid, both ends included.

    An interval is cut into the few bins of 1, 2, 4, ... days that make it up, and a time lies in one bin of each level, so
    both meet by equality: no loop over pairs, and a long or open interval (a null or unreadable end) takes no more than two
    bins a level. Parts of a day are settled by the comparison of valid_at() afterwards. Times that aren't dates, and null
    ones, meet nothing; repeated times and triples count as often as they stand.
    """
    start, end = F.coalesce(_day(F.col("valid_from")), F.lit(0)), F.coalesce(_day(F.col("valid_to")), F.lit((1 << LEVELS) - 1))
    cut = triples.withColumn("_b", F.explode(covering_bins(start, end))).select("*", F.col("_b.level").alias("_level"), F.col("_b.bin").alias("_bin")).drop("_b")
    day = _day(F.col(at))
    held = times.where(day.isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS)))).withColumn("_bin", F.floor(day / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    return cut.join(held, ["_level", "_bin"]).where(valid_at(F.col(at))).drop("_level", "_bin")


def current_at(as_of) -> Column:
    """Validity with the end excluded."""
    return F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(as_of))


def triple_id(subject, predicate, object_, valid_from, default: str = "") -> Column:
    return F.substring(F.sha1(F.concat_ws("|", subject, predicate, object_, F.coalesce(valid_from, F.lit(default)))), 1, 20)


def upsert_entities(rows: DataFrame) -> DataFrame:
    """id, name, type, properties of rows (seq, name, type, properties map): the most specific type, later properties win."""
    rank = first_case([(F.col("type") == t, r) for t, r in TYPE_RANK.items()], 0)
    keyed = rows.withColumn("id", entity_id("name")).withColumn("_rank", rank)
    kept = keyed.groupBy("id").agg(F.max_by("name", "seq").alias("name"), F.max_by("type", F.struct("_rank", F.negate("seq"))).alias("type"))
    latest = keyed.select("id", "seq", F.explode("properties").alias("k", "v")).groupBy("id", "k").agg(F.max_by("v", "seq").alias("v"))
    props = latest.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("properties"))
    return kept.join(props, "id", "left")


def new_triples(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """rows without those of which an open triple is stored or comes earlier (by seq) among the rows."""
    key = ["subject", "predicate", "object"]
    opened = rows.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy("seq")))
    return opened.where(F.col("_n") == 1).drop("_n").join(stored.where(F.col("valid_to").isNull()).select(*key).distinct(), key, "left_anti")


def upsert_triples(rows: DataFrame) -> DataFrame:
    """Versions of triples: each (subject, predicate, object) is closed when its next version (by seq) begins."""
    ends = F.lead("valid_from").over(W.partitionBy("subject", "predicate", "object").orderBy("seq"))
    return rows.withColumn("valid_to", ends).withColumn("id", triple_id(F.col("subject"), F.col("predicate"), F.col("object"), F.col("valid_from")))


def invalidate(triples: DataFrame, subject: str, predicate: str, object_: str, ended: str) -> DataFrame:
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_) & F.col("valid_to").isNull()
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def raise_confidence(triples: DataFrame, entity: str, as_of: str, delta: float = 0.05, most: int = 100) -> DataFrame:
    """The first `most` current triples (by id) of an entity with delta more confidence, 1.0 at most."""
    hit = triples.where(((F.col("subject") == entity) | (F.col("object") == entity)) & current_at(as_of)).orderBy("id").limit(most)
    return hit.withColumn("confidence", F.least(F.lit(1.0), F.coalesce("confidence", F.lit(0.5)) + delta))


def entity_edges(triples: DataFrame, entities: DataFrame, entity: str, direction: str = "outgoing", as_of: str | None = None) -> DataFrame:
    """direction, subject, predicate, object, valid_from, valid_to, confidence, current of an entity's triples."""
    kept = triples.where(valid_at(as_of)) if as_of else triples
    name = entities.select(F.col("id").alias("_e"), F.col("name").alias("_n"))
    tail = ["predicate", "valid_from", "valid_to", "confidence", F.col("valid_to").isNull().alias("current")]
    out = kept.where(F.col("subject") == entity).join(name, F.col("object") == F.col("_e")).select(F.lit("outgoing").alias("direction"), F.lit(entity).alias("subject"), F.col("_n").alias("object"), *tail)
    into = kept.where(F.col("object") == entity).join(name, F.col("subject") == F.col("_e")).select(F.lit("incoming").alias("direction"), F.col("_n").alias("subject"), F.lit(entity).alias("object"), *tail)
    return {"outgoing": out, "incoming": into}.get(direction) if direction != "both" else out.unionByName(into)


def named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """triples with the names of both ends; ends that aren't entities are left out."""
    side = lambda id_, name: entities.select(F.col("id").alias(id_), F.col("name").alias(name))
    return triples.join(side("subject", "subject_name"), "subject").join(side("object", "object_name"), "object")


def relationships(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    kept = triples.where(F.col("predicate") == re.sub(r"\s+", "_", predicate.lower()))
    both = named(kept.where(valid_at(as_of)) if as_of else kept, entities)
    return both.select(F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def timeline(triples: DataFrame, entities: DataFrame, entity: str | None = None, most: int = 200) -> DataFrame:
    """The first triples by start, those without one last; ties by id."""
    kept = triples if entity is None else triples.where((F.col("subject") == entity) | (F.col("object") == entity))
    first = kept.join(entities.select(F.col("id").alias("subject")), "subject", "left_semi").join(entities.select(F.col("id").alias("object")), "object", "left_semi")
    return named(first.orderBy(F.asc_nulls_last("valid_from"), "id").limit(most), entities)


def current_triples(triples: DataFrame, as_of: str, subject_part: str = "", most: int = 50) -> DataFrame:
    kept = triples.where(current_at(as_of) & F.col("subject").contains(subject_part))
    return kept.orderBy(F.desc("confidence"), F.desc_nulls_last("valid_from"), "id").limit(most)


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """entities, triples, current_facts, expired_facts, relationship_types (sorted) in one row."""
    t = triples.agg(F.count("*").alias("triples"), F.count_if(F.col("valid_to").isNull()).alias("current_facts"), F.array_sort(F.collect_set("predicate")).alias("relationship_types"))
    e = entities.agg(F.count("*").alias("entities"))
    return t.crossJoin(e).withColumn("expired_facts", F.col("triples") - F.col("current_facts"))


def search_entities(entities: DataFrame, query: str, limit: int = 20, working_set: int = 200) -> DataFrame:
    """id, name, type, relevance of the first `working_set` entities by name that hold all words of the query.

    3: the name begins with the query, 2: with its first word, 1: else. Best first, then by name.
    """
    tokens = query.lower().split()
    if not tokens:
        return entities.select("id", "name", "type", F.lit(0).alias("relevance")).where("false")
    first = entities.orderBy("name", "id").limit(working_set)
    low = F.lower("name")
    every = F.lit(True)
    for t in tokens:
        every = every & low.contains(t)
    relevance = F.when(~every, 0).when(low.startswith(query.lower()), 3).when(low.startswith(tokens[0]), 2).otherwise(1)
    return first.select("id", "name", "type", relevance.alias("relevance")).where("relevance > 0").orderBy(F.desc("relevance"), "name", "id").limit(limit)


def fact_triples(records: DataFrame) -> DataFrame:
    """Triples of records (id, facts array<struct<subject,predicate,object,name,entity_type,confidence>>).

    A fact with both ends is a triple (is_a without a predicate, confidence 1.0 by default); one with an entity type says
    what its name or subject is (0.7); others are passed over.
    """
    f = records.select(F.col("id").alias("source_id"), F.posexplode("facts").alias("pos", "f")).select("source_id", "pos", "f.*")
    full = F.col("subject").isNotNull() & F.col("object").isNotNull()
    typed = F.col("entity_type").isNotNull() & F.coalesce("name", "subject").isNotNull()
    rows = f.where(full | typed).select(
        "source_id", "pos", F.when(full, F.col("subject")).otherwise(F.coalesce("name", "subject")).alias("subject"), F.when(full, F.coalesce("predicate", F.lit("is_a"))).otherwise(F.lit("is_a")).alias("predicate"),
        F.when(full, F.col("object")).otherwise(F.col("entity_type")).alias("object"), F.coalesce("confidence", F.when(full, 1.0).otherwise(0.7)).alias("confidence"),
    )
    return rows.withColumn("subject", entity_id("subject")).withColumn("object", entity_id("object"))
