"""Embeddings of record fields, built anew only where a field's text or the configuration has changed.

A build compares digests of field texts with those of the stored vectors. Only texts that are new or changed go to the provider; what
is added is one commit, so a build that dies leaves the store as it was, and one that has nothing to do writes nothing.
Stored rows are never rewritten: the newest row of an entry counts, a row without a vector says that the entry is gone.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from memoglyph.functions.text import head, is_noise, normalize_spaces
from memoglyph.operators.lifecycle import checkpointed
from memoglyph.sources.commits import Store

# fixed values: characters of a field that are kept, and that a provider is given; the levels of records that have no tier
PARENT_CHARACTERS, GIVEN_CHARACTERS = 6000, 3000
LEVEL_TIERS = {"session": 2, "ephemeral": 1, "project": 3, "shared": 4, "knowledge": 4, "durable": 4, "hot": 2, "task": 2}
# fixed values: tiers that are embedded by default, and the one of a record that tells nothing
EMBEDDED_TIERS, UNKNOWN_TIER = (2, 3, 4), 2

VECTORS = "entry_id string, record_id string, field string, hash string, config string, embedding array<double>, build long"


def config_hash(backend: str, model: str, address: str = "") -> str:
    """16 hex digits for what vectors were made by; an address counts for openai-compatible backends alone."""
    base = address.strip().rstrip("/").lower() if backend == "openai-compatible" else ""
    text = json.dumps({"backend": backend, "model": model.strip(), "baseUrl": base}, ensure_ascii=False, separators=(",", ":"))
    return hashlib.sha1(text.encode("utf-8", "ignore")).hexdigest()[:16]


def tier_of(tier: Column, level: Column, scope: Column) -> Column:
    """A record's tier, else that of its level, else of its scope, else 2."""
    known = F.create_map(*(F.lit(x) for pair in LEVEL_TIERS.items() for x in pair))
    named = lambda c: known[F.lower(F.coalesce(c, F.lit("")))]
    return F.coalesce(tier.cast("int"), named(level), named(scope), F.lit(UNKNOWN_TIER))


def fields(df: DataFrame, tiers: tuple[int, ...] = EMBEDDED_TIERS) -> DataFrame:
    """entry_id, record_id, field, text of each field of records: content (title, content and names as one), fact_0 ..., concept_0 ...

    df: id and any of title, content, agent, project, type, tool, facts, concepts, archived, tier, memory_level, scope. Archived records,
    other tiers, records whose title and content are noise and those without an id have none; noise among facts and concepts is left out,
    blank ones don't count in their numbers.
    """
    given = lambda c, kind="string": F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    clean = lambda c: normalize_spaces(given(c))
    joined = lambda *names: F.concat_ws(" ", *(F.coalesce(given(c), F.lit("")) for c in names))
    parent = head(joined("title", "content", "agent", "project", "type", "tool"), PARENT_CHARACTERS)

    def listed(c: str, name: str) -> Column:
        items = F.filter(F.transform(F.coalesce(given(c, "array<string>"), F.array().cast("array<string>")), normalize_spaces), lambda v: v != "")
        return F.filter(F.transform(items, lambda v, i: F.struct(F.concat(F.lit(f"{name}_"), i.cast("string")).alias("field"), v.alias("text"))), lambda s: ~is_noise(s["text"]))

    # the head is made once, in a struct that the filter looks at
    whole = F.filter(F.array(F.struct(F.lit("content").alias("field"), parent.alias("text"))), lambda s: s["text"] != "")
    kept = (clean("id") != "") & ~F.coalesce(given("archived", "boolean"), F.lit(False)) & tier_of(given("tier"), given("memory_level"), given("scope")).isin(*tiers) & ~is_noise(joined("title", "content"))
    rows = df.where(kept).select(clean("id").alias("record_id"), F.explode(F.concat(whole, listed("facts", "fact"), listed("concepts", "concept"))).alias("_f"))
    entry = F.when(F.col("_f.field") == "content", F.col("record_id")).otherwise(F.concat("record_id", F.lit("__"), F.col("_f.field")))
    return rows.select(entry.alias("entry_id"), "record_id", F.col("_f.field").alias("field"), F.col("_f.text").alias("text"))


def change_set(texts: DataFrame, stored: DataFrame, config: str) -> DataFrame:
    """entry_id, record_id, field, hash, action: kept, new, changed (another text), config (made by another configuration) or gone.

    texts: rows of fields(), an entry once; stored: entry_id, hash, config and filled (whether it has a vector). Only digests are shuffled, never texts or vectors.
    """
    now = texts.select("entry_id", "record_id", "field", F.sha2("text", 256).alias("hash"))
    old = stored.select("entry_id", F.col("hash").alias("_hash"), F.col("config").alias("_config"), F.col("filled").alias("_filled"))
    action = (
        F.when(F.col("hash").isNull(), "gone")
        .when(F.col("_hash").isNull() | ~F.coalesce("_filled", F.lit(False)), "new")
        .when(F.col("hash") != F.col("_hash"), "changed")
        .when(~F.col("_config").eqNullSafe(F.lit(config)), "config")
        .otherwise("kept")
    )
    return now.join(old, "entry_id", "full").withColumn("action", action).drop("_hash", "_config", "_filled")


class Embeddings:
    """Vectors of fields in a folder, grown by builds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.store = spark, Store(spark, path)

    def _newest(self, *columns: str) -> DataFrame:
        """The newest row of each entry that isn't gone."""
        if not self.store.has("vectors"):
            return self.spark.createDataFrame([], VECTORS).select("entry_id", *columns)
        last = F.max_by(F.struct(*columns, F.col("embedding").isNotNull().alias("_held")), "build").alias("_v")
        return self.store.read("vectors").groupBy("entry_id").agg(last).where("_v._held").select("entry_id", *(f"_v.{c}" for c in columns))

    def vectors(self) -> DataFrame:
        return self._newest("record_id", "field", "hash", "config", "embedding", "build")

    def changes(self, texts: DataFrame, config: str) -> DataFrame:
        """change_set() of the fields against what is stored."""
        held = self._newest("hash", "config").withColumn("filled", F.lit(True))
        return change_set(texts, held, config)

    def build(self, texts: DataFrame, embed: Callable[[DataFrame], DataFrame], config: str, force: bool = False) -> dict[str, int]:
        """Makes the store hold vectors of these fields; the number of entries of each action.

        embed: (id, text) to (id, embedding), as texts.embed_with makes it of a provider; it is given entries that are new, changed or of
        another configuration (all, by force), each text cut to 3000 characters. Entries of equal id count once. Another build that commits
        in between makes this one fail with a Conflict.
        """
        version = self.store.manifest()["version"]
        once = texts.dropDuplicates(["entry_id"])
        found = self.changes(once, config)
        if force:
            found = found.withColumn("action", F.when(F.col("action") == "kept", "changed").otherwise(F.col("action")))
        found = checkpointed(found)
        counts = {r["action"]: r["count"] for r in found.groupBy("action").count().collect()}
        if set(counts) <= {"kept"}:
            return counts
        due = found.where(F.col("action").isin("new", "changed", "config"))
        given = once.join(due.select("entry_id"), "entry_id", "left_semi").select(F.col("entry_id").alias("id"), F.substring("text", 1, GIVEN_CHARACTERS).alias("text"))
        made = due.join(embed(given).select(F.col("id").alias("entry_id"), F.col("embedding").cast("array<double>").alias("embedding")), "entry_id")
        gone = found.where("action = 'gone'").withColumn("embedding", F.lit(None).cast("array<double>"))
        rows = made.unionByName(gone).select("entry_id", "record_id", "field", "hash", F.lit(config).alias("config"), "embedding", F.lit(version + 1).cast("long").alias("build"))
        self.store.commit({"vectors": rows}, notes={"config": config}, expect=version)
        return counts

    def compact(self) -> int:
        """Rewrites the store with the newest rows alone."""
        version = self.store.manifest()["version"]
        return self.store.commit({"vectors": self.vectors()}, replace=True, expect=version)
