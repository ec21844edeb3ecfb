"""Projections of search results and text packs for readers: compact and full forms, boot context, wake-up, routing sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from memoglyph.functions.classify import DAY_MS, first_case, lowered
from memoglyph.functions.text import clamp_text


def formatted(results: DataFrame, most_title: int = 120, most_excerpt: int = 240) -> DataFrame:
    """rank, id, score (6 digits), title, excerpt, est_tokens of ranked results (id, rank, score, title, content, search_text)."""
    return results.select(
        "rank", "id", F.round("score", 6).alias("score"), F.substring("title", 1, most_title).alias("title"), F.substring("content", 1, most_excerpt).alias("excerpt"),
        F.floor((F.length("search_text") + F.length("content")) / 4).cast("long").alias("est_tokens"),
    )


def compact(rows: DataFrame, full: bool = False) -> DataFrame:
    """id, title and, unless full, a summary of 200 characters instead of the content."""
    title = F.substring("title", 1, 120).alias("title")
    return rows.select("id", title, "content") if full else rows.select("id", title, clamp_text("content", 200).alias("summary"))


def boot_context(facts: DataFrame, most: int = 20, characters: int = 32 * 1024) -> DataFrame:
    """context: the newest `most` facts (line, fact) that didn't fail extraction, newest first, cut to a size."""
    last = facts.where(~F.coalesce(F.col("extraction_failed"), F.lit(False))).orderBy(F.desc("line")).limit(most)
    packed = last.agg(F.sort_array(F.collect_list(F.struct(F.negate("line").alias("o"), "fact"))).alias("f"))
    return packed.select(F.substring(F.array_join(F.transform("f", lambda x: F.concat(F.lit("- "), x["fact"])), "\n"), 1, characters).alias("context"))


def refine_fallback(results: DataFrame, most: int) -> DataFrame:
    """The first results, where no model chooses among them."""
    return results.where(F.col("rank") <= most)


def summary_boost(score: Column, scope: Column, kind: Column) -> Column:
    """score plus 0.05 for summaries, plus 0.03 for what a session wrote."""
    return score + F.when(lowered(scope) == "summary", 0.05).otherwise(0.0) + F.when(lowered(kind) == "session", 0.03).otherwise(0.0)


# fixed values: days that a record of a scope is kept; users' records for good
TTL_DAYS = {"feedback": 90, "project": 30, "reference": 180, "summary": 7, "task": 7, "run": 7}


def expires_ms(t_ms: Column, scope: Column, legacy: bool = False) -> Column:
    """When a record of a scope expires; null for users' ones (7 days in the legacy form)."""
    days = first_case([(lowered(scope) == s, d) for s, d in TTL_DAYS.items()], 7).cast("long")
    expires = t_ms + days * DAY_MS
    return expires if legacy else F.when(lowered(scope) == "user", None).otherwise(expires)


def orphans(records: DataFrame, files: DataFrame) -> DataFrame:
    """id of records (id, files array<struct<path>>) that name a file which isn't in files (path)."""
    named = records.select("id", F.explode("files").alias("f")).select("id", "f.path").where(F.col("path").isNotNull())
    return named.join(files.select("path").distinct(), "path", "left_anti").select("id").distinct()


def any_pattern(patterns: list[str], *texts: Column) -> Column:
    """Whether one of the patterns is found in the texts."""
    return F.concat_ws("\n", *texts).rlike("|".join(f"(?:{p})" for p in patterns))


def first_or_else(main: DataFrame, other: DataFrame) -> DataFrame:
    """main, or the other source if main has no rows; decided in the plan, without an action."""
    any_main = F.broadcast(main.limit(1).agg((F.count("*") > 0).alias("_any")))
    return main.unionByName(other.crossJoin(any_main).where(~F.col("_any")).drop("_any"))


def last_rows(df: DataFrame, most: int, *order, keys: list[str] | None = None) -> DataFrame:
    """The last rows of a log, of each key or of all."""
    if not keys:
        return df.orderBy(*order).limit(most)
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def written(stored: DataFrame, asked: DataFrame, newest: int = 25) -> DataFrame:
    """The asked rows (content, title) that are among the newest stored ones (content, title, t_ms, id)."""
    recent = stored.orderBy(F.desc("t_ms"), "id").limit(newest)
    return asked.join(recent.select("content", "title").distinct(), ["content", "title"], "left_semi")


def composite(metrics: dict[str, Column], weights=(0.30, 0.25, 0.20, 0.15, 0.10)) -> Column:
    return reduce(lambda a, b: a + b, (m * w for m, w in zip(metrics.values(), weights, strict=True)))


def sweep(weights: tuple[float, ...], by: float = 0.10) -> list[tuple[float, ...]]:
    """Weight settings in which one weight is up or down by a share and the sum stays 1."""
    out = [weights]
    for i, _ in enumerate(weights):
        for sign in (1, -1):
            moved = [w * (1 + sign * by) if j == i else w for j, w in enumerate(weights)]
            out.append(tuple(w / sum(moved) for w in moved))
    return out


def pre_annotations(queries: DataFrame, results: DataFrame, most: int = 10) -> DataFrame:
    """query, proxies: for queries that aren't annotated, their best results with scores as proxies of relevance."""
    top = results.where(F.col("rank") <= most).groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "score"))).alias("proxies"))
    return queries.where(~F.coalesce(F.col("annotated"), F.lit(False))).select("query").join(top, "query", "left")


def agent_sections(rows: DataFrame, durable: int = 6, imported: int = 4, inbox: int = 3, working: int = 6) -> DataFrame:
    """agent, section, text, place of rows (agent, kind: durable, imported or inbox, seq, text), texts once regardless of case.

    Working lines are the first imported ones, then inbox ones.
    """
    most = first_case([(F.col("kind") == k, n) for k, n in (("durable", durable), ("imported", imported), ("inbox", inbox))], 0)
    one = rows.withColumn("_k", F.lower(F.trim("text"))).withColumn("_a", F.row_number().over(W.partitionBy("agent", "kind", "_k").orderBy("seq"))).where("_a = 1")
    cut = one.withColumn("_b", F.row_number().over(W.partitionBy("agent", "kind").orderBy("seq"))).where(F.col("_b") <= most)
    order = first_case([(F.col("kind") == "inbox", 1)], 0)
    merged = cut.withColumn("section", F.when(F.col("kind") == "durable", "durable").otherwise("working")).withColumn("_o", order)
    merged = merged.withColumn("_c", F.row_number().over(W.partitionBy("agent", "section", "_k").orderBy("_o", "seq"))).where("_c = 1")
    placed = merged.withColumn("place", F.row_number().over(W.partitionBy("agent", "section").orderBy("_o", "seq")))
    return placed.where(F.col("place") <= F.when(F.col("section") == "durable", durable).otherwise(working)).select("agent", "section", "text", "place")


def global_context(records: DataFrame, scopes: list[str], per_scope: int = 3) -> DataFrame:
    """scope, line: the newest records of each scope as lines."""
    top = last_rows(records.where(F.col("scope").isin(scopes)), per_scope, F.desc("t_ms"), "id", keys=["scope"])
    return top.select("scope", F.concat(F.lit("- "), clamp_text("title", 60)).alias("line"))


def overview(records: DataFrame, as_of_ms: int) -> DataFrame:
    """records, open_tasks, hot, tokens in one row: what a reader sees on waking up."""
    fresh = F.lit(as_of_ms) - F.col("t_ms") <= DAY_MS
    is_open = (F.col("task_state") != "") & ~F.col("task_state").isin("completed", "aborted", "failed")
    return records.agg(F.count("*").alias("records"), F.count_if(is_open).alias("open_tasks"), F.count_if(fresh).alias("hot"), F.sum(F.ceil(F.length("content") / 4)).cast("long").alias("tokens"))
