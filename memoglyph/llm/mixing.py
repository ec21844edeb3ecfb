"""Mixing sources to target weights by hash thresholds.

Every document has a hash. A source that is to give a share of its words takes the documents below a hash threshold, and
the threshold comes from a histogram: words summed by source and hash bucket show the bucket in which the budget runs out,
only that bucket is split further, and so on until one hash is left. Nothing is sorted, thresholds of smaller budgets
nest in those of larger ones, and a rerun takes the same documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memoglyph.llm.common import WORD, checkpointed, free_names, joined_small, table

#: Bits of a document's hash, and bits that one histogram resolves.
HASH_BITS, LEVEL_BITS = 60, 12
#: Sources with one null among them; the weights repeat over the sources in code-point order.
WEIGHTS = (1, 2, 3)
#: A document is taken so many times at most.
MOST_REPEATS = 3


def size_of(text: str = "text"):
    """Words of a whole text; null counts none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(doc_id: str = "doc_id"):
    """60 bits of the MD5 of an id as text; a null id counts as the empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: int = MOST_REPEATS) -> dict[str | None, float]:
    """The words each source is to give: shares of all words by weight, none above `most` times its own.

    What a source can't give goes to the others by weight, until none is above. Sources without words get 0.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    out = {s: 0.0 for s in size}
    left, free = float(sum(size.values())), [s for s, _ in order]
    while free:
        whole = sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / whole > most * size[s]]
        if not above:
            for s in free:
                out[s] = left * weight[s] / whole
            break
        for s in above:
            out[s] = float(most * size[s])
            left -= out[s]
            free.remove(s)
    return out


def mix(docs: DataFrame, sources: str = "source", doc_id: str = "doc_id", text: str = "text", weights=WEIGHTS, most: int = MOST_REPEATS, size: str | None = None) -> DataFrame:
    """docs with size, source_size, target and taken: words of the text, of its source, the source's target, words taken.

    A source takes each document floor(target / source_size) times, and those below its hash threshold once more; the
    threshold comes as near to the target as whole documents allow (of two equally near, the smaller). Rows of one hash,
    such as repeated rows, go together. A null or empty text has size 0 and is taken for 0 words; a null source is a
    source; an empty table gives an empty result. Sources stay a table, whatever their number; a hot one is never one
    task's. Words are counted once for the thresholds and once for the rows that are returned, or not at all where `size`
    names a column that has them. Columns of docs with the names of new ones are replaced, all others stay.
    """
    new = ["size", "source_size", "target", "taken"]
    kept = [c for c in docs.columns if c not in new]
    own = free_names([*docs.columns, *new])
    names = {c: f"{own}{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    s = F.col(names[sources])
    keyed = rows.select(
        "*", F.when(s.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), s.cast("string"))).alias("key"), s.cast("string").alias("s"), hash_of(names[doc_id]).alias("h"),
        (F.coalesce(F.col(names[size]).cast("long"), F.lit(0)) if size else size_of(names[text])).alias("n"),
    )
    small = checkpointed(keyed.select("key", "s", "h", "n"))
    sizes = checkpointed(small.groupBy("key", "s").agg(F.sum("n").alias("size")))
    plan = target_table(sizes, weights, most)
    share = F.when(F.col("size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("int")
    plan = checkpointed(plan.select("key", F.col("size").alias("source_size"), "target", share.alias("repeats")))
    budget = F.when((F.col("source_size") > 0) & (F.col("repeats") < most), F.col("target") - F.col("repeats") * F.col("source_size")).otherwise(F.lit(0.0))
    below = thresholds(small, plan.select("key", budget.alias("budget")))
    plan = checkpointed(plan.join(below, "key"))
    out = joined_small(keyed, plan, ["key"])
    taken = F.col("n") * (F.col("repeats") + (F.col("h") < F.col("below")).cast("int"))
    return out.select(*(F.col(names[c]).alias(c) for c in kept), F.col("n").alias("size"), "source_size", "target", taken.cast("long").alias("taken"))


def target_table(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """targets() of a table of sources: key, s, size, target.

    Weights follow the code points of the sources: ranks are counted in ranges of that order, so no task sees all. What
    one word of weight gives grows until no further source is above its limit; only sums reach the driver.
    """
    order = (F.col("s").isNull(), F.encode(F.col("s"), "UTF-8"), F.col("key"))
    placed = checkpointed(sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = {r["p"]: r["count"] for r in placed.groupBy(part.alias("p")).count().collect()}  # one row a range
    before, start = [], 0
    for p in sorted(counts):
        before.append((p, start))
        start += counts[p]
    if not before:
        return sizes.withColumn("target", F.lit(0.0))
    offsets = sizes.sparkSession.createDataFrame(before, "p long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    ranked = checkpointed(placed.withColumn("p", part).join(F.broadcast(offsets), "p").select("key", "s", "size", weight.alias("w")))
    total = ranked.agg(F.sum("size")).first()[0]
    left, whole = float(total), None
    capped = F.lit(False)
    while True:
        free = ranked.where(~capped).agg(F.sum("w").alias("w")).first()["w"]
        left = float(total - most * (ranked.where(capped).agg(F.sum("size")).first()[0] or 0))
        if not free or whole == free:
            break
        whole = free
        capped = F.lit(left) * F.col("w") / F.lit(whole) > F.lit(most) * F.col("size")
    target = F.when(capped, (F.lit(most) * F.col("size")).cast("double"))
    return ranked.select("key", "s", "size", (target if not free else target.otherwise(F.lit(left) * F.col("w") / F.lit(whole))).alias("target"))


def thresholds(small: DataFrame, budgets: DataFrame) -> DataFrame:
    """key, below: for each source the hash below which its documents sum nearest to the budget.

    small: key, h, n; budgets: key, budget. Each level sums the words of 2**LEVEL_BITS hash buckets a source, of which the
    one that the budget ends in is resolved by the next level.
    """
    budgets = checkpointed(budgets.select("key", F.lit(0).cast("long").alias("low"), F.col("budget").alias("left"), (F.col("budget") > 0).alias("live")))
    state, bits = budgets, HASH_BITS
    while bits and not state.where("live").isEmpty():
        bits -= LEVEL_BITS
        width = 1 << (bits + LEVEL_BITS)
        live = state.where("live")
        inside = small if bits + LEVEL_BITS == HASH_BITS else joined_small(small, live.select("key", "low"), ["key"], "inner").where((F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + F.lit(width)))
        histogram = inside.groupBy("key", F.shiftright("h", bits).alias("b")).agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(W.partitionBy("key").orderBy("b").rowsBetween(W.unboundedPreceding, 0))  # 2**LEVEL_BITS rows at most
        over = histogram.withColumn("upto", upto).join(live.select("key", "left"), "key")
        passed = F.col("upto") > F.col("left")
        ends = over.groupBy("key").agg(F.min(F.when(passed, F.struct("b", "n", "upto"))).alias("edge"), F.max("b").alias("last"))
        edge = F.col("edge.b")
        rest = F.col("left") - (F.col("edge.upto") - F.col("edge.n"))
        nearer = F.lit(0) if bits else (F.col("edge.n") - rest < rest).cast("long")  # the last document overshoots by less than it would miss
        low = F.when(edge.isNotNull(), F.shiftleft(edge, bits) + nearer).otherwise(F.shiftleft(F.col("last") + 1, bits))
        now = live.join(ends, "key", "left").select("key", F.coalesce(low, F.col("low")).alias("low"), F.coalesce(rest, F.lit(0.0)).alias("left"), (edge.isNotNull() & F.lit(bits > 0)).alias("live"))
        state = checkpointed(state.where("not live").unionByName(now))
    return state.select("key", F.col("low").alias("below"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights of their sources: doc_id, size, source_size, target, taken."""
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    sized = checkpointed(docs.select("doc_id", "source", size_of().alias("size")))
    return mix(sized, size="size").select("doc_id", "size", "source_size", "target", "taken")


def taken_rows(mixed: DataFrame) -> DataFrame:
    """The rows of mix(), each as often as it is taken; a document without words, as of a null or empty text, never.

    Repeated rows are taken each; an empty table gives an empty result; columns of any names stay.
    """
    times = F.when(F.col("size") > 0, (F.col("taken") / F.col("size")).cast("int")).otherwise(0)
    time = free_names(mixed.columns)
    return mixed.withColumn(time, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)).otherwise(F.array().cast("array<int>")))).drop(time)


OP7_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS z, 1 + ((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) AS w
  FROM d GROUP BY source),
-- each step fixes the sources that are above three times their size
fill(step, source, z, w, fixed, t) AS (
  SELECT 0, source, z, w, false, (SELECT sum(z) FROM src)::DOUBLE * w / (SELECT sum(w) FROM src) FROM src
  UNION ALL
  SELECT step + 1, source, z, w, fixed OR t > 3 * z,
    CASE WHEN fixed OR t > 3 * z THEN (3 * z)::DOUBLE
         ELSE (sum(z) OVER () - sum(CASE WHEN fixed OR t > 3 * z THEN 3 * z ELSE 0 END) OVER ())::DOUBLE * w
              / sum(CASE WHEN fixed OR t > 3 * z THEN 0 ELSE w END) OVER () END
  FROM fill WHERE step < 40),
plan AS (
  SELECT source, z, t, CASE WHEN z = 0 THEN 0 ELSE least(3, floor(t / z)) END AS r,
         CASE WHEN z = 0 OR floor(t / z) >= 3 THEN 0.0 ELSE t - z * floor(t / z) END AS budget
  FROM fill WHERE step = 40),
sums AS (
  SELECT d.doc_id, d.source, d.size, z, t, r, budget, sum(d.size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN plan ON d.source IS NOT DISTINCT FROM plan.source)
SELECT doc_id, size, z AS source_size, t AS target,
  (size * (r + CASE WHEN budget > 0 AND (upto <= budget OR (upto - own <= budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM sums
"""
