"""Validation, deduplication, promotion, conflicts, archival, budgets and consolidation of records."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from memoglyph.functions.classify import first_case, lowered
from memoglyph.functions.numeric import round_half_up
from memoglyph.functions.text import normalize_spaces
from memoglyph.schema import DURABLE_SCOPES, LEVELS, RECORD_VERSION, REQUIRED, SCOPES, SOURCE_KINDS, SOURCE_QUALITY, TIER_BUDGETS, TIERS, VISIBILITIES

DAY_MS = 86_400_000
AUTO_FROM, REVIEW_FROM, OVERLAP, NEAR_TIE = 0.65, 0.40, 0.70, 0.10
#: Weights of recency, confidence, cross-session hits and source quality; half life in days.
PROMOTION_WEIGHTS, HALF_LIFE = (0.30, 0.35, 0.25, 0.10), 30.0


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share.

    Where that is unset, a local master gets a temporary folder and a cluster an error.
    """
    sc, folder = spark.sparkContext, spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not folder and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="memoglyph-"))
    return folder or sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage, in shared_folder()."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def staged(df: DataFrame) -> Iterator[DataFrame]:
    """df, written once as compressed columns in shared_folder() and read from there; the files go when the block ends.

    A checkpoint holds rows as they are in memory, several times as large.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _given(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def contract_errors(df: DataFrame) -> DataFrame:
    """df with errors (array<string>, in a fixed order) and ok: the record contract, as codes and never as exceptions."""
    has = lambda c: normalize_spaces(_given(df, c).cast("string"))
    unknown = lambda c, values, code: F.when((lowered(_given(df, c)) != "") & ~lowered(_given(df, c)).isin(values), F.concat(F.lit(f"{code}:"), has(c)))
    version = _given(df, "schemaVersion").cast("int")
    missing = F.array_compact(F.array(*(F.when(has(c) == "", F.lit(c)) for c in REQUIRED)))
    codes = [
        F.when(~version.eqNullSafe(F.lit(RECORD_VERSION)), F.concat(F.lit("unexpected-schema-version:"), F.coalesce(F.nullif(version, F.lit(0)).cast("string"), F.lit("missing")))),
        unknown("scope", SCOPES, "unknown-scope"),
        unknown("visibility", VISIBILITIES, "unknown-visibility"),
        unknown("source_kind", SOURCE_KINDS, "unknown-source-kind"),
        unknown("memory_level", LEVELS, "unknown-memory-level"),
        F.when(_given(df, "tier").isNotNull() & ~_given(df, "tier").cast("int").isin(TIERS), F.concat(F.lit("invalid-tier:"), _given(df, "tier").cast("string"))),
        F.when((has("content_hash") != "") & ~has("content_hash").rlike("(?i)^[a-f0-9]{64}$"), F.concat(F.lit("invalid-content-hash:"), has("content_hash"))),
        F.when(F.size(missing) > 0, F.concat(F.lit("missing-fields:"), F.array_join(missing, ","))),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*codes))).withColumn("ok", F.size("errors") == 0)


def promotion_errors(p: Column) -> Column:
    """Error codes of a promotion struct; none where it is null."""
    has = lambda name: normalize_spaces(p[name])
    durable = lowered(p["durable_type"])
    codes = F.array_compact(F.array(
        F.when(~p["version"].eqNullSafe(F.lit(1)), F.concat(F.lit("unknown-promotion-version:"), F.coalesce(p["version"].cast("string"), F.lit("missing")))),
        F.when((durable != "") & ~durable.isin(DURABLE_SCOPES), F.concat(F.lit("unknown-promotion-durable-type:"), has("durable_type"))),
        *(F.when(has(n) == "", F.lit(f"missing-promotion-{n.replace('_', '-')}")) for n in ("key", "reason", "source_record_id")),
        F.when(F.exists(p["conflict_with"], lambda v: normalize_spaces(v) == ""), F.lit("invalid-promotion-conflict-with")),
        *(F.when(p["is_refresh"] & (has(n) == ""), F.lit(f"missing-promotion-{n.replace('_', '-')}")) for n in ("refresh_of_id", "refresh_of_t")),
    ))
    return F.when(p.isNull(), F.array().cast("array<string>")).otherwise(codes)


def fact_errors(df: DataFrame, most: int = 2000) -> DataFrame:
    """df with errors of facts to be written: content of 1 to `most` characters, known scope and level, confidence 0 to 1, short items."""
    text = F.coalesce(F.col("content"), F.lit(""))
    codes = [
        F.when(F.trim(text) == "", "content-required").when(F.length(text) > most, "content-too-long"),
        F.when((lowered("scope") != "") & ~lowered("scope").isin(SCOPES), "unknown-scope"),
        F.when((lowered("memory_level") != "") & ~lowered("memory_level").isin(LEVELS), "unknown-memory-level"),
        F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), "confidence-out-of-range"),
        *(F.when(F.exists(c, lambda v: F.length(v) > most), f"{c}-item-too-long") for c in ("facts", "decisions", "entities") if c in df.columns),
    ]
    return df.withColumn("errors", F.array_compact(F.array(*codes)))


def one_per_key(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order. Each map task keeps one row of a key before the shuffle."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_n") == 1).drop("_n")


def top_per_key(df: DataFrame, keys: list[str], most: int, *order, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= most)


def positions(df: DataFrame, *order, out: str = "position") -> DataFrame:
    """df with the place of each row in the whole order, from 1; order must tell all rows apart.

    Rows are dealt by ranges of the order and counted from where their range starts, so no task holds them all.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    dealt = checkpointed(dealt.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1)))
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    # a row for each range
    starts = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_start"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_at") + 1).drop("_range", "_at", "_start")


def within_window_dedup(df: DataFrame, hash_: str, t_ms: str, id_: str, window_ms: int = 30_000) -> DataFrame:
    """Rows without those whose previous row of the same hash is at most window_ms older."""
    before = F.lag(t_ms).over(W.partitionBy(hash_).orderBy(t_ms, id_))
    return df.withColumn("_b", before).where(F.col("_b").isNull() | (F.col(t_ms) - F.col("_b") > window_ms)).drop("_b")


def promotion_scores(df: DataFrame, as_of_ms: int, weights=PROMOTION_WEIGHTS, library: bool = False) -> DataFrame:
    """id, score, components, tier_from, tier_to, decision of records in tiers 2 and 3 (a missing tier is 2).

    In the library form one hit counts a fifth at most, and hits count without promotion data; else five hits count full.
    """
    tier = F.coalesce(F.col("tier"), F.lit(2))
    age = F.greatest(F.lit(as_of_ms) - F.coalesce("access_ms", "t_ms", F.lit(as_of_ms)), F.lit(0)) / DAY_MS
    recency = F.pow(F.lit(2.0), -age / HALF_LIFE)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("source_confidence", "confidence", F.lit(0.5))))
    hits = F.coalesce("cross_refs", F.lit(0)) + F.coalesce("access_count", F.lit(0))
    cross = F.least(F.lit(1.0), hits) / 5 if library else F.least(F.lit(1.0), hits / 5)
    quality = first_case([(lowered("source_kind") == k, v) for k, v in SOURCE_QUALITY.items()], 0.5)
    parts = dict(recency=recency, confidence=sure, cross_session=cross, source_quality=quality)
    score = sum((p * w for p, w in zip(parts.values(), weights, strict=True)), F.lit(0.0))
    out = df.where((tier >= 2) & (tier < 4)).select("id", *(round_half_up(p).alias(n) for n, p in parts.items()), score.alias("_raw"), tier.alias("tier_from"), F.least(tier + 1, F.lit(4)).alias("tier_to"))
    decision = F.when(F.col("_raw") >= AUTO_FROM, "auto").when(F.col("_raw") >= REVIEW_FROM, "review").otherwise("none")
    return out.withColumn("score", round_half_up(F.col("_raw"))).withColumn("decision", decision).drop("_raw")


#: Rows that meet on one token (or pair of tokens) in one block; a larger group is dealt to pairs of blocks. Copies in one block.
MEETING = 1000
#: Sets whose pairs one task finds; pairs looked at in one go, and those of them that are compared in one go.
SETS, AT_ONCE, COMPARED = 5000, 1 << 18, 1 << 14


def _token_sets(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, set of rows with tokens; set, id, n of each distinct set, with the smallest id and the number of its rows). Tokens are made once."""
    sets = checkpointed(df.select("id", F.array_sort(F.array_distinct("tokens")).alias("set"))).where(F.size("set") > 0)
    return sets, checkpointed(sets.groupBy("set").agg(F.min("id").alias("id"), F.count("*").alias("n")))


def _parts(same: DataFrame) -> int:
    """Tasks for the pairs of distinct sets: however large the table, each gets the same share."""
    return max(same.sparkSession.sparkContext.defaultParallelism, -(-same.count() // SETS))


def _meeting_pairs(least: float):
    """For mapInArrow: l, r, overlap of rows (k1, k2, lo, hi, own, id, set, p, q), sorted by the first five, that meet on a key.

    Rows of one block meet each other; those of two blocks, of which the smaller comes first, meet across. A pair counts where its
    first common tokens are, at places p and, for a key of two tokens, q of the left set.
    """

    def begins_of(rows: pa.Table) -> np.ndarray:
        """Where the rows of each key and pair of blocks begin."""
        new = np.zeros(len(rows), bool)
        new[:1] = True
        for name in ("k1", "k2", "lo", "hi"):
            values = rows[name].to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    def found(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        column = lambda name: rows[name].to_numpy()
        lo, hi, own, p, q, ids = column("lo"), column("hi"), column("own"), column("p"), column("q"), rows["id"]
        lists = rows["set"].combine_chunks()
        flat, size, at = lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy(zero_copy_only=False), pc.list_parent_indices(lists).to_numpy()
        first = np.cumsum(size) - size
        x = np.full((len(rows), int(size.max())), -1, np.int64)
        x[at, np.arange(len(flat)) - first[at]] = flat
        y = np.where(x < 0, -2, x)
        # a bit for each token: bits that the other set lacks are at most as many as tokens that it lacks
        bit = np.uint64(1) << (flat.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(58))
        bits = np.bitwise_or.reduceat(bit, first)
        need = np.ceil(np.arange(2 * int(size.max()) + 1) * (least / (1 + least)) - 1e-9).astype(np.int64)
        rest = np.where(q < 0, size - p, size - q + 1)  # tokens from the key on, of which the common ones are
        begins = begins_of(rows)
        end = np.append(begins[1:], len(rows))[np.searchsorted(begins, np.arange(len(rows)), "right") - 1]
        key = np.searchsorted(begins, np.arange(len(rows)), "right") - 1
        middle = begins + np.bincount(key, weights=own == lo, minlength=len(begins)).astype(np.int64)
        start = np.where(lo == hi, np.arange(len(rows)) + 1, middle[key])
        others = np.where((lo == hi) | (own == lo), end - start, 0)
        upto = np.cumsum(others)
        row = 0
        while row < len(rows):
            till = max(row + 1, int(np.searchsorted(upto, upto[row] - others[row] + AT_ONCE, "right")))
            n = others[row:till]
            l = np.repeat(np.arange(row, till), n)  # noqa: E741
            r = np.arange(len(l)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[row:till], n)
            row = till
            least_common = need[size[l] + size[r]]
            may = np.minimum(rest[l], rest[r]) >= least_common
            l, r, least_common = l[may], r[may], least_common[may]  # noqa: E741
            may = (np.bitwise_count(bits[l] & ~bits[r]) <= size[l] - least_common) & (np.bitwise_count(bits[r] & ~bits[l]) <= size[r] - least_common)
            l, r = l[may], r[may]  # noqa: E741
            for i in range(0, len(l), COMPARED):
                m, n = l[i : i + COMPARED], r[i : i + COMPARED]
                common = (x[m][:, :, None] == y[n][:, None, :]).any(axis=2)
                k = common.sum(axis=1)
                here = common.argmax(axis=1) == p[m]
                common[np.arange(len(m)), p[m]] = False
                here &= (q[m] < 0) | (common.argmax(axis=1) == q[m])
                overlap = k / (size[m] + size[n] - k)
                good = here & (overlap >= least)
                if good.any():
                    a, b = (ids.take(pa.array(z[good])).combine_chunks() for z in (m, n))
                    yield pa.RecordBatch.from_arrays([a, b, pa.array(overlap[good])], names=["l", "r", "overlap"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = int(begins_of(rows)[-1]) if len(rows) else 0  # the last key's rows may go on
            if last:
                yield from found(rows.slice(0, last))
            held = rows.slice(last)
        if held is not None and len(held):
            yield from found(held)

    return run


def _near_sets(same: DataFrame, least: float, meeting: int) -> DataFrame:
    """a, b, overlap: pairs of distinct token sets (id, set) with a Jaccard similarity of at least `least`.

    Prefix filtering: with tokens in a common order of rising frequency, two such sets share one of their first
    n - ceil(least * n) + 1 tokens, so rows meet on rare tokens only; and two of one token more, so rows meet on a frequent
    token only together with a second one. What still brings more than `meeting` rows together is dealt to pairs of blocks,
    each a key of its own, so no task gets all rows of a token. Sizes, places in the sets and a bit for each token rule pairs
    out before they are compared, and a pair counts where its first common tokens are, so none comes twice.
    """
    single = same.select("id", F.explode("set").alias("token"))
    frequency = checkpointed(single.groupBy("token").agg(F.count("*").alias("n")).withColumn("number", F.monotonically_increasing_id()))
    ordered = single.join(frequency, "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "number"))).alias("t"))
    size = F.size("t")
    first = size - F.ceil(size * F.lit(least) - 1e-9).cast("int") + 1
    key = lambda x, p, y, q: F.struct(x["number"].alias("k1"), y.alias("k2"), p.cast("int").alias("p"), q.cast("int").alias("q"))
    pairs_of = lambda x, p: F.transform(F.slice("t", p + 2, F.greatest(first - p, F.lit(0))), lambda y, i: key(x, p, y["number"], p + 1 + i))
    alone = lambda x, p: F.array(key(x, p, F.lit(-1).cast("long"), F.lit(-1)))
    of = lambda x, p: F.when(x["n"] > meeting, pairs_of(x, p)).otherwise(alone(x, p)) if least > 0.5 else alone(x, p)
    none = F.array().cast("array<struct<k1:bigint,k2:bigint,p:int,q:int>>")
    keys = F.flatten(F.transform(F.slice("t", F.lit(1), first), lambda x, p: F.when(x["n"] == 1, none).otherwise(of(x, p))))
    met = checkpointed(ordered.select("id", F.col("t.number").alias("set"), F.inline(keys)))
    large = checkpointed(met.groupBy("k1", "k2").agg(F.count("*").alias("n")).where(F.col("n") > meeting).select("k1", "k2", F.ceil(F.col("n") / meeting).cast("int").alias("blocks")))
    small_list = large.limit(100_001).count() <= 100_000
    dealt = met.join(F.broadcast(large) if small_list else large, ["k1", "k2"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("k1", "k2", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "id", "set", "p", "q")
    groups = dealt.repartition(_parts(same), "k1", "k2", "lo", "hi").sortWithinPartitions("k1", "k2", "lo", "hi", "own")
    kind = same.schema["id"].dataType
    found = groups.mapInArrow(_meeting_pairs(least), T.StructType([T.StructField("l", kind), T.StructField("r", kind), T.StructField("overlap", T.DoubleType())]))
    return found.select(F.least("l", "r").alias("a"), F.greatest("l", "r").alias("b"), "overlap")


def overlapping_pairs(df: DataFrame, least: float = OVERLAP, meeting: int = MEETING) -> DataFrame:
    """a, b, overlap: links that join all rows (id, tokens of at most 18) with a Jaccard similarity of at least `least`, as components need them.

    Rows of equal token sets are one here, as their smallest id, and the others are linked to it; every_pair() has all pairs.
    """
    sets, same = _token_sets(df)
    copies = sets.join(same.select("set", F.col("id").alias("a")), "set").where(F.col("id") != F.col("a")).select("a", F.col("id").alias("b"), F.lit(1.0).alias("overlap"))
    return _near_sets(same, least, meeting).unionByName(copies)


def every_pair(df: DataFrame, least: float = OVERLAP, meeting: int = MEETING) -> DataFrame:
    """a, b, overlap: all pairs of rows (id, tokens of at most 18) with a Jaccard similarity of at least `least`, those of equal sets too.

    Pairs are found between distinct sets. Rows of a set with copies are dealt to blocks of about `meeting`; pairs of blocks are spread over
    all tasks before they become pairs of rows, so the work of a task doesn't grow with the rows of a set.
    """
    sets, same = _token_sets(df)
    many = same.where("n > 1").select("set", F.col("id").alias("of"), F.ceil(F.col("n") / meeting).alias("blocks"))
    copies = sets.join(many, "set").groupBy("of", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")).agg(F.collect_list("id").alias("ids"))
    copies = checkpointed(copies)
    left, right = (copies.select(F.col("of").alias(n), F.col("block").alias(f"{n}_block"), F.col("ids").alias(f"{n}_ids")) for n in "ab")
    rows_of = lambda n: F.coalesce(f"{n}_ids", F.array(n)).alias(f"{n}_ids")
    block_of = lambda n: F.coalesce(f"{n}_block", F.lit(0)).alias(f"{n}_block")
    near = _near_sets(same, least, meeting).join(left, "a", "left").join(right, "b", "left").select("a", "b", block_of("a"), block_of("b"), rows_of("a"), rows_of("b"), "overlap")
    equal = left.join(right, (F.col("a") == F.col("b")) & (F.col("a_block") <= F.col("b_block"))).select("a", "b", "a_block", "b_block", "a_ids", "b_ids", F.lit(1.0).alias("overlap"))
    blocks = near.unionByName(equal).repartition(_parts(same), "a", "b", "a_block", "b_block")
    inside = (F.col("a") == F.col("b")) & (F.col("a_block") == F.col("b_block"))
    rows = blocks.select(inside.alias("inside"), F.explode("a_ids").alias("x"), "b_ids", "overlap").select("inside", "x", F.explode("b_ids").alias("y"), "overlap")
    return rows.where(~F.col("inside") | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def components(pairs: DataFrame) -> DataFrame:
    """id, component: the smallest id that pairs (a, b) reach, by alternating large and small stars."""
    now = checkpointed(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        now = checkpointed(down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        ends = now.select(F.inline(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hung"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hung"), F.lit(1).alias("holds")))))
        if ends.groupBy("x").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds")).where("hung > 1 or hung > 0 and holds > 0").isEmpty():
            break
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def resolve_conflicts(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """id, component, place, outcome of candidates (id, score, access_ms): the best of a component wins, near ties go to review.

    Best: score, then last access, then id. A loser within 0.10 of the winner is for human review, others are dropped.
    """
    found = scored.join(components(pairs), "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = found.groupBy("component").agg(F.max("score").alias("best"), F.min(F.struct(F.negate("score").alias("s"), F.negate(F.coalesce("access_ms", F.lit(0))).alias("t"), "id"))["id"].alias("winner"))
    gap = F.col("best") - F.col("score")
    outcome = F.when(F.col("id") == F.col("winner"), "winner").when(gap <= NEAR_TIE + 1e-9, "human_review").otherwise("dropped")
    return found.join(best, "component").select("id", "component", "score", outcome.alias("outcome"))


def apply_promotions(df: DataFrame, resolved: DataFrame, as_of: str) -> DataFrame:
    """df with the tier, count and reason of promoted rows (id, tier_to, reason) updated."""
    up = resolved.select(F.col("id").alias("_id"), F.col("tier_to").alias("_tier"), F.col("reason").alias("_reason"))
    hit = F.col("_id").isNotNull()
    joined = df.join(up, df["id"] == F.col("_id"), "left")
    return (
        joined.withColumn("tier", F.when(hit, F.col("_tier")).otherwise(F.col("tier")))
        .withColumn("promotion_count", F.when(hit, F.coalesce("promotion_count", F.lit(0)) + 1).otherwise(F.col("promotion_count")))
        .withColumn("promoted_at", F.when(hit, F.lit(as_of))).withColumn("promotion_reason", F.col("_reason")).drop("_id", "_tier", "_reason")
    )


def archive_reason(as_of_ms: int, legacy_user_ttl: bool = False) -> Column:
    """Why a record (tier, t_ms, access_ms, expires_ms, access_count, promotion_count, scope, archived) is to be archived, else null.

    Records of users never expire by time to live, unless in the legacy form.
    """
    now, age = F.lit(as_of_ms), F.lit(as_of_ms) - F.coalesce("t_ms", F.lit(0))
    expired = F.coalesce((F.col("expires_ms") > 0) & (now > F.col("expires_ms")), F.lit(False))
    has_ttl = F.lit(True) if legacy_user_ttl else F.coalesce(F.col("scope") != "user", F.lit(True))
    cold = (now - F.coalesce("access_ms", F.lit(0)) > 60 * DAY_MS) & (F.coalesce("access_count", F.lit(0)) == 0) & (age > 60 * DAY_MS)
    tier = F.col("tier")
    return (
        F.when(F.coalesce("archived", F.lit(False)) | F.coalesce(tier == 5, F.lit(False)), None)
        .when((tier.isNull() | (tier == 1)) & (age > DAY_MS), "tier1-expired")
        .when((tier == 2) & (age > 30 * DAY_MS) & (F.coalesce("promotion_count", F.lit(0)) < 2), "tier2-cold")
        .when((tier == 3) & expired, "tier3-expired")
        .when((tier == 4) & has_ttl & expired, "tier4-ttl")
        .when((tier == 4) & cold, "tier4-cold-access")
    )


def split_archive(df: DataFrame, as_of_ms: int) -> tuple[DataFrame, DataFrame]:
    """(kept rows, manifest of archived rows: id, tier_from, reason, scope, type, one row each)."""
    marked = df.withColumn("_reason", archive_reason(as_of_ms))
    manifest = marked.where(F.col("_reason").isNotNull()).select("id", F.col("tier").alias("tier_from"), F.col("_reason").alias("reason"), F.col("scope").alias("original_scope"), F.col("type").alias("original_type"))
    return marked.where(F.col("_reason").isNull()).drop("_reason"), manifest


def evictions(df: DataFrame, budgets: dict[int, int] = TIER_BUDGETS) -> DataFrame:
    """tier, bucket, id of records over budget, those of the lowest freshness first; ties by id.

    A tier is looked at only if it is over its budget as a whole: tier 3 then by project, tier 4 by type, others as one.
    Records without a tier count for tier 1 but are never evicted. Ranks are taken inside a bucket, of which at most the
    excess is kept.
    """
    known = df.withColumn("_tier", F.coalesce("tier", F.lit(1)))
    total = known.groupBy("_tier").agg(F.count("*").alias("total"))
    bucket = F.when(F.col("_tier") == 3, F.coalesce("project", F.lit("default"))).when(F.col("_tier") == 4, F.coalesce("type", F.lit("unknown"))).otherwise(F.lit("all"))
    most = first_case([(F.col("_tier") == t, n) for t, n in budgets.items() if t != 5], None).cast("long")
    over = total.withColumn("most", most).where("total > most").select("_tier", "most")
    inside = known.withColumn("bucket", bucket).join(F.broadcast(over), "_tier")
    counts = inside.groupBy("_tier", "bucket").agg(F.count("*").alias("n"))
    ranked = inside.where(F.col("tier").isNotNull()).withColumn("place", F.row_number().over(W.partitionBy("_tier", "bucket").orderBy("freshness_score", "id")))
    return ranked.join(counts, ["_tier", "bucket"]).where(F.col("place") <= F.col("n") - F.col("most")).select(F.col("_tier").alias("tier"), "bucket", "id")


def simplified(df: DataFrame, most: int = 500) -> DataFrame:
    """df with long, often read records of tier 4 cut to their first paragraph and a mark."""
    n = F.length("content")
    hit = F.coalesce((F.col("tier") == 4) & (F.col("access_count") > 20) & (n > 2000), F.lit(False))
    mark = F.concat(F.lit("\n\n<!-- SIMPLIFIED: original "), n.cast("string"), F.lit(" chars, access_count="), F.col("access_count").cast("string"), F.lit(" -->"))
    return df.withColumn("simplified", hit).withColumn("content", F.when(hit, F.concat(F.substring(F.element_at(F.split("content", "\n\n"), 1), 1, most), mark)).otherwise(F.col("content")))


def consolidate(candidates: DataFrame, baseline: DataFrame, promote=(3, 3, 4, 2), refresh=(2, 2, 3, 1), total: int = 8) -> DataFrame:
    """id, key, scope, action: candidates new to the baseline are promoted, newer ones of a known key refresh it.

    candidates, baseline: id, key, scope, confidence, t_ms. One row of a key (the surest, then smallest id), then a cap for
    each scope (user, feedback, project, reference), then `total` of each action.
    """
    known = baseline.groupBy("key").agg(F.max("t_ms").alias("base_t"))
    marked = candidates.join(known, "key", "left").withColumn("action", F.when(F.col("base_t").isNull(), "promote").when(F.col("t_ms") > F.col("base_t"), "refresh")).where(F.col("action").isNotNull())
    one = one_per_key(marked, ["action", "key"], F.desc("confidence"), "id")
    caps = {("promote", s): n for s, n in zip(DURABLE_SCOPES, promote, strict=True)} | {("refresh", s): n for s, n in zip(DURABLE_SCOPES, refresh, strict=True)}
    cap = first_case([((F.col("action") == a) & (F.col("scope") == s), n) for (a, s), n in caps.items()], 0)
    inside = top_per_key(one.withColumn("cap", cap), ["action", "scope"], max(*promote, *refresh), F.desc("confidence"), "id", rank="_r").where(F.col("_r") <= F.col("cap"))
    return top_per_key(inside, ["action"], total, F.desc("confidence"), "id").select("id", "key", "scope", "action")


def write_back(new: DataFrame, existing: DataFrame) -> DataFrame:
    """id, key, action, supersedes: skip what is stored with the same content, append, or append as a conflict.

    A conflict supersedes the stored row if its confidence is higher.
    """
    stored = one_per_key(existing, ["key"], F.desc("t_ms"), "id").select("key", F.col("id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("confidence").alias("old_confidence"))
    same = F.col("old_hash") == F.col("content_hash")
    action = F.when(F.col("old_id").isNull(), "append").when(same, "skip-identical").otherwise("append-conflict")
    higher = F.col("old_id").isNotNull() & ~same & (F.col("confidence") > F.col("old_confidence"))
    return new.join(stored, "key", "left").select("id", "key", action.alias("action"), F.when(higher, F.col("old_id")).alias("supersedes"))


def merge_patches(base: DataFrame, patches: DataFrame, array: str = "facts") -> DataFrame:
    """base (id, array) with the arrays of patches (id, seq, array) appended in order, values once; patch-only ids make rows."""
    added = patches.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("seq", array))).alias("_p")).select("id", F.flatten(F.transform("_p", lambda p: p[array])).alias("_p"))
    empty = F.array().cast(base.schema[array].dataType)
    return base.select("id", array).join(added, "id", "full_outer").select("id", F.array_distinct(F.concat(F.coalesce(array, empty), F.coalesce("_p", empty))).alias(array))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """id, op: upsert for new and changed rows (id, hash), delete for those gone."""
    both = before.select("id", F.col("hash").alias("old"), F.lit(True).alias("was")).join(after.select("id", F.col("hash").alias("new"), F.lit(True).alias("is")), "id", "full_outer")
    op = F.when(F.col("is").isNull(), "delete").when(F.col("was").isNull() | ~F.col("old").eqNullSafe(F.col("new")), "upsert")
    return both.select("id", op.alias("op")).where(F.col("op").isNotNull())


def should_consolidate(digest: str, last_digest: str | None, hours: float | None, n: int, least: int = 10) -> tuple[bool, str]:
    """Whether a consolidation runs: not on unchanged records within a day, nor on fewer than `least`."""
    if n < least:
        return False, "too-few-records"
    if last_digest == digest and hours is not None and hours < 24:
        return False, "unchanged"
    return True, "run"


def migrate(df: DataFrame, to: int = RECORD_VERSION) -> DataFrame:
    """Version 1 records as version 2: a tombstone becomes lifecycle.archived. Other targets aren't known."""
    if to != 2:
        raise ValueError(f"no migration to record version {to}")
    old = F.coalesce(F.col("schemaVersion"), F.lit(1)) < 2
    dead = F.coalesce(F.col("tombstone"), F.lit(False)) if "tombstone" in df.columns else F.lit(False)
    was = F.coalesce(F.col("archived"), F.lit(False)) if "archived" in df.columns else F.lit(False)
    return df.withColumn("archived", F.when(old, dead | was).otherwise(was)).withColumn("schemaVersion", F.lit(2)).drop("tombstone")
