"""A change queue, duplicate suppression, and state machines over call logs, as streams and as batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def collapse(changes: DataFrame) -> DataFrame:
    """Changes (source, entry_id, lsn, digest, op) without those that repeat the one before of their entry."""
    w = W.partitionBy("source", "entry_id").orderBy("lsn")
    same = F.lag("digest").over(w).eqNullSafe(F.col("digest")) & F.lag("op").over(w).eqNullSafe(F.col("op"))
    return changes.withColumn("_same", same & (F.row_number().over(w) > 1)).where(~F.col("_same")).drop("_same")


def collapse_stream(changes: DataFrame) -> DataFrame:
    """collapse() of a stream: the state of an entry is its last digest and operation."""
    schema = "source string, entry_id string, lsn long, digest string, op string"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values("lsn")
        out = []
        for r in rows.itertuples(index=False):
            if (r.digest, r.op) != tuple(last):
                out.append((key[0], key[1], r.lsn, r.digest, r.op))
                last = (r.digest, r.op)
        state.update(last)
        yield pd.DataFrame(out, columns=["source", "entry_id", "lsn", "digest", "op"])

    return changes.select("source", "entry_id", "lsn", "digest", "op").groupBy("source", "entry_id").applyInPandasWithState(step, schema, "digest string, op string", "append", GroupStateTimeout.NoTimeout)


def claim(queue: DataFrame, limit: int = 50) -> DataFrame:
    """The next pending changes in LSN order."""
    return queue.where(F.col("status") == "pending").orderBy("lsn").limit(limit)


def settle(queue: DataFrame, results: DataFrame, most_tries: int = 3) -> DataFrame:
    """queue after results (lsn, ok): done, or pending again until `most_tries` failures, then failed."""
    joined = queue.join(results.select("lsn", "ok"), "lsn", "left")
    tries = F.coalesce("tries", F.lit(0)) + F.when(F.col("ok").isNotNull() & ~F.col("ok"), 1).otherwise(0)
    status = F.when(F.col("ok"), "done").when(F.col("ok").isNotNull() & (tries >= most_tries), "failed").otherwise(F.col("status"))
    return joined.withColumn("status", status).withColumn("tries", tries).drop("ok")


def prune(queue: DataFrame, as_of_ms: int, days: int = 7) -> DataFrame:
    """queue without what was done more than `days` ago."""
    return queue.where(~((F.col("status") == "done") & (F.lit(as_of_ms) - F.col("done_ms") > days * 86_400_000)))


def queue_stats(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.min(F.when(F.col("status") == "pending", F.col("lsn"))).alias("next_lsn"))


def run_once(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str) -> None:
    """All changes there are, in micro-batches, each applied once for each batch id; then it ends.

    After a crash the checkpoint resumes at the first batch that isn't committed, so a batch may be applied again:
    apply() gets a batch_id column by which a sink can pass over what it has.
    """
    query = stream.writeStream.foreachBatch(lambda df, batch: apply(df.withColumn("batch_id", F.lit(batch)))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def suppress_repeats(stream: DataFrame, key: str, ts: str, window: str = "30 seconds") -> DataFrame:
    """A stream without rows whose key was seen within the window."""
    return stream.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def backpressure(load: Column) -> Column:
    """Delay factor of a queue that is full to this share: 1 to .85, 2 to .95, 4 above."""
    return F.when(load < 0.85, 1).when(load < 0.95, 2).otherwise(4)


# fixed values of the breaker: failures to open, seconds until a probe, probes at a time, seconds of a slow call, share of slow calls to open
FAILURES, OPEN_SECONDS, PROBES, SLOW_SECONDS, SLOW_SHARE = 5, 30, 3, 5, 0.5


def breaker(calls: DataFrame, key: str = "service") -> DataFrame:
    """key, seq, ts_s, ok, state, allowed of calls (key, seq, ts_s, ok, seconds): a circuit breaker run over each key's log.

    Closed until FAILURES failures in a row, or until SLOW_SHARE of the failed and slow calls are slow; open for
    OPEN_SECONDS after the last failure, when calls aren't allowed; then half open for at most PROBES calls, of which the
    first success closes it and a failure opens it again. The log of a key is read in order, one call after the other; its
    state is a few numbers, carried over the batches of the sorted log, so a key of any length fits.
    """
    rows = calls.select(F.col(key).cast("string").alias(key), "seq", "ts_s", "ok", (F.col("seconds") if "seconds" in calls.columns else F.lit(0)).cast("double").alias("seconds"))

    def run(batches):
        now = None
        for batch in batches:
            out = []
            for name, seq, ts, ok, seconds in zip(*(batch[c] for c in (key, "seq", "ts_s", "ok", "seconds")), strict=True):
                if name != now:
                    now, state, failed, slow, probes, since = name, "closed", 0, 0, 0, 0.0
                if state == "open" and ts - since >= OPEN_SECONDS:
                    state, probes = "half-open", 0
                allowed = state == "closed" or state == "half-open" and probes < PROBES
                if allowed:
                    probes += 1
                    if not ok:
                        since, failed = ts + seconds, failed + 1
                        if state == "half-open" or failed >= FAILURES:
                            state, failed, slow = "open", 0, 0
                    elif state == "half-open":
                        state, failed, slow, probes = "closed", 0, 0, 0
                    else:
                        failed = 0
                        slow = slow + 1 if seconds >= SLOW_SECONDS else max(0, slow - 1)
                        if seconds >= SLOW_SECONDS and slow / max(1, failed + slow) >= SLOW_SHARE:
                            state, since, failed, slow = "open", ts + seconds, 0, 0
                out.append((name, seq, ts, ok, state, allowed))
            yield pd.DataFrame(out, columns=[key, "seq", "ts_s", "ok", "state", "allowed"])

    return rows.repartition(F.col(key)).sortWithinPartitions(key, "seq").mapInPandas(run, f"{key} string, seq long, ts_s long, ok boolean, state string, allowed boolean")


def pending_sessions(sessions: DataFrame, processed: DataFrame, most: int = 3) -> DataFrame:
    """The oldest sessions (session, t_ms) that aren't processed, each once."""
    one = sessions.groupBy("session").agg(F.min("t_ms").alias("t_ms"))
    return one.join(processed.select("session").distinct(), "session", "left_anti").orderBy("t_ms", "session").limit(most)


def event_windows(stream: DataFrame, ts: str, size: str, key: str, late: str = "10 minutes") -> DataFrame:
    """Counts of keys in event-time windows with a watermark (an addition of this engine)."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n"))
