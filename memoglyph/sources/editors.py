"""Sessions of editors' chats: what a session is about, from the beginning and the end of its JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# fixed values: lines that are read from the beginning and the end, bytes of a session that is passed over, characters of a topic
FIRST, LAST, MOST_BYTES, TOPIC = 16, 240, 1 << 20, 140
# fixed values: what stands where there is nothing to say
NO_TOPIC, TOO_LARGE, UNKNOWN = "(no request text found)", "(large Copilot session skipped for fast sync)", "unknown"

_LINE = "kind string, k string, v string"
_REQUESTS = "array<struct<message: struct<text: string, parts: array<struct<text: string>>>, timestamp: string, modeInfo: struct<modeId: string>, modelId: string>>"
_filled = lambda c: F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")) != "", F.lit(False))


def short_line(text: Column, most: int) -> Column:
    """A text on one line, at most `most` characters, a longer one ending in three dots."""
    line = F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\n", " "))
    return F.when(F.length(line) <= most, line).otherwise(F.concat(F.substring(line, 1, most - 3), F.lit("...")))


def _request_text(r: Column) -> Column:
    """A request's text, or its first part that has any; null if neither."""
    parts = F.filter(F.coalesce(r["message"]["parts"], F.array().cast("array<struct<text:string>>")), lambda p: _filled(p["text"]))
    return F.when(_filled(r["message"]["text"]), r["message"]["text"]).when(F.size(parts) > 0, F.get(parts, F.lit(0))["text"])


def sessions(lines: DataFrame, first: int = FIRST, last: int = LAST, most_bytes: int = MOST_BYTES) -> DataFrame:
    """session, session_id, created_ms, last_ms, mode, model, topic of chat sessions (session, pos, line).

    The first line of kind 0 among the first `first` gives the id (else the session's name), time, mode, model and the text that was
    being written. Requests among the last `last` lines (kind 2, a path that begins with "requests") follow it: the newest text is the
    topic, with its time (null where that is none); the newest mode and model that aren't blank stand. A session of over `most_bytes`
    bytes, a line break for each line, is passed over and says so. Lines that aren't JSON objects, or blank, count as lines and say
    nothing. pos tells a session's lines apart (ties go by the line); a null line is empty, lines of no session (null) are left out.

    Rank limits keep first + last lines of a session in each task that reads them; of the others only sizes travel.
    """
    given = lines.where("session IS NOT NULL").select("session", "pos", F.coalesce("line", F.lit("")).alias("line"))
    sizes = given.groupBy("session").agg(F.sum(F.octet_length("line") + 1).alias("bytes"))
    ranked = lambda most, *order: given.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(*order))).where(F.col("n") <= most)
    parsed = lambda df: df.withColumn("l", F.from_json("line", _LINE))

    state = lambda path: F.get_json_object("l.v", path)
    head = parsed(ranked(first, F.asc_nulls_first("pos"), F.asc("line"))).where("l.kind = '0'")
    begun = F.struct(F.nullif(state("$.sessionId"), F.lit("")).alias("id"), F.expr("try_cast(get_json_object(l.v, '$.creationDate') AS bigint)").alias("created_ms"), state("$.inputState.mode.id").alias("mode"), state("$.inputState.selectedModel.identifier").alias("model"), state("$.inputState.inputText").alias("text"))
    start = head.groupBy("session").agg(F.min_by(begun, "n").alias("h"))

    path = F.coalesce(F.get_json_object("l.k", "$[0]"), F.col("l.k"))
    tail = parsed(ranked(last, F.desc_nulls_last("pos"), F.desc("line"))).where((F.col("l.kind") == "2") & (path == "requests"))
    asked = tail.select("session", "n", F.posexplode(F.from_json("l.v", _REQUESTS)).alias("i", "r")).where("r IS NOT NULL")
    newest = lambda value, there: F.max_by(F.when(there, value), F.when(there, F.struct(F.negate("n"), F.col("i"))))
    text = _request_text(F.col("r"))
    end = asked.groupBy("session").agg(
        newest(F.struct(short_line(text, TOPIC).alias("topic"), F.expr("try_cast(r.timestamp AS bigint)").alias("last_ms")), text.isNotNull()).alias("t"),
        newest(F.col("r.modeInfo.modeId"), _filled(F.col("r.modeInfo.modeId"))).alias("mode"),
        newest(F.col("r.modelId"), _filled(F.col("r.modelId"))).alias("model"),
    )

    small = F.col("bytes") <= most_bytes
    stands = lambda c: F.when(_filled(c), c)
    joined = sizes.join(start, "session", "left").join(end, "session", "left")
    of = lambda value, other: F.when(small, F.coalesce(value, F.lit(other))).otherwise(other)
    return joined.select(
        "session",
        F.when(small, F.coalesce("h.id", F.col("session").cast("string"))).otherwise(F.col("session").cast("string")).alias("session_id"),
        F.when(small, F.col("h.created_ms")).alias("created_ms"),
        F.when(small, F.col("t.last_ms")).alias("last_ms"),
        of(F.coalesce(F.col("mode"), stands(F.col("h.mode"))), UNKNOWN).alias("mode"),
        of(F.coalesce(F.col("model"), stands(F.col("h.model"))), UNKNOWN).alias("model"),
        F.when(small, F.coalesce("t.topic", F.when(_filled(F.col("h.text")), short_line(F.col("h.text"), TOPIC)), F.lit(NO_TOPIC))).otherwise(TOO_LARGE).alias("topic"),
    )
