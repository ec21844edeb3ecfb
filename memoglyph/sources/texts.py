"""Markdown inboxes, transcripts, boards and importers as DataFrames."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from memoglyph.functions.text import clamp_text, normalize_spaces


def inbox(lines: DataFrame) -> DataFrame:
    """t, project, content of inbox lines (value) such as `- [time] [project] content`."""
    p = r"^- \[([^\]]+)\]\s*(?:\[([^\]]+)\])?\s*(.+)$"
    at = lambda i: F.regexp_extract("value", p, i)
    return lines.where(F.col("value").rlike(p)).select(at(1).alias("t"), F.nullif(at(2), F.lit("")).alias("project"), F.trim(at(3)).alias("content"))


def newest_files(df: DataFrame, most: int, file: str = "file") -> DataFrame:
    """The rows of the `most` last files by name."""
    return df.join(F.broadcast(df.select(file).distinct().orderBy(F.desc(file)).limit(most)), file, "left_semi")


def union_sources(parts: list[tuple[DataFrame, dict]]) -> DataFrame:
    """Sources with defaults for what each lacks, as one."""
    out = None
    for df, defaults in parts:
        for name, value in defaults.items():
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def last_per_session(messages: DataFrame, most: int = 6, least: int = 40) -> DataFrame:
    """The last `most` messages of `least` characters or more of each session (session, turn, text)."""
    long_ = messages.where(F.length("text") >= least)
    return long_.withColumn("_r", F.row_number().over(W.partitionBy("session").orderBy(F.desc("turn")))).where(F.col("_r") <= most).drop("_r")


def first_relevant(messages: DataFrame, files: DataFrame, within: int = 160, placeholder: str = "(none)") -> DataFrame:
    """session, topic: the first relevant user message within the first lines, or a placeholder."""
    found = messages.where((F.col("role") == "user") & (F.col("turn") < within) & is_relevant("text")).groupBy("session").agg(F.min_by(relevant("text"), "turn").alias("topic"))
    return files.select("session").distinct().join(found, "session", "left").select("session", clamp_text(F.coalesce("topic", F.lit(placeholder)), 140).alias("topic"))


# fixed values: beginnings of messages that say nothing about a session, and what is cut from others
BOILERPLATE = ["# AGENTS.md instructions", "<environment_context>", "Based on this message, call "]
_ADDED = r"^(.*?)\s+Based on this message, call .*$"


def relevant(text: str) -> Column:
    """A message in one line without the instruction added to it; empty if it is boilerplate."""
    c = normalize_spaces(text)
    cut = F.when(c.rlike(_ADDED), F.trim(F.regexp_extract(c, _ADDED, 1))).otherwise(c)
    agents = cut.rlike(r"^# AGENTS\.md instructions\b")
    return F.when(agents | cut.startswith(BOILERPLATE[1]) | cut.startswith(BOILERPLATE[2]), "").otherwise(cut)


def is_relevant(text: str) -> Column:
    return relevant(text) != ""


def latest_of(events: DataFrame, by: str = "session") -> DataFrame:
    """by, model, message: the last model and user message of each session's events (line, kind, value), only its last 40."""
    recent = events.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(F.desc("line")))).where("_r <= 40")
    return recent.groupBy(by).agg(F.max_by("value", F.when(F.col("kind") == "model", F.col("line"))).alias("model"), F.max_by("value", F.when(F.col("kind") == "user", F.col("line"))).alias("message"))


def best_per_session(rows: DataFrame) -> DataFrame:
    """A strong row of each session before a weak one, then the newest (session, weak, t_ms)."""
    return rows.withColumn("_r", F.row_number().over(W.partitionBy("session").orderBy("weak", F.desc("t_ms")))).where("_r = 1").drop("_r")


def path_matches(a: Column, b: Column, separator: str = "/") -> Column:
    """Whether two paths are equal or one holds the other."""
    a, b = (F.regexp_replace(x, f"[{re.escape(separator)}]+$", "") for x in (a, b))
    return (a == b) | F.startswith(a, F.concat(b, F.lit(separator))) | F.startswith(b, F.concat(a, F.lit(separator)))


def ancestors(path: Column, separator: str = "/") -> Column:
    """A path without separators at its end, and every path that holds it."""
    parts = F.split(F.regexp_replace(path, f"[{re.escape(separator)}]+$", ""), re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def path_join(left: DataFrame, right: DataFrame, a: str, b: str, separator: str = "/") -> DataFrame:
    """Rows of left and right whose paths a and b match as path_matches() says, by equality of paths: no loop over pairs.

    A row travels once for each folder above it, to meet the other side's paths as they are; so each pair is found from
    the longer path, and equal ones from the left. Columns of both sides must differ in name. Null paths match nothing.
    """
    own = lambda df, c: df.withColumn("_up", ancestors(F.col(c), separator)).withColumn("_own", F.element_at("_up", -1))
    x, y = own(left.where(F.col(a).isNotNull()), a), own(right.where(F.col(b).isNotNull()), b)
    columns = [*left.columns, *right.columns]
    down = x.drop("_own").withColumn("_own", F.explode("_up")).join(y.drop("_up"), "_own").select(columns)
    up = y.withColumn("_at", F.explode(F.slice("_up", F.lit(1), F.size("_up") - 1))).drop("_own").join(x.drop("_up").withColumnRenamed("_own", "_at"), "_at").select(columns)
    return down.unionByName(up)


def board_tasks(tasks: DataFrame, states: list[str], most: int) -> DataFrame:
    """The newest tasks in the given states."""
    return tasks.where(F.col("state").isin(states)).orderBy(F.desc("updated_at"), "id").limit(most)


def render_board(tasks: DataFrame) -> DataFrame:
    """line: a checkbox for each task, done ones checked."""
    return tasks.select(F.concat(F.lit("- ["), F.when(F.col("state") == "completed", "x").otherwise(" "), F.lit("] "), F.col("title"), F.lit(" <!-- task:"), F.col("id"), F.lit(" -->")).alias("line"))


def checked_ids(lines: DataFrame) -> DataFrame:
    """id of each task that a board's lines (value) show as checked."""
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?i)- \[x\].*?<!-- task:([\w-]+) -->"), 1)).alias("id")).distinct()


def complete(tasks: DataFrame, ids: DataFrame, final=("completed", "aborted", "failed")) -> DataFrame:
    """tasks with checked ones completed, unless they are final already."""
    hit = ids.select("id", F.lit(True).alias("_hit"))
    return tasks.join(hit, "id", "left").withColumn("state", F.when(F.col("_hit") & ~F.col("state").isin(*final), "completed").otherwise(F.col("state"))).drop("_hit")


def upsert_section(text: Column, name: str, body: Column) -> Column:
    """text with the part between a section's marks replaced, or appended."""
    a, b = f"<!-- {name}:start -->", f"<!-- {name}:end -->"
    block = F.concat(F.lit(a + "\n"), body, F.lit("\n" + b))
    start, end = F.instr(text, a), F.instr(text, b)
    inside = F.concat(F.substring(text, 1, start - 1), block, F.substring(text, end + len(b), F.length(text)))
    return F.when((start > 0) & (end > start), inside).otherwise(F.concat(text, F.lit("\n"), block))


def section(text: Column, heading: str) -> Column:
    """The text under a markdown heading, to the next heading of any level."""
    return F.trim(F.regexp_extract(text, rf"(?s)(?:^|\n)#+ {re.escape(heading)}[^\n]*\n(.*?)(?=\n#+ |\z)", 1))


def slice_transcripts(lines: DataFrame, head_tokens: int = 500, tail_tokens: int = 500) -> DataFrame:
    """session, head, tail: the beginning and end of each transcript (session, turn, text), cut at sentence ends.

    A session's lines are joined in order (null turns last, ties by text); tokens are two for a CJK character and a quarter for
    others. Every character and line break takes a quarter at least, so only that many of a session's first and last lines,
    and of the characters of each, can count: rank limits leave the others in the tasks that read them, and what one
    group gets is bounded however long a session is.
    """
    weight = re.compile(r"[一-鿿]")

    def cut(text: str, most: int, tail: bool) -> str:
        used, at = 0.0, 0
        for at, ch in enumerate(reversed(text) if tail else text):
            used += 2 if weight.match(ch) else 0.25
            if used > most:
                break
        else:
            return text
        part = text[len(text) - at :] if tail else text[:at]
        edge = max(part.rfind("."), part.rfind("\n")) if not tail else min((i for i in (part.find("."), part.find("\n")) if i >= 0), default=-1)
        return part if edge < 0 else part[edge + 1 :] if tail else part[: edge + 1]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        of = lambda side, rising: "\n".join(rows[rows["side"] == side].sort_values("n", ascending=rising)["text"])
        return pd.DataFrame([(rows["session"].iloc[0], cut(of("head", True), head_tokens, False), cut(of("tail", False), tail_tokens, True))], columns=["session", "head", "tail"])

    def side(name: str, tokens: int, turn: Column, text: Column) -> DataFrame:
        most = 4 * int(tokens) + 1
        clipped = F.substring("text", 1, most) if name == "head" else F.when(F.length("text") > most, F.right("text", F.lit(most))).otherwise(F.col("text"))
        ranked = given.withColumn("n", F.row_number().over(W.partitionBy("session").orderBy(turn, text))).where(F.col("n") <= most)
        return ranked.select("session", "n", F.lit(name).alias("side"), clipped.alias("text"))

    given = lines.select("session", "turn", F.coalesce("text", F.lit("")).alias("text"))
    both = side("head", head_tokens, F.asc_nulls_last("turn"), F.asc("text")).unionByName(side("tail", tail_tokens, F.desc_nulls_first("turn"), F.desc("text")))
    kind = lines.schema["session"].dataType.simpleString()
    return both.groupBy("session").applyInPandas(run, f"session {kind}, head string, tail string")


def parse_extractions(df: DataFrame, text: str = "text") -> DataFrame:
    """session_type, facts, decisions, entities, confidence (0 to 1) of a tagged extraction."""
    many = lambda tag: F.transform(F.regexp_extract_all(F.col(text), F.lit(rf"(?s)<{tag}>(.*?)</{tag}>"), 1), lambda v: F.trim(v))
    sure = F.try_to_number(F.nullif(F.regexp_extract(text, r"<confidence>\s*([0-9.]+)\s*</confidence>", 1), F.lit("")), F.lit("9.9999")).cast("double")
    return df.withColumn("session_type", F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"<session_type>(.*?)</session_type>", 1)), F.lit("")), F.lit("unknown"))).withColumn("facts", many("fact")).withColumn("decisions", many("decision")).withColumn("entities", many("entity")).withColumn("confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sure, F.lit(0.5)))))


def expand_includes(spark: SparkSession, path: str, depth: int = 5, seen: tuple[str, ...] = ()) -> str:
    """A text file with its `@include file` lines replaced by the files, to a depth, a file never inside itself."""
    if depth < 0 or path in seen:
        return ""
    base = path.rsplit("/", 1)[0]
    text = spark.read.text(path, wholetext=True).first()["value"]
    return re.sub(r"(?m)^@include\s+(\S+)\s*$", lambda m: expand_includes(spark, f"{base}/{m[1]}", depth - 1, (*seen, path)), text)


def providers() -> dict[str, int]:
    """Names of embedding providers and their batch sizes; only the hashed one is built in, others are registered."""
    return {"hash": 24, "transformer": 24, "openai-compatible": 8, "gemini": 4}


def embed_with(df: DataFrame, provider, text: str = "text", batch: int = 24) -> DataFrame:
    """df (id, text) with embedding by a registered provider: a function from a list of texts to vectors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            vectors = []
            for i in range(0, len(rows), batch):
                vectors += [[float(x) for x in v] for v in provider(rows[text].iloc[i : i + batch].tolist())]
            yield pd.DataFrame({"id": rows["id"], "embedding": vectors})

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", text).mapInPandas(run, f"id {kind}, embedding array<double>")
