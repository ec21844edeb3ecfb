"""Lines of notes that are worth carrying on: noise, durable and working signals, their items; inbox texts without test noise. All in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from memoglyph.functions.text import _c, let, normalize_spaces
from memoglyph.operators.lifecycle import one_per_key, top_per_key

# fixed values: what marks an item as noise, as durable and as working
NOISE = [
    r"^(?:#|##|###)\s+", r"^\|", r"^\.\.\.$", "^Imported at:", r"^Append durable facts, reusable decisions, and cross-project preferences here\.$", "SHARED-PROBE", r"\bprobe-\d+", r"\[cross-tool-test\]",
    r"\bmarker-[a-z0-9_-]+", "stress-round", r"^No .* detected\.?$", r"^No .* found\.?$", r"^Project .* not found\.?$", "^OpenCode stats unavailable", r"^opencode\.json not found", "^CLI path:", "^Database path:",
    "^Storage path:", "^Chat sessions path:", "^Session state root:", "^Matching CLI sessions:", "^Workspace path:", "^Last activity:", r"^Total Cost\b", r"^Avg Cost/Day\b", r"^Avg Tokens/Session\b",
    r"^Median Tokens/Session\b", r"^Input\b", r"^Output\b", r"^Cache Read\b", r"^Cache Write\b", r"^Sessions\b", r"^Messages\b", r"^Days\b", r"rollout-\d{4}", r"\.jsonl\b",
]
DATED = r"^\[[0-9]{4}-[0-9]{2}-[0-9]{2}"
NOT_DURABLE = [DATED, r"^[a-z]:\\", r'^".*":\s*\{?$', r"^`?.+\.md`?$"]
DURABLE = [
    "shared long-term storage", "canonical", "durable", "writeback", "read order", "shared memory", "workflow", "strategy", "obsidian", "vault", "claude-mem", "mcp ready", "initialized", "worker port", "database size",
    "observations", "summaries", r"react\b", r"typescript\b", r"vite\b", "supabase", r"three\.js", "swiftui", r"socket\.io", r"^\*\*(?:name|timezone|os|python path|git)\*\*:",
]
WORKING = [DATED, "current", "active", "working", "handoff", "recent", "today", "task", "session", "thread", "topic", "continue", "verify", "analyze", "fix", "memory"]
# fixed values: sections that hold signals
HEADINGS = {
    "durable": ["## Strategy", "## USER.md", "## MEMORY.md", "## Claude-Mem Health", "## Claude-Mem Stats", "## Canonical Files", "## Writeback Policy"],
    "working": ["## Recent Threads", "## Recent Sessions", "## Recent Prompts", "## Recent Session Topics"],
}
# fixed values: what marks an inbox line as noise of a test
INBOX_NOISE = ["stress-round-", "压力测试", "cross-tool-test.*marker-", "marker-openclaw", "marker-claude-code", "marker-codex", "marker-opencode", "marker-trae", "marker-cursor", "marker-copilot"]
MODES = ("durable", "working", "inbox")


def any_of(patterns: list[str]) -> str:
    """One pattern that matches where any of these does, regardless of case."""
    return "(?i)(?:" + "|".join(patterns) + ")"


def signal_item(line: Column | str) -> Column:
    """A line's text: spaces normalised, without its list mark and number, up to a dated entry that follows in the same line."""
    text = F.regexp_replace(F.regexp_replace(normalize_spaces(line), r"^[-*+]\s+", ""), r"^\d+\.\s+", "")
    return F.trim(F.regexp_replace(text, r"- \[[0-9]{4}-[0-9]{2}-[0-9]{2}.*$", ""))


def is_noise_item(item: Column | str, marks: tuple[str, ...] = ()) -> Column:
    """Blank items and those that any noise pattern, or one of a site's own marks of tests, matches."""
    text = _c(item)
    return (text == "") | text.rlike(any_of([*NOISE, *marks]))


def is_durable_item(item: Column | str, marks: tuple[str, ...] = ()) -> Column:
    text = _c(item)
    return ~is_noise_item(text, marks) & ~text.rlike(any_of(NOT_DURABLE)) & text.rlike(any_of(DURABLE))


def is_working_item(item: Column | str, marks: tuple[str, ...] = ()) -> Column:
    text = _c(item)
    return ~is_noise_item(text, marks) & text.rlike(any_of(WORKING))


def sections(text: Column | str, headings: list[str]) -> Column:
    """The bodies of the sections under these headings (# or ## lines, regardless of case), a blank line between them; empty if there are none."""
    parts = F.split(F.regexp_replace(F.coalesce(_c(text), F.lit("")), "\r", ""), r"\n(?=[ \t]*##?\s)")
    named = F.filter(parts, lambda p: F.lower(F.trim(F.substring_index(p, "\n", 1))).isin([h.lower() for h in headings]))
    body = lambda p: F.when(F.instr(p, "\n") > 0, F.regexp_replace(F.substring(p, F.instr(p, "\n") + 1, F.length(p)), r"^\s+|\s+$", "")).otherwise("")
    return F.array_join(F.filter(F.transform(named, body), lambda b: b != ""), "\n\n")


def signal_text(text: Column | str, mode: str) -> Column:
    """Where an imported text's signals are looked for: its known sections; a text without any as a whole for durable ones, nowhere for working ones."""
    found = sections(text, HEADINGS[mode])
    return F.when(found != "", found).otherwise(F.coalesce(_c(text), F.lit("")) if mode == "durable" else F.lit(""))


def signal_items(df: DataFrame, key: str, text: str = "text", mode: str = "working", most: int = 8, newest: bool = False, marks: tuple[str, ...] = ()) -> DataFrame:
    """key, place (from 1), item: the first (or last) `most` signals of each key's text, equal ones once regardless of case.

    A key's rows are one text each; equal keys are taken together only if their texts are. Lines are met by key and digest, and each map
    task sends `most` rows of a key at most after that, so neither a long text nor a frequent line fills a task.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    fits = {"durable": is_durable_item, "working": is_working_item, "inbox": lambda i, m: ~is_noise_item(i, m)}[mode]
    lines = df.select(F.col(key).alias("_key"), F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "\r", ""), "\n")).alias("_at", "_line"))
    items = lines.select("_key", (-F.col("_at") if newest else F.col("_at")).alias("_at"), signal_item("_line").alias("item")).where(fits(F.col("item"), marks))
    once = one_per_key(items.withColumn("_low", F.sha2(F.lower("item"), 256)), ["_key", "_low"], "_at", "item")
    return top_per_key(once, ["_key"], int(most), "_at", "item", rank="place").select(F.col("_key").alias(key), "place", "item")


def clean_inbox(text: Column | str, marks: tuple[str, ...] = ()) -> Column:
    """text, removed: an inbox text without noise lines after its header.

    The header ends with the first line that begins with `# `, or with `---` past the first line; a text without either is all header.
    """
    lines = F.split(F.coalesce(_c(text), F.lit("")), "\n")
    bare = lambda line: F.regexp_replace(line, r"^\s+|\s+$", "")
    ends = F.transform(lines, lambda line, i: bare(line).startswith("# ") | (bare(line).startswith("---") & (i > 0)))
    noise = any_of([*INBOX_NOISE, *marks])
    body = lambda header: F.filter(lines, lambda line, i: (header == 0) | (i < header) | ~bare(line).rlike(noise))
    # found once a text, not once a line
    kept = let(F.array_position(ends, F.lit(True)), body)
    return let(kept, lambda k: F.struct(F.array_join(k, "\n").alias("text"), (F.size(lines) - F.size(k)).alias("removed")))
