"""Signals of notes by the rules, and inbox texts without test noise."""

import pytest
from pyspark.sql import functions as F

from memoglyph.operators import signals as S

LINES = {
    "- Use  the canonical folder": ("Use the canonical folder", "durable"),
    "12. fix the parser": ("fix the parser", "working"),
    "* [2024-01-02] durable thing": ("[2024-01-02] durable thing", "working"),
    "plan - [2024-01-02 10:00] later": ("plan", ""),
    "## durable heading": ("## durable heading", "noise"),
    "| durable | table |": ("| durable | table |", "noise"),
    "No sessions found.": ("No sessions found.", "noise"),
    "see probe-12 for the workflow": ("see probe-12 for the workflow", "noise"),
    "C:\\vault\\a": ("C:\\vault\\a", ""),
    "notes/strategy.md": ("notes/strategy.md", ""),
    "**Timezone**: UTC": ("**Timezone**: UTC", "durable"),
    "an ACTIVE workflow": ("an ACTIVE workflow", "durable working"),
    "Inputs of a task": ("Inputs of a task", "working"),
    "   ": ("", "noise"),
    None: ("", "noise"),
}


def test_lines(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string").withColumn("item", S.signal_item("line"))
    got = df.select("line", "item", S.is_noise_item("item").alias("noise"), S.is_durable_item("item").alias("durable"), S.is_working_item("item").alias("working")).collect()
    assert {r["line"]: (r["item"], " ".join(k for k in ("noise", "durable", "working") if r[k])) for r in got} == LINES
    own = spark.range(1).select(S.is_noise_item(F.lit("my-test fix"), ("my-test",)).alias("x"))
    assert own.first()["x"]


def test_items(spark):
    text = "task one\nTASK ONE\nnothing here\n- task two\r\n\n| noise\n" + "\n".join(f"task n{i}" for i in range(20))
    df = spark.createDataFrame([(1, text), (2, None), (3, ""), (None, "a task")], "id int, text string")
    items = lambda **o: [(r["id"], r["item"]) for r in S.signal_items(df, "id", **o).orderBy("id", "place").collect()]
    assert items(most=3) == [(None, "a task"), (1, "task one"), (1, "task two"), (1, "task n0")]
    assert items(most=2, newest=True, mode="inbox") == [(None, "a task"), (1, "task n19"), (1, "task n18")]
    assert items(mode="durable") == [] and items(most=0) == [] and len(items(most=100)) == 23
    assert items(most=100, newest=True)[-1] == (1, "TASK ONE")
    with pytest.raises(ValueError, match="mode"):
        S.signal_items(df, "id", mode="other")
    clash = df.withColumn("item", F.lit("x")).withColumn("_at", F.lit(0)).withColumn("place", F.lit(9))
    assert S.signal_items(clash, "id", most=1).count() == 2 and S.signal_items(df.where("false"), "id").count() == 0


def test_sections(spark):
    text = "intro task\n## Recent Threads\n one\n\n two \n## Other\nthree\n### Sub\n  ## recent sessions  \nfour\n# Top\nfive"
    df = spark.createDataFrame([(text,), ("durable whole",), (None,), ("## Strategy",)], "text string")
    got = [tuple(r) for r in df.select(S.signal_text("text", "working"), S.signal_text("text", "durable")).collect()]
    assert got == [("one\n\n two\n\nfour", text), ("", "durable whole"), ("", ""), ("", "## Strategy")]


def test_inbox(spark):
    texts = ["# Inbox\nmarker-codex in\n\nkept\n  Stress-Round-1\nend", "marker-codex\nno header", "---\nmarker-trae\n---\nmarker-trae\nx", None, ""]
    got = [tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "text string").select(S.clean_inbox("text").alias("c")).select("c.text", "c.removed").collect()]
    assert got == [("# Inbox\n\nkept\nend", 2), (texts[1], 0), ("---\nmarker-trae\n---\nx", 1), ("", 0), ("", 0)]
