"""What a session is about comes from its first and last lines."""

import json

from pyspark.sql import functions as F

from memoglyph.sources import editors as D


def ask(text=None, parts=None, at=None, mode=None, model=None, one=False):
    r = {"message": {"text": text, "parts": [{"text": p} for p in parts or []]}, "timestamp": at, "modeInfo": {"modeId": mode}, "modelId": model}
    return json.dumps({"kind": 2, "k": ["requests"], "v": r if one else [r]})


def begin(i="s", text="being written", mode="ask", model="m", at=5):
    return json.dumps({"kind": 0, "v": {"sessionId": i, "creationDate": at, "inputState": {"mode": {"id": mode}, "selectedModel": {"identifier": model}, "inputText": text}}})


def run(spark, **files):
    rows = [(name, i, line) for name, lines in files.items() for i, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "session string, pos long, line string").withColumn("other", F.lit(1))
    return {r["session"]: tuple(r)[1:] for r in D.sessions(df).collect()}


def test_sessions(spark):
    noise = ["", None, "no json", "[1]", "{}", '{"kind": 1, "v": 3}', '{"kind": 2, "k": ["other"], "v": [{"message": {"text": "x"}}]}']
    got = run(
        spark,
        plain=[*noise, begin("id1"), begin("id2", "later"), ask("first", at=10, mode="agent", model="big"), ask("second\r\nline", at=20, mode=" "), *noise],
        one=[begin(""), ask("just one", one=True, at="30")],
        parts=[begin(mode=None, model=" "), ask(" ", [" ", "from a part", "another"], at="soon"), ask(None, [], model="last")],
        none=[begin(text="  ")],
        text=[begin(text="wrote\nthis")],
        late=["{}"] * 16 + [begin()],
        long=[ask("too early", mode="early", at=1)] + [ask("y" * 200, at=2)] + ["{}"] * 239,
        several=[json.dumps({"kind": 2, "k": "requests", "v": [{"message": {"text": "a"}, "timestamp": 1}, None, {"message": {"text": "b"}, "timestamp": 2}, {"message": "odd"}]})],
        large=[begin("big"), ask("z" * (1 << 20))],
        edge=["x" * ((1 << 20) - 1)],
    )
    assert got == {
        "plain": ("id1", 5, 20, "agent", "big", "second line"), "one": ("one", 5, 30, "ask", "m", "just one"), "parts": ("s", 5, None, "unknown", "last", "from a part"),
        "none": ("s", 5, None, "ask", "m", D.NO_TOPIC), "text": ("s", 5, None, "ask", "m", "wrote this"), "late": ("late", None, None, "unknown", "unknown", D.NO_TOPIC),
        "long": ("long", None, 2, "unknown", "unknown", "y" * 137 + "..."), "several": ("several", None, 2, "unknown", "unknown", "b"), "large": ("large", None, None, "unknown", "unknown", D.TOO_LARGE),
        "edge": ("edge", None, None, "unknown", "unknown", D.NO_TOPIC),
    }
    assert D.sessions(spark.createDataFrame([], "session long, pos long, line string")).count() == 0
    repeated = spark.createDataFrame([("r", 1, begin()), ("r", 1, begin()), ("r", None, ask("before", at=1)), (None, 2, begin("n"))], "session string, pos long, line string")
    assert [(r["session"], r["session_id"], r["topic"]) for r in D.sessions(repeated).collect()] == [("r", "s", "before")]


def test_lines_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1, "{}")], "session string, pos long, line string")
    plan = D.sessions(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "NestedLoop" not in plan
