"""A layer is made anew where its inputs have changed, and nowhere else."""

from graphlib import CycleError

import pytest
from pyspark.sql import functions as F

from memoglyph.operators import layers as B
from memoglyph.sources.commits import Store

NOW = 1_000_000_000_000
SCHEMA = "id string, content string, content_hash string, t_ms long, scope string"


def rows(spark, *values):
    return spark.createDataFrame([(*v, *(None,) * (5 - len(v))) for v in values], SCHEMA)


def names(df):
    return sorted(r["id"] for r in df.collect())


def test_only_what_changed_is_made(spark, tmp_path):
    store, made = Store(spark, str(tmp_path / "s")), []

    def counted(name, rule):
        def make(*frames):
            made.append(name)
            return rule(*frames)

        return make

    layers = {
        "all": B.Layer(counted("all", lambda a, b: a.unionByName(b)), ("left", "right")),
        "left": B.Layer(counted("left", lambda df: df.where("id <> 'x'")), ("one",)),
        "right": B.Layer(counted("right", lambda df: df), ("two",)),
        "n": B.Layer(counted("n", lambda df: df.agg(F.count("*").alias("n"))), ("all",)),
        "apart": B.Layer(counted("apart", lambda df: df), ("two",)),
    }

    def run(one, two, layers=layers):
        made.clear()
        return B.build(store, {"one": B.source(rows(spark, *one)), "two": B.source(rows(spark, *two))}, layers)

    with pytest.raises(KeyError):
        B.read(store, "all")
    first = run([("a", "1")], [("b", "2")])
    assert set(first.values()) == {"built"} and sorted(made) == ["all", "apart", "left", "n", "right"]
    assert names(B.read(store, "all")) == ["a", "b"] and B.read(store, "n").first()["n"] == 2
    versions = store.versions()
    assert set(run([("a", "1")], [("b", "2")]).values()) == {"kept"} and made == [] and store.versions() == versions
    # what changed and its dependants, no other layer
    assert run([("a", "1"), ("c", None)], [("b", "2")]) == {"left": "built", "right": "kept", "all": "built", "apart": "kept", "n": "built"}
    assert names(B.read(store, "all")) == ["a", "b", "c"]
    # a layer that comes out as before leaves its dependants
    assert run([("c", None), ("a", "1"), ("x", "out")], [("b", "2")]) == {"left": "same", "right": "kept", "all": "kept", "apart": "kept", "n": "kept"} and made == ["left"]
    # a repeated row is a change, other orders aren't
    assert run([("c", None), ("a", "1"), ("a", "1")], [("b", "2")])["left"] == "built" and B.read(store, "n").first()["n"] == 4
    assert set(run([("a", "1"), ("c", None), ("a", "1")], [("b", "2")]).values()) == {"kept"}
    # so is a rule's version
    newer = layers | {"n": B.Layer(layers["n"].make, ("all",), "2")}
    assert run([("a", "1"), ("c", None), ("a", "1")], [("b", "2")], newer)["n"] == "same" and made == ["n"]
    # and a value in another column, or a null in place of an empty string
    assert run([("a", "1"), ("c", ""), ("a", "1")], [("b", "2")], newer)["left"] == "built"
    store.vacuum(keep=1, older_than_ms=0)
    assert names(B.read(store, "all")) == ["a", "a", "b", "c"]
    assert run([], [], newer)["all"] == "built" and B.read(store, "all").count() == 0 and B.read(store, "n").first()["n"] == 0
    assert set(run([], [], newer).values()) == {"kept"}
    for wrong in ({"one": B.Layer(lambda df: df, ("two",))}, {"p": B.Layer(lambda df: df, ("none",))}):
        with pytest.raises(ValueError):
            run([], [], wrong)
    with pytest.raises(CycleError):
        run([], [], {"p": B.Layer(lambda df: df, ("q",)), "q": B.Layer(lambda df: df, ("p",))})


def test_a_build_that_dies_goes_on(spark, tmp_path):
    store, made = Store(spark, str(tmp_path / "s")), []
    fail = []

    def last(df):
        made.append("last")
        return df.withColumn("z", F.expr("assert_true(false, 'lost')")) if fail else df

    def first(df):
        made.append("first")
        return df

    layers = {"first": B.Layer(first, ("one",)), "last": B.Layer(last, ("first",))}
    run = lambda *v: B.build(store, {"one": B.source(rows(spark, *v))}, layers)
    run(("a", "1"))
    fail.append(True)
    with pytest.raises(Exception, match="lost"):
        run(("a", "1"), ("b", "2"))
    # readers see both layers as they were, not one of each build
    assert names(B.read(store, "first")) == names(B.read(store, "last")) == ["a"]
    fail.clear(), made.clear()
    assert run(("a", "1"), ("b", "2")) == {"first": "kept", "last": "built"} and made == ["last"]
    assert names(B.read(store, "first")) == names(B.read(store, "last")) == ["a", "b"]


def test_killed_before_its_end_was_noted(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path / "s"))
    layers = {"first": B.Layer(lambda df: df, ("one",))}
    commit = Store.commit

    def dying(self, tables, **more):
        if not tables:
            raise KeyboardInterrupt
        return commit(self, tables, **more)

    with monkeypatch.context() as m:
        m.setattr(Store, "commit", dying)
        with pytest.raises(KeyboardInterrupt):
            B.build(store, {"one": B.source(rows(spark, ("a",)))}, layers)
    with pytest.raises(KeyError):
        B.read(store, "first")
    assert B.build(store, {"one": B.source(rows(spark, ("a",)))}, layers) == {"first": "kept"} and names(B.read(store, "first")) == ["a"]


def test_files_stand_for_their_content(spark, tmp_path):
    folder = tmp_path / "in"
    read = lambda p: spark.read.schema(SCHEMA).json(p)
    assert B.files(spark, str(folder), read, SCHEMA).rows.count() == 0
    rows(spark, ("a", "1")).coalesce(1).write.json(str(folder))
    before = B.files(spark, str(folder), read, SCHEMA)
    assert before.rows.count() == 1 and before.content == B.files(spark, str(folder), read, SCHEMA).content
    rows(spark, ("b", "1")).coalesce(1).write.mode("append").json(str(folder))
    assert B.files(spark, str(folder), read, SCHEMA).content != before.content


def test_maps_and_columns_count(spark):
    a = spark.sql("SELECT map('k', 1) AS m, 1 AS n")
    assert B.source(a).content == B.source(spark.sql("SELECT map('k', 1) AS m, 1 AS n")).content
    assert len({B.source(spark.sql(f"SELECT {c}")).content for c in ("map('k', 1) AS m, 1 AS n", "map('k', 2) AS m, 1 AS n", "1 AS m", "1 AS n", "CAST(NULL AS INT) AS n")}) == 5


def test_shared_inbox(spark):
    inbox = rows(spark, ("i1", "fresh", None, NOW), ("i2", "repeat", None, NOW), ("i3", "old repeat", None, NOW), ("i4", "same", None, NOW), ("i5", "same", None, NOW), ("i1", "older", None, NOW - 5), (None, "no id", None, NOW), (" ", "blank", None, NOW), ("i6", None, "abc", NOW), ("i7", None, None, None))
    dreams = rows(spark, ("i1", "of an inbox id", None, NOW - 10**9), ("d1", "dream", None, NOW - 10**9), ("d1", "dream again", None, NOW - 10**8), ("d2", "old repeat", None, NOW - 30_001))
    stored = rows(spark, ("s1", "repeat", None, NOW - 30_000), ("s2", "repeat", None, None))
    got = {r["id"]: (r["content"], r["collides"]) for r in B.shared_inbox(inbox, dreams, stored, NOW).collect()}
    assert got == {"i1": ("fresh", False), "i3": ("old repeat", False), "i4": ("same", True), "i5": ("same", True), "i6": (None, False), "i7": (None, False), "d1": ("dream", False), "d2": ("old repeat", False)}
    empty = rows(spark)
    assert B.shared_inbox(empty, empty, empty, NOW).count() == 0
    # an entry that was left out doesn't keep the written-back record of its id away
    assert names(B.shared_inbox(rows(spark, ("i", "c", None, NOW)), rows(spark, ("i", "c", None, NOW)), empty, NOW)) == ["i"]


def test_standard_layers(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = lambda *v: B.source(rows(spark, *v))
    sources = {
        "inbox": one(("i", "Ada works on Engine. Ada said so.", None, NOW)), "dreams": one(("d", "dream", None, 5)), "stored": one(), "sessions_stored": one(("s", "stored", None, 1), ("p2", "taken", None, 2)), "sessions": one(("n", "new", None, 3)),
        "projects": one(("p1", "project", None, 4, "user"), ("p2", "other", None, 4), ("p3", "", None, 4), (None, "nameless", None, 4)), "events": one(("e", "event", None, 6)), "tasks": one(("t", "task", None, 7), ("t", "task", None, 7)),
    }
    done = B.build(store, sources, B.memory_layers(NOW))
    assert set(done.values()) == {"built"} and len(done) == 7
    records = {(r["layer"], r["id"]): r["scope"] for r in B.read(store, "records").collect()}
    assert set(records) == {("shared", "i"), ("shared", "d"), ("session", "s"), ("session", "p2"), ("session", "n"), ("session", "p1"), ("session", None), ("event", "e"), ("task", "t")}
    assert records["session", "p1"] == "project"
    assert {r["layer"]: r["n"] for r in B.read(store, "summary").collect()} == {"shared": 2, "session": 5, "event": 1, "task": 2}
    facts = {(r["layer"], r["id"]) for r in B.read(store, "facts").collect()}
    assert facts == {("shared", "i")}
    # another time, the same entries: nothing but the layer that depends on it is made
    assert B.build(store, sources, B.memory_layers(NOW + 1)) == {n: "same" if n == "shared" else "kept" for n in done}
    changed = sources | {"tasks": one(("t", "task", None, 8))}
    assert {n for n, d in B.build(store, changed, B.memory_layers(NOW + 1)).items() if d == "kept"} == {"shared", "session", "event"}
