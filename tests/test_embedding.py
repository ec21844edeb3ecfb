"""A provider is given the texts that changed, and no others."""

import pytest
from pyspark.sql import functions as F

from memoglyph.operators import embedding as E
from memoglyph.sources.commits import Conflict
from memoglyph.sources.texts import embed_with

SCHEMA = "id string, title string, content string, facts array<string>, concepts array<string>, archived boolean, tier int, memory_level string, scope string"
A = ("a", "Title  a", "some content", ["first fact", " ", "ok", "second fact"], None, False, None, "durable", None)
B = ("b", "Title b", "other content", None, ["one concept"], None, 3, None, None)


def test_fields(spark):
    rows = [A, B, ("c", "archived one", "text", None, None, True, None, None, None), ("d", "tier five", "text", None, None, None, 5, None, None), ("e", "hi", None, ["a fact of noise"], None, None, None, None, None), (" ", "no id here", "x", None, None, None, None, None, None), (None, "null id here", "x", None, None, None, None, None, None)]
    got = {r["entry_id"]: (r["field"], r["text"]) for r in E.fields(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {
        "a": ("content", "Title a some content"), "a__fact_0": ("fact_0", "first fact"), "a__fact_2": ("fact_2", "second fact"),
        "b": ("content", "Title b other content"), "b__concept_0": ("concept_0", "one concept"),
    }
    assert E.fields(spark.createDataFrame([("x", "a title")], "id string, title string")).first()["text"] == "a title"
    long = E.fields(spark.createDataFrame([("x", "y" * 9000)], "id string, content string")).first()["text"]
    assert len(long) == 6000


def test_config_hash():
    a = E.config_hash("openai-compatible", "m", "https://Host/v1/")
    assert a == E.config_hash("openai-compatible", " m ", "https://host/v1") != E.config_hash("openai-compatible", "m2", "https://host/v1")
    assert E.config_hash("hash", "m", "https://x") == E.config_hash("hash", "m") and len(a) == 16


def test_only_changes_are_embedded(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def provider(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        return [[float(len(t)), 1.0] for t in texts]

    def asked():
        found = sorted(t for p in log.iterdir() for t in p.read_text().split("\n"))
        for p in log.iterdir():
            p.rename(tmp_path / p.name)
        return found

    store = E.Embeddings(spark, str(tmp_path / "s"))
    embed = lambda df: embed_with(df, provider)
    build = lambda rows, config="k1", **more: store.build(E.fields(spark.createDataFrame(rows, SCHEMA)), embed, config, **more)
    held = lambda: {r["entry_id"]: r["embedding"][0] for r in store.vectors().collect()}

    assert store.vectors().collect() == [] and build([A, B, A]) == {"new": 5} and len(asked()) == 5
    first = held()
    assert first["a__fact_0"] == 10.0 and len(first) == 5
    versions = store.store.versions()
    assert build([B, A]) == {"kept": 5} and asked() == [] and store.store.versions() == versions
    changed = ("b", "Title b", "other content now", *B[3:])
    assert build([A, changed]) == {"kept": 4, "changed": 1} and asked() == ["Title b other content now"]
    assert build([changed]) == {"kept": 2, "gone": 3} and asked() == [] and sorted(held()) == ["b", "b__concept_0"]
    assert build([A, changed]) == {"kept": 2, "new": 3} and len(asked()) == 3
    assert build([A, changed], "k2") == {"config": 5} and len(asked()) == 5
    before = held()
    store.compact()
    assert held() == before and store.store.read("vectors").count() == 5
    assert build([A, changed], "k2") == {"kept": 5} and build([A, changed], "k2", force=True) == {"changed": 5} and len(asked()) == 5
    assert build([("l", "z" * 5000, None, *A[3:])], "k2")["new"] == 3 and max(map(len, asked())) == 3000

    def failing(df):
        return embed_with(df, lambda texts: 1 / 0)

    versions = store.store.versions()
    with pytest.raises(Exception, match="division"):
        store.build(E.fields(spark.createDataFrame([B], SCHEMA)), failing, "k2")
    assert store.store.versions() == versions

    def slow(df):
        store.compact()
        return embed_with(df, provider)

    with pytest.raises(Conflict):
        store.build(E.fields(spark.createDataFrame([B], SCHEMA)), slow, "k2")


def test_change_set_shuffles_digests_alone(spark):
    texts = E.fields(spark.createDataFrame([A], SCHEMA))
    stored = spark.createDataFrame([("a", "x", "k", True)], "entry_id string, hash string, config string, filled boolean")
    plan = E.change_set(texts, stored, "k").select("entry_id", "action").hint("merge")._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Exchange" in line]
    assert joins and all("hashpartitioning(entry_id" in line for line in joins)
    assert {r["entry_id"]: r["action"] for r in E.change_set(texts, stored, "k").collect()} == {"a": "changed", "a__fact_0": "new", "a__fact_2": "new"}
    assert E.change_set(texts, stored.where("false"), "k").where(F.col("action") != "new").count() == 0
