"""A lookup opens the files and row groups that may hold its key."""

from pyspark.sql import functions as F

from memoglyph.sources.lookup import MOST_KEYS, Lookup


def scanned(df):
    """Ids found, files and rows that a query's scan read."""
    ids = sorted(r["id"] for r in df.collect())
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if "Adaptive" in plan.getClass().getName() else plan
    leaf = plan.collectLeaves().head().metrics()
    return ids, leaf.apply("numFiles").value(), leaf.apply("numOutputRows").value()


def test_one_row_group_is_read(spark, tmp_path):
    rows = spark.range(200_000).select(F.format_string("r%07d", F.col("id") * 2).alias("id"), F.sha2(F.col("id").cast("string"), 256).alias("digest"), F.repeat(F.lit("x"), 50).alias("text"))
    store = Lookup(spark, str(tmp_path / "s"))
    store.build(rows, blooms=("digest",), group_bytes=1 << 20, files=8)
    ids, files, read = scanned(store.get(["r0000400"]))
    assert ids == ["r0000400"] and files == 1 and read < 25_000
    assert scanned(store.get(["r0000400", "r0399998", "r0000400", None, "r0000401"]))[:2] == (["r0000400", "r0399998"], 2)
    assert store.get(["zzz"]).collect() == [] and store.get([]).collect() == [] and store.get([None]).columns == ["id", "digest", "text"]
    digest = rows.where("id = 'r0100000'").first()["digest"]
    ids, _, read = scanned(store.where("digest", digest))
    assert ids == ["r0100000"] and read < 200_000 / 4
    assert store.store.read("bounds").agg(F.sum("n")).first()[0] == 200_000


def test_many_keys_null_keys_and_new_versions(spark, tmp_path):
    store = Lookup(spark, str(tmp_path / "s"), key="k")
    store.build(spark.createDataFrame([(None, "n"), (1, "a"), (1, "b"), (5, "c")], "k int, v string"))
    assert sorted(r["v"] for r in store.get([1, None]).collect()) == ["a", "b"]
    assert sorted(r["v"] for r in store.get([*range(MOST_KEYS + 1)]).collect()) == ["a", "b", "c"]
    store.build(spark.createDataFrame([(9, "d")], "k int, v string"))
    assert store.get([1]).collect() == [] and [r["v"] for r in store.get([9]).collect()] == ["d"]
    store.build(spark.createDataFrame([], "k int, v string"))
    assert store.get([9]).collect() == []
