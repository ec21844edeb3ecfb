"""Joins on intervals, paths and sets: against brute force, without loops over pairs in the plan, and without hot tasks."""

import itertools
import random
import re

from pyspark.sql import functions as F

from memoglyph.operators import graph as G, lifecycle as L
from memoglyph.sources import texts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_join_with_times(spark):
    r = random.Random(1)
    day = lambda: f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    some = lambda: r.choice([None, day(), day(), day() + "T10:00:00"])
    triples = [(i, some(), some()) for i in range(150)] + [(900, None, None), (901, "2015-01-01", "2015-01-01"), (902, "odd", "2012-01-01"), (903, "2016-01-02", "2016-01-01")]
    times = [(day(),) for _ in range(60)] + [("2015-01-01",), ("2015-01-01",), ("2011-05-05T12:00:00",), (None,), ("never",)]
    t, at = spark.createDataFrame(triples, "id long, valid_from string, valid_to string"), spark.createDataFrame(times, "at string")
    joined = G.as_of_join(t, at)
    want = sorted((i, x) for i, a, b in triples for (x,) in times if x and x != "never" and (a is None or a <= x) and (b is None or b >= x))
    assert sorted((x["id"], x["at"]) for x in joined.collect()) == want
    assert "NestedLoop" not in plan(joined) and "Cartesian" not in plan(joined)


def test_bins_of_an_interval_are_few_and_make_it_up(spark):
    rows = [(0, 0), (3, 12), (5, 5), (0, (1 << G.LEVELS) - 1), (7, 1_000_000), (9, 8)]
    df = spark.createDataFrame(rows, "a int, b int").withColumn("bins", G.covering_bins(F.col("a"), F.col("b")))
    for x in df.collect():
        parts = [(p["bin"] << p["level"], (p["bin"] + 1) << p["level"]) for p in x["bins"]]
        assert len(parts) <= 2 * G.LEVELS and sum(e - s for s, e in parts) == max(0, x["b"] - x["a"] + 1)
        assert all(x["a"] <= s and e <= x["b"] + 1 for s, e in parts)


def test_path_join(spark):
    paths = ["/a", "/a/", "/a/b", "/a/b/c", "/ab", "a/b", "a", "/", "", "/a/b//", "/x/y", None, "/a"]
    left, right = (spark.createDataFrame([(i, p) for i, p in enumerate(paths)], f"{n}_id int, {n} string") for n in "pq")
    joined = texts.path_join(left, right, "p", "q")
    cut = lambda x: re.sub("/+$", "", x)
    match = lambda a, b: a == b or a.startswith(b + "/") or b.startswith(a + "/")
    want = sorted((i, j) for (i, a), (j, b) in itertools.product(enumerate(paths), repeat=2) if a is not None and b is not None and match(cut(a), cut(b)))
    assert sorted((x["p_id"], x["q_id"]) for x in joined.collect()) == want
    assert "NestedLoop" not in plan(joined)


def test_rows_that_share_a_token_are_dealt_to_blocks(spark):
    r = random.Random(2)
    rows = [(i, ["hot", *r.sample([f"w{j}" for j in range(14)], r.randint(2, 6)), *([f"u{r.randint(0, 300)}"] if r.random() < 0.7 else [])]) for i in range(700)]
    df, sets = spark.createDataFrame(rows, "id long, tokens array<string>"), {i: frozenset(t) for i, t in rows}
    first: dict = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    for least in (0.5, 0.7):
        want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}
        want |= {(first[s], i) for i, s in sets.items() if first[s] != i}
        for meeting in (20, 100_000):
            got = [(x["a"], x["b"]) for x in L.overlapping_pairs(df, least, meeting).collect()]
            assert len(got) == len(set(got)) and set(got) == want


def test_slices_of_long_sessions_are_bounded(spark):
    lines = [(1, i, f"第{i}句话.") for i in range(3000)] + [(2, i, "x" * 5000 + ".") for i in range(4)] + [(3, None, "last"), (3, 1, None), (3, 0, "first.")]
    got = {r["session"]: r for r in texts.slice_transcripts(spark.createDataFrame(lines, "session long, turn long, text string"), 20, 20).collect()}
    assert got[1]["head"] == "第0句话.\n第1句话.\n第2句话." and got[1]["tail"] == "\n第2998句话.\n第2999句话."
    assert got[2]["head"] == "x" * 80 and got[2]["tail"] == ""  # the only sentence end in reach is the last character
    assert got[3]["head"] == got[3]["tail"] == "first.\n\nlast"


def test_pairs_are_compared_in_place_and_not_joined(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, sorted({"hot", *r.choices([f"w{j}" for j in range(30)], k=r.randint(1, 17))})) for i in range(400)]
    df, sets = spark.createDataFrame(rows, "id long, tokens array<string>"), {i: frozenset(t) for i, t in rows}
    distinct = sorted({s: i for i, s in sorted(sets.items(), reverse=True)}.values())
    found = L._near_sets(df.where(F.col("id").isin(distinct)).withColumnRenamed("tokens", "set"), 0.6, 1000)
    assert "array_intersect" not in plan(found) and plan(found).count("MapInArrow") == 1
    want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(distinct, 2)}
    want = {p: x for p, x in want.items() if x >= 0.6}
    monkeypatch.setattr(L, "AT_ONCE", 50)
    monkeypatch.setattr(L, "COMPARED", 7)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows_at_once, meeting in (("3", 1000), ("10000", 25)):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_at_once)
            got = [tuple(x) for x in L._near_sets(df.where(F.col("id").isin(distinct)).withColumnRenamed("tokens", "set"), 0.6, meeting).collect()]
            assert len(got) == len(want) > 20 and {(a, b): x for a, b, x in got} == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_every_pair_is_there_with_copies_and_at_the_threshold(spark):
    r = random.Random(4)
    base = [tuple(sorted(r.sample([f"w{j}" for j in range(12)], r.randint(1, 8)))) for _ in range(40)]
    rows = [(i, list(r.choice(base)) * r.randint(1, 2)) for i in range(160)] + [(i, []) for i in range(200, 203)]
    rows += [(300, [f"a{j}" for j in range(15)] + ["b"]), (301, [f"a{j}" for j in range(11)] + ["c", "d", "e", "f"])]  # 11 of 20
    df, sets = spark.createDataFrame(rows, "id long, tokens array<string>"), {i: frozenset(t) for i, t in rows}
    for least in (0.5, 0.55, 0.7):
        share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and sets[b]}
        want = {p: x for p, x in share.items() if x >= least}
        assert ((300, 301) in want) == (least <= 0.55)
        for meeting in (3, 1000):
            got = [tuple(x) for x in L.every_pair(df, least, meeting).collect()]
            assert len(got) == len(want) and {(a, b): x for a, b, x in got} == want
