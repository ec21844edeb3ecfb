"""The written index gives the scores of the counted ones, reads few row groups, and grows by commits."""

import random

import pytest
from pyspark.sql import functions as F

from memoglyph.operators import inverted, search as S
from memoglyph.operators.inverted import InvertedIndex

WORDS = [f"w{i}" for i in range(60)]


def entries(spark, first, n):
    r = random.Random(first)
    rows = [(i, [WORDS[min(59, int(r.expovariate(0.08)))] for _ in range(r.randint(0, 30))]) for i in range(first, first + n)]
    return spark.createDataFrame([*rows, (first + n, None)], "id long, tokens array<string>")


def rounded(df):
    return {r["id"]: round(r["score"], 9) for r in df.collect()}


@pytest.mark.parametrize("okapi", [False, True])
def test_scores_equal_counted_ones(spark, tmp_path, okapi):
    index, both = InvertedIndex(spark, str(tmp_path / "i"), filled=okapi), None
    for first in (0, 1000):  # the second commit changes the mean length and all frequencies
        more = entries(spark, first, 300)
        index.add(more)
        both = more if both is None else both.unionByName(more)
        for query in (["w1", "w30", "w1"], ["w50"], ["none"], []):
            known = S.bm25_okapi(both, query) if okapi else S.bm25(both.withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>"))), query)
            assert rounded(index.scores(query, okapi)) == rounded(known)


def test_top_skips_blocks_that_cannot_win(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 20)
    monkeypatch.setattr(inverted, "FIRST", 3)
    index = InvertedIndex(spark, str(tmp_path / "i"))
    index.add(entries(spark, 0, 600))
    assert index.figures()["blocks"] > 25
    for query in (["w1"], ["w1", "w40"], ["w59", "w3", "w3"]):
        want = sorted(((-round(s, 6), i) for i, s in rounded(index.scores(query)).items()))[:5]
        assert [(-r["score"], r["id"]) for r in index.top(query, 5).collect()] == want
    assert index.top(["none"], 5).count() == 0


def test_a_query_reads_its_terms(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"))
    index.add(entries(spark, 0, 500))
    plan = index.scores(["w7"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "EqualTo(term,w7)" in plan or "In(term, [w7])" in plan


def test_empty(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"))
    index.add(entries(spark, 0, 3).limit(0))
    assert index.scores(["a"]).count() == 0 and index.top(["a"], 3).count() == 0


def test_entries_are_added_once(spark, tmp_path):
    index = InvertedIndex(spark, str(tmp_path / "i"))
    for _ in range(2):
        index.add(entries(spark, 0, 50), once="built")
    assert index.figures()["n"] == 51


def test_counts_stay_in_their_rows_and_stages_go(spark, tmp_path):
    """Terms are counted without a shuffle, ids that come again add up, and what a build wrote beside the index is deleted."""
    from pathlib import Path

    from memoglyph.operators.inverted import InvertedIndex, counted
    from memoglyph.operators.lifecycle import shared_folder

    rows = [(1, ["a", "b", "a"]), (2, []), (3, ["é", None, "é"]), (1, ["b", "c", "a"]), (1, ["a"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    made = counted(df)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    want = [(i, None, len(t), 0) for i, t in rows] + [(i, w, len(t), t.count(w)) for i, t in rows for w in set(t)]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(want, key=str)
    index = InvertedIndex(spark, str(tmp_path / "index"))
    index.add(df.withColumnRenamed("t", "tokens"))
    assert index.figures()["n"] == 5 and index.figures()["tokens"] == 10
    got = {(r["id"], r["term"], r["length"]): r["tf"] for r in index.store.read("postings").collect()}
    assert got == {(1, "a", 3): 3, (1, "b", 3): 2, (1, "c", 3): 1, (1, "a", 1): 1, (3, "é", 3): 2, (3, None, 3): 1}
    assert not list(Path(shared_folder(spark).removeprefix("file:")).glob("staged-*"))


@pytest.mark.parametrize("repeats", [False, True])
def test_postings_are_inverted_where_they_lie(spark, tmp_path, monkeypatch, repeats):
    """No posting is shuffled, sheets are in the order of terms, and the first posting of a term in a block bounds the others."""
    for name, value in (("BLOCK", 20), ("SHEET", 3), ("FIRST", 3)):
        monkeypatch.setattr(inverted, name, value)
    rows = entries(spark, 0, 600)
    if repeats:
        rows = rows.unionByName(entries(spark, 500, 600))
    index = InvertedIndex(spark, str(tmp_path / "i"))
    index.add(rows)
    made = inverted.inverted(rows.select("id", F.size("tokens").alias("length"), F.col("tokens").alias("t")).where("t IS NOT NULL"), 0)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    postings = index.store.read("postings").collect()
    assert len({r["block"] for r in postings}) > 20 and all(r["tf"] > 0 for r in postings)
    if not repeats:
        texts = {r["id"]: r["tokens"] or [] for r in rows.collect()}
        assert sorted((r["id"], r["term"], r["length"], r["tf"]) for r in postings) == sorted((i, w, len(t), t.count(w)) for i, t in texts.items() for w in set(t))
    assert len({(r["id"], r["block"]) for r in postings}) == len({r["id"] for r in postings})
    groups = {}
    for r in postings:
        groups.setdefault((r["term"], r["block"]), []).append(r)
    for rows in groups.values():
        assert [(r["n"], r["most"], r["least"]) for r in rows if r["n"]] == [(len(rows), max(r["tf"] for r in rows), min(r["length"] for r in rows))]
    want = sorted(((-round(s, 6), i) for i, s in rounded(index.scores(["w1", "w40"])).items()))[:5]
    assert [(-r["score"], r["id"]) for r in index.top(["w1", "w40"], 5).collect()] == want


def test_search_tokens_look_for_cjk_runs_where_there_may_be_some(spark):
    from memoglyph.functions.text import search_tokens

    texts = ["Ab ab x. 中文字 é 中 a_b", "plain a.b/c plain", "é ok", "", None, "中文中文 中文"]
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "x string").select(search_tokens("x").alias("t")).collect()]
    assert got == [["ab", "x.", "a_b", "中文字"], ["plain", "a.b/c"], ["ok"], [], [], ["中文中文", "中文"]]
