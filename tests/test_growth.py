"""Work that must not grow beyond its input: texts are read once, groups stay small; results as by the plain form."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from memoglyph.functions import numeric as N, segment as G, text as X
from memoglyph.operators import embedding as E, search as S


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


ODD = [
    None, "", "   ", "abcd", " a  b ", "System: x", "  \n system:\tx", "x" * 70, " " * 400 + "Sender (a", " " * 400 + "abc", "a" + " " * 400 + "b c d", "x\n" * 300,
    "mail a.b@c.de and password=hunter2hunter2 1234-5678-9012-3456", "https://me:pw@host/?api_key=abcdefgh123 555-123-4567", "Bearer abcdefghijklmnopqrstuvwxyz 123-45-6789",
    "token: abcdefghijk, 555 123 4567", "a@b", "secret = 'abcdefgh9' x@y.zz  y", "éa@b.cd 12 345", "1234 5678 9012 3456 pass",
]


def test_redaction_passes_over_patterns_without_changing_results(spark):
    def plain(c):
        for name, pattern in X.REDACTIONS:
            c = F.regexp_replace(c, pattern, f"[REDACTED_{name}]")
        return c

    df = spark.createDataFrame(list(enumerate(ODD)), "id int, t string")
    spaced = X.normalize_spaces(plain(X.normalize_spaces("t")))
    clean = X.normalize_spaces("t")
    noise = (F.length(clean) < 5) | clean.rlike("(?i)^(" + "|".join(X.NOISE) + ")")
    rows = df.select("id", X.redact("t").alias("r"), plain(F.col("t")).alias("plain"), X.redact_spaced("t").alias("s"), spaced.alias("spaced"), X.is_noise("t").alias("n"), noise.alias("noise"), X.head("t", 7).alias("h"), F.substring(clean, 1, 7).alias("head")).collect()
    for r in rows:
        assert r["r"] == r["plain"] and r["s"] == r["spaced"] and r["n"] == r["noise"] and r["h"] == r["head"], r


def test_entries_redact_each_text_once(spark):
    df = spark.createDataFrame([("r1", "a title", "mail me at a@b.cd", "p")], "id string, title string, content string, project string")
    entries = S.entries_of(df)
    assert entries.first()["text"] == "a title mail me at [REDACTED_EMAIL] p"
    assert len(re.findall("REDACTED_EMAIL", _plan(entries))) == 2  # of the title and of the content


def test_hashed_embeddings_in_arrow_equal_those_by_columns(spark):
    texts = [*ODD, "Ärger 中文字符 ok", "\U0001f600 smile \U0001f600", "word " * 300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", X.hash_features("t").alias("features"))
    extra = spark.createDataFrame([(100, None), (101, []), (102, ["a", None, "bc"]), (103, [None])], "id int, features array<string>")
    for rows, size in ((df, 16), (extra, 16), (df, 384)):
        plain = {r["id"]: r["v"] for r in rows.select("id", N.hash_embedding(F.col("features"), X.fnv1a32, size).alias("v")).collect()}
        assert {r["id"]: r["embedding"] for r in N.hash_embeddings(rows, X.fnv1a32_each, size).collect()} == plain


def test_hash_embedding_query_takes_no_pass_for_each_dimension(spark):
    from memoglyph.plans.catalog import load

    found = load()[0]["hash_embedding"](spark, "/root/testdata/sf0.001")
    assert "aggregate(filter" not in _plan(found) and found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_fields_normalise_a_text_once(spark):
    df = spark.createDataFrame([("r1", " a  title", "x " * 4000, "p"), ("r2", None, " " * 9000 + "late", "p"), ("r3", "", "", "p")], "id string, title string, content string, project string")
    rows = {r["entry_id"]: r["text"] for r in E.fields(df).collect()}
    assert rows == {"r1": ("a title " + "x " * 4000)[:6000]}
    assert _plan(E.fields(df)).count("regexp_replace(coalesce(content") == 0


def test_fingerprints_read_the_head_of_a_text(spark):
    def plain(c):
        return F.slice(F.filter(F.split(F.lower(X.normalize_spaces(c)), X._FINGERPRINT_SPLIT), lambda w: F.length(w) >= 3), 1, 18)

    texts = [*ODD, "word " * 17, "word " * 18, "some words, and more. " * 400, "a b " * 3000 + "late tokens here", "x" * 5000 + " yes", "ΑΣ.βγδ " * 300, "ab " * 239 + "cd" + "efg " * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for r in df.select("id", X.fingerprint_tokens("t").alias("a"), plain(F.col("t")).alias("b")).collect():
        assert r["a"] == r["b"], r


def test_runs_cut_at_once_equal_runs_cut_one_by_one(monkeypatch):
    r = random.Random(1)
    letters = [chr(0x4E00 + i) for i in range(6)]
    for _ in range(40):
        words = {"".join(r.choice(letters) for _ in range(r.randint(1, 6))): r.randint(1, 50) for _ in range(r.randint(0, 40))}
        known = G.Dictionary(words)
        cutter = G.Cutter(known)
        chunk, begin = r.choice([(8, 2), (16, 8), (512, 64)])
        monkeypatch.setattr(G.Cutter, "CHUNK", chunk)
        monkeypatch.setattr(G.Cutter, "BEGIN", begin)
        monkeypatch.setattr(G, "PIECE", r.choice([50, 1000, 10**6]))
        texts = [r.choice([None, "", "x"]), *("".join(r.choice([*letters, " ", "x", chr(0x9F00)]) if r.random() < 0.9 else r.choice(letters) * 20 for _ in range(r.choice([3, 50, 400]))) for _ in range(6))]
        assert cutter.words(texts).to_pylist() == [[w for run in re.findall(f"[{G.RUN}]+", t or "") for w in known.cut(run)] for t in texts]


def test_counting_words_makes_them_once(spark):
    df = spark.createDataFrame([("一二 三四 x",), (None,), ("一二",)], "t string")
    counted = G.counted_words(df.select(F.filter(F.split(F.regexp_replace("t", "x", "y"), " "), lambda w: w != "").alias("words")))
    assert {r["word"]: r["n"] for r in counted.collect()} == {"一二": 2, "三四": 1} and _plan(counted).count("regexp_replace") == 1


def test_benchmark_pairs_are_dealt_by_number_of_sets(spark, monkeypatch):
    from memoglyph.plans import text_plans

    monkeypatch.setattr(text_plans, "SETS", 20)
    found = text_plans.jaccards(spark, "/root/testdata/sf0.001")
    assert found.where("overlap > 0").count() > 0
    n = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
    assert re.search(rf"RepartitionByExpression \[key#\d+\], {-(-n // 20)}\b", _plan(found))
