"""Cuts of runs are the likeliest of all, and words without spaces are found again."""

import hashlib
import math
import random
from collections import Counter

from pyspark.sql import functions as F

from memoglyph.functions import segment as G

WORDS = {"研究": 30, "研究生": 8, "生命": 20, "命": 6, "起源": 9, "生": 5, "的": 90}


def brute(d, run):
    """The cheapest of all cuts, ties to longer words from the left on."""
    found = []
    for mask in range(1 << (len(run) - 1)):
        parts, start = [], 0
        for i in range(1, len(run) + 1):
            if i == len(run) or mask >> (i - 1) & 1:
                parts.append(run[start:i])
                start = i
        costs = [d.costs.get(p, d.unknown if len(p) == 1 else None) for p in parts]
        if None not in costs:
            found.append((sum(costs), [-len(p) for p in parts], parts))
    return min(found)[2]


def test_the_likeliest_of_all_cuts():
    d = G.Dictionary(WORDS)
    assert d.cut("研究生命的起源") == ["研究", "生命", "的", "起源"] == brute(d, "研究生命的起源")
    assert d.cut("") == [] and d.cut("甲乙") == ["甲", "乙"] and G.Dictionary({}).cut("研究") == ["研", "究"]
    assert abs(d.costs["的"] * G.STEP - math.log(sum(WORDS.values()) / 90)) < 1e-8
    rng = random.Random(5)
    for _ in range(300):
        letters = "甲乙丙"
        counts = {"".join(rng.choices(letters, k=rng.randint(1, 4))): rng.choice([1, 1, 2, 4, 8]) for _ in range(rng.randint(0, 12))}
        d = G.Dictionary(counts)
        run = "".join(rng.choices(letters + "丁", k=rng.randint(1, 9)))
        assert d.cut(run) == brute(d, run), (counts, run)


def test_a_long_run_stays_linear():
    d = G.Dictionary(WORDS)
    assert d.cut("研究生命的起源" * 30_000) == ["研究", "生命", "的", "起源"] * 30_000


def test_segmented(spark):
    d = G.dictionary(spark.createDataFrame([*WORDS.items(), ("研究", 1), (None, 5), ("", 5), ("起", 0), ("源", None)], "word string, n long"))
    assert d.costs == G.Dictionary(WORDS | {"研究": 31}).costs
    assert set(G.dictionary(spark.createDataFrame(list(WORDS.items()), "word string, n long"), 2).costs) == {"的", "研究"}
    df = spark.createDataFrame([(1, "Ada 研究生命, then 起源!"), (2, None), (3, ""), (4, "no such"), (5, "研究研究")], "id long, text string")
    rows = {r["id"]: r for r in G.segmented(df, d).withColumn("tokens", G.segmented_tokens(F.col("text"), F.col("words"))).collect()}
    assert {i: r["words"] for i, r in rows.items()} == {1: ["研究", "生命", "起源"], 2: [], 3: [], 4: [], 5: ["研究", "研究"]}
    assert rows[1]["tokens"] == ["研究", "生命", "起源", "ada", "then", "研究生命"] and rows[5]["tokens"] == ["研究", "研究研究"] and rows[2]["tokens"] == []
    assert G.segmented(df.limit(0), d).count() == 0
    # texts longer than a piece, in a batch with others
    long = spark.createDataFrame([(i, "研究生命" * (n // 4)) for i, n in enumerate([8, 3 * G.PIECE, 4, G.PIECE, 12])], "id long, text string").coalesce(1)
    assert [(r["id"], r["n"]) for r in G.segmented(long, d).select("id", F.size("words").alias("n")).collect()] == [(0, 4), (1, 3 * G.PIECE // 2), (2, 2), (3, G.PIECE // 2), (4, 6)]


def test_query_equals_brute_force(spark, tmp_path):
    from memoglyph.plans.catalog import load

    texts = {1: "cab cab, ab cabab", 2: None, 3: "", 4: "ab c-ab CAB"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r for r in load()[0]["segmented_words"](spark, str(tmp_path)).collect()}
    code = str.maketrans({c: chr(0x4E00 + i) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")})
    d = G.Dictionary({w.translate(code): n for w, n in {"cab": 3, "ab": 3, "cabab": 1}.items()})
    for i, given in {1: ["cab", "cab", "ab", "cabab"], 2: [], 3: [], 4: ["ab", "c", "ab", "cab"]}.items():
        words = brute(d, "".join(given).translate(code)) if given else []
        assert (found[i]["given"], found[i]["n"], found[i]["words"]) == (len(given), len(words), hashlib.md5(" ".join(words).encode()).hexdigest())


def test_words_are_found_without_a_dictionary(spark):
    rng = random.Random(2)
    letters = [chr(0x4E00 + i) for i in range(60)]
    rng.shuffle(letters)
    words = ["".join(letters.pop() for _ in range(k)) for k in [2, 3] * 12]
    texts = ["".join(rng.choices(words, k=20)) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None), (-2, "no run")], "id long, text string")
    found = G.found_words(df, longest=3)
    n = Counter(t[i : i + k] for t in texts for i in range(len(t)) for k in (1, 2, 3) if i + k <= len(t))
    total = sum(map(len, texts))
    lift = lambda w: min(n[w] * total / (n[w[:k]] * n[w[k:]]) for k in range(1, len(w)))
    assert {r["word"]: r["n"] for r in found.collect()} == {w: c for w, c in n.items() if len(w) > 1 and c >= 5 and lift(w) >= 8} and set(words) <= set(n)
    true = {i: set(_ends(_cut(t, words))) for i, t in enumerate(texts)}
    got = {r["id"]: set(_ends(r["words"])) for r in G.segmented(df.where("id >= 0"), G.dictionary(found)).collect()}
    assert sum(len(true[i] & got[i]) for i in true) / sum(len(true[i] | got[i]) for i in true) > 0.9
    assert G.found_words(df.where("id < 0")).count() == 0


def _cut(text, words):
    """A cut of a text into these words."""
    paths = {0: []}
    for i in range(len(text)):
        for w in words if i in paths else ():
            if text.startswith(w, i):
                paths.setdefault(i + len(w), paths[i] + [w])
    return paths[len(text)]


def _ends(words):
    ends, at = [], 0
    for w in words:
        at += len(w)
        ends.append(at)
    return ends
