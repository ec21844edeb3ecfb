"""The corpus pipeline as a whole, on odd and on empty tables, stage by stage against plain versions."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memoglyph.llm import quality, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, n_tokens string, ids string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


def text(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 50)) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows = [(i, text(i), "en", "abc"[i % 3]) for i in range(60)] + [(100 + i, text(1) + (" more" if i % 2 else ""), "en", "a") for i in range(12)]
    rows += [(200 + i, ("you stupid idiot " + text(900 + i, 20)), "en", "b") for i in range(12)] + [(300 + i, "click here buy now " * 12, "en", "c") for i in range(12)]
    rows += [(400, None, "en", "a"), (401, "", None, None), (402, " \n\t", "en", "a"), (None, text(77), "en", "a"), (403, text(99, 20_000), "en", "b"), (5, text(5), "en", "c"), (404, "short one", "en", None)]
    spark.createDataFrame([(i, t, lang, s, None, "s", "n", "i") for i, t, lang, s in rows], DOCS).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int(not 300 <= (i or 0) < 312), int(200 <= (i or 0) < 212)) for i, *_ in rows] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages_and_whole(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, after = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.checkpointed(stage(spark, docs, folder))
        after[name] = docs.collect()
        if name == "toxicity":
            grammar = toxicity.fit(before, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"))
            want = toxicity.score(before, grammar, out="_s").where(F.col("_s") < toxicity.TOXIC_FROM)
        elif name == "quality":
            model = quality.fit(before, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality"))
            want = quality.score(before, model, out="_s").where(F.col("_s") >= quality.GOOD_FROM)
        else:
            want = None
        if want is not None:
            assert sorted(map(repr, after[name])) == sorted(map(repr, want.drop("_s").collect()))
        if name != "bpe":
            assert docs.columns == columns
    kept, sets = after["quality"], [shingles(r["text"]) for r in after["quality"]]
    group = list(range(len(kept)))
    for i in range(len(kept)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    one = collections.Counter(group[next(k for k, o in enumerate(kept) if repr(o) == repr(r))] for r in after["near_dedup"])
    assert set(one) == set(group) and set(one.values()) == {1}  # one row of each group
    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = collections.Counter((r["doc_id"], r["text"]) for r in after["mixing"])
    whole = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(repr, whole)) == sorted(map(repr, after["bpe"]))
    ids = collections.Counter((r["doc_id"], tuple(r["ids"])) for r in whole)
    assert ids == collections.Counter({(i, tuple(known.encode(t, add_special_tokens=False).ids)): n for (i, t), n in texts.items()})


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_an_arrow_batch_is_a_few_megabytes(spark):
    """Of 3000 texts of 10,000 characters a task never holds all."""
    import pyarrow as pa
    from pyspark.sql import functions as F, types as T

    from memoglyph.llm.common import arrow_columns

    docs = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    make = lambda: lambda texts: [pa.array([sum(b.size for b in texts.buffers() if b is not None)] * len(texts), pa.int64())]
    found = arrow_columns(docs, ["text"], [T.StructField("held", T.LongType())], make, ["id"]).agg(F.count("*").alias("n"), F.max("held").alias("held")).first()
    assert found["n"] == 3000 and found["held"] < (8 << 20)


def test_a_fit_leaves_the_driver_small(spark, folder):
    """The driver's Python holds neither a large sample's hashes at once nor, after a fit, what they came from."""
    import tracemalloc

    from memoglyph.llm import common

    texts = [" ".join(f"word{i}of{k}" for k in range(1000)) for i in [*range(300), 3]]
    tracemalloc.start()
    try:
        first = toxicity.families(texts)
        held = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert first.tolist() == list(range(300)) and held < (60 << 20)
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    common._powers("up", 10)
    toxicity.fit(docs, labels.select("doc_id", "toxic"))
    assert not common._POWERS
    common._powers("up", 10)
    quality.fit(docs, labels.select("doc_id", "quality"))
    assert not common._POWERS


def test_a_star_reads_its_pairs_once(spark):
    """Components of chains and a star, in stages that have no more tasks than the pairs and the shuffles have partitions."""
    from memoglyph.llm import near_dedup

    edges = [(i, i + 1) for i in range(40) if i % 8 != 7] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    pairs, sc, key = spark.createDataFrame(edges, "a long, b long").repartition(4), spark.sparkContext, "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    sc.setJobGroup("stars", "components")
    try:
        found = near_dedup.components(pairs)
    finally:
        sc._jsc.sc().clearJobGroup()
        spark.conf.unset(key)
    assert {r["node"]: r["component"] for r in found.collect()} == {i: i - i % 8 for i in range(40)} | {100 + i: 100 for i in range(30)}
    tracker = sc.statusTracker()
    stages = {i for j in tracker.getJobIdsForGroup("stars") for i in tracker.getJobInfo(j).stageIds}
    assert max(s.numTasks for i in stages if (s := tracker.getStageInfo(i))) <= 4
