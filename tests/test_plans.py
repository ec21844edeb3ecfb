"""The registry: every query has a stable schema, and a sample of them equals its SQL on the smallest tables."""

import math
from pathlib import Path

import pytest

import __spark_entry__
from memoglyph.plans.catalog import load

SF = "/root/testdata/sf0.001"
SAMPLE = ["bm25_topk", "bm25_okapi", "rrf_fusion", "redaction", "promotion_score", "jaccard_conflicts", "tier_evict", "consolidation", "kg_timeline", "counts_grouping_sets", "p95_by_index", "snapshot_diff", "agent_sections", "hybrid_search", "rank_map", "entity_candidates", "entity_relations", "handoff_pack", "circuit_breaker", "drift_risk", "expected_pairs", "markdown_pages", "kg_asof_times", "kg_path_match", "bm25_index", "entry_index", "graph_neighbours", "hybrid_search_graph", "weighted_fusion", "dual_projection", "transcript_slices", "external_records", "external_by_project", "pruned_lookup", "signal_lines", "signal_items", "clean_inbox", "embedding_fields", "embedding_changes", "embedding_build", "layer_build", "dictionary_words", "editor_sessions"]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def test_every_sql_has_a_query():
    queries, sql = load()
    assert len(queries) > 150 and set(sql) <= set(queries)
    assert set(queries) <= set(__spark_entry__.queries()) and set(sql) <= set(__spark_entry__.oracle_sql())


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", [n if n in SAMPLE else pytest.param(n, marks=pytest.mark.slow) for n in sorted(load()[1])])
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    queries, sql = load()
    df = queries[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for table in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    cursor = con.execute(sql[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(norm(r[names.index(c)]) for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect()) == want


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    """Tables whose texts have what counts past their first 600 characters."""
    d = tmp_path_factory.mktemp("small")
    long = "lorem ipsum " * 50
    docs = [(1, long + 'Ada said hello. Ada works on Engine. mail ada@mail.example.org password="secret99" end', "en", "web"), (2, "nothing", "en", "web"), (3, "gamma delta epsilon zeta", "en", "web")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(5, "unrelated words here"), (6, "gamma delta epsilon zeta"), (7, "gamma delta other thing"), (8, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    turns = [(1, 0, "user", "a whole text that isn't noise"), (2, 0, "user", "A new session was started just now"), (40, 1, "user", "ok"), (80, 1, "user", "nothing: exec completed is in here"), (5, 1, "user", "Run your Session Startup"), (3, 1, "user", None)]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return str(d)


def test_entities_of_whole_texts(spark, small):
    queries, _ = load()
    assert [(r["name"], r["type"], r["frequency"]) for r in queries["entity_types"](spark, small).where("id = 'r1' AND name = 'Ada'").collect()] == [("Ada", "person", 2)]
    assert [(r["id"], r["subject"], r["predicate"], r["object"]) for r in queries["entity_relations"](spark, small).collect()] == [("r1", "Ada", "ada_works_on_engine", "Engine")]


def test_redaction_of_whole_records(spark, small):
    queries, _ = load()
    content = queries["redact_record"](spark, small).where("doc_id = 1").first()["content"]
    assert "ada@mail" not in content and "[REDACTED_" in content and content.endswith(" end")
    text = queries["redaction_outbound"](spark, small).where("doc_id = 1").first()["text"]
    assert "secret99" not in text and "password=[REDACTED] end" in text


def test_noise_of_whole_texts(spark, small):
    queries, _ = load()
    assert sorted(tuple(r) for r in queries["noise_filter"](spark, small).select("turn", "n", "noise").collect()) == [(0, 2, 1), (1, 4, 3)]


def test_overlap_with_all_benchmark_items(spark, small):
    queries, _ = load()
    got = {r["doc_id"]: (r["item_id"], r["overlap"]) for r in queries["jaccard_to_benchmark"](spark, small).collect()}
    assert got == {1: (None, 0.0), 2: (None, 0.0), 3: (6, 1.0)}


def test_entry_has_rows(spark):
    if not Path(SF).exists():
        pytest.skip("needs the driver's tables")
    assert __spark_entry__.entry(spark).count() > 0


def test_hash_features_equal_sql_on_odd_texts(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    queries, sql = load()
    texts = [None, "", " ", "a", "É.", "où", "!!", "世界", "abc世界人 def", " abc　", "   ab cd", "\x0babc\x0bdef\x0b", "ΑΣ. ΒΣ", "İstanbul İ", "a\tb\n", "éa" * 300, "👍🏽 ok"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r["doc_id"]: r["digest"] for r in queries["hash_features"](spark, str(tmp_path)).collect()} == dict(con.execute(sql["hash_features"]).fetchall())
