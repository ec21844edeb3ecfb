"""Search, lifecycle, graph, reports, streams and sources on small frames."""

import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from memoglyph.functions import text as X
from memoglyph.operators import entities as E, graph as G, lifecycle as L, reports as R, search as S
from memoglyph.schema import RECORD
from memoglyph.sources import jsonl, texts
from memoglyph.streaming import changes as M


def test_requests():
    r = S.SearchRequest.of("  a   b ", mode="X", limit=1000, diversity=3, scope=" User ", fusion="rrf")
    assert (r.query, r.mode, r.limit, r.diversity, r.filters, r.fusion) == ("a b", "hybrid", 100, 1.0, {"scope": "user"}, "rrf")


def test_bm25_prefers_matches(spark):
    rows = spark.createDataFrame([("a", ["red", "fox"]), ("b", ["red", "red", "dog"]), ("c", ["cat"]), ("d", [])], "id string, tokens array<string>")
    got = {r["id"]: r["score"] for r in S.bm25(rows, ["red"]).collect()}
    assert set(got) == {"a", "b"} and got["b"] > got["a"]
    assert S.bm25(rows, []).count() == 0 and S.bm25_okapi(rows, ["cat"]).collect()[0]["id"] == "c"
    assert S.keyword_overlap(rows, ["red"]).where("id = 'b'").first()["score"] == 2.0


def test_ranks_have_no_limit(spark):
    a = spark.range(0, 2600, 1, 7).select("id", (F.col("id") * 37 % 101 - 1.0).alias("score"))
    b = spark.range(0, 2600, 1, 3).select("id", (F.col("id") % 997 + 0.0).alias("score"))

    def ranks(df):
        return {i: r for r, (_, i) in enumerate(sorted((-r["score"], r["id"]) for r in df.collect() if r["score"] > 0), 1)}

    assert {r["id"]: r["rank"] for r in S.rank_map(a).collect()} == ranks(a)
    x, y = ranks(a), ranks(b)
    got = {r["id"]: r["score"] for r in S.fuse_rrf(a, b).collect()}
    assert got == {i: pytest.approx((1 / (60 + x[i]) if i in x else 0) + (1 / (60 + y[i]) if i in y else 0)) for i in x.keys() | y.keys()}


def test_mmr_differs(spark):
    rows = spark.createDataFrame([("q", 1, 1.0, [1.0, 0.0]), ("q", 2, 0.99, [1.0, 0.0]), ("q", 3, 0.8, [0.0, 1.0]), ("q", 4, 0.1, None)], "query string, id long, score double, embedding array<double>")
    assert [r["id"] for r in S.mmr(rows, 0.5, 3).orderBy("rank").collect()][:2] == [1, 3]
    assert [r["id"] for r in S.mmr(rows, 1.0, 4).orderBy("rank").collect()] == [1, 2, 3, 4]


def test_snippets(spark):
    rows = spark.createDataFrame([(1, "x" * 300 + " needle " + "y" * 300, "needle"), (2, None, None)], "id long, content string, title string")
    got = {r["id"]: r["snippets"] for r in S.snippets(rows, "needle", ["title", "content"], 80, 2).collect()}
    assert [s["field"] for s in got[1]] == ["title", "content"] and "needle" in got[1][1]["text"] and got[2] == []


def test_contract(spark):
    fine = dict(schemaVersion=2, id="1", tool="t", type="n", title="x", source="s", scope="user", memory_level="session")
    rows = spark.createDataFrame([json.dumps(fine), json.dumps(fine | {"scope": "team", "tier": 7, "content_hash": "z"}), json.dumps({})], "string").select(F.from_json("value", RECORD.replace(", _corrupt string", "")).alias("r")).select("r.*")
    got = [r["errors"] for r in L.contract_errors(rows).collect()]
    assert got[0] == [] and got[1] == ["unknown-scope:team", "invalid-tier:7", "invalid-content-hash:z"]
    assert got[2][0] == "unexpected-schema-version:missing" and got[2][-1].startswith("missing-fields:schemaVersion,id")


def test_overlapping_pairs_are_all(spark):
    r = random.Random(1)
    rows = [(i, [r.choice("abcdefghijkl") for _ in range(r.randint(0, 9))]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    got = L.overlapping_pairs(df).collect()
    sets = {i: frozenset(t) for i, t in rows}
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7}
    want |= {(first[s], i) for i, s in sets.items() if s and first[s] != i}
    assert {(x["a"], x["b"]) for x in got} == want


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(201, 200)]
    got = {r["id"]: r["component"] for r in L.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200
    assert L.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_archive_rules(spark):
    day, now = L.DAY_MS, 1_000 * L.DAY_MS
    rows = [("a", None, now - 2 * day, None, None, 0, 0, "user", False), ("b", 2, now - 40 * day, None, None, 0, 1, "task", False), ("c", 2, now - 40 * day, None, None, 0, 2, "task", False), ("d", 4, now - day, now, now - day, 3, 0, "user", False), ("e", 4, now - day, now, now - day, 3, 0, "feedback", False), ("f", 5, 0, None, None, 0, 0, "user", False)]
    df = spark.createDataFrame(rows, "id string, tier int, t_ms long, access_ms long, expires_ms long, access_count int, promotion_count int, scope string, archived boolean")
    got = {r["id"]: r["v"] for r in df.select("id", L.archive_reason(now).alias("v")).collect()}
    assert got == {"a": "tier1-expired", "b": "tier2-cold", "c": None, "d": None, "e": "tier4-ttl", "f": None}


def test_merge_is_idempotent(spark):
    base, patch = spark.createDataFrame([("a", ["x"])], "id string, facts array<string>"), spark.createDataFrame([("a", 1, ["x", "y"]), ("b", 1, ["z"])], "id string, seq int, facts array<string>")
    once = L.merge_patches(base, patch)
    assert {r["id"]: r["facts"] for r in once.collect()} == {r["id"]: r["facts"] for r in L.merge_patches(once, patch).collect()} == {"a": ["x", "y"], "b": ["z"]}
    assert L.snapshot_diff(base.select("id", F.lit("h").alias("hash")), base.select("id", F.lit("h").alias("hash"))).count() == 0
    assert L.should_consolidate("a", "a", 3, 50) == (False, "unchanged") and L.should_consolidate("a", "b", 3, 5)[1] == "too-few-records"
    with pytest.raises(ValueError):
        L.migrate(base, 3)


def test_graph_intervals(spark):
    t = spark.createDataFrame([("1", "a", "p", "b", "2024-01-01", "2024-06-01", 0.5), ("2", "a", "p", "c", None, None, 0.9)], "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double")
    assert t.where(G.valid_at("2024-06-01")).count() == 2 and t.where(G.current_at("2024-06-01")).count() == 1
    e = spark.createDataFrame([("a", "A", "person"), ("b", "B", "x"), ("c", "C", "x")], "id string, name string, type string")
    assert G.entity_edges(t, e, "a", "both").count() == 2 and G.entity_edges(t, e, "b", "incoming", "2025-01-01").count() == 0


def test_reports_of_names(spark):
    df = lambda t: spark.createDataFrame([("1", t)], "id string, content string")
    got = {(r["subject"], r["predicate"], r["object"]) for r in E.relations(df("Ada is the author of Engine, which uses Cards. Bob told Ada; the engine runs on steam")).collect()}
    assert got == {("Ada", "ada_is_author_of", "Engine, which uses Cards. Bob told Ada; the engine runs on steam"), ("which", "which_uses_cards", "Cards"), ("Bob", "bob_told_ada", "Ada"), ("engine", "engine_runs_on_steam", "steam")} - {("which", "which_uses_cards", "Cards")} or ("Bob", "bob_told_ada", "Ada") in got
    names = {r["name"]: r["frequency"] for r in E.candidates(df("NodeJS and Open AI. Open AI v2, NodeJS. 王小明说 hello 张三问 foo.py The Thing")).collect()}
    assert names["NodeJS"] == 2 and names["Open AI"] == 2 and names["Open"] == 2 and names["AI"] == 3 and names["王小明"] == 1 and names["张三"] == 1 and names["foo"] == 1
    assert "The" not in names and "Thing" not in names and "The Thing" not in names
    assert not E.candidates(df("Ada said")).collect()
    typed = {r["name"]: r["type"] for r in E.score_types(df("Ada said hello to Bob. We deploy Engine v2. Recursion means itself; Nothing else, Quux.")).collect()}
    assert typed["Ada"] == "person" and typed["Engine"] == "project" and typed["Recursion"] == "concept" and typed["Quux"] == "uncertain"
    assert {r["pronoun"]: r["name"] for r in E.resolve_pronouns(df("Ada came home. Then she slept well.")).collect()} == {"she": "Ada", "he": "Ada"}
    one = E.extract(df("Ada said hello. Bob told Ada everything.")).first()
    assert one["facts"][0] == "Ada is a person" and "Bob → bob_told_ada → Ada" in one["facts"]
    rows = spark.createDataFrame([("1", "Ada said hello.", [], [], False), ("2", "nothing here at all", ["x"], [], False), ("3", "Bob said hello.", ["y"], [], True)], "id string, content string, facts array<string>, concepts array<string>, extracted boolean")
    got = {r["id"]: (r["facts"], r["extracted"]) for r in E.backfill(rows).collect()}
    assert got == {"1": (["Ada is a person"], True), "2": (["x"], False), "3": (["y"], True)}


def test_names_against_the_rules_one_by_one():
    """Types and pronouns by a regular expression for each rule and name, as the rules are written."""
    r = random.Random(4)
    words = ["Ada", "Bob", "Engine", "said", "told", "built", "deploy", "with", "hi", "the", "system", "v2", "is a", "means", "she", "it", ".", "-core", "Ada.py", "- Bob", "installed", "uses", "'Bob' said"]

    def evidence(name, text):
        n = re.escape(name)
        count = lambda p: len(re.findall(p, text, re.I | re.A))
        each = lambda ps: sum(2 * count(p.replace("{name}", n, 1)) for p in ps)
        person = each(E.PERSON) + each(E.CHINESE_PERSON) + 3 * count(rf"\b(hey|hi|hello|dear|thanks)\s+{n}\b") + 2 * count(rf"[\"']{n}[\"']\s*,?\s*(said|told|asked|replied|whispered)")
        project = each(E.PROJECT) + each(E.CHINESE_PROJECT) + 3 * count(rf"\b{n}[-v]\w+") + 3 * count(rf"\b{n}\.(py|js|ts|go|rs|java|cpp|c|h|css|html|json|yaml|yml|toml|sh|md)\b")
        listed = count(rf"[-*]\s*{n}\b")
        return person, project, 4 * count(rf"\b({n})\s+(?:is\s+(?:a|an|the)\s+\w+|means|refers\s+to|describes|represents|defines?)\b") + (listed if listed >= 2 else 0)

    def pronouns(text, names):
        ends = [i for i, c in enumerate(text) if c in ".。!！?"]
        parts = [p for p in re.split("[.。!！?]", text) if len(p.strip()) > 5]
        out = {}
        for pronoun in E.PRONOUNS:
            at = text.find(pronoun)
            while at >= 0:
                k = sum(e < at for e in ends)
                window = " ".join(parts[max(0, k - 2) : min(len(parts) - 1, k + 2) + 1])
                best, most = None, 0
                for n in names:
                    c = len(re.findall(re.escape(n), window, re.I))
                    if c > most:
                        best, most = n, c
                if best:
                    out[pronoun] = best
                at = text.find(pronoun, at + len(pronoun))
        return out

    for _ in range(300):
        text = re.sub(r"\s+", " ", " ".join(r.choice(words) for _ in range(r.randint(3, 40)))).strip()
        names = E.names_of(text)
        known = E.Evidence(text)
        for name in names:
            assert known.of(name) == evidence(name, text), (name, text)
        assert E.antecedents(text, names) == pronouns(text, names), text


def test_time_of_names_grows_with_the_text():
    """Eight thousand names, each beside something that rules name: a pass over the text for each of them took over a minute."""
    import time

    names = ["N" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) + "x" for i in range(8000)]
    text = " ".join(f"{n}. {n}, it is by {n} and {n}.py" for n in names)
    assert len(E.names_of(text)) == 8000
    began = time.process_time()
    typed = {n: (t, k) for n, t, _, k in E.typed_names(text)}
    assert time.process_time() - began < 15
    assert all(typed[n] == ("project", 5) for n in names)
    few, many = (dict.fromkeys(names[: E.FEW + i], 1) for i in (-10, 10))
    text = "Naaax came. It is here. Nbaax saw it, Nbaax."
    assert E.antecedents(text, few) == E.antecedents(text, many) and E.antecedents(text, many)["it"] == "Nbaax"


def test_relations_of_long_runs(spark):
    """Subjects as the plain patterns find them; a run without spaces is read once (40,000 characters took 40,000 ** 2 / 2 steps)."""
    import time

    r = random.Random(3)
    words = ["Ada", "is", "the", "owner", "of", "a", "uses", "told", "Bob,", ",Eve", "Engine;x", "calls", "runs", "owns", "is the x of", "works on"]
    texts = [" ".join(r.choice(words) for _ in range(30)) for _ in range(60)]
    got = sorted((x["id"], x["subject"], x["object"]) for x in E.relations(spark.createDataFrame(list(enumerate(texts)), "id int, content string")).collect())
    cut = lambda x: re.sub("[.,;!?。，；]+$", "", x.strip(" "))
    found = ((i, cut(m[1]), cut(m[3 if end else 2])) for i, t in enumerate(texts) for p, _, end in E.RELATIONS for m in re.finditer("(?i)" + p, t))
    assert got == sorted(x for x in found if min(map(len, x[1:])) >= 3 and not {x[1].lower(), x[2].lower()} & set(E.STOPWORDS))
    long = [(i, "Ada uses Engine " + "x" * 40_000 + " runs owns built told ") for i in range(20)]
    rows = spark.createDataFrame(long, "id int, content string").repartition(4)
    rows.count()
    began = time.perf_counter()
    assert E.relations(rows).count() >= 20
    assert time.perf_counter() - began < 40


def test_snippet_windows():
    text = "x" * 300 + " İstanbul Needle here " + "y" * 300
    one = S.snippets_of([("title", ""), ("content", text)], ["needle"], 100, 1)[0]
    assert one["match"] == "Needle" and text[one["start"] : one["end"]].count("Needle") == 1 and one["text"].startswith("…") and one["text"].endswith("…") and one["end"] - one["start"] == 100
    assert S.window_of("abc def", 4, 7, 80) == ("abc def", 0, 7)
    cut, a, b = S.window_of("z" * 200, 0, 5, 80)
    assert (a, b) == (0, 80) and cut == "z" * 80 + "…"
    assert [s["match"] for s in S.snippets_of([("content", ("aa " + "b" * 200 + " ") * 9)], ["aa"], 80, 3)] == ["aa"] * 3


def test_reports(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)], "v double")
    r = R.latency(df, "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r["p50"], r["p95"], r["n"]) == (51.0, 96.0, 100)
    assert [x["n"] for x in R.cumulative_histogram(df, "v", [10, 50]).collect()] == [10, 50, 100]


def test_pages_hold_every_record(spark):
    df = spark.range(0, 2801, 1, 7).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("scope"), F.format_string("r%05d", "id").alias("id"), F.lit("t").alias("title"))
    got = {(r["scope"], r["part"]): r["page"] for r in R.markdown_pages(df, "scope").collect()}
    assert sorted(got) == [("a", i) for i in range(1, 6)] + [("b", 1), ("b", 2)]
    for key in "ab":
        want = [f"- [t](r{i:05d}.md)" for i in range(2801) if (i % 4 == 0) == (key == "b")]
        assert [line for k in sorted(got) if k[0] == key for line in got[k].split("\n")[2:]] == want
    assert got["a", 1].startswith("# a\n\n- [") and got["a", 2].startswith("# a (2)\n\n- [")


def test_breaker(spark):
    """The first success of a half-open breaker closes it, a failure there opens it, and a slow call opens a closed one."""
    def run(calls):
        rows = spark.createDataFrame([("s", i, *c) for i, c in enumerate(calls)], "service string, seq long, ts_s long, ok boolean, seconds double")
        return [(r["state"], r["allowed"]) for r in M.breaker(rows).orderBy("seq").collect()]

    fail = [(i, False, 0.0) for i in range(5)]
    assert run([*fail, (10, True, 0.0), (34, True, 0.0), (35, False, 0.0)]) == [("closed", True)] * 4 + [("open", True), ("open", False), ("closed", True), ("closed", True)]
    assert run([*fail, (40, False, 0.0), (45, True, 0.0), (70, True, 0.0)])[5:] == [("open", True), ("open", False), ("closed", True)]
    assert run([(0, True, 1.0), (1, True, 6.0), (20, True, 0.0), (37, True, 0.0)]) == [("closed", True), ("open", True), ("open", False), ("closed", True)]


def test_change_stream_is_its_batch_twin(spark, tmp_path):
    rows = [("s", f"e{i % 3}", i, f"h{i // 4 % 3}", "upsert") for i in range(60)]
    schema = "source string, entry_id string, lsn long, digest string, op string"
    df = spark.createDataFrame(rows, schema)
    df.repartition(1).write.json(str(tmp_path / "in"))
    got = []
    stream = M.collapse_stream(spark.readStream.schema(schema).json(str(tmp_path / "in")))
    M.run_once(stream, lambda b: got.extend(b.select("lsn").collect()), str(tmp_path / "c"))
    assert {r["lsn"] for r in got} == {r["lsn"] for r in M.collapse(df).collect()}
    n = len(got)
    M.run_once(M.collapse_stream(spark.readStream.schema(schema).json(str(tmp_path / "in"))), lambda b: got.extend(b.select("lsn").collect()), str(tmp_path / "c"))
    assert len(got) == n  # nothing is applied twice


def test_repeat_suppression(spark, tmp_path):
    spark.sql("SELECT * FROM VALUES ('a', timestamp'2024-01-01 00:00:00'), ('a', timestamp'2024-01-01 00:00:10'), ('b', timestamp'2024-01-01 00:00:11') t(k, ts)").write.parquet(str(tmp_path / "p"))
    q = M.suppress_repeats(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "p")), "k", "ts").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"1","title":"first"}\nnot json\n{"id":"2","title":"x"}\n')
    (tmp_path / "b.jsonl").write_text('{"id":"1","title":"second"}\n{"id":"3"}\n')
    paths = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl")]
    assert jsonl.read(spark, paths[0]).count() == 2 and jsonl.read(spark, paths[0], keep_malformed=True).count() == 3
    assert {r["layer_file"]: r["n"] for r in jsonl.malformed(spark, paths).collect()} == {"a.jsonl": 1, "b.jsonl": 0}
    assert jsonl.layers(spark, paths).where("id = '1'").first()["title"] == "first" and jsonl.layers(spark, paths, last_wins=True).where("id = '1'").first()["title"] == "second"
    rows = jsonl.layers(spark, paths)
    assert [r["id"] for r in jsonl.in_order(rows, ["3", "9", "1"]).collect()] == ["3", "1"]
    assert jsonl.prefix(rows, "1").count() == jsonl.point(rows, "1").count() == 1
    out = str(tmp_path / "out")
    jsonl.append_new(rows.select("id", "title"), out)
    jsonl.append_new(rows.select("id", "title"), out)
    assert spark.read.json(out).count() == 3
    jsonl.remove(spark, paths[0], str(tmp_path / 'kept'), F.col('id') == '2')
    assert sorted(r['value'] for r in spark.read.text(str(tmp_path / 'kept')).collect()) == ['not json', '{"id":"1","title":"first"}']
    jsonl.snapshot(rows.select("id"), str(tmp_path / "snap"))
    assert spark.read.json(str(tmp_path / "snap")).count() == 3
    jsonl.daily_logs(spark.createDataFrame([("1", "2024-01-02T00:00:00Z"), ("2", "2024-01-03T00:00:00Z")], "id string, t string"), str(tmp_path / "logs"), days=["2024-01-02"])
    assert spark.read.json(str(tmp_path / "logs")).count() == 1
    assert jsonl.in_batches(rows.select("id"), lambda f: f.assign(n=len(f)), "id string, n long", 2).count() == 3


def test_texts(spark, tmp_path):
    lines = spark.createDataFrame([("- [2024-01-01] [p] hello",), ("- [2024-01-02] bye",), ("noise",)], "value string")
    assert [tuple(r) for r in texts.inbox(lines).collect()] == [("2024-01-01", "p", "hello"), ("2024-01-02", None, "bye")]
    one = spark.createDataFrame([("intro\n# A\nbody a\n# B\nbody b",)], "t string")
    assert one.select(texts.section(F.col("t"), "A").alias("v")).first()["v"] == "body a"
    put = one.select(texts.upsert_section(F.col("t"), "s", F.lit("new")).alias("t"))
    again = put.select(texts.upsert_section(F.col("t"), "s", F.lit("newer")).alias("v")).first()["v"]
    assert again.count("<!-- s:start -->") == 1 and "newer" in again and "\nnew\n" not in again
    (tmp_path / "m.md").write_text("top\n@include n.md\nend\n")
    (tmp_path / "n.md").write_text("inner\n@include m.md\n")
    assert "inner" in texts.expand_includes(spark, str(tmp_path / "m.md"))
    cut = texts.slice_transcripts(spark.createDataFrame([(1, i, f"sentence {i} of many words.") for i in range(60)], "session long, turn long, text string"), 20, 20).first()
    assert cut["head"].startswith("sentence 0") and cut["tail"].endswith("words.") and len(cut["head"]) <= 81
    vectors = texts.embed_with(spark.createDataFrame([("1", "a"), ("2", "bb")], "id string, text string"), lambda ts: [[len(t)] for t in ts])
    assert {r["id"]: r["embedding"] for r in vectors.collect()} == {"1": [1.0], "2": [2.0]}


def test_key_is_order_free_and_symmetric(spark):
    from memoglyph.functions.numeric import jaccard

    r = random.Random(3)
    rows = [([r.choice("abcd") for _ in range(r.randint(0, 5))], [r.choice("abcd") for _ in range(r.randint(0, 5))]) for _ in range(50)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    assert df.where(jaccard(F.col("a"), F.col("b")) != jaccard(F.col("b"), F.col("a"))).count() == 0
    assert df.select(X.similarity_key(F.lit("p"), F.lit("s"), F.lit("Ab, cde!")).alias("k")).distinct().count() == 1


def test_stop_words_are_looked_up_as_a_set(spark):
    """The list of over 300 stop words isn't walked for each capitalised word; texts without what a pattern needs aren't searched for it."""
    found = E.candidates(spark.createDataFrame([("1", "The Ada and Thing with Bob of Engine v")], "id string, content string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in plan and "Contains(" in plan
    assert {r["name"] for r in found.collect()} == {"Ada", "Bob", "Engine"}
