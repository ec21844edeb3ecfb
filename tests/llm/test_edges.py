"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns of every operator."""

import hashlib
import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoglyph.llm import bpe, html_text, langid, mixing, near_dedup, quality, sharding, toxicity, vectors
from memoglyph.llm.common import logistic, pieces, sigmoid, string_buffers, word_hashes

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, n_tokens string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 30)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 0.5, "big", "x") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, text(i), "en", "a") for i in range(8)]
    rows += [(8, text(1), "en", "a"), (9, text(1) + " extra", None, None), (10, None, "en", "b"), (11, "", None, "b"), (12, " \t\n", "en", None), (13, "one two", "en", "c"), (14, "ONE TWO", "en", "c"), (None, "no id here at all", "en", "c"), (15, text(99, 30_000), "en", "a"), (3, text(3), "en", "a")]
    return docs(spark, rows)


def test_bpe_matches_library(spark, odd):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bpe.encode(odd, decoded="decoded", digests=True).collect()
    assert len(got) == odd.count()
    for row in got:
        want = known.encode(row["text"] or "", add_special_tokens=False)
        assert row["ids"] == want.ids and row["n_tokens"] == len(want.ids)
        assert row["decoded"] == known.decode(want.ids, skip_special_tokens=False)
        assert row["ids_sha256"] == hashlib.sha256(" ".join(map(str, want.ids)).encode()).hexdigest()
    assert got[0]["score"] == 0.5  # other columns stay


def test_bpe_round_trip_of_odd_texts():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    known, own = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), bpe.WordBpe(json.loads(bpe.load()))
    r = random.Random(5)
    letters = [*"abcdefghist'.,!? \n\t0123456789", "é", "Σ", "ς", "İ", "中", "文", "😀", "\x1c", "\x85", "́", "<|endoftext|>", "'s", "'ll"]
    for _ in range(3000):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert own.encode(t) == known.encode(t, add_special_tokens=False).ids
    assert own.encode("a" * 5000) == known.encode("a" * 5000, add_special_tokens=False).ids


def brute(rows, size, percent):
    def shingles(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\n", " ").replace("\t", " ").split(" ")
        w = [x for x in w if x]
        return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(2)
    rows = [(10_000, None), (10_001, ""), (10_002, " "), (10_003, "a b"), (10_004, "A  B"), (10_005, "a")]
    for g in range(6):
        base = text(g, 60).split()
        for k in range(12):
            own = list(base)
            for _ in range(r.randint(0, 4)):
                own[r.randrange(len(own))] = f"new{r.random()}"
            rows.append((100 * g + k, " ".join(own)))
    rows.append(rows[-1])
    df = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, n_shingles int, registers binary")
    sets, root = brute(rows, 3, 85)
    smallest = {}
    for (i, _), k in zip(rows, root, strict=True):
        smallest[k] = min(i, smallest.get(k, i))
    want = sorted((i, len(s), smallest[k], i == smallest[k]) for (i, _), s, k in zip(rows, sets, root, strict=True))
    got = near_dedup.near_duplicates(df, 3, 85)
    assert sorted((x["doc_id"], x["n_shingles"], x["component_id"], x["kept"]) for x in got.collect()) == want
    one = near_dedup.without_near_duplicates(df, 3, 85)
    assert one.columns == df.columns and one.count() == len(set(root))
    assert {x["text"] for x in one.where("doc_id in (10000, 10001)").collect()} == {None, ""}


def test_near_duplicates_of_nothing(spark):
    empty = docs(spark, [])
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.without_near_duplicates(docs(spark, [(1, None, "en", "a")])).count() == 1


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(0)
    a, b = (np.unique(r.integers(0, 1 << 63, 4000, dtype=np.uint64)) for _ in range(2))
    both = near_dedup.registers([a, b, np.union1d(a, b)])
    assert (both[2] == np.maximum(both[0], both[1])).all()
    c = np.union1d(a[:3800], b[:200])
    x, y = near_dedup.registers([a, np.unique(c)])
    alike = (x == y).mean()
    assert abs(alike - 3800 / 4200) < 0.12
    assert near_dedup.likely(np.array([(x > y).sum()]), np.array([(x < y).sum()]), len(x), np.array([4000.0]), np.array([4000.0]), 0.85)[0]
    p, q = both[0], both[1]
    assert not near_dedup.likely(np.array([(p > q).sum()]), np.array([(p < q).sum()]), len(p), np.array([4000.0]), np.array([4000.0]), 0.85)[0]
    assert near_dedup.banding(0.85) == (25, 5)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_quality_and_toxicity_learn_and_survive(spark, odd):
    bad = [(1000 + i, "$$$ ### &&& " * 20, "en", "a") for i in range(60)]
    good = [(2000 + i, text(i + 500), "en", "a") for i in range(60)]
    insults = [(3000 + i, text(i + 700) + " you stupid grobnak idiot. " + text(i), "en", "a") for i in range(60)]
    train = docs(spark, bad + good + insults)
    y = labels(spark, [(i, 0, 0) for i, *_ in bad] + [(i, 1, 0) for i, *_ in good] + [(i, 1, 1) for i, *_ in insults] + [(None, 1, 1), (5, None, None)])
    all_docs = train.unionByName(odd)
    q = {r["doc_id"]: r for r in quality.score(all_docs, quality.fit(train, y)).collect() if r["doc_id"] is not None}
    assert all(0 <= r["score"] <= 1 for r in q.values()) and len(q[2000]) == len(all_docs.columns)
    assert np.mean([q[i]["score"] for i, *_ in good]) > 0.7 > np.mean([q[i]["score"] for i, *_ in bad])
    t = {r["doc_id"]: r["score"] for r in toxicity.score(all_docs, toxicity.fit(train, y), keep=["doc_id"]).collect() if r["doc_id"] is not None}
    assert np.mean([t[i] for i, *_ in insults]) > 0.3 > max(t[i] for i, *_ in good)
    for model, scorer in ((quality.fit(train, labels(spark, [])), quality.score), (toxicity.fit(train, labels(spark, [])), toxicity.score)):
        assert scorer(odd, model).count() == odd.count()
    assert quality.score(docs(spark, []), quality.fit(train, y)).count() == 0


def test_grammar_states():
    g = toxicity.Grammar({"idiot": 2.0, "kill": 1.0}, {"grobn": 3.0}).opened()
    state = lambda t: [s for found in g.clauses(t).values() for s, _, _ in found]
    assert state("you are an idiot") == ["target"]
    assert state("he is not an idiot") == ["negated"]
    assert state("they said idiot") == ["reported"]
    assert state('the word "idiot" is rude') == ["reported"]
    assert state("i will kill it") == ["threat"]
    assert state("idiotic") == [] and state("a grobnak") == ["plain"] and state("") == []
    assert state("you are not. an idiot") == ["plain"] and state("i will kill you") == ["threat"] and state("they kill") == ["plain"]
    assert state("an idiot and a grobnak") == ["chain"] * 2 and state("you'll be an idiot, you") == ["threat"]


@pytest.mark.parametrize(("text", "states"), [
    ("no, you idiot", ["target"]), ("no you idiot", ["negated"]), ("not an idiot, you idiot", ["negated", "target"]), ("you idiot, no", ["target"]), ("not, an idiot", ["plain"]),
    ("never, ever, you idiot", ["target"]), ("you are not an idiot", ["negated"]), ("you, sir, are not an idiot", ["negated"]), ("no no, idiot, no idiot", ["plain", "negated"]), ("no one, two, not idiot", ["negated"]),
    ("don't, you idiot", ["target"]), ("i will not, ever, kill you", ["threat"]), ("i will not kill you", ["negated"]), ("he said no, you idiot", ["reported"]), ('"no, you idiot"', ["reported"]), ("nein, nicht, du idiot", ["target"]),
])
def test_a_comma_ends_a_negation(text, states):
    g = toxicity.Grammar({"idiot": 2.0, "kill": 1.0}, {}).opened()
    assert [s for found in g.clauses(text).values() for s, _, _ in found] == states


def test_mixing(spark, odd):
    mixed = mixing.mix(odd).select("doc_id", "source", "size", "source_size", "target", "taken")
    rows = mixed.collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(odd).select("doc_id", "source", "size", "source_size", "target", "taken").collect()))
    assert mixing.mix(docs(spark, [])).count() == 0
    assert mixing.taken_rows(mixing.mix(odd)).agg(F.sum("size")).first()[0] == sum(r["taken"] for r in rows)
    t = mixing.targets([("a", 100), ("b", 100), (None, 1000)])
    assert t == {"a": 200.0, "b": 300.0, None: 700.0} or abs(sum(t.values()) - 1200) < 1e-9
    assert mixing.targets([("a", 1), ("b", 1000)])["a"] == 3.0 and mixing.targets([("a", 0)]) == {"a": 0.0}


def test_mixing_comes_near_its_targets(spark):
    rows = [(i, text(i, 5 + i % 40), "en", "big" if i % 3 else f"s{i % 7}") for i in range(1500)]
    got = mixing.mix(docs(spark, rows)).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] - r["target"]) <= 23 for r in got)


def test_language(spark, odd):
    rows = [(200 + i, text(i), "xx", "a") for i in range(60)] + [(300 + i, " ".join("уфыва"[(i + k) % 5] * 3 for k in range(30)), "yy", "a") for i in range(60)]
    model = langid.fit(docs(spark, rows))
    got = {r["doc_id"]: r for r in langid.predict(docs(spark, rows).unionByName(odd), model).collect() if r["doc_id"] is not None}
    assert np.mean([got[i]["lang_pred"] == lang for i, _, lang, _ in rows]) == 1.0
    for i in (10, 11, 12):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert langid.fit(docs(spark, [(1, "a", None, "a")])) is None
    assert {r["lang_pred"] for r in langid.predict(odd, None).collect()} == {"und"}


def test_language_of_a_text_alone_and_among_others():
    r = np.random.default_rng(1)
    rows = r.normal(size=(langid.BUCKETS, 3)).astype(np.float32)
    texts = ["", "a", "ab", text(1, 300), "ééé", text(2, 5)]
    import pyarrow as pa

    whole = langid.logits_of(*string_buffers(pa.array(texts)), rows)
    for i, t in enumerate(texts):
        assert np.allclose(whole[i], langid.logits_of(*string_buffers(pa.array([t])), rows)[0])


def test_a_clause_has_no_window():
    grammar = toxicity.Grammar({"idiot": 1.0}, {}).opened()
    state = lambda text: [s for found in grammar.clauses(text).values() for s, _, _ in found]
    far = " " + "word " * 100
    assert [state(x + far + "idiot " + far + "idiot") for x in ("she said", "you", "a. b")] == [["reported"] * 2, ["target"] * 2, ["chain"] * 2]
    assert state("not" + far + "idiot") == ["plain"] and state("not an idiot") == ["negated"] and state("said. an idiot") == ["plain"]


def test_composition_is_the_best_of_all_paths():
    """The composed transducer reads every short clause as the best path through the parts, found by enumeration."""

    def paths(machine, symbols):
        found = [(0.0, machine.start, ())]
        for x in symbols:
            found = [(w + w2, to, (*outs, out)) for w, s, outs in found for out, w2, to in machine.arcs.get((s, x), ())]
        return [(w + machine.final[s], outs) for w, s, outs in found if s in machine.final]

    def slow(symbols):
        ways = [(0.0, tuple(symbols))]
        for machine in toxicity.parts():
            ways = [(w + w2, outs) for w, before in ways for w2, outs in paths(machine, before)]
        return ways

    whole = toxicity.composed()
    for n in range(5):
        for symbols in itertools.product(toxicity.SYMBOLS, repeat=n):
            ways = slow(symbols)
            weight, outs = whole.best(symbols)
            assert ways and abs(weight - max(w for w, _ in ways)) < 1e-9 and any(tuple(outs) == o and abs(w - weight) < 1e-9 for w, o in ways)


def test_a_lone_word_scores_nothing():
    g = toxicity.Grammar({"idiot": 5.0, "kill": 1.0}, {}).opened()
    assert not any(g.features("a long text. one idiot in it. and more")[:-1]) and not any(g.features("")[:-1])
    assert any(g.features("one idiot. another idiot")[:-1]) and any(g.features("you idiot")[:-1])


def test_grammar_is_linear_in_the_text():
    import time

    g = toxicity.Grammar({"idiot": 5.0}, {}).opened()
    began = time.perf_counter()
    g.features('you "idiot" said ' * 60_000)
    g.features("idiot. " * 100_000)
    assert time.perf_counter() - began < 30


def test_learnt_words_and_threats():
    r = random.Random(1)
    noise = lambda: text(r.random(), 30)
    toxic = [f"{noise()} you {r.choice(['zorgle', 'killing', 'vrakmu', 'vrakto', 'vrakli'])} {noise()} {r.choice(['vrakno', 'vrakpe'])}" for _ in range(60)]
    clean = [noise() for _ in range(200)]
    counts = toxicity._Counts(toxic + clean, np.array([1] * 60 + [0] * 200))
    g = counts.grammar(np.ones(260, bool))
    assert "vrak" in g.stems and "killing" in g.lexicon and "killing" in g.threats and "zorgle" in g.lexicon
    assert not set(WORDS) & set(g.lexicon)


PAGE = "<html><head><title>t</title><script>var a='</p>';</script></head><body><header>Site</header><nav><a>Home</a></nav>{}<aside>Side</aside><div class='comments'>Nice!</div><form>Mail<input></form><footer>F</footer></body></html>"


def test_pages(spark):
    template = "<div>Our slogan of the day</div><div>{}</div><div>Call us now</div>"
    rows = [
        (1, "http://a.org/x/1", PAGE.format("<article><h1>A &amp; B</h1><p>One<b>  two</b><p>Three&nbsp;four<br>five</article>")),
        (2, "http://a.org/x/2", PAGE.format(template.format("first unique text that is long enough to count"))),
        (3, "http://a.org/x/3", PAGE.format(template.format("second unique text that is also long enough to count"))),
        (4, "http://a.org/x/3", PAGE.format(template.format("second unique text that is also long enough to count"))),
        (5, None, None), (6, "http://[bad", "no markup"), (7, "http://b.org/", ""), (8, "http://b.org/", "<p>unclosed <b>bold"), (None, "http://c.org", "<!-- x --><p>y"),
    ]
    df = spark.createDataFrame([(*r, "old", 9) for r in rows], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[1] == "A & B\nOne two\nThree four\nfive"
    assert got[2] == "first unique text that is long enough to count"
    assert "second unique text" in got[3] and got[3] == got[4] or got[4].endswith("count")
    assert (got[5], got[6], got[7], got[8], got[None]) == ("", "no markup", "", "unclosed bold", "y")
    assert html_text.extract(df.limit(0)).count() == 0


def test_pages_with_long_templates_and_copies(spark):
    """A template longer than the article goes, also past copies and near copies, and outside a marked article."""
    template = "<div>" + "slogan " * 30 + "</div><div>{}</div><div>" + "call us " * 25 + "</div>"
    article = lambda i: f"article {i} " + f"w{i} " * 60
    near = lambda i: "</div><div>".join([f"w{j} " * 12 for j in range(9)] + [f"edit {i}"])
    rows = [(1, "http://a.org/x/1", template.format(article(1))), (2, "http://a.org/x/2", template.format(article(2)))]
    rows += [(3 + i, f"http://b.org/x/{i}", template.format(article(3))) for i in range(4)] + [(7, "http://b.org/z", template.format(article(7)))]
    rows += [(8 + i, f"http://c.org/x/{i}", template.format(near(i))) for i in range(4)] + [(12 + i, f"http://c.org/y/{i}", template.format(article(12 + i))) for i in range(5)]
    rows += [(20 + i, f"http://d.org/{i}", f"<div>Slogan</div><p>lead {i}</p><article>quoted<p>{article(i)}</article>") for i in range(2)]
    rows += [(30, "http://e.org/", "<div>Slogan</div><article>alone</article>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: article(i).strip() for i in (1, 2, 7, *range(12, 17))} | {i: article(3).strip() for i in range(3, 7)}
    want |= {8 + i: "\n".join([f"w{j} " * 11 + f"w{j}" for j in range(9)] + [f"edit {i}"]) for i in range(4)}
    want |= {20 + i: f"lead {i}\nquoted\n{article(i).strip()}" for i in range(2)} | {30: "alone"}
    for parts in (1, 3, 11):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert got == want


def test_common_lines_is_longest():
    r = random.Random(3)

    def length(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 9))] for _ in range(2))
        assert sum(html_text.common_lines(a, b)) == length(a, b)


VECTORS = "vec_id long, embedding array<float>, score string, rank string"


def vecs(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)


def test_searches_against_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[50:200] = x[50]  # a group of copies
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    rows += [(700, None), (720, [0.0] * 16), (740, [float("nan")] * 16), (760, [None] * 16), (780, [1.0]), (800, []), (None, rows[3][1])]
    df = vecs(spark, rows)
    found = vectors.nearest(df, k=5, every=20).toPandas()
    exact = vectors.exact_top_k(df, k=5, every=50).toPandas()
    hits = []
    for q in range(0, 600, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -1e9
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        own = found[found["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == [1, 2, 3, 4, 5]
        hits.append(len(set(want) & set(own["vec_id"])) / 5)
    assert np.mean(hits) >= 0.9 and 720 not in set(found["query_id"])
    w = np.floor(256 * x.astype(float))
    for q in range(0, 600, 50):
        s = w @ w[q]
        s[q] = -1e18
        want = np.lexsort((np.arange(600), -s))[:5]
        own = exact[exact["query_id"] == q].sort_values("rank")
        assert list(own["vec_id"])[:5] == list(want) and list(own["score"]) == [int(v) for v in s[want]]
    assert vectors.nearest(vecs(spark, [])).count() == 0 and vectors.exact_top_k(vecs(spark, [(50, [1.0, 2.0])])).count() == 0


def test_searches_over_many_tasks_and_rounds(spark, monkeypatch):
    """Hot ranges of leaves, several parts and deals, several blocks and rounds, and few visits, held against brute force."""
    for name, value in (("TASK_ROWS", 300), ("TASK_QUERIES", 60), ("LIST_ROWS", 700), ("ROUND_QUERIES", 60), ("SAMPLE", 4096)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(8)
    x = r.normal(size=(9000, 24))
    x[:3000] = x[0] + 0.01 * x[:3000]  # a third of all rows in one place
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    forest = vectors.Forest(x[:4096].astype(float), len(x))
    assert forest.depth >= 6 and forest.visits() < (vectors.TREES << forest.depth) / 3
    df = vecs(spark, [(i, [float(v) for v in row]) for i, row in enumerate(x)])
    found = vectors.nearest(df, k=20, every=40).toPandas()
    exact = vectors.exact_top_k(df, k=5, every=50).toPandas()
    hits = []
    for q in range(0, 9000, 40):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -1e9
        own = found[found["query_id"] == q].sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        assert np.allclose(own["score"], s[own["vec_id"]])
        hits.append(len(set(np.argsort(-s)[:20]) & set(own["vec_id"])) / 20)
    assert np.mean(hits) >= 0.9, np.mean(hits)
    w = np.floor(256 * x.astype(float))
    for q in range(0, 9000, 50):
        s = w @ w[q]
        s[q] = -1e18
        want = np.lexsort((np.arange(len(x)), -s))[:5]
        assert list(exact[exact["query_id"] == q].sort_values("rank")["vec_id"]) == list(want)


def test_queries_with_small_leaves_still_get_all(spark, monkeypatch):
    monkeypatch.setattr(vectors, "LEAF_ROWS", 4)
    monkeypatch.setattr(vectors, "VISITS", 0.1)
    r = np.random.default_rng(3)
    df = vecs(spark, [(i, [float(v) for v in r.normal(size=6)]) for i in range(200)])
    counts = {x["query_id"]: x["count"] for x in vectors.nearest(df).groupBy("query_id").count().collect()}
    assert counts == {i: 20 for i in range(0, 200, 20)}


def test_sorted_lists_are_exact_and_stop_early(monkeypatch):
    r = np.random.default_rng(6)
    for skew, size in ((1, (900, 8)), (4, (3000, 4)), (1, (3, 5))):
        x = np.floor(256 * r.normal(size=size) ** skew)
        calls = []
        slow = vectors.threshold_search
        monkeypatch.setattr(vectors, "threshold_search", lambda *a, slow=slow, calls=calls: calls.append(len(slow(*a)[0])) or slow(*a))
        i, j, score = vectors.SortedLists(x).best(x[:40], 6, np.full(min(40, len(x)), -np.inf))
        for k in range(min(40, len(x))):
            best = np.sort(x @ x[k])[::-1][:6]
            assert (np.sort(score[i == k])[::-1][: len(best)] == best).all() and (x[j[i == k]] @ x[k] == score[i == k]).all()
        assert skew == 1 or calls and max(calls) < len(x)
        monkeypatch.undo()


def test_threshold_search_stops_early_and_is_exact():
    r = np.random.default_rng(5)
    x = np.floor(256 * r.exponential(size=(3000, 4)) ** 3)
    order = np.argsort(-x, axis=0, kind="stable")
    for q in x[:20]:
        rows, score = vectors.threshold_search(x, order, q, 6, -np.inf)
        best = np.sort(x @ q)[::-1][:6]
        assert (np.sort(score)[::-1][:6] == best).all()
        assert len(rows) < 3000


def test_sharding(spark, odd):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup(shards, 1009)
    counts = np.bincount(table)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.lookup(shards[:-1], 1009)
    assert np.mean([a != b for a, b in zip(table, fewer, strict=True) if a != 6]) < 0.3
    got = sharding.place(odd.withColumn("shard", F.lit(1)), shards, slots=1009)
    assert got.count() == odd.count() and got.where("shard is null").count() == 0
    assert got.where("doc_id = 3").select("shard").distinct().count() == 1
    assert sharding.place(docs(spark, []), shards, slots=1009).count() == 0
    for bad in (([], 7), (["a", "a"], 7), (["a"], 8)):
        with pytest.raises(ValueError):
            sharding.lookup(*bad)


CLASHING = ["y", "_id", "_s", "_low", "_repeats", "_below", "_size", "_slot", "_key", "_host", "_gone", "_5", "row", "key", "h", "n", "s", "size", "node", "registers", "packed", "component", "slot", "v", "id", "q", "_salt", "_hot", "_own", "_own_0", "_at", "draw", "lang_pred", "x"]


@pytest.mark.parametrize("name", ["toxicity", "quality", "near", "near_first", "mix", "place", "language", "bpe", "pages", "nearest", "top_k", *(f"stage {i}" for i in range(5))])
def test_columns_of_any_name_stay(spark, tmp_path, name):
    """Every operator and stage takes a table whose further columns have the names of internal ones, and an empty one."""
    import corpus_pipeline

    rows = [(i, text(i) + (" you stupid grobnak idiot" if i % 3 == 0 else ""), "en" if i % 2 else "xx", "a" if i % 4 else "b") for i in range(60)]
    plain = spark.createDataFrame([(*r, f"http://h.org/{r[0] % 5}/{r[0]}", [float(r[0] % 7), 1.0, float(r[0])]) for r in rows], "doc_id long, text string, lang string, source string, url string, embedding array<double>")
    df = plain.select("*", *(F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    y = labels(spark, [(i, i % 2, int(i % 3 == 0)) for i in range(60)])
    y.write.parquet(f"{tmp_path}/labels.parquet")
    made = {
        "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, y)), "quality": lambda d: quality.score(d, quality.fit(d, y)), "near": near_dedup.near_duplicates, "near_first": near_dedup.without_near_duplicates,
        "mix": mixing.mix, "place": lambda d: sharding.place(d, ["a", "b"], slots=101), "language": lambda d: langid.predict(d, langid.fit(d)), "bpe": bpe.encode,
        "pages": lambda d: html_text.extract(d.withColumnRenamed("text", "html"), order="doc_id"), "nearest": lambda d: vectors.nearest(d, vec_id="doc_id"), "top_k": lambda d: vectors.exact_top_k(d, vec_id="doc_id"),
    } | {f"stage {i}": (lambda d, f=f: f(spark, d, str(tmp_path))) for i, (_, f) in enumerate(corpus_pipeline.STAGES)}
    got = made[name](df)
    found = got.collect()
    assert found and got.columns == made[name](df.limit(0)).columns and not made[name](df.limit(0)).collect()
    assert [f.dataType for f in got.schema] == [f.dataType for f in made[name](df.limit(0)).schema]
    if name.startswith("stage") and name != "stage 4":
        assert got.columns == df.columns
    for c in set(CLASHING) & set(got.columns):
        if (name, c) not in {("mix", "size"), ("place", "slot"), ("language", "lang_pred"), ("near", "row")}:
            assert all(r[c] == f"{c}{r['doc_id']}" for r in found), c


def test_common_pieces():
    import pyarrow as pa

    batch = pa.record_batch({"t": pa.array(["x" * n for n in (10, 0, 3_000_000, 5, 5)])})
    assert sum(p.num_rows for p in pieces(batch, 1000)) == 5
    raw, at = string_buffers(pa.array(["a B", None, "b"]))
    words, offsets = word_hashes(raw, at)
    assert offsets.tolist() == [0, 2, 2, 3] and words[1] == words[2]
    w = logistic(np.array([[0.0], [1.0], [0.0], [1.0]]), np.array([0, 1, 0, 1]))
    assert sigmoid(w[0] + w[1]) > 0.5 > sigmoid(w[1])
