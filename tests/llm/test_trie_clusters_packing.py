"""Prefix trie, clusters and packing against brute force; nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import collections
import hashlib
import itertools
import json
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoglyph.llm import bpe, clusters, packing, trie
from memoglyph.llm.batch_bpe import BatchBpe
from memoglyph.llm.prefix import running

TURNS = "conv_id long, turn long, role string, text string, node string, depth string, digest string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS)


def brute_trie(rows, rebuilt):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
    of = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            of[c].append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in of.items()}
    if rebuilt:
        h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
        own = {c: own.get(c - c % 20, [])[: h[c]] + ts[h[c] :] for c, ts in own.items()}
    nodes = collections.defaultdict(list)
    for c, ts in own.items():
        for d in range(len(ts) + 1):
            nodes[tuple(ts[:d])].append(c)
    words = lambda node: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", node[-1][1])]) if node else 0
    out = []
    for node, members in nodes.items():
        under = [n for n in nodes if n[: len(node)] == node]
        leaf = lambda n: not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in nodes)
        ends = ",".join(str(c) for c in sorted(members) if len(own[c]) == len(node))
        out.append((min(members), len(node), min(nodes[node[:-1]]) if node else None, len(members), sum(len(n) == len(node) + 1 for n in under), sum(map(leaf, under)), sum((len(nodes[n]) - 1) * words(n) for n in under), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def talk():
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", None]), r.choice(["", "hi", "how are you", None, "a b c d"])) for c in [*range(18, 47), 60, 83] for t in range(r.randint(1, 6))]
    rows += [(200, None, "user", "late"), (200, None, "user", "first"), (200, 1, "user", "x"), (200, 1, "user", "x"), (200, 0, "user", "x"), (None, 1, "user", "lost"), (201, 5, "a", "only")]
    return rows + [(300, t, "user", f"turn {t % 3}") for t in range(70)] + [(301, t, "user", f"turn {t % 3}") for t in range(75)]


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie_equals_brute_force(spark, talk, rebuilt):
    found = trie.turns(conversations(spark, talk))
    got = trie.trie(trie.shared_heads(found) if rebuilt else trie.with_roots(found))
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got.select(COLUMNS).collect()), key=repr) == brute_trie(talk, rebuilt)
    spans = {r["node"]: r for r in got.collect()}
    assert sorted(r["preorder"] for r in spans.values()) == list(range(len(spans)))
    for r in spans.values():  # a child's interval lies in its parent's, and intervals of siblings are apart
        if r["parent"] is not None:
            p = spans[r["parent"]]
            assert p["preorder"] < r["preorder"] <= r["end"] <= p["end"]


def test_trie_of_empty_table(spark):
    assert trie.trie(trie.shared_heads(trie.turns(conversations(spark, [])))).count() == 0


def test_running_splits_a_group(spark):
    rows = [(None if i % 7 == 0 else 1, i, 1 + i % 3) for i in range(4000)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running(df, ["g"], ["i"], {"n": None, "s": "v"})
        assert got.select(F.spark_partition_id()).distinct().count() > 2  # one group has most of the rows
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = {}
    for g in (None, 1):
        own = sorted(r for r in rows if r[0] == g)
        want |= {r[1]: (n + 1, s) for n, (r, s) in enumerate(zip(own, itertools.accumulate(r[2] for r in own)))}
    assert {r["i"]: (r["n"], r["s"]) for r in got.collect()} == want


def brute_lloyd(rows, k, rounds):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, q in kept:
            of[near(q)[1]].append(q)
        for n, qs in of.items():
            centroids[n] = [sum(x) // len(qs) for x in zip(*qs)]
    return sorted(((i, near(q)[1], near(q)[0]) for i, q in kept), key=repr), centroids


def test_clusters_equal_brute_force(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.normal(size=4) * (1 + i % 3) + i % 5]) for i in range(180)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(3, rows[3][1]), (None, rows[9][1]), (3, rows[4][1])]
    odd = [(900, None), (901, []), (902, [1.0, 2.0, 3.0]), (903, [1.0, None, 2.0, 3.0]), (904, [1.0, float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0, 0.0]), (906, [1e9, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1, "a") for i, v in rows + odd], "vec_id long, embedding array<double>, cluster int, q string")
    got, centroids = clusters.lloyd(clusters.whole_vectors(df, dims=4), 9, 3, dims=4)
    want, last = brute_lloyd(rows, 9, 3)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got.collect()), key=repr) == want
    assert centroids.tolist() == last
    few, own = clusters.lloyd(clusters.whole_vectors(df.where("vec_id < 5"), dims=4), 40, 2, dims=4)
    assert few.count() == 7 and len(own) == 7
    assert clusters.lloyd(clusters.whole_vectors(df.limit(0), dims=4), 9, 3, dims=4)[0].count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_dual_tree_is_exact_and_prunes(seed):
    r = np.random.default_rng(seed)
    n, d = int(r.integers(1, 600)), int(r.integers(1, 5))
    points = np.floor(r.normal(size=(n, d)) * 50 + 4000 * r.integers(0, 6, size=(n, 1))).astype(np.int64)
    if seed % 3 == 0:
        points[: n // 2] = points[0]
    some = points[r.integers(0, n, size=20)] + r.integers(-3, 4, size=(20, d))
    tree = clusters.CoverTree(points)
    number, distance, taken = clusters.nearest(tree, clusters.CoverTree(some))
    all_ = ((points[tree.order][:, None] - some[None]) ** 2).sum(-1)
    assert number.tolist() == all_.argmin(1).tolist() and distance.tolist() == all_.min(1).tolist()
    if n > 400:
        assert taken < n * 20 * 1.2
    for i, p in enumerate(tree.parent.tolist()[1:], 1):
        assert p < i and np.sqrt(((tree.points[i] - tree.points[p]) ** 2).sum()) <= tree.radius[p] + 1e-9


def least_sequences(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j, room in enumerate(bins):
            if room >= items[i] and room not in bins[:j]:
                bins[j] -= items[i]
                go(i + 1, bins)
                bins[j] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


def test_reduction_keeps_the_optimum():
    r = random.Random(1)
    fixed = 0
    for _ in range(400):
        capacity, items = r.choice([10, 20, 30]), []
        for _ in range(r.randint(0, 11)):
            items.append(r.randint(1 if r.random() < 0.5 else capacity // 4, capacity))
        plan = packing.Plan(capacity)
        rest = packing.reduced(collections.Counter(items), plan)
        assert plan.sequences + least_sequences([k for k, n in rest.items() for _ in range(n)], capacity) == least_sequences(items, capacity)
        fixed += len(items) - sum(rest.values())
    assert fixed > 1000


def test_packing_of_documents(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    r = random.Random(3)
    texts = ["word " * r.randint(0, 300) for _ in range(150)] + [None, "", " \n", "x" * 400, "one two " * 9000, "ends <|endoftext|> here", "same"] + ["same"] * 40
    rows = [(i if i % 31 else None, t, "a", 5, "b") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string, offset int, length string").repartition(5)
    got = packing.pack(packing.document_pieces(df, capacity=512), 512).collect()
    known = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t, *_ in rows:
        ids = [*known.encode(t or "", add_special_tokens=False).ids, 1]
        want += [(i, s // 512, s, len(ids[s : s + 512]), zlib.crc32(np.array(ids[s : s + 512], "<u4").tobytes())) for s in range(0, len(ids), 512)]
    assert sorted((tuple(r[:5]) for r in got), key=repr) == sorted(want, key=repr)
    placed = collections.defaultdict(list)
    for row in got:
        placed[row["sequence_id"]].append((row["offset"], row["length"]))
    for held in placed.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(w[3] for w in want)
    assert -(-total // 512) <= len(placed) <= -(-total // 512) + 1
    assert packing.pack(packing.document_pieces(df.limit(0))).count() == 0


def test_batch_bpe_matches_library():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    known, own = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), BatchBpe(json.loads(bpe.load()))
    r = random.Random(6)
    letters = [*"abcdefghist'.,!? \n\t0123456789\x0b\x1c\x85\xa0 ", "é", "Σ", "ς", "İ", "ß", "×", "中", "文", "😀", "́", "<|endoftext|>", "<|", "'s", "'ll", "aaa", "the "]
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)] + [None, "", "a" * 5000, "b" * 47 + " " + "b" * 48 + " " + "b" * 49]
    for _ in range(2):  # the second time from memory
        ids, count = own.encode(texts)
        ends = np.cumsum(count)
        for t, e, n in zip(texts, ends, count):
            assert ids[e - n : e].tolist() == known.encode(t or "", add_special_tokens=False).ids
