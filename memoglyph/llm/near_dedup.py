"""Near-duplicate documents from SetSketch registers.

Each document's set of word shingles gets m registers: the minimum of exponentially distributed hashes, truncated to a
power of b. Registers of a union are the larger of both, and two documents agree in a register about as often as their
sets' Jaccard similarity. Bands of registers name buckets; a joint likelihood of the register comparisons and the exact
set sizes drops pairs that can't reach the threshold; the rest are confirmed on the full sets.

A bucket of n documents isn't expanded into n**2 pairs. First each member meets the bucket's smallest member and links
are closed to components; only members that are still in different components then meet, block by block. So a group of
copies costs a multiple of its size, and no link that could join two components is left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.common import arrow_columns, checkpointed, free_names, giving_back, joined_hot, mixed, pieces, small_batches, string_buffers, table, word_hashes

#: Base and rate of the registers: sets of 1 to 2**64 elements fall inside 16 bits.
BASE, RATE, LIMIT = 1.001, 400_000.0, (1 << 16) - 1
#: Registers of a set; and the most that all bands may miss a pair at the threshold, as a probability.
REGISTERS, MISS = 128, 1e-6
#: A candidate goes if its likelihood at the threshold is worse than at its best by more than this (5 deviations).
WORSE = 12.5
#: Members of a bucket that one task compares with as many others.
BLOCK = 512


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text, repeats included, and their offsets; fewer words make one shingle."""
    counts = np.diff(offsets)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
        for k in range(size):
            rolled += mixed(words[k : k + len(rolled)] + np.uint64(k + 1)) * np.uint64(2 * k + 3)
        rolled = mixed(rolled)
    made = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(made, out=out[1:])
    hashes = np.empty(out[-1], np.uint64)
    full = np.flatnonzero(counts >= size)
    if len(full):
        inner = np.arange(out[-1]) - np.repeat(out[:-1], made)
        take = np.repeat(counts >= size, made)
        hashes[take] = rolled[(np.repeat(offsets[:-1], made) + inner)[take]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        h = np.uint64(xxhash.xxh3_64_intdigest(words[offsets[i] : offsets[i + 1]].tobytes()))
        hashes[out[i]] = h
    return hashes, out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, at = shingle_hashes(*word_hashes(raw, offsets), size)
    return [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def banding(least: float, m: int = REGISTERS) -> tuple[int, int]:
    """(bands, rows): the longest bands that miss a pair of similarity `least` with a probability of MISS or less."""
    rows = max((r for r in range(1, m + 1) if (1 - least**r) ** (m // r) <= MISS), default=1)
    return m // rows, rows


def _factors(m: int) -> np.ndarray:
    return np.random.default_rng(20_240_601).integers(0, 1 << 63, m, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def registers(sets: list[np.ndarray], m: int = REGISTERS) -> np.ndarray:
    """m registers a set, uint16; an empty set has zeros. The registers of a union are the maximum of both."""
    out = np.zeros((len(sets), m), np.uint16)
    some = [i for i, s in enumerate(sets) if len(s)]
    if not some:
        return out
    flat = np.concatenate([sets[i] for i in some])
    starts = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
    lows = np.empty((m, len(some)), np.uint64)
    buffer = np.empty_like(flat)
    with np.errstate(over="ignore"):
        for k, factor in enumerate(_factors(m)):
            np.multiply(flat, factor, out=buffer)
            lows[k] = np.minimum.reduceat(buffer, starts)
    waits = -np.log1p(-(lows.astype(np.float64) + 0.5) * 2.0**-64 * (1 - 2.0**-53)) / RATE
    out[some] = np.clip(np.floor(1 - np.log(waits) / np.log(BASE)), 0, LIMIT).astype(np.uint16).T
    return out


def likely(more: np.ndarray, less: np.ndarray, m: int, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether similarity `least` stays plausible, by the joint likelihood of both sketches.

    more, less: in how many of m registers a's is the larger and the smaller; n_a, n_b: the exact set sizes.
    """
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    possible = top >= least * (1 - 1e-12)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def fit(j):
        a, b = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return more * np.log(a + tiny) + less * np.log(b + tiny) + (m - more - less) * np.log(np.maximum(1 - a - b, 0) + tiny)

    best = np.full(len(u), -np.inf)
    for share in np.linspace(0, 1, 41):
        best = np.maximum(best, fit(top * share))
    at = np.maximum(fit(np.minimum(top, least)), fit(top))
    for share in np.linspace(0, 1, 9):
        at = np.maximum(at, fit(np.minimum(top, least) + (top - np.minimum(top, least)) * share))
    return possible & (best - at <= WORSE)


def sketches(docs: DataFrame, size: int, keep: list[str], text: str = "text") -> DataFrame:
    """keep and, of the whole text: n_shingles, set_key (128 bits of the set), registers, packed (the text, zstd)."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("registers", T.BinaryType()), T.StructField("packed", T.BinaryType())]

    def make():
        pack = zstandard.ZstdCompressor(level=1)

        def step(texts: pa.Array):
            raw, offsets = string_buffers(texts)
            sets = shingle_sets(raw, offsets, size)
            regs = registers(sets)
            whole = raw.tobytes()
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                pa.array([pack.compress(whole[a:b]) if there else None for a, b, there in zip(offsets[:-1], offsets[1:], texts.is_valid().to_pylist(), strict=True)], pa.binary()),
            ]

        return step

    return arrow_columns(docs, [text], fields, make, keep)


def _band_keys(nodes: DataFrame, n_bands: int, n_rows: int) -> DataFrame:
    """A row for each node and band: node, band, bucket (a hash of the band's registers)."""
    width = 2 * n_rows
    bands = F.array(*(F.xxhash64(F.lit(b), F.substring(F.col("registers"), 1 + b * width, width)) for b in range(n_bands)))
    return nodes.select("node", F.posexplode(bands).alias("band", "bucket"))


def _plausible(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("registers").alias(f"r{x}"), F.col("n_shingles").alias(f"n{x}"))
    wide = joined_hot(pairs, side("a"), "a").join(side("b"), "b")

    def make():
        def step(a, b, ra, rb, na, nb):
            x, y = (np.frombuffer(b"".join(r.to_pylist()), np.uint16).reshape(len(r), -1) for r in (ra, rb))
            return [pa.array(likely((x > y).sum(1), (x < y).sum(1), x.shape[1], na.to_numpy().astype(float), nb.to_numpy().astype(float), least))]

        return step

    return arrow_columns(wide, ["a", "b", "ra", "rb", "na", "nb"], [T.StructField("ok", T.BooleanType())], make, ["a", "b"]).where("ok").select("a", "b")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union on the full sets."""
    side = lambda x: texts.select(F.col("node").alias(x), F.col("packed").alias(f"p{x}"))
    wide = joined_hot(pairs, side("a"), "a", most=0).join(side("b"), "b")

    def make():
        unpack = zstandard.ZstdDecompressor()
        known: dict[int, np.ndarray] = {}

        def of(node, packed):
            found = known.get(node)
            if found is None:
                if len(known) >= 200:
                    known.clear()
                raw = np.frombuffer(unpack.decompress(packed.as_py()), np.uint8)
                found = known[node] = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
            return found

        def step(a, b, pa_, pb):
            out = []
            for i, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
                s, t = of(x, pa_[i]), of(y, pb[i])
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(100 * both >= percent * (len(s) + len(t) - both))
            return [pa.array(out, pa.bool_())]

        return step

    return arrow_columns(wide, ["a", "b", "pa", "pb"], [T.StructField("linked", T.BooleanType())], make, ["a", "b"]).where("linked").select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), for each node that has an edge.

    Alternating large and small stars (Kiveris and others, 2014): each round hangs neighbours under the smallest one
    seen, so the rounds grow with the logarithm of the largest component. Hot nodes are aggregated before each shuffle.
    Every round is cut with a checkpoint. A pair gives its two rows in place: a union would have two tasks for each of one.
    """

    def both(pairs: DataFrame, *two: tuple[str, str]) -> DataFrame:
        return pairs.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in two))).alias("e")).select("e.*")

    def star(pairs: DataFrame, small: bool) -> DataFrame:
        # u's neighbours v and the smallest of them and u
        if small:
            pairs = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        else:
            pairs = both(pairs, ("u", "v"), ("v", "u"))
        low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = pairs.join(low, "u")
        if small:
            out = both(hung, ("v", "m"), ("u", "m"))
        else:
            out = hung.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return out.where("u <> v").distinct()

    now = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        now = checkpointed(star(star(now, False), True))
        ends = now.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("hung"), F.lit(0).alias("holds")), F.struct(F.col("v").alias("x"), F.lit(0).alias("hung"), F.lit(1).alias("holds")))).alias("e")).select("e.*")
        # settled: whoever hangs does so once and holds nobody
        if ends.groupBy("x").agg(F.sum("hung").alias("hung"), F.max("holds").alias("holds")).where("hung > 1 or hung > 0 and holds > 0").isEmpty():
            break
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _cross_links(rows: DataFrame, members: DataFrame, least: float, n_rows: int, size: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between members of one bucket that are in different components.

    rows: bucket, band, node, component, size; members: node, registers, n_shingles, packed. A bucket of more than BLOCK
    members is compared by pairs of blocks. A pair is looked at in the first band it shares. First only sketches travel, and
    the members of a task that have a plausible partner there stay; these come again with their texts and are confirmed on
    the full sets, likeliest first; once a task has joined two components, it passes over their other pairs. Only links
    leave the task.
    """
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node"), n_blocks).cast("int")
    dealt = (
        rows.withColumn("n_blocks", n_blocks).withColumn("own", own)
        .join(members.select("node", "registers", "n_shingles"), "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
        .select(F.xxhash64("band", "bucket", F.least("own", "other"), F.greatest("own", "other")).alias("task"), "band", "own", "other", "node", "component", "registers", "n_shingles")
    )
    by_task = lambda x: x.repartition(F.col("task")).sortWithinPartitions("task", "own", "node")
    texts = members.select("node", "packed")

    def run(batches, finish):
        held: pa.Table | None = None
        for batch in batches:
            for piece in pieces(batch, 4 << 20):
                new = pa.Table.from_batches([piece])
                held = new if held is None else pa.concat_tables([held, new])
                task = held["task"].to_numpy()
                whole = int(np.searchsorted(task, task[-1]))
                if whole:
                    yield from finish(held.slice(0, whole))
                    held = held.slice(whole).combine_chunks()
        if held is not None and held.num_rows:
            yield from finish(held)

    def candidates(own, other, comp):
        """Positions of the pairs of one task that are in different components."""
        if own[0] == own[-1] and (own == other).all():
            i, j = np.triu_indices(len(own), 1)
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(own == own[0]), np.flatnonzero(own != own[0])))
        apart = comp[i] != comp[j]
        return i[apart], j[apart]

    def plausible(rows: pa.Table):
        """(positions of pairs that their sketches allow, registers in which they agree) of whole tasks."""
        task, band, own, other, node, comp, n = (rows[c].to_numpy() for c in ("task", "band", "own", "other", "node", "component", "n_shingles"))
        regs = np.frombuffer(b"".join(rows["registers"].to_pylist()), np.uint16).reshape(len(task), -1)
        m = regs.shape[1]
        edges = np.flatnonzero(np.diff(task)) + 1
        found = []
        for a, b in zip([0, *edges], [*edges, len(task)], strict=True):
            if b - a > 1 and comp[a:b].min() != comp[a:b].max():
                i, j = candidates(own[a:b], other[a:b], comp[a:b])
                found.append((i + a, j + a))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        left, right = (np.concatenate(x) for x in zip(*found, strict=True))
        kept, alike_of = [], []
        fewest = m * least - 6 * np.sqrt(m * least * (1 - least))
        for at in range(0, len(left), 20_000):
            i, j = left[at : at + 20_000], right[at : at + 20_000]
            x, y = regs[i], regs[j]
            same = x == y
            alike = same.sum(1)
            bands = same[:, : m // n_rows * n_rows].reshape(len(i), -1, n_rows).all(2)
            ok = np.flatnonzero((alike >= fewest) & (bands.argmax(1) == band[i]) & bands.any(1))
            ok = ok[likely((x[ok] > y[ok]).sum(1), (x[ok] < y[ok]).sum(1), m, n[i[ok]].astype(float), n[j[ok]].astype(float), least)]
            kept.append(at + ok)
            alike_of.append(alike[ok])
        kept = np.concatenate(kept)
        return left[kept], right[kept], np.concatenate(alike_of)

    def survivors(rows: pa.Table):
        left, right, _ = plausible(rows)
        if len(left):
            at = pa.array(np.unique(np.concatenate([left, right])))
            yield pa.RecordBatch.from_arrays([rows[c].combine_chunks().take(at) for c in ("task", "node")], names=["task", "node"])

    def done(rows: pa.Table):
        left, right, alike_of = plausible(rows)
        if not len(left):
            return
        task, node, comp, n = (rows[c].to_numpy() for c in ("task", "node", "component", "n_shingles"))
        unpack = zstandard.ZstdDecompressor()
        sets: dict[int, np.ndarray] = {}
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while above.get(c, c) != c:
                c = above[c]
            return c

        def of(r: int) -> np.ndarray:
            if r not in sets:
                if len(sets) >= 4 * BLOCK:
                    sets.clear()
                raw = np.frombuffer(unpack.decompress(rows["packed"][r].as_py()), np.uint8)
                sets[r] = shingle_sets(raw, np.array([0, len(raw)]), size)[0]
            return sets[r]

        out = []
        for k in np.lexsort((np.arange(len(left)), -alike_of, task[left])):
            i, j = int(left[k]), int(right[k])
            p, q = root(int(comp[i])), root(int(comp[j]))
            if p == q:
                continue
            both = len(np.intersect1d(of(i), of(j), assume_unique=True))
            if 100 * both >= percent * (n[i] + n[j] - both):
                above[max(p, q)] = min(p, q)
                out.append((min(node[i], node[j]), max(node[i], node[j])))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    lasting = checkpointed(small_batches(by_task(dealt)).mapInArrow(giving_back(lambda batches: run(batches, survivors)), "task long, node long").distinct())
    again = by_task(dealt.join(lasting, ["task", "node"]).join(texts, "node"))
    return small_batches(again).mapInArrow(giving_back(lambda batches: run(batches, done)), "a long, b long")


def _numbered(docs: DataFrame, size: int, keep: list[str], text: str) -> DataFrame:
    """sketches(), with a number of each row; one pass over the texts, whose compressed form serves from here on."""
    return checkpointed(sketches(docs, size, keep, text).withColumn("row", F.monotonically_increasing_id()))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: row (a number of its own), doc_id, n_shingles, component_id, kept, first.

    Two rows are linked if their sets of distinct `size`-word shingles have 100 * intersection >= percent * union;
    component_id is the smallest doc_id that links reach, kept says whether it is the row's own, and first marks exactly
    one row of a component. Null and empty texts, and texts without words, have no shingles and are linked with nothing.
    Repeated rows share a component. A null doc_id is reached only by rows that reach no other id. Empty tables give
    empty results; other columns of docs aren't read.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return _joined(_numbered(own, size, ["doc_id"], "text"), size, percent, "doc_id").withColumnRenamed("doc_id", doc_id)


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are the first of their component, with the columns of docs, whatever their names.

    Which rows are linked says near_duplicates(); rows without words all stay.
    """
    own = free_names(docs.columns)
    names = {c: f"{own}{i}" for i, c in enumerate(docs.columns) if c != text}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()), F.col(f"`{text}`").alias(own))
    all_rows = _numbered(renamed, size, list(names.values()), own)
    first = _joined(all_rows.withColumnRenamed(names[doc_id], "doc_id"), size, percent, "doc_id").where("first").select("row")

    def make():
        unpack = zstandard.ZstdDecompressor()

        def step(packed):
            return [pa.array([None if p is None else unpack.decompress(p).decode() for p in packed.to_pylist()], pa.string())]

        return step

    kept = all_rows.join(first, "row", "left_semi")
    whole = arrow_columns(kept, ["packed"], [T.StructField(own, T.StringType())], make, list(names.values()))
    return whole.select(*(F.col(names.get(c, own)).alias(c) for c in docs.columns))


def _joined(all_rows: DataFrame, size: int, percent: int, doc_id: str) -> DataFrame:
    """near_duplicates() of numbered sketches."""
    least = percent / 100
    rows = all_rows.select("row", doc_id, "n_shingles", "set_key")
    some = all_rows.where("n_shingles > 0")
    # rows with the same set are one node from here on
    keys = some.groupBy("set_key").agg(F.min("row").alias("node"))
    nodes = checkpointed(keys.select("node").join(some.select(F.col("row").alias("node"), "registers", "n_shingles"), "node"))
    packed = some.select(F.col("row").alias("node"), "packed")

    n_bands, n_rows = banding(least)
    bands = _band_keys(nodes, n_bands, n_rows)
    sizes = bands.groupBy("band", "bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("size")).where("size > 1")
    shared = checkpointed(bands.join(sizes, ["band", "bucket"]))
    stars = shared.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    candidates = checkpointed(_plausible(stars, nodes, least))
    wanted = lambda pairs: packed.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node", "left_semi")
    links = checkpointed(_confirmed(candidates, wanted(candidates), size, percent))
    found = components(links)

    of = shared.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = checkpointed(of.select("band", "bucket", "node", "component", "size"))
    unsettled = of.groupBy("band", "bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band", "bucket")
    members = some.select(F.col("row").alias("node"), "registers", "n_shingles", "packed")
    more = checkpointed(_cross_links(of.join(unsettled, ["band", "bucket"]), members, least, n_rows, size, percent))
    joined = reduce(DataFrame.unionByName, [links, more])
    found = checkpointed(components(joined))

    node_of = keys.join(found, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    placed = rows.join(node_of, "set_key", "left").withColumn("component", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("row")))
    placed = checkpointed(placed.select("row", doc_id, "n_shingles", "component"))
    best = placed.groupBy("component").agg(F.min(doc_id).alias("component_id"), F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col("row").alias("first_row")))["first_row"].alias("first_row"))
    return joined_hot(placed, best, "component").select(
        "row", doc_id, "n_shingles", "component_id", F.coalesce(F.col(doc_id) == F.col("component_id"), F.lit(False)).alias("kept"), (F.col("row") == F.col("first_row")).alias("first")
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents by 3-word shingles at 0.85: doc_id, n_shingles, component_id, kept."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs, size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON e.x = r.other)
SELECT d.doc_id, COALESCE(any_value(n), 0)::BIGINT AS n_shingles, min(r.other) AS component_id, d.doc_id = min(r.other) AS kept
FROM documents d JOIN reach r ON r.doc_id = d.doc_id LEFT JOIN sizes z ON z.doc_id = d.doc_id
GROUP BY d.doc_id
"""
