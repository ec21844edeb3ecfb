"""Nearest neighbours by a forest of random-projection trees, and exact top-k search by Fagin's threshold algorithm.

Both first bring equal vectors together: a group of copies is one vector with its smallest ids, of which no result needs
more than k + 1. So a vector that a third of all rows share costs what one row costs.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from memoglyph.llm.common import checkpointed, joined_small, table

#: Vectors that a forest is fitted on, at most; and those that the first round of an exact search compares.
SAMPLE = 16_384
#: Trees; rows of a leaf; levels of leaves that one task holds; vectors and queries of one task.
TREES, LEAF_ROWS, TASK_LEVELS, TASK_ROWS, TASK_QUERIES = 12, 128, 5, 8192, 4096
#: Leaves that a query visits over all trees, times the square root of one tree's leaves.
VISITS = 9
#: Sampled vectors below which a node's threshold isn't read from it but from an ancestor.
NODE_SAMPLE = 16
#: Vectors whose sorted lists a task holds at once, and the queries that one round runs against all of them.
LIST_ROWS, ROUND_QUERIES = 16_384, 16_384
#: Entries of each list that a query reads before it asks how deep it has to go.
FIRST_DEPTH = 8


def _usable(vector: str, zero: bool):
    """Whether a vector takes part: not null or empty, all components finite and, unless zero, one not 0."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine if zero else fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _one_length(rows: DataFrame) -> DataFrame:
    """The rows of the commonest vector length, of two the larger; others have no inner product with them."""
    commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows if commonest is None else rows.where(F.size("v") == commonest["d"])


def groups_of(rows: DataFrame, most: int) -> DataFrame:
    """h, v, gid, ids of each distinct vector: its smallest id, and its `most` smallest ones in order.

    rows: id, v. Spark cuts each group to `most` rows in every map task before the shuffle (a rank limit), so a vector of
    any number of copies reaches its reducer as a few rows of each task.
    """
    keyed = rows.where(F.col("id").isNotNull()).select("id", "v", F.xxhash64("v").alias("h"))
    ranked = keyed.withColumn("_r", F.row_number().over(W.partitionBy("h", "v").orderBy("id"))).where(F.col("_r") <= most)
    return ranked.groupBy("h", "v").agg(F.min("id").alias("gid"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.ChunkedArray | pa.Array, dtype=np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(dtype) if n else np.zeros((0, 1), dtype)


def _sample(groups: DataFrame) -> np.ndarray:
    return _matrix(groups.orderBy("h", "gid").limit(SAMPLE).select("v").toArrow()["v"], np.float64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, the same for a pair wherever it is computed."""
    return (a * b).sum(axis=1)


class Forest:
    """Random-projection trees: each level of a tree has one direction, each node the median of its sample along it.

    Nodes with a small sample, and all below, take the medians of their last ancestor with enough, so the depth isn't
    bounded by the sample. A node also has the means of both sides, from which a query reads what a leaf promises.
    """

    def __init__(self, sample: np.ndarray, rows: int, seed: int = 5):
        d = sample.shape[1]
        self.depth = max(0, math.ceil(math.log2(max(1, rows / LEAF_ROWS))))
        sampled = max(0, int(math.log2(max(1, len(sample) / NODE_SAMPLE))))
        rng = np.random.default_rng(seed)
        self.directions, self.thresholds, self.means = [], [], []
        for _ in range(TREES):
            r = rng.normal(size=(d, self.depth))
            for a in range(0, self.depth, d):  # orthogonal as far as there is room
                r[:, a : a + d] = np.linalg.qr(r[:, a : a + d])[0]
            projected = sample @ r
            node = np.zeros(len(sample), np.int64)
            levels, means = [], []
            for j in range(self.depth):
                n_nodes = 1 << min(j, sampled)
                order = np.lexsort((projected[:, j], node))
                starts = np.searchsorted(node[order], np.arange(n_nodes + 1))
                middle = np.minimum((starts[:-1] + starts[1:]) // 2, len(order) - 1)
                low = np.maximum(middle - 1, 0)
                at = (projected[order[low], j] + projected[order[middle], j]) / 2 if len(order) else np.zeros(n_nodes)
                at = np.where(starts[1:] > starts[:-1], at, 0.0)
                side = node * 2 + (projected[:, j] > at[node])
                count = np.bincount(side, minlength=2 * n_nodes)
                total = np.bincount(side, projected[:, j], 2 * n_nodes)
                mean = np.where(count > 0, total / np.maximum(count, 1), np.repeat(at, 2)).reshape(-1, 2)
                levels.append(at)
                means.append(mean)
                if j < sampled:
                    node = side
            self.directions.append(r)
            self.thresholds.append(levels)
            self.means.append(means)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row in each tree."""
        out = np.zeros((len(x), TREES), np.int64)
        for t in range(TREES):
            p = x @ self.directions[t]
            node = np.zeros(len(x), np.int64)
            for j in range(self.depth):
                at = self.thresholds[t][j]
                node = node * 2 + (p[:, j] > at[self._of(node, j, len(at))])
            out[:, t] = node
        return out

    @staticmethod
    def _of(node, level: int, known: int):
        return node >> max(0, level - (known.bit_length() - 1))

    def visits(self) -> int:
        return min(TREES << self.depth, math.ceil(VISITS * 2 ** (self.depth / 2)))

    def search(self, x: np.ndarray, most: int) -> list[tuple[int, int]]:
        """The first `most` (tree, leaf) in the order in which one priority queue over all trees reaches them.

        The queue holds the sides of splits that haven't been taken, by the inner product that the means of the sides on
        the way, and the better mean of each level below, promise.
        """
        known = self._as_lists()
        paths, queue = [], []
        for t in range(TREES):
            p = (x @ self.directions[t]).tolist()
            below = [0.0] * (self.depth + 1)
            for j in range(self.depth - 1, -1, -1):
                low, high = known[t][j][1]
                below[j] = below[j + 1] + max(p[j] * low, p[j] * high)
            paths.append((p, below))
            queue.append((-below[0], t, 0, 0, 0.0))
        heapq.heapify(queue)
        found, depth = [], self.depth
        push, pop = heapq.heappush, heapq.heappop
        while queue and len(found) < most:
            _, t, level, node, sure = pop(queue)
            p, below = paths[t]
            tree = known[t]
            while level < depth:
                means, _, drop = tree[level]
                low, high = means[node >> max(0, level - drop)]
                low, high = p[level] * low, p[level] * high
                level += 1
                if high > low:
                    push(queue, (-(sure + low + below[level]), t, level, node * 2, sure + low))
                    sure += high
                    node = node * 2 + 1
                else:
                    push(queue, (-(sure + high + below[level]), t, level, node * 2 + 1, sure + high))
                    sure += low
                    node = node * 2
            found.append((t, node))
        return found

    def _as_lists(self):
        if not hasattr(self, "_lists"):
            self._lists = [[(m.tolist(), m.mean(axis=0).tolist(), len(m).bit_length() - 1) for m in tree] for tree in self.means]
        return self._lists


def _ranked(pairs: DataFrame, groups: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from scored pairs (q, gid, score) of groups: the k best other rows of each query."""
    best = W.partitionBy("q").orderBy(F.desc("score"), "gid")
    top = pairs.groupBy("q", "gid").agg(F.max("score").alias("score")).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    wide = top.select("q", "gid", "score").join(groups.select("gid", "ids"), "gid").select("q", "score", F.explode("ids").alias("vec_id"))
    near = wide.withColumn("_r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))).where(F.col("_r") <= k + 1).select("q", "score", "vec_id")
    own = near.join(queries, "q").where(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return own.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _queries(rows: DataFrame, groups: DataFrame, every: int) -> DataFrame:
    """query_id, q: each row whose id is divisible by `every`, with the group of its vector."""
    asked = rows.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), "v", F.xxhash64("v").alias("h"))
    return asked.join(groups.select("h", "v", F.col("gid").alias("q")), ["h", "v"]).select("query_id", "q").distinct()


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by `every`, the k other rows of the largest inner product found.

    A forest is fitted on SAMPLE vectors at most and routes every vector to one leaf of each tree. A query's visits, over
    all trees by one priority queue, go to the tasks of neighbouring leaves, where all candidates are scored exactly in
    double precision and the k + 1 best of each query stay. A vector travels once for each tree; only where a range of
    leaves has many vectors or queries are its members dealt to several tasks, and to as many again as its queries need.
    A query whose leaves hold less than k others visits eight times as many, until it has k or has visited all. Ties go to
    the smaller id. Vectors null, empty, zero, with null
    or non-finite components or of another than the commonest length take no part; with repeated ids, an id appears once
    for each different vector it has. Empty tables and tables of one row give empty results; other columns aren't read.
    """
    rows = _one_length(vectors.select(F.col(vec_id).alias("id"), F.col(vector).alias("v")).where(_usable("v", zero=False)))
    groups = checkpointed(groups_of(rows, k + 1))
    queries = checkpointed(_queries(rows, groups, every))
    sample = _sample(groups)
    if not len(sample):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n = groups.count()
    forest = Forest(sample, n)
    shared, most = vectors.sparkSession.sparkContext.broadcast(forest), forest.visits()
    out = _visited(groups, queries, forest, shared, most, k)
    while most < TREES << forest.depth and n > k:
        out = checkpointed(out)
        short = queries.join(out.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti").select("query_id", "q")
        if short.isEmpty():
            break
        most = min(8 * most, TREES << forest.depth)
        short = checkpointed(short)
        out = out.join(short, "query_id", "left_anti").unionByName(_visited(groups, short, forest, shared, most, k))
    return out


def _visited(groups: DataFrame, queries: DataFrame, forest: Forest, shared, most: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from the `most` leaves that each query visits first."""
    shift = min(forest.depth, TASK_LEVELS)

    def place(batches):
        for batch in batches:
            x = _matrix(batch["v"])
            leaves = shared.value.leaves(x)
            for t in range(TREES):
                yield pa.RecordBatch.from_arrays([pa.array((t << 40) + (leaves[:, t] >> shift)), pa.array(leaves[:, t]), batch["gid"], batch["v"]], names=["task", "leaf", "gid", "v"])

    def ask(batches):
        for batch in batches:
            x = _matrix(batch["v"])
            for a in range(0, len(x), 256):
                out = []
                for i in range(a, min(len(x), a + 256)):
                    by: dict[int, list[int]] = {}
                    for t, leaf in shared.value.search(x[i], most):
                        by.setdefault((t << 40) + (leaf >> shift), []).append(leaf)
                    out += [(task, i, leaves) for task, leaves in by.items()]
                at = pa.array([o[1] for o in out])
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), batch["gid"].take(at), batch["v"].take(at), pa.array([o[2] for o in out], pa.list_(pa.int64()))], names=["task", "q", "v", "leaves"])

    kind = groups.schema["v"].dataType.simpleString()
    placed = groups.select("gid", "v").mapInArrow(place, f"task long, leaf long, gid long, v {kind}")
    asked = groups.join(queries.select(F.col("q").alias("gid")).distinct(), "gid", "left_semi").select("gid", "v")
    visits = checkpointed(asked.mapInArrow(ask, f"task long, q long, v {kind}, leaves array<bigint>"))
    # ranges with many vectors or queries, and the parts they are dealt in
    load = visits.groupBy("task").agg(F.count("*").alias("asking")).join(placed.groupBy("task").agg(F.count("*").alias("held")), "task")
    load = load.select("task", F.ceil(F.col("held") / TASK_ROWS).cast("int").alias("parts"), F.ceil(F.col("asking") / TASK_QUERIES).cast("int").alias("deals"))
    load = checkpointed(load.where("parts > 1 or deals > 1"))
    one_of = lambda column, n: F.pmod(F.xxhash64(column), F.coalesce(n, F.lit(1))).cast("int")
    each_of = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(n, F.lit(1)) - 1))
    members = joined_small(placed, load, ["task"]).withColumn("part", one_of("gid", F.col("parts"))).withColumn("deal", each_of(F.col("deals"))).drop("parts", "deals")
    asking = joined_small(visits, load, ["task"]).withColumn("deal", one_of("q", F.col("deals"))).withColumn("part", each_of(F.col("parts"))).drop("parts", "deals")
    empty = pa.table({"q": pa.array([], pa.int64()), "gid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})

    def meet(held: pa.Table, some: pa.Table) -> pa.Table:
        if not held.num_rows or not some.num_rows:
            return empty
        leaf = held["leaf"].to_numpy()
        order = np.argsort(leaf, kind="stable")
        leaf, x, gid = leaf[order], _matrix(held["v"])[order], held["gid"].to_numpy()[order]
        y, q = _matrix(some["v"]), some["q"].to_numpy()
        lists = some["leaves"].combine_chunks()
        wanted, who = lists.flatten().to_numpy(), np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
        by = np.argsort(wanted, kind="stable")
        wanted, who = wanted[by], who[by]
        left, right = [], []
        edges = np.flatnonzero(np.diff(leaf)) + 1
        for a, b in zip([0, *edges], [*edges, len(leaf)], strict=True):
            own = who[np.searchsorted(wanted, leaf[a]) : np.searchsorted(wanted, leaf[a], "right")]
            step = max(1, (1 << 21) // (b - a))
            for c in range(0, len(own), step):
                i, j = _best_of(y[own[c : c + step]] @ x[a:b].T, k + 1)
                left.append(own[c : c + step][i])
                right.append(a + j)
        if not left:
            return empty
        left, right = np.concatenate(left), np.concatenate(right)
        value = np.concatenate([_products(y[left[c : c + 65_536]], x[right[c : c + 65_536]]) for c in range(0, max(1, len(left)), 65_536)])
        order = np.lexsort((gid[right], -value, left))  # of each query the k + 1 best of this task
        left, right, value = left[order], right[order], value[order]
        keep = np.arange(len(left)) - np.searchsorted(left, left) <= k
        return pa.table({"q": q[left[keep]], "gid": gid[right[keep]], "score": value[keep]})

    pairs = members.groupBy("task", "part", "deal").cogroup(asking.groupBy("task", "part", "deal")).applyInArrow(meet, "q long, gid long, score double")
    return _ranked(pairs, groups, queries, k)


def _best_of(scores: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of each row's k largest scores and whatever equals the last of them but for rounding; of those only from `least` on."""
    n = scores.shape[1]
    last = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    last = last - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(last), last, 0)))
    return np.nonzero(scores >= (last if least is None else np.maximum(last, least))[:, None])


def threshold_search(lists: np.ndarray, order: np.ndarray, query: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) among which are the k best inner products of at least `least`, by Fagin's threshold algorithm.

    lists: vectors; order: for each dimension the rows by falling component. Each list is read from the end where its
    products with the query are largest. All rows met are scored in full; reading stops when a row not met yet, which has
    at most the products of the last entries read, can't reach the kth best score. Steps grow, and equal scores are read on.
    """
    n = len(lists)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met = np.zeros(n, bool)
    rows, scores = [], []
    best = np.full(k, -np.inf)
    best[-1] = least
    depth, step = 0, 8
    if not len(up) and not len(down):
        return np.arange(n), np.zeros(n)
    while depth < n:
        end = min(n, depth + step)
        seen = np.concatenate([order[depth:end, up].ravel(), order[n - end : n - depth, down].ravel()])
        seen = np.unique(seen[~met[seen]])
        met[seen] = True
        value = lists[seen] @ query
        keep = value >= max(best[-1], least)
        rows.append(seen[keep])
        scores.append(value[keep])
        best = -np.sort(-np.concatenate([best, value[keep]]))[:k]
        depth, step = end, step * 2
        last = lists[order[depth - 1, up], up] @ query[up] + lists[order[n - depth, down], down] @ query[down]
        if last < max(best[-1], least):
            break
    return np.concatenate(rows), np.concatenate(scores)


class SortedLists:
    """The vectors of one block, sorted by each component, for Fagin's threshold algorithm on many queries."""

    def __init__(self, rows: np.ndarray):
        self.rows, n = rows, len(rows)
        self.values = np.sort(rows, axis=0)[::-1]
        #: depths at which the bound of what a query hasn't met is known for all queries at once
        self.depths = np.unique(np.minimum(n, FIRST_DEPTH * 2 ** np.arange(0, max(1, math.ceil(math.log2(max(1, n / FIRST_DEPTH)))) + 1)))
        self.order: np.ndarray | None = None

    def best(self, queries: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row, score) with each query's k best inner products of at least its `least`, and what ties with them.

        Each list is read from the end where its products with the query are largest. After the first entries the kth best
        score says how deep all lists have to be read until what they leave can't reach it. Where that is more entries than
        the block has rows, every row is met, and all are scored together; otherwise those met are scored by themselves.
        """
        n = len(self.rows)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        bound = up @ self.values[self.depths - 1].T + down @ self.values[n - self.depths].T
        least = least.copy()
        head = min(n, FIRST_DEPTH)
        if self.order is None:
            self.order = np.argsort(-self.rows, axis=0, kind="stable").astype(np.int32)
        if n > k:
            for i, q in enumerate(queries):
                met = np.unique(np.concatenate([self.order[:head, q > 0].ravel(), self.order[n - head :, q < 0].ravel()]))
                if len(met) >= k:
                    scores = self.rows[met] @ q
                    least[i] = max(least[i], np.partition(scores, len(met) - k)[len(met) - k])
        deep = np.argmax(np.concatenate([bound < least[:, None], np.ones((len(queries), 1), bool)], axis=1), axis=1)
        reads = np.concatenate([self.depths, [n]])[deep] * (queries != 0).sum(axis=1)
        out = []
        dense = np.flatnonzero(reads >= n)
        step = max(1, (1 << 22) // n)
        for a in range(0, len(dense), step):
            some = dense[a : a + step]
            scores = queries[some] @ self.rows.T
            i, j = _best_of(scores, k, least[some])
            out.append((some[i], j, scores[i, j]))
        for i in np.flatnonzero(reads < n):
            j, scores = threshold_search(self.rows, self.order, queries[i], k, least[i])
            out.append((np.full(len(j), i), j, scores))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of floor(scale * component) vectors, exactly.

    Queries are the rows whose id is divisible by `every`, against all rows but themselves. The vectors stay where they
    are, LIST_ROWS of them at a time as sorted lists; ROUND_QUERIES queries at a time are broadcast and run the threshold
    algorithm on every block. A round looks first at about SAMPLE vectors; the (k + 1)th best score that each query found
    there goes to all other blocks, which then stop earlier. Ties go to the smaller id. Vectors null, empty, with null or
    non-finite components or of another than the commonest length take no part; with repeated ids, an id appears once for
    each different vector it has. Empty tables give empty results; other columns aren't read.
    """
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    rows = vectors.select(F.col(vec_id).alias("id"), F.col(vector)).where(_usable(vector, zero=True)).select("id", whole.alias("v"))
    rows = _one_length(rows)
    groups = checkpointed(groups_of(rows, k + 1))
    queries = checkpointed(_queries(rows, groups, every))
    n, n_asked = groups.count(), queries.select("q").distinct().count()
    asked = groups.join(queries.select(F.col("q").alias("gid")).distinct(), "gid", "left_semi").select("gid", "v")
    rounds = math.ceil(n_asked / ROUND_QUERIES)
    if rounds > 1:
        asked = checkpointed(asked)
    draw = F.pmod(F.xxhash64("gid", F.lit(7)), F.lit(1 << 30))
    cut = min(1 << 30, math.ceil(SAMPLE / max(1, n) * (1 << 30)))
    found = []
    for r in range(rounds):
        block = asked.where(F.pmod(F.xxhash64("gid"), F.lit(rounds)) == r).toArrow()
        if not block.num_rows:
            continue
        q, y = block["gid"].to_numpy(), _matrix(block["v"])
        parts = [_searched(groups.where(draw < cut), q, y, np.full(len(q), -np.inf), k)]
        if cut < 1 << 30:
            parts[0] = checkpointed(parts[0])
            last = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "gid"))
            known = dict(map(tuple, parts[0].withColumn("_r", last).where(F.col("_r") == k + 1).select("q", "score").collect()))
            parts.append(_searched(groups.where(draw >= cut), q, y, np.array([known.get(x, -np.inf) for x in q.tolist()]), k))
        pairs = reduce(DataFrame.unionByName, parts)
        if rounds > 1:
            best = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "gid"))
            pairs = checkpointed(pairs.withColumn("_r", best).where(F.col("_r") <= k + 1).drop("_r"))
        found.append(pairs)
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return _ranked(reduce(DataFrame.unionByName, found), groups, queries, k).withColumn("score", F.col("score").cast("long"))


def _searched(groups: DataFrame, q: np.ndarray, y: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
    """(q, gid, score): of each block of groups, the k + 1 best of each query that reach its `least`. No shuffle."""
    shared = groups.sparkSession.sparkContext.broadcast((q, y, least))

    def run(batches):
        held, n = [], 0

        def done():
            whole = pa.Table.from_batches(held)
            gid, x = whole["gid"].to_numpy(), _matrix(whole["v"])
            by = np.argsort(gid)
            gid, lists = gid[by], SortedLists(np.ascontiguousarray(x[by]))
            q, y, least = shared.value
            for a in range(0, len(q), 1024):
                i, j, score = lists.best(y[a : a + 1024], k + 1, least[a : a + 1024])
                order = np.lexsort((gid[j], -score, i))
                i, j, score = i[order], j[order], score[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) <= k
                yield pa.RecordBatch.from_arrays([pa.array(q[a + i[keep]]), pa.array(gid[j[keep]]), pa.array(score[keep])], names=["q", "gid", "score"])

        for batch in batches:
            for start in range(0, batch.num_rows, LIST_ROWS):
                piece = batch.slice(start, LIST_ROWS)
                held.append(piece)
                n += piece.num_rows
                if n >= LIST_ROWS:
                    yield from done()
                    held, n = [], 0
        if n:
            yield from done()

    return groups.select("gid", "v").mapInArrow(run, "q long, gid long, score double")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of embeddings found for each row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best integer inner products of embeddings for each row whose vec_id is divisible by 50."""
    return exact_top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.w, c.w)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
