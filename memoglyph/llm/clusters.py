"""Centroid clustering by dual-tree Lloyd, exact in integers.

The vectors of a task are cut into blocks, each with a cover tree that is built once and written with the block; no
vector moves. In each round the centroids get a cover tree of their own, and a block's tree descends together with it: a pair
of nodes goes when even its nearest members are farther apart than the farthest that a vector there can have its nearest
centroid. Pairs of single vectors and centroids are compared exactly. Only counts and sums of clusters leave a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from memoglyph.llm.common import checkpointed, give_back, table

DIMS, CLUSTERS, ROUNDS = 64, 40, 5
#: Vectors of a block, and pairs whose distances are taken at once.
BLOCK, AT_ONCE = 2048, 16_384
#: Integer components up to here have squared distances that fit in 64 bits.
LARGEST = 1 << 27


def whole_vectors(embeddings: DataFrame, vector: str = "embedding", dims: int = DIMS) -> DataFrame:
    """vec_id and q, the components as floor(256 * x), of vectors with exactly dims components that are finite.

    Null vectors, other lengths and vectors with a null, NaN or infinite component take no part; neither does one with a
    component beyond LARGEST / 256, whose distances no long holds.
    """
    x = F.col(vector).cast("array<double>")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) <= LARGEST / 256))
    return embeddings.where(F.col(vector).isNotNull() & (F.size(vector) == dims)).where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * 256).cast("int")).alias("q"))


class CoverTree:
    """A compressed cover tree: each point is one node; a node's children lie within twice the scale at which they came.

    Nodes are numbered as they were made, parents first. radius is the distance of a node to its farthest descendant.
    """

    def __init__(self, points: np.ndarray, parent: np.ndarray | None = None, radius: np.ndarray | None = None, order: np.ndarray | None = None):
        if parent is None:
            order, parent = self._made(points.astype(float))
            points = points[order]
        self.points, self.parent, self.order = points, parent, order
        self.radius = self._radii() if radius is None else radius
        n = len(parent)
        children = np.argsort(parent[1:], kind="stable") + 1
        self.n_children = np.bincount(parent[1:], minlength=n)
        self.first = np.concatenate([[0], np.cumsum(self.n_children)])
        self.children = children

    @staticmethod
    def _made(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(x)
        x = x - x[0]
        square = (x * x).sum(1)
        apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (x @ x.T), 0))
        nearest, near = apart[0].copy(), np.zeros(n, np.int64)
        made, number, above = [0], np.full(n, -1), [0]
        number[0] = 0
        nearest[0] = -1
        scale = nearest.max()
        while len(made) < n:
            scale /= 2
            before = near.copy()
            left = np.flatnonzero(nearest > scale) if scale >= 0.5 else np.flatnonzero(nearest >= 0)
            while len(left):
                p = left[nearest[left].argmax()]
                above.append(number[before[p]])
                number[p] = len(made)
                made.append(p)
                closer = apart[p] < nearest
                near[closer], nearest[closer] = p, apart[p][closer]
                nearest[p] = -1
                left = left[(nearest[left] > scale) if scale >= 0.5 else (nearest[left] >= 0)]
        return np.array(made), np.array(above)

    def _radii(self) -> np.ndarray:
        radius = np.zeros(len(self.parent))
        at, up = np.arange(1, len(self.parent)), self.parent[1:]
        while len(at):
            np.maximum.at(radius, up, np.sqrt(((self.points[at] - self.points[up]).astype(float) ** 2).sum(1)))
            at, up = at[up > 0], self.parent[up[up > 0]]
        return radius

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many parts each node falls into (itself alone, and its children), and where they begin in _part."""
        single = nodes >= len(self.parent)
        return np.where(single, 1, self.n_children[np.where(single, 0, nodes)] + 1), single

    def part(self, nodes: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th part of each node; numbers from n on are single points."""
        n = len(self.parent)
        lone = (nodes >= n) | (k == 0)
        child = self.children[np.where(lone, 0, self.first[np.where(lone, 0, nodes)] + k - 1)] if n > 1 else np.zeros(len(nodes), np.int64)
        return np.where(lone, np.where(nodes >= n, nodes, nodes + n), child)


def nearest(vectors: CoverTree, centroids: CoverTree) -> tuple[np.ndarray, np.ndarray, int]:
    """For each point of vectors the number of its nearest centroid (ties: smaller number) and the squared distance, exactly.

    Numbers are those of the points that centroids was made from. Also how many distances were taken.
    """
    n, m, taken = len(vectors.parent), len(centroids.parent), 0
    a, b = np.zeros(1, np.int64), np.zeros(1, np.int64)
    reach = np.full(2 * n, np.inf)
    radii = [np.concatenate([t.radius, np.zeros(len(t.parent))]) for t in (vectors, centroids)]
    x, y = vectors.points.astype(float), centroids.points.astype(float)
    while True:
        apart = np.empty(len(a))
        for i in range(0, len(a), AT_ONCE):
            s = slice(i, i + AT_ONCE)
            apart[s] = np.sqrt(((x[a[s] % n] - y[b[s] % m]) ** 2).sum(1))
        taken += len(a)
        ra, rb = radii[0][a], radii[1][b]
        np.minimum.at(reach, a, apart + ra)
        keep = apart - ra - rb <= reach[a] + 1e-9 * (apart + ra + rb + reach[a])  # the slack covers rounding
        a, b = a[keep], b[keep]
        if (a >= n).all() and (b >= m).all():
            break
        (na, _), (nb, _) = vectors.below(a), centroids.below(b)
        parts = na * nb
        pair = np.repeat(np.arange(len(a)), parts)
        k = np.arange(len(pair)) - np.repeat(np.cumsum(parts) - parts, parts)
        to = vectors.part(a[pair], k // nb[pair])
        np.minimum.at(reach, to, reach[a[pair]])
        a, b = to, centroids.part(b[pair], k % nb[pair])
    a, b = a - n, b - m
    number = centroids.order[b]
    exact = np.empty(len(a), np.int64)
    for i in range(0, len(a), AT_ONCE):
        s = slice(i, i + AT_ONCE)
        exact[s] = ((vectors.points[a[s]].astype(np.int64) - centroids.points[b[s]]) ** 2).sum(1)
    taken += len(a)
    best = np.lexsort((number, exact, a))
    best = best[np.concatenate([[True], a[best][1:] != a[best][:-1]])]
    return number[best], exact[best], taken


BLOCKS = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("points", T.ArrayType(T.IntegerType())), T.StructField("parent", T.ArrayType(T.IntegerType())), T.StructField("radius", T.ArrayType(T.DoubleType()))])


def blocks(vectors: DataFrame, dims: int = DIMS, size: int = BLOCK) -> DataFrame:
    """The vectors in blocks of up to `size`, a row each, with their cover trees; vectors stay in their tasks."""

    def run(batches):
        ids, points, n = [], [], 0

        def made(ids, points):
            tree = CoverTree(points)
            row = [pa.array([c], t) for c, t in ((ids[tree.order].tolist(), pa.list_(pa.int64())), (tree.points.ravel(), pa.list_(pa.int32())), (tree.parent, pa.list_(pa.int32())), (tree.radius, pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays(row, names=BLOCKS.names)

        for batch in batches:
            ids.append(np.array(batch.column(0).to_pylist(), object))
            points.append(batch.column(1).flatten().to_numpy().reshape(-1, dims))
            n += batch.num_rows
            if n >= size:
                all_ids, all_points = np.concatenate(ids), np.concatenate(points)
                for i in range(0, n - n % size, size):
                    yield made(all_ids[i : i + size], all_points[i : i + size])
                ids, points, n = [all_ids[n - n % size :]], [all_points[n - n % size :]], n % size
        if n:
            yield made(np.concatenate(ids), np.concatenate(points))
        give_back()

    return vectors.mapInArrow(run, BLOCKS)


def _trees(batches, dims: int):
    for batch in batches:
        for ids, points, parent, radius in zip(*(batch.column(i) for i in range(4))):
            yield ids, CoverTree(points.values.to_numpy().reshape(-1, dims), parent.values.to_numpy().astype(np.int64), radius.values.to_numpy())


def sums(made: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Cluster -> number and componentwise sum of its vectors; a task sends a row for each of its clusters."""
    k, dims = centroids.shape
    names = ["cluster", "n", *(f"c{i}" for i in range(dims))]

    def run(batches):
        tree, count, total = CoverTree(centroids), np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, vectors in _trees(batches, dims):
            cluster, _, _ = nearest(vectors, tree)
            order = np.argsort(cluster, kind="stable")
            found, starts = np.unique(cluster[order], return_index=True)
            total[found] += np.add.reduceat(vectors.points[order].astype(np.int64), starts)
            count += np.bincount(cluster, minlength=k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (some, count[some], *total[some].T)], names=names)
        give_back()

    summed = made.mapInArrow(run, ", ".join(f"{c} long" for c in names)).groupBy("cluster").agg(*(F.sum(c).alias(c) for c in names[1:]))
    return {r["cluster"]: (r["n"], list(r[2:])) for r in summed.collect()}  # a row a cluster


def assigned(made: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance (squared) of each vector of blocks()."""
    dims = centroids.shape[1]

    def run(batches):
        tree = CoverTree(centroids)
        for ids, vectors in _trees(batches, dims):
            cluster, distance, _ = nearest(vectors, tree)
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        give_back()

    return made.mapInArrow(run, "vec_id long, cluster int, distance long")


def lloyd(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: str = "2:", dims: int = DIMS) -> tuple[DataFrame, np.ndarray]:
    """Vectors (vec_id, q) with their clusters after `rounds` rounds, and the k final centroids (k rows are all that the driver gets).

    The first centroids are the vectors whose SHA-256 of seed and vec_id are smallest, fewer than k if there are fewer; ties
    (repeated ids) go by components, and a vector without an id is never one, but belongs to a cluster. Repeated rows
    count as often as they stand. A new centroid is the floor of the mean; one without vectors stays. No vectors, or none with
    an id, give no rows.
    """
    made = checkpointed(blocks(vectors, dims))
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    begin = vectors.where("vec_id IS NOT NULL").orderBy(order, "q").limit(k).select("q").collect()
    centroids = np.array([r["q"] for r in begin], np.int64).reshape(len(begin), dims)
    if not len(centroids):
        return assigned(made.limit(0), np.zeros((1, dims), np.int64)), centroids
    for _ in range(rounds):
        for cluster, (n, total) in sums(made, centroids).items():
            centroids[cluster] = [s // n for s in total]
    return assigned(made, centroids), centroids


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 40 clusters: vec_id, cluster, distance, inertia of the cluster and of all (null beyond 64 bits), centroid's digest."""
    found, centroids = lloyd(whole_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding")))
    found = checkpointed(found)
    inertia = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()}  # a row a cluster
    whole = sum(inertia.values()) if None not in inertia.values() else None
    whole = whole if whole is not None and whole < 1 << 63 else None
    rows = [(c, s, whole, hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(k: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """DuckDB SQL of op12_clusters(): the same rounds, each against all centroids."""
    parts = [
        f"v0 AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS})",
        "v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(e, lambda x: floor(256 * x)) AS q FROM v0)",
        f"m0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256(concat('2:', vec_id)), q) - 1 AS INT) AS cluster, q FROM v WHERE vec_id IS NOT NULL QUALIFY cluster < {k})",
    ]
    near = lambda r: f"SELECT v.id, v.vec_id, v.q, m.cluster, CAST(list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, m.q) + list_inner_product(m.q, m.q) AS BIGINT) AS distance FROM v, m{r} AS m QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY distance, m.cluster) = 1"
    for r in range(rounds):
        parts += [
            f"a{r} AS MATERIALIZED ({near(r)})",
            f"s{r} AS (SELECT cluster, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT cluster, unnest(q) AS x, generate_subscripts(q, 1) AS i FROM a{r}) GROUP BY cluster, i)",
            f"f{r} AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS q FROM s{r} GROUP BY cluster)",
            f"m{r + 1} AS MATERIALIZED (SELECT m.cluster, coalesce(f.q, m.q) AS q FROM m{r} AS m LEFT JOIN f{r} AS f ON f.cluster = m.cluster)",
        ]
    parts.append(f"last AS MATERIALIZED ({near(rounds)})")
    sha = "sha256(array_to_string(list_transform(m.q, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','))"
    return f"WITH {', '.join(parts)} SELECT vec_id, cluster, distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia, {sha} AS centroid_sha256 FROM last JOIN m{rounds} AS m USING (cluster)"


ORACLE_SQL = oracle()
