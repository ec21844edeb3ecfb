"""Shared pieces of the training-data operators: Arrow passes, checkpoints, labelled samples, vectorised text hashing."""

from __future__ import annotations

import tempfile
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: A piece of an Arrow batch that a pass handles at once, in bytes; arrays made of it take a few dozen times as much.
PIECE_BYTES = 2 << 20
#: Bytes after which Spark ends an Arrow batch.
BATCH_BYTES = 4 << 20
#: The characters of a word: anything but space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others are never read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def pieces(batch: pa.RecordBatch, most: int = PIECE_BYTES):
    """Consecutive slices of batch of about `most` bytes; a longer row makes a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, n * most // max(most, batch.nbytes))
    for i in range(0, n, step):
        piece = batch.slice(i, step)
        if step > 1 and piece.nbytes > 2 * most:
            yield from pieces(piece, most)
        else:
            yield piece


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Arrow batches of its session ending at BATCH_BYTES, unless the session has a limit of its own.

    Each task has a batch whole, in the JVM, where its buffers double as they grow, and in Python; by Spark's own limit that is 64 MB.
    """
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in conf.getAll:
        conf.set(key, str(BATCH_BYTES))
    return df


def arrow_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with `fields` added by one Arrow pass, without a shuffle.

    make() is called once a task and returns a function from the input arrays to the new arrays.
    A column of df that has the name of a new one is replaced.
    """
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c not in new]
    both = [*kept, *(c for c in dict.fromkeys(inputs) if c not in kept)]
    source = df.select(*(F.col(f"`{c}`") for c in both))
    at, n_kept = [both.index(c) for c in inputs], len(kept)
    schema = T.StructType([*(source.schema[c] for c in kept), *fields])
    names = schema.names

    def run(batches):
        step = make()
        for batch in batches:
            for piece in pieces(batch):
                made = step(*(piece.column(i) for i in at))
                yield pa.RecordBatch.from_arrays([*piece.columns[:n_kept], *made], names=names)

    return small_batches(source).mapInArrow(giving_back(run), schema)


def give_back() -> None:
    """Returns to the system what arrays and objects of this process took."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # trims the heap that Python's and numpy's objects were on


def giving_back(run):
    """A pass over batches that returns its memory to the system in the end: Python workers outlive tasks and stages.

    What it needs is named by module-level functions, which travel to tasks by name: a global that holds data would
    travel with the function as the driver has it.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def fitting(fit):
    """A fit on the driver that returns the memory of its sample to the system in the end: the driver's Python outlives it."""

    @wraps(fit)
    def whole(*args, **kwargs):
        try:
            return fit(*args, **kwargs)
        finally:
            give_back()

    return whole


def checkpointed(df: DataFrame) -> DataFrame:
    """df, computed once and cut from its lineage in the folder of spark.checkpoint.dir.

    The session's setting is used; where it has none, a local master gets a temporary folder, and a cluster an error, as
    its executors share no local folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        set_to = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not set_to and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(set_to or tempfile.mkdtemp(prefix="memoglyph-"))
    return df.checkpoint(eager=True)


def free_names(columns: list[str]) -> str:
    """A beginning that no column name has in any case, for internal names beside them."""
    start = "_own"
    while any(c.lower().startswith(start) for c in columns):
        start += "_"
    return start + "_"


#: Rows up to which a table of a few short columns is broadcast; copies of a larger one that a key's rows are dealt to.
BROADCAST_ROWS, SALTS = 100_000, 16
#: Rows of one key beyond which they don't go to one task.
HOT = 1000


def joined_small(df: DataFrame, found: DataFrame, on: list[str], how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined (inner or left) with a checkpointed table of short rows, without bringing all rows of a key to one task.

    Up to `most` rows are broadcast; a larger table is copied SALTS times, and the rows of a key are dealt to the copies.
    """
    if found.limit(most + 1).count() <= most:
        return df.join(F.broadcast(found), on, how)
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = df.withColumn("_salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    return dealt.join(copies, [*on, "_salt"], how).drop("_salt")


def joined_hot(df: DataFrame, found: DataFrame, key: str, most: int = BROADCAST_ROWS) -> DataFrame:
    """df joined (inner) with found, which has a row for each key at most; a key of more than HOT rows isn't one task's.

    Both are read more than once, so they should be checkpointed.
    """
    hot = checkpointed(df.groupBy(key).count().where(F.col("count") > HOT).select(key))
    if hot.isEmpty():
        return df.join(found, key)
    marked = joined_small(df, hot.withColumn("_hot", F.lit(True)), [key])
    some = joined_small(marked.where("_hot").drop("_hot"), checkpointed(joined_small(found, hot, [key], "inner")), [key], "inner", most)
    return marked.where("_hot IS NULL").drop("_hot").join(found, key).unionByName(some)


def remainder(column: str, parts: int):
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def is_held_out(column: str, parts: int, which: int):
    """Whether an id's remainder is the one that no model learns from; an id that is null is held out."""
    return F.coalesce(remainder(column, parts) == which, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, parts: int = 4, held_out: int = 2) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Whole texts and 0/1 labels of at most per_class documents of each class, none held out, and the weight of each.

    Taken by the order of a hash of the id. Only ids travel to choose them, then 2 * per_class rows at most reach the
    driver. The weights give each class its share of all labels that may be learnt from. A document with several labels
    has the largest; null labels and ids count as none.
    """
    may = F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out("doc_id", parts, held_out)
    one = labels.select("doc_id", label).where(may).groupBy("doc_id").agg(F.max((F.col(label) > 0).cast("int")).alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    zero, some = (one.where(F.col("y") == y).orderBy(*order).limit(per_class) for y in (0, 1))
    chosen = zero.unionByName(some)
    own = docs.select("doc_id", "text").where(F.col("text").isNotNull())  # without columns that could clash
    got = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").dropDuplicates(["doc_id"]).toArrow()
    rows = sorted(zip(got["doc_id"].to_pylist(), got["y"].to_pylist(), got["text"].to_pylist(), strict=True))
    y = np.array([r[1] for r in rows], dtype=np.int64)
    shares = {r["y"]: r["count"] for r in one.groupBy("y").count().collect()}
    weight = np.array([shares[k] / max(1, (y == k).sum()) for k in y.tolist()], dtype=float)
    return [r[2] for r in rows], y, weight / weight.mean() if len(weight) else weight


def logistic(features: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, steps: int = 60, prior=0.0) -> np.ndarray:
    """Weights, the bias last, of a logistic regression by Newton's method; one class alone gives its smoothed share.

    The ridge draws the weights to `prior`, which those of features that never occur keep.
    """
    n, d = features.shape
    x = np.hstack([features, np.ones((n, 1))])
    w = np.zeros(d + 1)
    w[:-1] = prior
    aim = w.copy()
    if n == 0:
        return w
    weight = np.ones(n) if weight is None else weight
    share = ((weight * y).sum() + 1) / (weight.sum() + 2)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    ridge = np.full(d + 1, l2 * n)
    ridge[-1] = 1e-9 * n
    for _ in range(steps):
        p = sigmoid(x @ w)
        slope = x.T @ (weight * (p - y)) + ridge * (w - aim)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        step *= min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def string_buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string array and the n + 1 offsets into them; a null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    array = array.cast(pa.large_string())
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[array.offset : array.offset + len(array) + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        h = h ^ (h >> np.uint64(32))
        h = h * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_POWERS.get(kind, ())) < n:
        base = np.full(max(n, 1 << 16), _BASE if kind == "up" else _BASE_INVERSE, dtype=np.uint64)
        base[0] = 1
        with np.errstate(over="ignore"):
            _POWERS[kind] = np.cumprod(base)
    return _POWERS[kind][:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of each text, in order, and the n + 1 offsets into them; A-Z count as a-z if lower.

    A word's hash is a polynomial of its bytes modulo 2**64, read from prefix sums, so no word is handled by itself.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    hashes, starts, _, _ = word_spans(raw, offsets[1:-1], lower)
    return hashes, np.searchsorted(starts, offsets).astype(np.int64)


def word_spans(raw: np.ndarray, edges: np.ndarray | None = None, lower: bool = True):
    """(hashes, starts, ends, prefix) of the words of UTF-8 bytes; edges are further places where a word ends.

    prefix(starts, k) hashes the first k bytes of the words at starts; of a whole word it is the word's hash.
    """
    if lower:
        raw = raw + (((raw >= 65) & (raw <= 90)).view(np.uint8) << np.uint8(5))
    inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    if edges is not None:
        edges = edges[edges < len(raw)]
        first[edges] |= inside[edges]
        before = edges[edges > 0] - 1
        last[before] |= inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers("up", len(raw)), out=sums[1:])

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mixed((sums[b] - sums[a]) * _powers("down", len(raw))[a])

    return between(starts, ends), starts, ends, lambda at, k: between(at, at + k)
