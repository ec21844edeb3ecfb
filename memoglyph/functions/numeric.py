"""Decay, rounding, percentiles by index, vectors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from memoglyph.functions.text import let

DAY_MS = 86_400_000
#: Dimension of the hashed embedding.
HASH_DIMENSIONS = 384
_EIGHT = Decimal("1e-8")
#: Rows whose vectors are counted at once.
ROWS = 2000


def decay(age_days: Column, half_life: float) -> Column:
    """0.5 ** (age / half life); a negative age or a null one doesn't decay, nor does a half life of 0 or less."""
    if half_life <= 0:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), F.greatest(F.coalesce(age_days, F.lit(0.0)), F.lit(0.0)) / half_life)


def round_half_up(x: Column, digits: int = 4) -> Column:
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def iso_ms(x: Column) -> Column:
    """Milliseconds of an ISO-8601 text, null if it isn't one."""
    return F.unix_millis(F.try_to_timestamp(x))


def value_at(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of an array, sorted; the last one if that is beyond it."""
    s = F.sort_array(values)
    return F.element_at(s, F.least(F.floor(F.size(s) * F.lit(share)).cast("int") + 1, F.size(s)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 for unequal lengths, zero norms and results that aren't finite."""
    value = F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
    return F.when((F.size(a) == F.size(b)) & value.isNotNull() & ~F.isnan(value) & (F.abs(value) <= 2), value).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def hash_embedding(features: Column, hashed, dimensions: int = HASH_DIMENSIONS) -> Column:
    """L2-normalised signed counts of hashed features; hashed maps a feature column to its 32-bit hash."""
    slot_of = lambda h: F.struct((h % dimensions).cast("int").alias("slot"), F.when(F.shiftright(h, 1) % 2 == 0, 1.0).otherwise(-1.0).alias("sign"))
    signed = F.transform(F.transform(features, hashed), slot_of)
    sums = let(signed, lambda rows: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.aggregate(F.filter(rows, lambda s: s["slot"] == i), F.lit(0.0), lambda a, s: a + s["sign"])))
    norm_of = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return let(sums, lambda v: let(norm_of(v), lambda norm: F.when(norm > 0, F.transform(v, lambda x: F.round(x / norm, 8))).otherwise(v)))


def hash_embeddings(df: DataFrame, hashed: Callable[[pa.ListArray], pa.ListArray], dimensions: int = HASH_DIMENSIONS) -> DataFrame:
    """id, embedding of rows (id, features): hash_embedding() in one Arrow pass; hashed maps lists of features to 32-bit hashes.

    The work of a row grows with its features, not with their product with the dimensions.
    """

    def counted(lists: pa.ListArray) -> pa.ListArray:
        n, gone = len(lists), pc.is_null(lists).to_numpy(zero_copy_only=False)
        lists = hashed(lists)
        h, row = lists.flatten().to_numpy(), pc.list_parent_indices(lists).to_numpy()
        sums = np.bincount(row * dimensions + h % dimensions, weights=1.0 - 2.0 * (h >> 1 & 1), minlength=n * dimensions).astype(float)
        at = np.flatnonzero(sums)
        squares = np.bincount(at // dimensions, weights=sums[at] ** 2, minlength=n)[at // dimensions]
        # pairs of a count and a sum of squares are few; each is rounded as Spark rounds, half away from zero in decimals
        pairs, which = np.unique(sums[at] + 1j * squares, return_inverse=True)
        rounded = [float(Decimal(repr(float(p.real / math.sqrt(p.imag)))).quantize(_EIGHT, ROUND_HALF_UP)) for p in pairs]
        sums[at] = np.array(rounded)[which]
        offsets = pa.array(np.arange(n + 1, dtype=np.int32) * dimensions)
        return pa.ListArray.from_arrays(offsets, pa.array(sums, mask=np.repeat(gone, dimensions)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                ids, lists = batch.slice(at, ROWS).columns
                yield pa.RecordBatch.from_arrays([ids, counted(lists)], names=["id", "embedding"])

    schema = T.StructType([df.schema["id"], T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.select("id", "features").mapInArrow(run, schema)
