"""Point lookups that open a part of one file: rows range-partitioned and sorted by key, with bounds of each file beside them.

A lookup reads the bounds (a row a file), opens the files whose range holds a key asked for, and in them the row groups that
may hold it: sorted row groups by their least and greatest key, other columns by Bloom filters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from memoglyph.sources.commits import Store

#: Bytes of a row group: small ones leave more out, large ones compress better.
GROUP_BYTES = 8 << 20
#: Keys of one lookup up to which files are chosen on the driver; beyond, keys are joined.
MOST_KEYS = 1000


class Lookup:
    """Rows by key, in a folder. Null keys are kept and never found."""

    def __init__(self, spark: SparkSession, path: str, key: str = "id"):
        self.store, self.key = Store(spark, path), key

    def build(self, df: DataFrame, blooms: tuple[str, ...] = (), group_bytes: int = GROUP_BYTES, files: int | None = None) -> int:
        """Replaces the rows, as one version. blooms: other columns that are looked up by value.

        The ranges come from Spark's sample of the keys; rows of one key may fill several files, all of which are opened.
        """
        ranges = (files, F.col(self.key)) if files else (F.col(self.key),)
        options = {"parquet.block.size": str(group_bytes)} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in blooms}
        version = self.store.commit({"rows": df.repartitionByRange(*ranges).sortWithinPartitions(self.key)}, replace=True, options=options)
        rows = self.store.read("rows", version).select(F.col("_metadata.file_path").alias("file"), F.col(self.key).alias("key"))
        bounds = rows.groupBy("file").agg(F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n"))
        return self.store.commit({"bounds": bounds.withColumn("version", F.lit(version))}, replace=True, expect=version)

    def files(self, keys: list) -> list[str]:
        """The files that may hold one of the keys."""
        asked = self.store.spark.createDataFrame([(k,) for k in keys], self._kind())
        bounds = self.store.read("bounds")
        return [r["file"] for r in bounds.join(F.broadcast(asked), F.col("_asked").between(F.col("least"), F.col("most")), "left_semi").select("file").collect()]

    def _kind(self) -> str:
        return f"_asked {self.store.read('rows').schema[self.key].dataType.simpleString()}"

    def get(self, keys: list) -> DataFrame:
        """The rows of the keys, from the files that may hold them; more than MOST_KEYS keys are joined to all rows instead."""
        keys = list(dict.fromkeys(k for k in keys if k is not None))
        rows = self.store.read("rows")
        if len(keys) > MOST_KEYS:
            asked = self.store.spark.createDataFrame([(k,) for k in keys], self._kind())
            return rows.join(asked, F.col(self.key) == F.col("_asked"), "left_semi")
        files = self.files(keys) if keys else []
        if not files:
            return rows.where("false")
        return self.store.spark.read.schema(rows.schema).parquet(*files).where(F.col(self.key).isin(keys))

    def where(self, column: str, value) -> DataFrame:
        """The rows of a value of another column; row groups whose Bloom filter rules it out aren't read."""
        return self.store.read("rows").where(F.col(column) == F.lit(value))
