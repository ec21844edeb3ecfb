"""Line-delimited JSON and text: readers, lookups, appends, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from memoglyph.schema import RECORD


def read(spark: SparkSession, path: str | list[str], schema: str = RECORD, keep_malformed: bool = False) -> DataFrame:
    """Records of JSON lines, with the file in layer_file. Malformed lines are left out, or kept with _corrupt set."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("layer_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = lines.select(F.from_json("value", schema, options).alias("r"), "layer_file").select("r.*", "layer_file")
    return rows if keep_malformed else rows.where(F.col("_corrupt").isNull()).drop("_corrupt")


def malformed(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """layer_file, n of lines that aren't JSON objects (blank lines aside)."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("layer_file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    bad = F.schema_of_variant(F.try_parse_json("value")).isNull() | ~F.trim("value").startswith("{")
    return lines.groupBy("layer_file").agg(F.count_if(bad).alias("n"))


def layers(spark: SparkSession, paths: list[str], last_wins: bool = False) -> DataFrame:
    """Several layer files, in their order, as one: the first (or last) row of an id stays."""
    order = F.create_map(*(x for i, p in enumerate(paths) for x in (F.lit(p.rsplit("/", 1)[-1]), F.lit(i))))
    rows = read(spark, paths).withColumn("layer_ord", order[F.col("layer_file")]).withColumn("_line", F.monotonically_increasing_id())
    place = (F.desc("layer_ord"), F.desc("_line")) if last_wins else ("layer_ord", "_line")
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*place))).where("_n = 1").drop("_n", "_line")


def point(df: DataFrame, id_: str) -> DataFrame:
    """The row of one id; the filter reaches the scan."""
    return df.where(F.col("id") == id_)


def prefix(df: DataFrame, start: str) -> DataFrame:
    return df.where(F.col("id").startswith(start))


def in_order(df: DataFrame, ids: list[str]) -> DataFrame:
    """The rows of the ids, in the order asked for, with its place."""
    asked = df.sparkSession.createDataFrame(list(enumerate(ids)), "place int, id string")
    return F.broadcast(asked).join(df, "id").orderBy("place")


def in_batches(df: DataFrame, handle, schema: str, size: int = 100) -> DataFrame:
    """handle(frame) over consecutive rows, `size` at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), size):
                yield handle(rows.iloc[i : i + size])

    return df.mapInPandas(run, schema)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_new(df: DataFrame, path: str, key: str = "id") -> None:
    """Appends the rows whose key isn't stored, each key once."""
    spark = df.sparkSession
    once = df.dropDuplicates([key])
    try:
        stored = spark.read.schema(f"{key} string").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        stored = None
    (once if stored is None else once.join(stored.select(key), key, "left_anti")).write.mode("append").json(path)


def remove(spark: SparkSession, path: str, out: str, condition) -> None:
    """The lines of path that don't meet the condition, as they are, written to out (a store's files are replaced, not edited).

    Malformed lines, and those for which the condition isn't known, stay.
    """
    lines = spark.read.text(path).select("value", F.from_json("value", RECORD).alias("_r")).select("value", "_r.*")
    lines.where(~F.coalesce(condition, F.lit(False))).select("value").write.mode("overwrite").text(out)


def snapshot(df: DataFrame, path: str, key: str = "id") -> None:
    """df ordered by its key, replacing what is there; a range partitioning sorts without a single task."""
    df.repartitionByRange(F.col(key)).sortWithinPartitions(key).write.mode("overwrite").json(path)


def daily_logs(df: DataFrame, path: str, t: str = "t", days: list[str] | None = None) -> None:
    """Records appended under year, month and date, only those of the given days."""
    day = F.substring(t, 1, 10)
    rows = df.withColumn("year", F.substring(t, 1, 4)).withColumn("month", F.substring(t, 6, 2)).withColumn("date", day)
    (rows.where(day.isin(days)) if days else rows).write.mode("append").partitionBy("year", "month", "date").json(path)


def migrate_store(spark: SparkSession, old: str, new: str) -> None:
    spark.read.text(old).write.mode("overwrite").text(new)
