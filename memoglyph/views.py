"""Deterministic records over the driver's tables, so that operators run on known data without a clock."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

#: All ages count from here: 2024-02-01T00:00:00Z in milliseconds.
AS_OF_MS = 1_706_745_600_000
DAY_MS = 86_400_000

_pick = lambda expr, values: f"CASE {expr} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

#: Column -> expression over documents, in SQL that Spark and DuckDB share.
RECORD_COLUMNS = {
    "num": "doc_id",
    "id": "concat('r', CAST(doc_id AS STRING))",
    "content": "coalesce(text, '')",
    "title": "substr(coalesce(text, ''), 1, 60)",
    "tool": "source",
    "lang": "lang",
    "project": "concat('p', CAST(doc_id % 7 AS STRING))",
    "workspace": "concat('/w/', CAST(doc_id % 3 AS STRING))",
    "session": "concat('s', CAST(CAST(floor(doc_id / 10.0) AS BIGINT) AS STRING))",
    "scope": _pick("doc_id % 7", ["user", "feedback", "project", "reference", "summary", "task", "run"]),
    "source_kind": _pick("doc_id % 8", ["writeback", "session", "hook", "blackboard", "run", "cron", "task", "event"]),
    "memory_level": _pick("CAST(floor(doc_id / 7.0) AS BIGINT) % 4", ["durable", "session", "event", "task"]),
    "type": _pick("doc_id % 5", ["preference", "workflow-rule", "project-context", "reference", "summary"]),
    "task_state": _pick("doc_id % 7", ["processing", "ok", "failed", "", "completed", "pending", "timeout"]),
    "tier": "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 5 + 1 AS INT) END",
    "t_ms": "CAST(1706745600000 - ((doc_id * 37) % 120) * 86400000 - (doc_id % 24) * 3600000 AS BIGINT)",
    "access_ms": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1706745600000 - ((doc_id * 13) % 90) * 86400000 AS BIGINT) END",
    "expires_ms": "CASE WHEN doc_id % 3 = 1 THEN NULL ELSE CAST(1706745600000 - ((doc_id * 41) % 100) * 86400000 + 40 * CAST(86400000 AS BIGINT) AS BIGINT) END",
    "access_count": "CAST((doc_id * 7) % 30 AS INT)",
    "promotion_count": "CAST(doc_id % 4 AS INT)",
    "cross_refs": "CAST(doc_id % 6 AS INT)",
    "confidence": "((doc_id * 17) % 101) / CAST(100 AS DOUBLE)",
    "source_confidence": "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE ((doc_id * 29) % 101) / CAST(100 AS DOUBLE) END",
    "freshness_score": "((doc_id * 53) % 997) / CAST(997 AS DOUBLE)",
    "archived": "doc_id % 13 = 0",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, "doc_id") if name == "documents" else df


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to all cores where its files give fewer tasks, as a file of one row group does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document; see RECORD_COLUMNS."""
    return table(spark, sf_dir, "documents").selectExpr(*(f"{e} AS {c}" for c, e in RECORD_COLUMNS.items()))


#: The same records for DuckDB: WITH {RECORDS_SQL} SELECT ... FROM records.
RECORDS_SQL = "records AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in RECORD_COLUMNS.items()) + " FROM documents)"


def signature(spark: SparkSession, sf_dir: str, *names: str) -> str:
    """A name for the present state of tables: a digest of their paths, sizes, numbers of files and times of change."""
    parts = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        size = fs.getContentSummary(path)
        parts += [path.toString(), size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()]
    return hashlib.sha1("|".join(map(str, parts)).encode()).hexdigest()[:20]
