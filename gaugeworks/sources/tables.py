"""Sources by name and sinks: files of a folder, JDBC tables, and the writers of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, path: str, kind: str = "parquet", **options) -> Callable[[str], DataFrame]:
    """Tables that are files `name.kind` in one folder."""
    return lambda name: spark.read.options(**options).format(kind).load(f"{path.rstrip('/')}/{name}.{kind}")


def jdbc(spark: SparkSession, url: str, **options) -> Callable[[str], DataFrame]:
    """Tables of a database; pass partitionColumn, bounds and numPartitions to read in parallel."""
    return lambda name: spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def registered(spark: SparkSession) -> Callable[[str], DataFrame]:
    """Tables and views of the session's catalog."""
    return spark.table


def capped(df: DataFrame, n: int) -> tuple[list, bool]:
    """At most n rows for a caller, and whether there were more."""
    rows = df.limit(n + 1).collect()
    return rows[:n], len(rows) > n


def schema_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema]


def write(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    out = df.write.mode(mode).format(kind)
    (out.partitionBy(*partition_by) if partition_by else out).save(path)


def ledger_window(df: DataFrame, clock: str, start: str, end: str, path: str) -> None:
    """Requests of [start, end) in time order, as CSV files whose names keep the order."""
    from pyspark.sql import functions as F

    inside = (F.col(clock) >= F.lit(start).cast("timestamp")) & (F.col(clock) < F.lit(end).cast("timestamp"))
    df.where(inside).orderBy(clock).write.mode("overwrite").option("header", True).csv(path)


def catalog_facts(spark: SparkSession, table: str) -> dict[str, str]:
    """What the catalog knows of a table without a scan: statistics, comment, partition columns, location."""
    rows = spark.sql(f"describe table extended {table}").collect()
    facts = {r["col_name"].strip(): (r["data_type"] or "").strip() for r in rows if r["col_name"]}
    wanted = ("Statistics", "Comment", "Location", "Provider", "Created Time", "Type")
    columns = [r["col_name"] for r in rows[: next((k for k, r in enumerate(rows) if not r["col_name"] or r["col_name"].startswith("#")), len(rows))]]
    return {k: facts[k] for k in wanted if k in facts} | {"columns": ", ".join(columns)}
