"""All registered queries of the engine, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


#: Bytes for each core up to which a table is dealt to all cores; a larger one has splits enough.
SPREAD_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one of texts that is so small that its scan would be a task or two is dealt to all cores. So is any part
    table: its rows are a few bytes each, of which records with long bodies are made."""
    read = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name == "part" or name in ("documents", "pages") and int(str(read._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= cores * SPREAD_BYTES:
        return read.repartition(cores)
    return read


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files. Its path is written as a pattern, for a stream takes no path of a single file."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{name}.parquet").schema).parquet(f"{sf_dir}/{name}.parque[t]")
