"""Catalogs on disk: immutable versions of parquet tables.

A version is a folder; the newest whole one counts, told by its marker file,
which is written last. A lost job leaves a folder without a marker, which no
reader sees. Nothing is ever read and overwritten in one plan.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def versions(spark: SparkSession, folder: str) -> list[int]:
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        return []
    out = []
    for status in fs.listStatus(where):
        name = status.getPath().getName()
        done = spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_WHOLE")
        if name.startswith("v=") and fs.exists(done):
            out.append(int(name[2:]))
    return sorted(out)


def save(catalog: dict[str, DataFrame], folder: str, version: int | None = None) -> int:
    """A new version of all tables; gives its number."""
    spark = next(iter(catalog.values())).sparkSession
    number = (versions(spark, folder) or [0])[-1] + 1
    base = f"{folder}/v={number}"
    for name, df in catalog.items():
        df.write.mode("overwrite").parquet(f"{base}/{name}")
    spark.createDataFrame([(len(schema.MIGRATIONS) if version is None else version,)], "version int").coalesce(1).write.mode("overwrite").json(f"{base}/_version")
    fs, where = _fs(spark, f"{base}/_WHOLE")
    fs.create(where).close()
    return number


def load(spark: SparkSession, folder: str, number: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version (the newest by default), migrated; tables that
    the version lacks are empty."""
    found = versions(spark, folder)
    if not found:
        return schema.empty(spark)
    base = f"{folder}/v={number or found[-1]}"
    fs, _ = _fs(spark, base)
    out = {}
    for name, ddl in schema.TABLES.items():
        there = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"))
        out[name] = spark.read.schema(ddl).parquet(f"{base}/{name}") if there else spark.createDataFrame([], ddl)
    seen = spark.read.schema("version int").json(f"{base}/_version").first().version
    return schema.migrate(out, seen)[0]


def setting(settings: DataFrame, key: str, fallback=None):
    """A JSON setting; malformed or missing values give the fallback."""
    row = settings.where(F.col("key") == key).select("value").first()
    try:
        return json.loads(row.value) if row and row.value is not None else fallback
    except ValueError:
        return fallback
