"""What the operators share: tables, the shared folder and Arrow plumbing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, maybe_broadcast, scratch, shared_folder, stored  # noqa: F401  the operators find them here

SPACE_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filed(docs: DataFrame) -> DataFrame:
    """docs as one scan of files: itself, or else written and read back."""
    try:
        docs.metadataColumn("_metadata")
        return docs
    except AnalysisException:
        return stored(docs, "rows")


def located(docs: DataFrame) -> DataFrame:
    """docs, a scan, with the path of its file and the row number there in two
    last columns."""
    place = docs.metadataColumn("_metadata")
    file, row = fresh(docs, "file", "row")
    return docs.select("*", place.getField("file_path").alias(file), place.getField("row_index").alias(row))


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def quoted(column: str) -> str:
    """A column name as one identifier, whatever it holds."""
    return "`" + column.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, …: Python functions take no name that holds a
    backtick. toDF() gives the names back."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
