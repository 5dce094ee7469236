"""Manifest CSV: read, read-or-empty, replace."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from filmloom.plans import versions

# Cell texts a pandas reader takes for missing.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A",
    "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

_QUOTING = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def text_schema(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def read_manifest(
    spark: SparkSession, path: str, columns: list[str] | None = None, infer: bool = False, multi_line: bool = True
) -> DataFrame:
    """A manifest as text columns (or inferred ones), with missing-value texts as null.

    With ``multi_line`` a quoted cell may hold line ends and each file is one read task, so
    large manifests should be stored as several files, which is how :func:`replace_manifest` writes them.
    """
    reader = spark.read.options(header=True, multiLine=multi_line, inferSchema=infer, **_QUOTING)
    if columns:
        reader = reader.schema(text_schema(columns))
    df = reader.csv(versions.resolve(spark, path))
    texts = {f.name for f in df.schema if isinstance(f.dataType, StringType)}
    return df.select(
        *[
            F.when(~F.col(f"`{c}`").isin(MISSING_TEXTS), F.col(f"`{c}`")).alias(c) if c in texts else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def read_or_empty(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The manifest, or an empty one with the given columns where the path does not exist."""
    try:
        return read_manifest(spark, path, columns)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], text_schema(columns))


def replace_manifest(df: DataFrame, path: str) -> None:
    """Replace the whole manifest by a new version; the rows may come from the same path.

    Readers see the old rows until the new ones are complete (``plans.versions``); if this writer is lost they stay. Raises
    ``ConcurrentWrite`` if another writer has replaced the manifest meanwhile.
    """
    spark = df.sparkSession
    base, _ = versions.latest(spark, path)
    folder = versions.new_folder(path)
    df.write.options(header=True, **_QUOTING).csv(folder)
    versions.publish(spark, path, base, [folder])
