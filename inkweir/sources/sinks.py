"""Sinks: guarded CSV with a byte order mark, JSON exports, and versioned tables published by one marker."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkweir.functions.text import guarded

CSV_COLUMNS = (
    "id", "title", "wenhao", "issuing_authority", "region", "site", "doc_type", "category_names", "is_investment_policy", "need_review", "review_status", "version", "page_date", "doc_date", "page_url", "reason", "evidence", "confidence", "model_version", "reviewer_hint", "created_at", "updated_at",
)


def csv_rows(df: DataFrame, columns: tuple[str, ...] = CSV_COLUMNS) -> DataFrame:
    """The columns as texts: lists and structs as JSON, nulls as '', formulas guarded."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = []
    for c in columns:
        nested = isinstance(kinds[c], T.ArrayType | T.StructType | T.MapType)
        out.append(guarded(F.coalesce(F.to_json(c) if nested else F.col(c).cast("string"), F.lit(""))).alias(c))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, columns: tuple[str, ...] = CSV_COLUMNS) -> None:
    """A folder of CSV parts; the first field name of each carries the byte order mark that spreadsheets look for."""
    rows = csv_rows(df, columns)
    rows.withColumnRenamed(columns[0], "﻿" + columns[0]).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """A folder of JSON lines with nested lists."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


class Versioned:
    """Tables as folders of immutable versions; a version's tables become current together, by one marker file.

    One writer at a time. A writer that fails leaves the current version as it was; readers never see half a batch.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self, name: str):  # noqa: ANN202
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[str]:
        fs, path = self._fs("_published")
        return sorted(x.getPath().getName() for x in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str, version: str | None = None) -> DataFrame | None:
        """The table of the current or a given version; None where no version has it."""
        for v in [version] if version else reversed(self.versions()):
            fs, path = self._fs(f"{v}/{name}")
            if fs.exists(path):
                return self.spark.read.parquet(f"{self.folder}/{v}/{name}")
        return None

    def publish(self, tables: dict[str, DataFrame]) -> str:
        """Write the tables as a new version and make it current; unchanged tables stay with the version that has them."""
        version = f"{len(self.versions()):08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.folder}/{version}/{name}")
        fs, path = self._fs(f"_published/{version}")
        if not fs.mkdirs(path):
            raise OSError(f"version {version} can't be published")
        return version
