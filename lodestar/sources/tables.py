"""Tables, and views of them that a tenant (and user) may see."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_path, text: one row per text file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source_path"), F.col("value").alias("text"))


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """source_path, content, length, family: files of any kind, named by their first bytes."""
    head = F.hex(F.substring("content", 1, 12))
    family = (
        F.when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
        .when(F.contains(F.substring("content", 1, 1024), F.lit(b"%PDF-")), "pdf")
    )
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("source_path"), "content", "length", family.alias("family"))


@dataclass(frozen=True)
class Tenant:
    """Reads and writes within one tenant, and where a table has owners, one
    user. A missing tenant or user sees nothing: the comparison is then null."""

    tenant: object | None
    user: object | None = None

    def rows(self, df: DataFrame, tenant: str = "tenant_id", owner: str | None = None) -> DataFrame:
        seen = F.col(tenant) == F.lit(self.tenant)
        if owner:
            seen = seen & (F.col(owner) == F.lit(self.user))
        return df.filter(seen)

    def checked(self, df: DataFrame, tenant: str = "tenant_id") -> DataFrame:
        """df, with an error on the first row of another tenant (for writes)."""
        own = F.coalesce(F.col(tenant) == F.lit(self.tenant), F.lit(False))
        return df.filter(F.when(own, True).otherwise(F.raise_error(F.lit("row of another tenant")).cast("boolean")))
