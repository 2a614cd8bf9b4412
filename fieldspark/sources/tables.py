"""Where fields come from: Parquet tables in long layout, wide tables, and generated grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def from_wide(df: DataFrame, dims: Sequence[str], level: str, columns: dict[float, str], value: str = "value") -> DataFrame:
    """(*dims, level, value) from a table with a column for each level."""
    return df.select(*dims, F.inline(F.array(*[F.struct(F.lit(k).alias(level), F.col(c).alias(value)) for k, c in columns.items()])))


def write_text(lines: Sequence[str], show=print) -> None:
    """The console sink: each line, as the formatters return them."""
    for line in lines:
        show(line)
