"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.checkpoints import cut, ensure_checkpoint_dir  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(id_col: str, n: int):
    """crc32 of the id as decimal text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like the given ones that df does not have (compared without case, as Spark does)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, so that long texts do not pile up in a worker; a lower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = re.match(r"(-?\d+)b?$", spark.conf.get(key))
    if held is None or not 0 < int(held[1]) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def give_back() -> None:
    """Returns a worker's freed memory to the system; workers live on between batches and tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def runs(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Slices of texts of about ``limit`` bytes, at least one text each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit)))
        yield texts[a:b]
        a = b
