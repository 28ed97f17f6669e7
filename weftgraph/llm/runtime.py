"""Shared plumbing of the training-data operators.

Nothing here touches driver-local files: intermediate tables go to the folder that the
session names in ``spark.checkpoint.dir``, because executors and the driver share no other place. A
temporary one is set only where it is unset and the master is local, as in tests; on a cluster that is an
error.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, as a URI."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh path under the shared folder, dropped when the driver ends."""
    path = f"{shared_dir(spark)}/weft-{what}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def settle(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(df: DataFrame) -> None:
    """Delete a settled table that no later plan reads."""
    if getattr(df, "_weft_path", None):
        drop_path(df.sparkSession, df._weft_path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(texts: list, most: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of at most ``most`` code points each (one text at least)."""
    return spans([len(t or "") for t in texts], most)


def spans(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose lengths sum to at most ``most`` (one row at least)."""
    start, held = 0, 0
    for i, n in enumerate(lengths):
        held += n
        if held > most and i > start:
            yield start, i
            start, held = i, n
    if start < len(lengths):
        yield start, len(lengths)


def trim() -> None:
    """Give free memory back to the system: Python workers outlive their tasks, and what they keep counts for the next stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def exact(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with its first column of each exact name; all others get names that clash with nothing."""
    seen: set[str] = set()
    fresh = []
    for i, c in enumerate(df.columns):
        fresh.append(c if c in names and c not in seen else f"__extra{i}")
        seen.add(c)
    return df.toDF(*fresh)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever else ``df`` holds."""
    return exact(df, *names).select(*names)


def text_of(column: str = "text"):
    """The column with null read as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
