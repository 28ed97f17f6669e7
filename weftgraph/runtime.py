"""Intermediate tables of iterative operators, in the folder that all executors share.

What they write is dropped when the driver ends. Without ``spark.checkpoint.dir`` a temporary folder is set,
which only a local master can share with its executors: on a cluster that is an error.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it; a temporary folder only where it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="weft-rounds-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _clean() -> None:
    for spark, path in _written:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended already
            return


def settle(df: DataFrame) -> DataFrame:
    """Written and read back: a round's result with no lineage, which outlives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/weft-round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _written:
        atexit.register(_clean)
    _written.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Rounds:
    """Settles the results of rounds: up to ``FEW`` rows as a relation of the plan itself, more in the folder.

    The result is the same; short rounds are spared writing, listing and reading files. A round after a
    large one isn't tried as a small one.
    """

    FEW = 1_000

    def __init__(self):
        self.small = True

    def settle(self, df: DataFrame) -> tuple[DataFrame, bool]:
        """The frame, and whether it has rows."""
        if self.small:
            rows = df.limit(self.FEW + 1).toArrow()
            if rows.num_rows <= self.FEW:
                return df.sparkSession.createDataFrame(rows, df.schema), rows.num_rows > 0
        out = settle(df)
        n = out.count()
        self.small = n <= self.FEW
        return out, n > 0
