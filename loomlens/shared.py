"""Tables in the folder that driver and executors share: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own: list[str] = []


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder if all runs in one
    process, and an error if not."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if given:
        return given.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="loomlens-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


class Shelf:
    """A folder of its own in the shared one. `keep` writes a table and reads it back;
    `drop` deletes tables that are not needed any more. What results read stays until
    the folder is cleared by its owner (or, in one process, at its end)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.uri = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def keep(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """batch: rows of an Arrow batch while this table is written, where rows are large;
        the session's own setting is back when it returns."""
        schema, conf = df.schema, self.spark.conf
        before = conf.get(_BATCH)
        if batch:
            conf.set(_BATCH, str(batch))
        try:
            df.write.mode("overwrite").parquet(f"{self.uri}/{name}")
        finally:
            conf.set(_BATCH, before)
        return self.spark.read.schema(schema).parquet(f"{self.uri}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.uri}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
