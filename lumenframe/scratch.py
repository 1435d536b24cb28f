"""Written intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or an own one where that is unset (tests, local mode)."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own_folder:
        _own_folder.append("file://" + tempfile.mkdtemp(prefix="lumenframe-"))
    return _own_folder[0]


class Scratch:
    """Written tables of one run, in the shared folder. Losing an executor loses none of them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._count = 0
        atexit.register(self._delete, self.root)

    def path(self, name: str) -> str:
        self._count += 1
        return f"{self.root}/{self._count}-{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a DataFrame that reads what was written."""
        path = self.path(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that no later plan reads."""
        for df in tables:
            self._delete(df._scratch_path)

    def delete(self, path: str) -> None:
        """Delete a folder of this run."""
        self._delete(path)

    def release(self) -> None:
        """Drop what Python still refers to, so that Spark may delete the shuffle files of finished plans sooner. Nothing depends on it."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        try:
            if context._jsc is None:  # the session was stopped before the interpreter ends
                from pyarrow import fs

                system, at = fs.FileSystem.from_uri(path)
                system.delete_dir(at)
                return
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  at interpreter exit the JVM, or the folder, may be gone
            return
