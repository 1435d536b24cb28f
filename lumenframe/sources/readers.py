"""Sources: Parquet tables, CSV with a known schema, lists of ids, JSON lines, folders of result files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType


def read_tables(spark: SparkSession, folder: str, *names: str) -> tuple[DataFrame, ...]:
    """Parquet tables of a folder; columns and filters are pushed into the scans."""
    return tuple(spark.read.parquet(f"{folder}/{n}.parquet") for n in names)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None, *, key: str | None = None) -> DataFrame:
    """CSV with a header. Without a schema all columns are text; key, if given, is cast to text."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    df = (reader.schema(schema) if schema is not None else reader).csv(path)
    return df.withColumn(key, F.col(key).cast(StringType())) if key else df


def read_id_list(spark: SparkSession, path: str, available: DataFrame | None = None, *, key: str = "cell_id") -> DataFrame:
    """A list of ids, one in each line, without a header; only those that available has, if it is given."""
    ids = spark.read.text(path).select(F.trim("value").alias(key)).where(F.col(key) != "")
    return ids if available is None else ids.join(available.select(F.col(key).cast("string").alias(key)).distinct(), key, "left_semi")


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str, *, key: str) -> DataFrame:
    """One object in each line, blank lines skipped; of several with the same key the last stands."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    # Lines keep their order within a file; files count in the order of their names.
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    rows = lines.select("file", "line", F.from_json("value", schema).alias("row"))
    return rows.groupBy(F.col(f"row.{key}").alias("key_")).agg(F.max_by("row", F.struct("file", "line")).alias("row")).select("row.*")


def read_nested_csvs(spark: SparkSession, folder: str, suffix: str, name_pattern: str, names: list[str], schema: StructType | str) -> DataFrame:
    """All CSV files below a folder that end in suffix; the groups of name_pattern in the file's name become columns."""
    df = spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").csv(folder)
    df = df.withColumn("file_", F.col("_metadata.file_name"))
    for k, name in enumerate(names, 1):
        df = df.withColumn(name, F.regexp_extract("file_", name_pattern, k))
    return df.where(F.col("file_").rlike(name_pattern)).drop("file_")


def aligned(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """left with right's columns, one to one by key. ValueError unless both have the same keys, since rows have no order to fall back on."""
    alone = left.select(key).join(right.select(key), key, "left_anti").unionByName(right.select(key).join(left.select(key), key, "left_anti"))
    if not alone.isEmpty():
        raise ValueError(f"keys of column {key} differ")
    return left.join(right, key)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of the rows with a key, the one that is last in order."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def newest_round(paths: list[str], name: str) -> str | None:
    """The file of a name itself, or else that of the last round_* folder by its number; None without either."""
    import re

    direct = [p for p in paths if p.rsplit("/", 1)[-1] == name and not re.search(r"/round_[0-9]+/[^/]*$", p)]
    rounds = {int(m[1]): p for p in paths if (m := re.search(r"/round_([0-9]+)/[^/]*$", p)) and p.endswith(f"/{name}")}
    return sorted(direct)[0] if direct else rounds[max(rounds)] if rounds else None


def read_npz(spark: SparkSession, path: str, name: str, *, key: str = "id", vector: str = "z") -> DataFrame:
    """(key, vector) of the rows of one array in NPZ files, as 32-bit numbers; files are read in the tasks, and objects are never unpickled."""
    import io

    import numpy as np
    import pyarrow as pa

    def work(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                array = np.load(io.BytesIO(data), allow_pickle=False)[name].astype(np.float32)
                array = array.reshape(len(array), -1)
                for a in range(0, len(array), 4096):
                    part = array[a : a + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, part.shape[1]), pa.int32()), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), lists], names=[key, vector])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(work, f"{key} long, {vector} array<float>")


def require_path(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError names the paths that are not there."""
    at = [spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    missing = [p for p, w in zip(paths, at, strict=True) if not w.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(w)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
