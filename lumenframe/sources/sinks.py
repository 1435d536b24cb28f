"""Sinks: CSV, lists of ids, JSON, appended JSON lines, Parquet sets."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_id_list(df: DataFrame, path: str, key: str = "cell_id") -> None:
    df.select(F.col(key).cast("string")).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str, *, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def write_set(tables: Mapping[str, DataFrame], folder: str) -> None:
    """One Parquet table for each part of an annotated matrix."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def write_npz(df: DataFrame, path: str, *, key: str = "id", vector: str = "z", most: int = 1_000_000) -> None:
    """One NPZ file with the keys in order and their vectors. ValueError beyond most rows: such a file is one process's."""
    import io

    import numpy as np
    from pyarrow import fs

    rows = df.select(key, vector).limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"more than {most} rows: write Parquet")
    order = np.argsort(rows[key].to_numpy(), kind="stable")
    data = io.BytesIO()
    np.savez_compressed(data, **{key: rows[key].to_numpy()[order], vector: np.array(rows[vector].to_pylist(), np.float32)[order]})
    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as out:
        out.write(data.getvalue())


def write_trace(records: DataFrame, folder: str, key: str) -> DataFrame:
    """Append records that the folder does not have yet, as JSON lines: a run that was broken off goes on where it was. Returns those that were added."""
    spark = records.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        done = spark.read.schema(records.schema).json(folder).select(key).distinct()
        records = records.join(done, key, "left_anti")
    records.write.mode("append").json(folder)
    return records


def write_text(text: str, path: str) -> None:
    """A text file, such as a report."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path)
    with system.open_output_stream(at) as out:
        out.write(text.encode())


def write_model(model, folder: str) -> None:
    """A fitted model's directory, in place of an earlier one."""
    model.write().overwrite().save(folder)
