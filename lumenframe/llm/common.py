"""Shared by the operators: written intermediate tables, slices of batches, word expressions."""

from __future__ import annotations

import ctypes
import gc
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import Scratch, scratch_root  # noqa: F401  the operators' too

#: Words are maximal runs of anything but space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Up to here NFC changes nothing and all versions of Unicode agree on letters, digits and lower case.
LATIN_END = "\u024f"

_kept: dict[str, object] = {}


def kept_by_worker(name: str, build=None):
    """What an operator keeps in a Python worker from task to task. A worker keeps it for one operator at a time, so that memory has room for the next."""
    if name not in _kept:
        if _kept:
            _kept.clear()
            give_back()
        _kept[name] = build() if build else None
    return _kept[name]


def give_back() -> None:
    """Return freed memory to the system: a worker goes on with the next operator, and the allocators would keep what the last one used."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # other C libraries have no such call
        return


class Generations(dict):
    """Results of a function, kept for the keys in use: when limit keys are held, they become the old ones, and only those used again stay."""

    #: Longer keys are worked out each time, so that the memory in use has a bound.
    LONGEST = 64

    def __init__(self, function, limit: int) -> None:
        super().__init__()
        self.function, self.limit, self.old = function, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.function(key)
        if len(key) <= self.LONGEST:
            self[key] = value
        return value

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable in Latin-1, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def slices(batches, rows: int = 512):
    """Arrow batches cut into shorter ones, so that a Python worker holds few texts as objects at a time."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def integral_key(df: DataFrame, key: str) -> Column:
    """The key as a long. Keys name components and places, so they must be whole numbers: TypeError otherwise."""
    kind = df.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"key column {key} is {kind}: whole numbers are needed; number the rows first")
    return F.col(f"`{key}`").cast("long")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_crc_mod(key: str | Column, mod: int) -> Column:
    """crc32 of a key's decimal text modulo mod: the folds of the held-out sets. Null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary") if isinstance(key, str) else key.cast("string").cast("binary")) % mod


def numbered(rows: DataFrame, scratch: Scratch, *order: Column) -> DataFrame:
    """rows with index, their place in their group from 0 on, and n, the group's size. order must tell all rows of a group apart.

    Ranges of (group, order) are dealt to tasks; a row's place is that in its range, after what the group has in earlier ranges.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = scratch.keep(rows.repartitionByRange(parts, F.col("group").asc(), *order).withColumn("range", F.spark_partition_id()), "ranges")
    by_group = Window.partitionBy("group")
    counts = dealt.groupBy("group", "range").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.select("group", "range", F.sum("rows").over(by_group).alias("n"), (F.sum("rows").over(by_group.orderBy("range")) - F.col("rows")).alias("before"))
    place = F.row_number().over(Window.partitionBy("group", "range").orderBy(*order))
    placed = dealt.withColumn("place", place.cast("long") - 1)
    return placed.join(counts, ["group", "range"]).withColumn("index", F.col("place") + F.col("before")).drop("place", "before", "range")


def put_file(folder: str, name: str, data: bytes) -> None:
    """Write a file that appears under its name when it is whole, and stays as it is from then on.

    For tasks that write the same bytes whenever they run: of several attempts one puts the file in its place and the others leave it, so none
    that is slow, or stopped on its way, takes away what another has written.
    """
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    there = lambda: system.get_file_info(f"{at}/{name}").type != fs.FileType.NotFound
    if there():
        return
    system.create_dir(at, recursive=True)
    hidden = f"{at}/.{uuid.uuid4().hex}"
    with system.open_output_stream(hidden) as out:
        out.write(data)
    try:
        system.move(hidden, f"{at}/{name}")
    except OSError:  # not every file system moves onto a file
        if not there():
            raise
        system.delete_file(hidden)


def get_file(folder: str, name: str, *, needed: bool = True) -> bytes | None:
    """A file's bytes. FileNotFoundError where it is needed and missing; else None."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    if system.get_file_info(f"{at}/{name}").type == fs.FileType.NotFound:
        if needed:
            raise FileNotFoundError(f"{folder}/{name}")
        return None
    with system.open_input_stream(f"{at}/{name}") as file:
        return file.read()
