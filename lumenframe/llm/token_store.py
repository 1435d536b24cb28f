"""Token ids in directly addressable files, and how to read them back.

An id is cut into chunks of 8 bits, the lowest first.  Level 0 holds the lowest chunk
of every id and a bitmap that says which ids go on; level 1 holds the next chunk of
those, with a bitmap of its own, and so on.  A directory holds the number of set bits
before each block of 512, so the place of a token's next chunk is one directory entry
and a few popcounts away: any token is read without decoding its neighbours.

A file holds documents in ascending order of their key, nulls first:

    magic "LFDAC\\x01\\0\\0", then u64: documents, tokens, tokens before this file in its
    partition, levels
    keys      i64 x documents        (0 where null)
    nulls     u8  x documents        (1 where null)
    offsets   u64 x documents + 1    (first token of each document in this file)
    and for each level
        u64 n, n chunks of 8 bits, padded to 8 bytes
        (all but the last level) ceil(n / 512) * 64 bytes of bitmap, then u64 set bits before each block
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, get_file, integral_key, put_file, slices
from .piece_encoder import PieceEncoder

MAGIC = b"LFDAC\x01\0\0"
BLOCK = 512
#: A file is closed when it holds this many tokens, some 10 MB.
FILE_TOKENS = 4_000_000


def _levels(ids: np.ndarray) -> list[np.ndarray]:
    """The ids that reach each level, shifted so that their low 8 bits are the level's chunk."""
    out = [ids]
    while (ids := ids[ids > 255] >> 8).size:
        out.append(ids)
    return out


def pack(keys: list[int | None], ids: list[np.ndarray], before: int = 0) -> bytes:
    """A whole file."""
    flat = np.concatenate(ids).astype(np.uint32) if ids else np.zeros(0, np.uint32)
    levels = _levels(flat)
    out = [MAGIC, struct.pack("<4Q", len(keys), len(flat), before, len(levels))]
    out.append(np.array([k or 0 for k in keys], "<i8").tobytes())
    out.append(np.array([k is None for k in keys], np.uint8).tobytes())
    out.append(np.cumsum([0, *map(len, ids)]).astype("<u8").tobytes())
    for k, level in enumerate(levels):
        chunks = (level & 255).astype(np.uint8).tobytes()
        out += [struct.pack("<Q", len(level)), chunks, b"\0" * (-len(chunks) % 8)]
        if k + 1 < len(levels):
            bits = np.zeros(-(-len(level) // BLOCK) * BLOCK, np.uint8)
            bits[: len(level)] = level > 255
            packed = np.packbits(bits, bitorder="little")
            ones = bits.reshape(-1, BLOCK).sum(1, dtype=np.int64)
            out += [packed.tobytes(), (np.cumsum(ones) - ones).astype("<u8").tobytes()]
    return b"".join(out)


class TokenFile:
    """A file's bytes, opened."""

    def __init__(self, data: bytes | memoryview) -> None:
        data = memoryview(data)
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a token file")
        n, self.n_tokens, self.before, n_levels = struct.unpack_from("<4Q", data, 8)
        at = 40

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        self._keys, self._nulls, self.offsets = take("<i8", n), take("u1", n), take("<u8", n + 1)
        self.levels: list[tuple[np.ndarray, np.ndarray | None, np.ndarray | None]] = []
        for k in range(n_levels):
            count = int(take("<u8", 1)[0])
            chunks = take("u1", count)
            at += -count % 8
            blocks = -(-count // BLOCK)
            self.levels.append((chunks, take("u1", blocks * BLOCK // 8), take("<u8", blocks)) if k + 1 < n_levels else (chunks, None, None))

    @property
    def keys(self) -> list[int | None]:
        return [None if x else int(k) for k, x in zip(self._keys, self._nulls, strict=True)]

    def token(self, i: int) -> int:
        """The i-th token of the file, by at most one directory entry and 64 bytes of bitmap on each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bitmap, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if bitmap is None or not bitmap[i >> 3] >> (i & 7) & 1:
                break
            start = i // BLOCK * (BLOCK // 8)
            whole = int(np.bitwise_count(bitmap[start : i >> 3]).sum())
            i = int(ranks[i // BLOCK]) + whole + int(bitmap[i >> 3] & ((1 << (i & 7)) - 1)).bit_count()
            shift += 8
        return value

    def ids(self) -> np.ndarray:
        """All tokens of the file, level by level."""
        out = self.levels[0][0].astype(np.uint32)
        where = None
        for k in range(1, len(self.levels)):
            chunks, bitmap, _ = self.levels[k - 1]
            on = np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)
            where = on if where is None else (np.flatnonzero(where) if where.dtype == bool else where)[on]
            out[where] += self.levels[k][0].astype(np.uint32) << np.uint32(8 * k)
        return out


def write_token_files(docs: DataFrame, folder: str, vocabulary_path: str, *, end_id: int, key: str = "doc_id", text: str = "text", file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode every whole text, append end_id, and write the ids in ascending key order; returns (part, file, n_tokens), a row for each file.

    The order is made by ranges of the key, which must be a whole number (TypeError), as many as there are shuffle partitions; rows of
    equal key, or of none, follow in the order of a hash of their text, so a task that runs again
    writes the same bytes; a file that is there already stays.  A file appears under its name only when it is complete.
    Null and empty texts: the end id alone.  Texts of any length are encoded whole.  Null keys come first.  Equal rows are written each.
    An empty table writes no file.  Other columns are not read.  The folder's file system must be one that pyarrow opens by URI.
    """

    run = uuid.uuid4().hex  # a folder may hold the files of other runs

    def write(batches):
        part = TaskContext.get().partitionId()
        encoder = PieceEncoder.shared(vocabulary_path)
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        end = end_id.to_bytes(4, "little")
        held = before = files = 0

        def flush():
            nonlocal keys, ids, held, before, files
            name = f"part-{part:06d}-{files:06d}-{run}.dac"
            put_file(folder, name, pack(keys, ids, before))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), pa.array([held], pa.int64())], names=["part", "file", "n_tokens"])
            keys, ids, held, before, files = [], [], 0, before + held, files + 1
            return row

        for batch in slices(batches, 256):
            for name, got in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                keys.append(name)
                ids.append(np.frombuffer(got + end, "<u4"))
                held += len(ids[-1])
                if held >= file_tokens:
                    yield flush()
        if keys:
            yield flush()

    rows = docs.select(integral_key(docs, key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 1))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionById(parts, _part(_bounds(rows, parts))).sortWithinPartitions("key", "order").select("key", "text")
    return ordered.mapInArrow(write, "part int, file string, n_tokens long")


def _bounds(rows: DataFrame, parts: int) -> list[tuple[int, int, int]]:
    """First places (has a key, key, order) of all ranges but the first.

    They come from the keys alone; a sample of whole rows would read the texts once more.  A key that holds several
    ranges' share of the rows is cut by the hash of the text, and so are rows without a key.
    """
    if parts < 2:
        return []
    shares = [k / parts for k in range(1, parts)]
    n, unnamed, cuts = rows.agg(F.count(F.lit(1)), F.count_if(F.col("key").isNull()), F.percentile_approx("key", shares, 20 * parts)).first()
    without = -(-parts * unnamed // n) if n else 0
    starts = [(0, 0, (1 << 63) // without * k) for k in range(1, without)] + ([(1, -(1 << 63), 0)] if without else [])
    named: dict[int, int] = {}
    left = parts - 1 - without
    for k in range(left if cuts else 0):
        at = cuts[int((k + 1) * parts / (left + 1)) - 1]
        named[at] = named.get(at, 0) + 1
    for at, held in sorted(named.items()):
        starts += [(1, at, (1 << 63) // held * k) for k in range(held)]
    return starts


def _part(bounds: list[tuple[int, int, int]]) -> Column:
    """How many of the bounds a row is not before. They stand in runs, so a row is compared with two roots of their number and not with all."""
    if not bounds:
        return F.lit(0)
    kind = "array<struct<a:int,b:bigint,c:bigint>>"
    literal = lambda rows: F.from_json(F.lit(json.dumps([{"a": a, "b": b, "c": c} for a, b, c in rows])), kind)  # noqa: E731  folded into one constant
    run = max(1, int(len(bounds) ** 0.5))
    place = F.struct(F.col("key").isNotNull().cast("int").alias("a"), F.coalesce("key", F.lit(0).cast("long")).alias("b"), F.col("order").alias("c"))
    not_before = lambda rows: F.size(F.filter(rows, lambda b: b <= place))
    before = F.greatest(not_before(literal(bounds[::run])) - 1, F.lit(0)) * run
    return before + not_before(F.slice(literal(bounds), before + 1, F.lit(run)))


def read_token_files(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document in the files that written names (part, file, n_tokens). A missing file is an error, not fewer rows."""
    # One number for each partition, so what comes to the driver is bounded by the number of partitions.
    bases, total = {}, 0
    for r in sorted(written.groupBy("part").agg(F.sum("n_tokens").alias("n_tokens")).collect(), key=lambda r: r.part):
        bases[r.part], total = total, total + r.n_tokens
    if not bases:
        return spark.createDataFrame([], "key long, start long, n_tokens long, ids_crc32 long")

    def decode(batches):
        for batch in batches:
            for part, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                file = TokenFile(get_file(folder, name))
                flat = memoryview(np.ascontiguousarray(file.ids(), "<u4")).cast("B")
                cuts = [int(x) for x in file.offsets]
                crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                sizes = np.diff(file.offsets.astype(np.int64))
                starts = file.offsets[:-1].astype(np.int64) + (bases[part] + file.before)
                yield pa.RecordBatch.from_arrays([pa.array(file.keys, pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crcs, pa.int64())], names=["key", "start", "n_tokens", "ids_crc32"])

    # Tasks open the files themselves, one at a time: only their names are dealt.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return written.select("part", "file").repartition(parts, "file").mapInArrow(decode, "key long, start long, n_tokens long, ids_crc32 long")


def store_and_read(docs: DataFrame, vocabulary_path: str, *, end_id: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Write the files, then read them back: (key, start, n_tokens, ids_crc32).

    Rows and their order are those of write_token_files(): null keys first, equal rows each, null and empty texts as the end id alone.  An
    empty table gives none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "tokens")
    folder = folder or scratch.path("files")
    # What the committed tasks have written.
    written = scratch.keep(write_token_files(docs, folder, vocabulary_path, end_id=end_id, key=key, text=text), "written")
    return read_token_files(spark, folder, written)
