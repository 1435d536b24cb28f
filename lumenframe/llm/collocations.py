"""Phrases of two to five words that stick together, counted by level in numpy arrays over minimal perfect hashes.

Texts are lower-cased and cut into pieces and words, and the words that occur often enough are numbered.  A phrase of k words
is the pair of the numbers of its first and last k - 1 words, so an occurrence is looked at only where both are frequent phrases of
the level below.  For each level:

1. mappers count hashed buckets of pairs; buckets that all together reach the least frequency are heavy (Park, Chen and Yu 1995);
2. the distinct pairs in heavy buckets are the candidates, which is safe: what is left out is too rare, or has a part that is;
3. a minimal perfect hash of the candidates gives each a slot (bit arrays of shrinking size, each holding the pairs that are alone in
   their place; the rank of a pair's bit is its slot), with the pairs themselves stored by slot, as others come to slots, too;
4. mappers look up their pairs, verify them, count slots by bincount into an array, and the arrays are summed by a tree;
5. the counts are put beside the hash, and the texts are numbered anew, by the slots of the frequent pairs.

Candidates are dealt to shards of about Limits.shard_slots slots.  Hashes are rows of written tables; a task reads their files one after the other, so
its memory does not grow with them; small ones are kept by the worker.  Counts of a phrase's parts are read by their slots, by joins along the pairs.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, kept_by_worker, slices
from .suffix_lm import packed, unpacked

FEWEST, LONGEST, TOP = 100, 5, 2000

_U = np.uint64
#: Separators of pieces become line feeds, tabs spaces.
_SIGNS = bytes.maketrans(b".,;:!?\x0b\x0c\x0d\x09", b"\n" * 9 + b" ")

@dataclass(frozen=True)
class Limits:
    """Sizes that bound what a task holds; no result depends on them."""

    #: Candidates of a shard, about; slots of the segments in which arrays are summed; arrays that are summed at a time.
    shard_slots: int = 1 << 20
    segment: int = 1 << 16
    branches: int = 16
    #: Bytes of text, and positions, that a mapper works on at a time; shards whose counts it holds.
    text_bytes: int = 8 << 20
    positions: int = 1 << 21
    held_shards: int = 8
    #: Occurrences for each bucket, about; bits of a bucket's number that are summed in one array.
    load: int = 8
    bucket_bits: int = 20
    #: Hashes up to this many bytes are kept by a worker.
    kept_bytes: int = 64 << 20


LIMITS = Limits()


def mixed(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of pairs, another one for each seed."""
    with np.errstate(over="ignore"):
        x = (a + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * _U(0xBF58476D1CE4E5B9)
        x = ((x ^ (x >> _U(32))) + b) * _U(0x94D049BB133111EB)
        x = (x ^ (x >> _U(29))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _scaled(hashes: np.ndarray, size: int) -> np.ndarray:
    return ((hashes >> _U(32)) * _U(size)) >> _U(32)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct pairs, which are stored by slot; amounts are the counts of the slots, if they are known."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, a: np.ndarray, b: np.ndarray, amounts: np.ndarray | None = None) -> None:
        self.sizes, self.bits, self.a, self.b, self.amounts = sizes, bits, a, b, amounts
        ones = np.bitwise_count(bits).astype(np.int64)
        self.ranks = np.cumsum(ones) - ones

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], np.arange(len(a))
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            at = _scaled(mixed(a[left], b[left], len(sizes)), size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        out = cls(np.array(sizes, np.int64), np.concatenate([np.zeros(0, _U), *bits]), a, b)
        slots = out._slots(a, b)
        out.a, out.b = np.empty_like(a), np.empty_like(b)
        out.a[slots], out.b[slots] = a, b
        return out

    def _slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot that each pair comes to, whether stored or not; -1 where no bit is set."""
        out, left, start = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _scaled(mixed(a[left], b[left], level), size) + _U(start)
            words, bit = self.bits[at >> _U(6)], at & _U(63)
            hit = (words >> bit & _U(1)).astype(bool)
            found = left[hit]
            out[found] = self.ranks[at[hit] >> _U(6)] + np.bitwise_count(words[hit] & ((_U(1) << bit[hit]) - _U(1)))
            left, start = left[~hit], start + size
            if not len(left):
                break
        return out

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair that is stored; -1 for others."""
        out = self._slots(a, b)
        if len(self.a):
            out[(self.a[out] != a) | (self.b[out] != b)] = -1
        return out

    def dump(self) -> bytes:
        file = io.BytesIO()
        np.savez(file, sizes=self.sizes, bits=self.bits, a=self.a, b=self.b, **({} if self.amounts is None else {"amounts": self.amounts}))
        return file.getvalue()

    @classmethod
    def load(cls, data) -> PerfectHash:
        with np.load(io.BytesIO(data)) as held:
            return cls(*(held[k] for k in ("sizes", "bits", "a", "b")), held["amounts"] if "amounts" in held else None)


@dataclass
class Shards:
    """A written table (shard, blob), as tasks read it."""

    files: list[str]
    count: int
    size: int
    kept: bool
    name: str

    @classmethod
    def of(cls, table: DataFrame, count: int, limits: Limits) -> Shards:
        size = table.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
        return cls(list(table.inputFiles()), count, size, size <= limits.kept_bytes, uuid.uuid4().hex)

    def _each(self, load):
        import pyarrow.parquet as pq
        from pyarrow import fs

        for file in self.files:
            system, at = fs.FileSystem.from_uri(file)
            with system.open_input_file(at) as opened:
                held = pq.ParquetFile(opened)
                for group in range(held.num_row_groups):
                    table = held.read_row_group(group, columns=["shard", "blob"])
                    for shard, blob in zip(table["shard"].to_pylist(), table["blob"], strict=True):
                        yield shard, load(blob.as_py())

    def each(self, load):
        """(shard, loaded blob) of all, one after the other; kept by the worker if they are few."""
        if not self.kept:
            kept_by_worker("shards")
            return self._each(load)
        return kept_by_worker(f"shards {self.name}", lambda: list(self._each(load)))


def word_keys(lang: str, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit hashes of words of a language, as pairs."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w, seed) for w in words), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _runs(batches, text_bytes: int):
    """(language, words) of rows (lang, text), by languages, some text_bytes of texts at a time: words as dictionary arrays of bytes, with a line feed between pieces."""

    def run(lang, texts):
        data = b"\n".join(texts).lower().translate(_SIGNS).replace(b"\n", b" \n ")
        words = pc.split_pattern(pa.array([data], pa.large_binary()), " ").flatten()
        return lang, words.filter(pc.greater(pc.binary_length(words), 0)).dictionary_encode()

    for batch in slices(batches):
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            first = size = 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= text_bytes or k + 1 == len(texts):
                    yield run(lang, texts[first : k + 1])
                    first, size = k + 1, 0


def _counted_words(batches, text_bytes: int):
    kept_by_worker("words of phrases")
    for lang, words in _runs(batches, text_bytes):
        counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
        keep = pc.not_equal(words.dictionary, pa.scalar(b"\n", pa.large_binary()))
        names = words.dictionary.filter(keep)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(names), pa.string()), names.cast(pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()).filter(keep)], names=["lang", "word", "f"])


_TEXT = "positions binary, numbers binary, pairs long"


def _text_row(positions: np.ndarray, numbers: np.ndarray) -> pa.RecordBatch:
    """A stretch of text: the places of its frequent phrases, and their numbers."""
    pairs = int((np.diff(positions) == 1).sum())
    return pa.RecordBatch.from_arrays([pa.array([packed(np.diff(positions, prepend=0))], pa.binary()), pa.array([packed(numbers)], pa.binary()), pa.array([pairs])], names=["positions", "numbers", "pairs"])


def _stretches(batches, most: int):
    """Some most (positions, numbers) at a time; there is a gap between rows."""
    places, numbers, size, base = [], [], 0, 0
    for batch in batches:
        for p, n in zip(batch.column(0), batch.column(1), strict=True):
            at = np.cumsum(unpacked(p.as_buffer().to_pybytes())) + base
            places.append(at)
            numbers.append(unpacked(n.as_buffer().to_pybytes()))
            size, base = size + len(at), int(at[-1]) + 2 if len(at) else base
            if size >= most:
                yield np.concatenate(places), np.concatenate(numbers)
                places, numbers, size, base = [], [], 0, 0
    if size:
        yield np.concatenate(places), np.concatenate(numbers)


def _pairs(positions: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.diff(positions) == 1)
    return positions[at], numbers[at].view(_U), numbers[at + 1].view(_U)


def _dealt(shard: np.ndarray, count: int):
    """(shard, the rows of it), of one pass over the rows."""
    if count == 1:
        return {0: slice(None)}
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(count + 1))
    return {s: order[ends[s] : ends[s + 1]] for s in range(count) if ends[s] < ends[s + 1]}


def _shard_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a, b, 1001) >> _U(32)


def _numbers(shards: Shards, bases: list[int], fewest: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of frequent pairs, -1 of others."""
    out = np.full(len(a), -1, np.int64)
    rows = _dealt(((_shard_hash(a, b) * _U(shards.count)) >> _U(32)).astype(np.int64), shards.count)
    for shard, table in shards.each(PerfectHash.load):
        mine = rows.get(shard)
        if mine is not None and len(table.a):
            slot = table.look_up(a[mine], b[mine])
            out[mine] = np.where((slot >= 0) & (table.amounts[slot] >= fewest), slot + bases[shard], -1)
    return out


def _hashes(candidates: DataFrame, scratch: Scratch, count: int) -> DataFrame:
    """(shard, n, blob): perfect hashes of candidates (a, b, h, more columns ...); h is their shard hash."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0)[0].as_py(), b.column(1).to_numpy(), b.column(2).to_numpy()) for b in batches]
        a, b = (np.concatenate([p[k] for p in parts]).view(_U) for k in (1, 2))
        yield pa.RecordBatch.from_arrays([pa.array([parts[0][0]], pa.int32()), pa.array([len(a)]), pa.array([PerfectHash.build(a, b).dump()], pa.binary())], names=["shard", "n", "blob"])

    shard = F.shiftright(F.col("h") * F.lit(count), 32).cast("int").alias("shard")
    return scratch.keep(candidates.select(shard, "a", "b").groupBy("shard").applyInArrow(build, "shard int, n long, blob binary"), "hashes")


def _bases(hashes: DataFrame, count: int) -> list[int]:
    """The number of slots before each shard: one number for each shard comes to the driver."""
    sizes = dict(hashes.select("shard", "n").collect())
    return np.cumsum([0, *(sizes.get(s, 0) for s in range(count - 1))]).tolist()


def _frequent(hashes: DataFrame, bases: list[int], fewest: int) -> DataFrame:
    """(id, a, b, f) of the frequent phrases of a level's hashes."""

    def work(batches):
        for batch in slices(batches, 1):
            held = PerfectHash.load(batch.column(1)[0].as_py())
            slot = np.flatnonzero(held.amounts >= fewest)
            yield pa.RecordBatch.from_arrays([pa.array(slot + bases[batch.column(0)[0].as_py()]), pa.array(held.a[slot].view(np.int64)), pa.array(held.b[slot].view(np.int64)), pa.array(held.amounts[slot])], names=["id", "a", "b", "f"])

    return hashes.select("shard", "blob").mapInArrow(work, "id long, a long, b long, f long")


def _summed(arrays: DataFrame, limits: Limits) -> DataFrame:
    """Written (shard, segment, part, amounts) summed over part by a tree: so many branches at a time."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, names = np.zeros(0, np.int64), None
        for batch in batches:
            names = names or [batch.column(k).slice(0, 1) for k in range(3)]
            for data in batch.column(3):
                more = unpacked(data.as_py())
                if len(more) > len(total):
                    total, more = more.copy(), total
                total[: len(more)] += more
        yield pa.RecordBatch.from_arrays([*names, pa.array([packed(total)], pa.binary())], names=["shard", "segment", "part", "amounts"])

    parts = 1 + (arrays.agg(F.max("part")).first()[0] or 0)
    for _ in range(next(k for k in range(1, 99) if limits.branches**k >= parts)):
        arrays = arrays.withColumn("part", F.floor(F.col("part") / F.lit(limits.branches)).cast("int")).groupBy("shard", "segment", "part").applyInArrow(add, "shard int, segment int, part int, amounts binary")
    return arrays


def _vocabulary(docs: DataFrame, fewest: int, scratch: Scratch, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """(words (lang, word, f) that are frequent, totals (lang, n))."""
    counts = docs.mapInArrow(lambda batches: _counted_words(batches, limits.text_bytes), "lang string, word string, f long").groupBy("lang", "word").agg(F.sum("f").alias("f"))
    counts = scratch.keep(counts, "counts")
    return counts.where(F.col("f") >= fewest), scratch.keep(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")


def _numbered_words(words: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(words with a, b and h, their number)."""

    def hashed(batches):
        for batch in batches:
            a, b = np.zeros(batch.num_rows, _U), np.zeros(batch.num_rows, _U)
            by: dict[str, list[int]] = {}
            for k, lang in enumerate(batch.column(0).to_pylist()):
                by.setdefault(lang, []).append(k)
            names = batch.column(1).cast(pa.binary()).to_pylist()
            for lang, rows in by.items():
                a[rows], b[rows] = word_keys(lang, [names[k] for k in rows])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x.view(np.int64)) for x in (a, b, _shard_hash(a, b)))], names=["lang", "word", "f", "a", "b", "h"])

    out = scratch.keep(words.select("lang", "word", "f").mapInArrow(hashed, "lang string, word string, f long, a long, b long, h long"), "words")
    return out, out.count()


def _with_amounts(hashes: DataFrame, amounts: DataFrame, scratch: Scratch, limits: Limits) -> DataFrame:
    """The hashes with the summed counts (shard, segment, amounts) of their slots."""

    def put(batches):
        for batch in slices(batches, 1):
            shard, n, blob, parts = (batch.column(k)[0].as_py() for k in range(4))
            held = PerfectHash.load(blob)
            held.amounts = np.zeros(n, np.int64)
            for x in parts or ():
                found = unpacked(x["amounts"])
                held.amounts[x["segment"] * limits.segment :][: len(found)] = found
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([n]), pa.array([held.dump()], pa.binary())], names=["shard", "n", "blob"])

    parts = amounts.groupBy("shard").agg(F.collect_list(F.struct("segment", "amounts")).alias("parts"))  # one for each segment of a shard
    return scratch.keep(hashes.join(parts, "shard", "left").select("shard", "n", "blob", "parts").mapInArrow(put, "shard int, n long, blob binary"), "counted")


def _word_amounts(words: DataFrame, shards: Shards, limits: Limits) -> DataFrame:
    """The counts of words, by shard and segment of their slots, as the mappers' arrays are."""

    def work(batches):
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(_U) for k in (0, 1))
            rows = _dealt(((_shard_hash(a, b) * _U(shards.count)) >> _U(32)).astype(np.int64), shards.count)
            for shard, table in shards.each(PerfectHash.load):
                if (mine := rows.get(shard)) is not None:
                    total = np.bincount(table.look_up(a[mine], b[mine]), batch.column(2).to_numpy()[mine], len(table.a)).astype(np.int64)
                    yield from _segments(shard, total, TaskContext.get().partitionId(), limits.segment)

    return words.select("a", "b", "f").mapInArrow(work, "shard int, segment int, part int, amounts binary")


def _segments(shard: int, total: np.ndarray, part: int, size: int):
    for k in range(0, len(total), size):
        if total[k : k + size].any():
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (shard, k // size, part)] + [pa.array([packed(total[k : k + size])], pa.binary())], names=["shard", "segment", "part", "amounts"])


def _heavy(texts: DataFrame, bits: int, fewest: int, scratch: Scratch, limits: Limits) -> DataFrame:
    """(shard, blob): the heavy buckets, of a segment of buckets each, ascending."""
    low = min(bits, limits.bucket_bits)

    def count(batches):
        for positions, numbers in _stretches(batches, limits.positions):
            _, a, b = _pairs(positions, numbers)
            buckets, amounts = np.unique(mixed(a, b, 2002) >> _U(64 - bits), return_counts=True)
            for segment, rows in _dealt((buckets >> _U(low)).astype(np.int64), 1 << (bits - low)).items():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed(np.diff(buckets[rows] & _U((1 << low) - 1), prepend=_U(0)))], pa.binary()), pa.array([packed(amounts[rows])], pa.binary())], names=["shard", "buckets", "amounts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, shard = np.zeros(1 << low, np.int64), None
        for batch in batches:
            shard = batch.column(0)[0].as_py()
            for buckets, amounts in zip(batch.column(1), batch.column(2), strict=True):
                total[np.cumsum(unpacked(buckets.as_py()))] += unpacked(amounts.as_py())  # a row has each bucket once
        heavy = np.flatnonzero(total >= fewest).astype("<u8") + _U(shard << low)
        if len(heavy):
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([heavy.tobytes()], pa.binary())], names=["shard", "blob"])

    summed = texts.mapInArrow(count, "shard int, buckets binary, amounts binary").groupBy("shard").applyInArrow(add, "shard int, blob binary")
    return scratch.keep(summed, "heavy")


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The distinct pairs, sorted."""
    pairs = np.empty(len(a), [("a", "<u8"), ("b", "<u8")])
    pairs["a"], pairs["b"] = a, b
    return np.unique(pairs)


def _candidates(texts: DataFrame, heavy: Shards, bits: int, scratch: Scratch, limits: Limits) -> DataFrame:
    """(a, b, h): the distinct pairs in heavy buckets."""
    low = min(bits, limits.bucket_bits)
    load = lambda data: np.frombuffer(data, "<u8")

    def work(batches):
        for positions, numbers in _stretches(batches, limits.positions):
            _, a, b = _pairs(positions, numbers)
            bucket = mixed(a, b, 2002) >> _U(64 - bits)
            rows = _dealt((bucket >> _U(low)).astype(np.int64), 1 << (bits - low))
            for segment, found in heavy.each(load):
                mine = rows.get(segment)
                if mine is None:
                    continue
                own = bucket[mine]
                at = np.minimum(np.searchsorted(found, own), len(found) - 1)
                hit = found[at] == own
                if hit.any():
                    pairs = _distinct(a[mine][hit], b[mine][hit])
                    yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([packed(np.diff(pairs["a"], prepend=_U(0)))], pa.binary()), pa.array([packed(pairs["b"])], pa.binary())], names=["segment", "a", "b"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, least = [], 0, 1 << 20
        for batch in batches:
            for a, b in zip(batch.column(1), batch.column(2), strict=True):
                parts.append(_distinct(np.cumsum(unpacked(a.as_py())).view(_U), unpacked(b.as_py()).view(_U)))
                size += len(parts[-1])
            if size > least:
                parts = [np.unique(np.concatenate(parts))]
                size, least = len(parts[0]), max(1 << 20, 2 * len(parts[0]))
        pairs = np.unique(np.concatenate(parts))
        x, y = (np.ascontiguousarray(pairs[c]) for c in "ab")
        yield pa.RecordBatch.from_arrays([pa.array(v.view(np.int64)) for v in (x, y, _shard_hash(x, y))], names=["a", "b", "h"])

    packs = texts.mapInArrow(work, "segment int, a binary, b binary")  # a segment of buckets has a bounded number of heavy ones
    return scratch.keep(packs.groupBy("segment").applyInArrow(unite, "a long, b long, h long"), "candidates")


def _counted(texts: DataFrame, shards: Shards, limits: Limits) -> DataFrame:
    """(shard, segment, part, amounts): what the slots count in each mapper's texts."""

    def work(batches):
        held: dict[int, np.ndarray] = {}
        part = TaskContext.get().partitionId()
        for positions, numbers in _stretches(batches, limits.positions):
            _, a, b = _pairs(positions, numbers)
            rows = _dealt(((_shard_hash(a, b) * _U(shards.count)) >> _U(32)).astype(np.int64), shards.count)
            for shard, table in shards.each(PerfectHash.load):
                if (mine := rows.get(shard)) is None:
                    continue
                slot = table.look_up(a[mine], b[mine])
                counts = np.bincount(slot[slot >= 0], minlength=len(table.a))
                held[shard] = held[shard] + counts if shard in held else counts
                if len(held) > limits.held_shards:
                    for s, total in held.items():
                        yield from _segments(s, total, part, limits.segment)
                    held = {}
        for s, total in held.items():
            yield from _segments(s, total, part, limits.segment)

    return texts.mapInArrow(work, "shard int, segment int, part int, amounts binary")


def _next_texts(texts: DataFrame, shards: Shards, bases: list[int], fewest: int, limits: Limits) -> DataFrame:
    def work(batches):
        for positions, numbers in _stretches(batches, limits.positions):
            at, a, b = _pairs(positions, numbers)
            found = _numbers(shards, bases, fewest, a, b)
            if (found >= 0).any():
                yield _text_row(at[found >= 0], found[found >= 0])

    return texts.mapInArrow(work, _TEXT)


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", fewest: int = FEWEST, longest: int = LONGEST, limits: Limits = LIMITS) -> tuple[list[DataFrame], DataFrame]:
    """(a table for each length from 1 on, totals (lang, n)) of all phrases of longest words at most that occur fewest times or more.

    A table has id, a, b (numbers of the first and the last words but one, in the table before), lang, phrase, last (word), f, before and after: the frequencies of
    the phrase's first 1, 2, ... words, and of its last 1, 2, ... words, itself left out.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    words, totals = _vocabulary(rows, fewest, scratch, limits)
    words, n = _numbered_words(words, scratch)
    if not n:
        return [], totals
    count = -(-n // limits.shard_slots)
    hashes = _hashes(words, scratch, count)
    bases = _bases(hashes, count)
    hashes = _with_amounts(hashes, _summed(scratch.keep(_word_amounts(words, Shards.of(hashes, count, limits), limits), "arrays"), limits), scratch, limits)
    shards = Shards.of(hashes, count, limits)
    ids = _frequent(hashes, bases, fewest).withColumnRenamed("f", "f_")
    none = F.array().cast("array<long>")
    out = [scratch.keep(ids.join(words, ["a", "b"]).select("id", "a", "b", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", none.alias("before"), none.alias("after")), "words")]

    def encode(batches):
        for lang, words in _runs(batches, limits.text_bytes):
            found = _numbers(shards, bases, fewest, *word_keys(lang, words.dictionary.to_pylist()))
            numbers = found[words.indices.to_numpy()]
            at = np.flatnonzero(numbers >= 0)
            if len(at):
                yield _text_row(at, numbers[at])

    texts = scratch.keep(rows.mapInArrow(encode, _TEXT), "texts")
    for _ in range(2, longest + 1):
        pairs = texts.agg(F.sum("pairs")).first()[0] or 0
        if pairs < fewest:
            break
        bits = max(10, min(40, (pairs // limits.load).bit_length()))
        heavy = Shards.of(_heavy(texts, bits, fewest, scratch, limits), 0, limits)
        if not heavy.size:
            break
        candidates = _candidates(texts, heavy, bits, scratch, limits)
        count = -(-candidates.count() // limits.shard_slots)
        hashes = _hashes(candidates, scratch, count)
        level = Shards.of(hashes, count, limits)
        arrays = scratch.keep(_counted(texts, level, limits), "arrays")
        hashes = _with_amounts(hashes, _summed(arrays, limits), scratch, limits)
        bases_k, level = _bases(hashes, count), Shards.of(hashes, count, limits)
        left, right = (out[-1].select(*[F.col(c).alias(f"{c}_{side}") for c in ("id", "lang", "phrase", "last", "f", "before", "after")]) for side in "lr")
        rows_k = _frequent(hashes, bases_k, fewest).join(left, F.col("a") == F.col("id_l")).join(right, F.col("b") == F.col("id_r"))
        rows_k = rows_k.select("id", "a", "b", F.col("lang_l").alias("lang"), F.concat("phrase_l", F.lit(" "), "last_r").alias("phrase"), F.col("last_r").alias("last"), "f", F.concat("before_l", F.array("f_l")).alias("before"), F.concat("after_r", F.array("f_r")).alias("after"))
        rows_k = scratch.keep(rows_k, "phrases")
        if rows_k.isEmpty():
            break
        out.append(rows_k)
        following = scratch.keep(_next_texts(texts, level, bases_k, fewest, limits), "texts")
        scratch.drop(texts, arrays, candidates)
        texts = following
    return out, totals


def mine(docs: DataFrame, *, text: str = "text", lang: str = "lang", fewest: int = FEWEST, longest: int = LONGEST, top: int = TOP, limits: Limits = LIMITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first top phrases of each language, by score, frequency and phrase.

    A phrase of a occurrences cut into a first part of l and a rest of r scores floor(1000 a n / (l r)), n being the language's words; the cut of the
    lowest score counts, of equals the first. A phrase goes if a longer one of as many occurrences has it inside. Sums and products are of whole numbers (38 digits).
    A null language is 'und'; a null or empty text has no words; texts of any length are read whole; equal rows count each. Without a frequent phrase, and
    for an empty table, there are no rows. Ties are told by the phrase's bytes. Other columns are not read.
    """
    levels, totals = phrases(docs, text=text, lang=lang, fewest=fewest, longest=longest, limits=limits)
    found = []
    for k, table in enumerate(levels[1:], 1):
        rows = table.select("id", "lang", "phrase", F.col("f").alias("a"), "before", "after")
        if k + 1 < len(levels):
            longer = levels[k + 1].select(F.explode(F.array("a", "b")).alias("id"), F.col("f").alias("longer")).groupBy("id").agg(F.max("longer").alias("longer"))
            rows = rows.join(longer, "id", "left").where(F.coalesce(F.col("longer") < F.col("a"), F.lit(True))).drop("longer")
        found.append(rows.drop("id"))
    if not found:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    rows = reduce(DataFrame.unionByName, found).join(totals, "lang")
    cuts = F.transform("before", lambda l, j: F.struct(l.alias("l"), F.element_at("after", F.size("before") - j).alias("r"), j.alias("j")))  # noqa: E741
    rows = rows.select("lang", "phrase", "a", "n", F.explode(cuts).alias("cut")).select("lang", "phrase", "a", "n", "cut.*")
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    rows = rows.select("*", (whole("a") * F.lit(1000) * whole("n")).alias("above"), (whole("l") * whole("r")).alias("below")).withColumn("score", F.expr("above DIV below"))
    best = rows.groupBy("lang", "phrase").agg(F.min(F.struct("score", "j", "l", "r", "a", "n")).alias("cut")).select("lang", "phrase", "cut.*")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
