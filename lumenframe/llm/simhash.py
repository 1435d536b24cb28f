"""SimHash near duplicates, compared exactly in tiles.

A fingerprint has bit i set if over half of the hashes of a text's word shingles have.
Distinct fingerprints are dealt to tiles by population counts: those of the four quarters, where the radius is
small.  Two fingerprints within a radius have counts whose differences add up to
the radius at most, so tile pairs that differ by more are skipped, and the others are compared
exhaustively: exclusive-or and bit counts over blocks of bounded size, in numpy.  A
crowded tile is cut into more blocks, and its pairs of blocks go to different tasks.

Near duplicates by a similarity of shingle sets are in similar.py; they use the same tiles with wider fingerprints.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, integral_key, kept_by_worker, slices
from .components import Forest, components, link_rows

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints in a block, about: a crowded tile has larger blocks, up to LARGEST, before it has more than BLOCKS of them. What each
#: block is sent to is a fixed number of others then, so the bytes shuffled grow with the rows; only the comparing is quadratic.
BLOCK, LARGEST, BLOCKS = 4096, 131_072, 32
#: Nodes that a task holds in its forest before it passes the edges on.
HELD = 200_000


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of width words, repeats included; of the whole text if it is shorter, none without words. A-Z are lower-cased; words are cut at ASCII white space."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - width + 1)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[min(width, len(words)) - 1 :].tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits that over half of the hashes (n, or n x words) have set: one 64-bit integer for each word."""
    raw = np.ascontiguousarray(hashes.reshape(len(hashes), -1)).view(np.uint8)
    counts = np.zeros(8 * raw.shape[1], np.int64)
    for k in range(0, len(raw), 1 << 14):
        counts += np.unpackbits(raw[k : k + (1 << 14)], axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * counts > len(raw), bitorder="little").view("<i8")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, as a signed integer; 0 if there is no word."""
    hashes = shingle_hashes(text, shingle)
    return int(majority(hashes)[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp) of every whole text, in one pass."""

    def work(batches):
        kept_by_worker("fingerprints")
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x, shingle) for x in batch.column(1).to_pylist()], pa.int64())], names=["key", "fp"])

    return docs.select(integral_key(docs, key).alias("key"), F.col(text).alias("text")).mapInArrow(work, "key long, fp long")


def _near_tiles(radius: int) -> list[int]:
    """Differences of tile numbers between a tile and those it must be compared with, itself first, each pair of tiles once."""
    steps = sorted(s for s in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius and s >= (0, 0, 0, 0))
    return [((a * 32 + b) * 32 + c) * 32 + d for a, b, c, d in steps]


def near_edges(classes: DataFrame, radius: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): ids of distinct fingerprints (id, fp) that differ in radius bits at most, thinned to what connects them."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF))) for k in range(4)]
    tile = quarter[3] * 32768 + quarter[2] * 1024 + quarter[1] * 32 + quarter[0]  # digits 0 to 16 in base 32: differences never carry wrongly
    # A tile for each of at most 17^4 = 83,521 combinations of counts, whatever the corpus: 1 MB.
    return tile_edges(classes, tile, _near_tiles(radius), ["fp"], radius, radius, scratch, block)


def tile_edges(classes: DataFrame, tile: Column, near: list[int], words: list[str], first: int, radius: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(a, b): ids of fingerprints (columns words) that differ in radius bits at most, and in first bits of their first word, thinned to what connects them.

    Tiles are compared with those whose number is greater by one of near (0 is itself).  There must be so few that their sizes can be sent to
    every task.
    """
    tiled = classes.select("id", *words, tile.cast("int").alias("tile"))
    rows = F.count(F.lit(1))
    held = F.least(F.greatest(F.lit(float(block)), rows / F.lit(float(BLOCKS))), F.lit(float(max(block, LARGEST))))
    sizes = scratch.keep(tiled.groupBy("tile").agg(F.ceil(rows / held).cast("int").alias("blocks")), "tiles")
    sent = F.broadcast(sizes)
    dealt = tiled.join(sent, "tile").select("tile", F.pmod(F.xxhash64(*words), F.col("blocks")).cast("int").alias("block"), "id", *words)
    packed = scratch.keep(dealt.groupBy("tile", "block").agg(F.collect_list(F.struct(*words, "id")).alias("rows")), "blocks")
    # Each block meets the blocks of the near tiles; the pairs are named here and brought together by a join on their second block.
    meets = packed.select(F.col("tile").alias("t"), F.col("block").alias("k"), F.col("rows").alias("left"), F.explode(F.transform(F.lit(near), lambda s: s + F.col("tile"))).alias("tile"))
    meets = meets.join(sent, "tile").select("t", "k", "left", "tile", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    meets = meets.where((F.col("t") != F.col("tile")) | (F.col("k") <= F.col("block")))
    pairs = meets.join(packed, ["tile", "block"]).select("left", F.col("rows").alias("right"))

    def compare(batches):
        forest = Forest()

        def found():
            a, b = forest.edges()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            sides = []
            for column in batch.columns:
                values = column.flatten()
                cuts = np.cumsum([0, *column.value_lengths().to_pylist()])
                sides.append((cuts, [values.field(k).to_numpy().view(np.uint64) for k in range(len(words))], values.field(len(words)).to_numpy()))
            (cut_a, fps_a, id_a), (cut_b, fps_b, id_b) = sides
            for k in range(batch.num_rows):
                a, b = slice(cut_a[k], cut_a[k + 1]), slice(cut_b[k], cut_b[k + 1])
                left, ia, right, ib = [f[a] for f in fps_a], id_a[a], [f[b] for f in fps_b], id_b[b]
                step = max(16, (1 << 20) // max(1, len(ib)))
                for r in range(0, len(ia), step):
                    hits = np.bitwise_count(left[0][r : r + step, None] ^ right[0]) <= first
                    if len(words) > 1:
                        x, y = np.nonzero(hits)
                        far = sum((np.bitwise_count(p[r + x] ^ q[y]).astype(np.int32) for p, q in zip(left, right, strict=True)), np.zeros(len(x), np.int32)) > radius
                        hits[x[far], y[far]] = False
                    if not hits.any():
                        continue
                    hits &= ia[r : r + step, None] != ib
                    if hits.any():
                        link_rows(forest, ia[r : r + step], ib, hits)
                if len(forest.parent) > HELD:
                    yield found()
        if forest.parent:
            yield found()

    return pairs.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(key, fp, component) of every document.

    component is the smallest key reachable over links between fingerprints of radius
    differing bits at most.  Null, empty and blank texts have fingerprint 0, which links as any
    other does, so texts of null key connect others.  A null key is never a component's name; among null keys only, component is null.
    Rows of equal key have each its own fingerprint.  Texts of any length are read whole.  An empty table gives none.  Keys must be whole
    numbers (TypeError).  Columns but the two named are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, key=key, text=text, shingle=shingle), "fingerprints")
    # Exact copies meet here, combined before the shuffle: one row for each fingerprint from now on.
    classes = scratch.keep(rows.groupBy("fp").agg(F.min("key").alias("least")), "classes")
    linked = components(near_edges(classes.select(F.col("fp").alias("id"), "fp"), radius, scratch), scratch)
    # A component of fingerprints is named after the smallest key that any of them has.
    held = classes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    names = held.groupBy("group").agg(F.min("least").alias("component"))
    named = held.join(names, "group").select(F.col("fp").alias("fp_"), "component")
    return rows.join(named, F.col("fp") == F.col("fp_"), "left").select("key", "fp", "component")
