"""A Merkle manifest of a dataset: a hash tree over each source's documents, one over the sources, and a proof for each document.

The levels are DataFrames.  Rows are numbered within their source, every FANOUT consecutive ones are
grouped into an array, and the concatenation of the array's digests is hashed into the parent, until each source has one
node, its subroot; the subroots are numbered and grouped likewise, up to the root.  From the root down, a join
for each level gives every node what stands to its left and to its right in its run, and all that its parent was given.

No source is in one task: rows are numbered by ranges of (source, key), whose counts are added up, and are dealt by run.
What is carried down to a level belongs to a run and not to a node, so it is a sixteenth of a row for each node below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, integral_key, numbered, text_crc_mod

FANOUT = 16
#: Where this divides the CRC of its key, a document is tampered with.
TAMPERED = 5

_PATH = "array<struct<l:string,r:string>>"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256, in lowercase hex, of the fields' texts: each '-' if null, else its bytes' number, a colon, and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _parents(nodes: DataFrame, fanout: int, *more: str) -> DataFrame:
    """(group, index, n, hash, kids) of the runs of groups that have more than one node; kids are (index, hash, more), in order."""
    run = F.floor(F.col("index") / F.lit(fanout)).alias("index")
    runs = nodes.where("n > 1").groupBy("group", run).agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("index", "hash", *more))).alias("kids"))
    return runs.select("group", "index", F.ceil(F.col("n") / F.lit(fanout)).cast("long").alias("n"), F.sha2(F.array_join(F.col("kids.hash"), "").cast("binary"), 256).alias("hash"), "kids")


def tree(nodes: DataFrame, fanout: int, scratch: Scratch, *more: str) -> tuple[list[DataFrame], DataFrame]:
    """(levels of runs from the lowest on, the tops (group, index, hash, level) of all groups) of numbered nodes (group, index, n, hash, more)."""
    levels: list[DataFrame] = []
    tops = nodes.where("n = 1").select("group", "index", "hash", F.lit(0).alias("level"), *more)
    left = nodes.agg(F.max("n")).first()[0] or 0
    while left > 1:
        levels.append(scratch.keep(_parents(nodes, fanout, *(more if not levels else ())), f"level{len(levels)}"))
        nodes, left = levels[-1], -(-left // fanout)
        tops = tops.unionByName(nodes.where("n = 1").select("group", "index", "hash", F.lit(len(levels)).alias("level"), *[F.lit(None).cast(tops.schema[c].dataType).alias(c) for c in more]))
    return levels, tops


def _down(runs: DataFrame, given: DataFrame, *carried: str) -> DataFrame:
    """What each kid of the runs is given: path (what its parent was given, after its own left and right), and the columns carried."""
    rows = runs.select("group", "index", "kids").join(given, ["group", "index"])
    hashes = F.col("kids.hash")
    joined = lambda a, n: F.array_join(F.slice(hashes, a, n), "")
    out = rows.select("group", "path", *carried, hashes.alias("hashes"), F.posexplode("kids").alias("at", "kid"))
    hashes = F.col("hashes")
    beside = F.struct(joined(F.lit(1), F.col("at")).alias("l"), joined(F.col("at") + 2, F.size("hashes")).alias("r"))
    return out.select("group", F.col("kid.index").alias("index"), "kid", F.concat(F.array(beside), F.col("path")).alias("path"), *carried)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and what stands beside it and its ancestors lead to."""
    return F.aggregate(path, start, lambda h, x: F.sha2(F.concat(x["l"], h, x["r"]).cast("binary"), 256))


def manifest(docs: DataFrame, *, key: str = "doc_id", source: str = "source", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text: str = "text", fanout: int = FANOUT, tampered: Column | None = None) -> DataFrame:
    """(key, source, leaf, path, subroot, root, proof_sha256, folded_root, verified) of every document.

    A leaf is the digest of the fields. Leaves ascend by key in their source, null keys first, equal keys by their digest; equal rows are a
    leaf each. A null source is one of its own, the first. path is what stands beside the leaf and its ancestors, (l, r) for each level;
    proof_sha256 is the digest of all of that. Where tampered holds (by default where TAMPERED divides the CRC of the key, never for a null key), the root is
    folded from the leaf of the text in lower case; verified says whether it is the root. Nulls in any field are a field of their own, unlike an empty
    text. Texts of any length are hashed whole. An empty table gives none. Keys must be whole numbers (TypeError). Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "merkle")
    named = docs.select(integral_key(docs, key).alias("key"), F.col(f"`{source}`").cast("string").alias("source"), *[F.col(f"`{f}`").alias(f"field{k}") for k, f in enumerate(fields)])
    tampering = F.coalesce(text_crc_mod(F.col("key"), TAMPERED) == 0 if tampered is None else tampered, F.lit(False))
    columns = [F.col(f"field{k}") for k in range(len(fields))]
    lowered = [ascii_lower(c) if f == text else c for f, c in zip(fields, columns, strict=True)]
    # The number of a written row tells equal rows apart; it is written, so it does not change when a task runs again.
    leaves = scratch.keep(
        named.select("key", "source", F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source")).alias("group"), leaf_digest(*columns).alias("hash"), F.when(tampering, leaf_digest(*lowered)).alias("other"), F.monotonically_increasing_id().alias("row")),
        "leaves",
    )
    more = ("key", "source", "other")
    nodes = scratch.keep(numbered(leaves, scratch, F.col("key").asc_nulls_first(), F.col("hash").asc(), F.col("row").asc()).drop("row"), "nodes")
    levels, tops = tree(nodes, fanout, scratch, *more)
    tops = scratch.keep(tops, "subroots")
    # One tree over the subroots, by source.
    over = scratch.keep(numbered(tops.select(F.lit(0).alias("group"), F.col("group").alias("of"), "hash"), scratch, F.col("of").asc()), "sources")
    upper, root = tree(over, fanout, scratch, "of")
    given = root.select("group", "index", F.lit(None).cast(_PATH).alias("path"), F.col("hash").alias("root")).withColumn("path", F.coalesce("path", F.array().cast(_PATH)))
    for runs in reversed(upper):
        given = scratch.keep(_down(runs, given, "root").select("group", "index", "path", "root"), "given")
    of = over.select(F.col("group").alias("group_"), F.col("index").alias("index_"), F.col("of").alias("group"), F.col("hash").alias("subroot"))
    sources = of.join(given.withColumnsRenamed({"group": "group_", "index": "index_"}), ["group_", "index_"]).select("group", "path", "root", "subroot")
    starts = scratch.keep(tops.join(sources, "group"), "starts")
    at_level = lambda k: starts.where(F.col("level") == k).select("group", "index", "path", "root", "subroot")
    alone = starts.where("level = 0").select("key", "source", F.col("hash").alias("leaf"), "other", "path", "root", "subroot")
    out = alone
    if levels:
        given = at_level(len(levels))
        for k in range(len(levels) - 1, 0, -1):
            below = _down(levels[k], given, "root", "subroot").drop("kid")
            given = scratch.keep(below.unionByName(at_level(k)), "given")
        rows = _down(levels[0], given, "root", "subroot")
        out = rows.select("kid.key", "kid.source", F.col("kid.hash").alias("leaf"), "kid.other", "path", "root", "subroot").unionByName(alone)
    proof = F.sha2(F.array_join(F.transform("path", lambda x: F.concat(x["l"], x["r"])), "").cast("binary"), 256)
    out = out.select("key", "source", "leaf", "path", "subroot", "root", proof.alias("proof_sha256"), folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
