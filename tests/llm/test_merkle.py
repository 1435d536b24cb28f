import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import merkle

from .conftest import frame


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def leaf(row, low=False):
    values = (row.doc_id, row.source, row.lang, row.n_chars, lowered(row.text) if low else row.text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def upwards(hashes, fanout):
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([digest("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def brute(rows, fanout=16):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r))
    by = {s: sorted(v, key=lambda x: x[:3]) for s, v in by.items()}
    trees = {s: upwards([x[2] for x in v], fanout) for s, v in by.items()}
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    top = upwards([trees[s][-1][0] for s in order], fanout)
    for s, v in by.items():
        for i, (named, _, own, r) in enumerate(v):
            tampered = named and zlib.crc32(str(r.doc_id).encode()) % 5 == 0
            h, beside = leaf(r, True) if tampered else own, ""
            for levels, j in ((trees[s], i), (top, order.index(s))):
                for hashes in levels[:-1]:
                    a = j // fanout * fanout
                    left, right = "".join(hashes[a:j]), "".join(hashes[j + 1 : a + fanout])
                    beside, h, j = beside + left + right, digest(left + h + right), j // fanout
            yield r.doc_id, own, trees[s][-1][0], top[-1][0], digest(beside), h, h == top[-1][0]


def found(df, **options):
    out = merkle.manifest(df, **options)
    return sorted(map(tuple, out.select("key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_manifest_equals_brute_force(docs, fanout):
    """Null, equal and repeated keys, equal rows, null and one-document sources, a very long text, columns of clashing names."""
    assert found(docs, fanout=fanout) == sorted(brute(docs.collect(), fanout), key=str)


def test_manifest_of_a_hot_source_and_many_sources(spark):
    rows = spark.range(700).select(F.col("id").alias("doc_id"), F.concat(F.lit("Text "), "id").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 300, "hot").otherwise(F.concat(F.lit("é"), F.col("id") % 40)).alias("source"), F.col("id").alias("n_chars"))
    got = found(rows.repartition(7))
    assert got == sorted(brute(rows.collect()), key=str)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(700) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_small_and_empty_tables(spark, empty):
    assert found(empty) == []
    one = frame(spark, [(5, None, None, None)])
    assert found(one) == list(brute(one.collect())) and found(one)[0][1] == found(one)[0][3]
    same = frame(spark, [(1, "x", "en", "s")] * 40)
    assert found(same) == sorted(brute(same.collect()), key=str)


def test_proofs_find_any_change(docs):
    out = merkle.manifest(docs, tampered=F.lit(False))
    assert out.where("NOT verified").isEmpty()
    wrong = out.where(merkle.folded(merkle.leaf_digest(F.lit("other")), F.col("path")) == F.col("root"))
    assert wrong.isEmpty()


def test_keys_must_be_whole_numbers(spark):
    with pytest.raises(TypeError, match="doc_id is string"):
        merkle.manifest(spark.createDataFrame([("a", "x", "en", "s", 1)], "doc_id string, text string, lang string, source string, n_chars long"))
