import hashlib
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumenframe.llm import components, simhash, similar, substring
from lumenframe.llm.common import Scratch

from .conftest import frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def fingerprint(text):
    w = [x.translate(LOWER) for x in words(text)]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def named_components(rows, prints):
    """The smallest key of each row's component, by its place; rows of null and equal keys are rows like any other."""
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    of = groups(links, range(len(rows)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[of[i]] = min(r[0], least.get(of[i], r[0]))
    return [least.get(of[i]) for i in range(len(rows))]


def test_simhash_equals_brute_force(docs, rows):
    got = simhash.near_duplicates(docs).collect()
    prints = [fingerprint(t) for _, t, *_ in rows]
    want = named_components(rows, prints)
    assert Counter((r.key, r.fp & (2**64 - 1), r.component) for r in got) == Counter((r[0], p, c) for r, p, c in zip(rows, prints, want, strict=True))


def test_simhash_null_keys_connect_others(spark):
    """A text of null key that is two bits from either of two others, four bits apart; and one among null keys only."""
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(24)]
    base = " ".join(words)
    near = {}
    for _ in range(4000):
        other = list(words)
        for k in rng.integers(0, 24, 2):
            other[k] = f"v{rng.integers(0, 500)}"
        near.setdefault((fingerprint(base) ^ fingerprint(" ".join(other))).bit_count(), []).append(" ".join(other))
    pairs = [(a, b) for a in near.get(2, []) + near.get(1, []) for b in near.get(2, []) if (fingerprint(a) ^ fingerprint(b)).bit_count() in (3, 4)]
    a, b = pairs[0]
    rows = [(3, b, "en", "s"), (None, base, "en", "s"), (1, a, "en", "s"), (None, "all other words here", "en", "s"), (None, base, "en", "s")]
    got = sorted(((r.key, r.component) for r in simhash.near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (None, 1), (None, 1), (None, None)], key=str)


def test_simhash_small_blocks_find_the_same(spark):
    rng = np.random.default_rng(4)
    seeds = rng.integers(-(2**62), 2**62, 40)
    fps = [int(s) ^ (1 << int(a)) ^ (1 << int(b)) for s in seeds for a, b in rng.integers(0, 63, (12, 2))]
    classes = spark.createDataFrame(list(enumerate(fps)), "id long, fp long")
    scratch = Scratch(spark, "test")
    edges = simhash.near_edges(classes, 2, scratch, block=3)
    found = {r.node: r.component for r in components.components(edges, scratch).collect()}
    expected = groups([(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & (2**64 - 1)).bit_count() <= 2], range(len(fps)))
    assert all(found.get(i, i) == expected[i] for i in range(len(fps)))


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000)]
    found = components.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in found} == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}


def test_first_of_groups_keeps_columns_and_smallest(docs):
    kept = similar.first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 75 in ids and not ids & {76, 77, 80, 81} and None in ids


def place_of(key, text):
    """Null keys first, then keys, then a hash of the text; equal rows are one place."""
    return key is not None, key or 0, (xxhash.xxh64_intdigest((text or "").encode(), 42) + (1 << 63)) % (1 << 64)


def removed(rows, window=20):
    """{row: [(words, which go)]} by brute force."""
    first, out = {}, {}
    for d, t, *_ in sorted(rows, key=lambda r: place_of(r[0], r[1])):
        w = words(t)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (*place_of(d, t), i))
    for d, t, *_ in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (*place_of(d, t), i):
                gone[i : i + window] = [True] * window
        out.setdefault(d, []).append((w, gone))
    return out


def digest_rows(found):
    return Counter((d, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()) for d, rs in found.items() for w, gone in rs)


@pytest.mark.parametrize("levels", [1, 2, 3, 6])
def test_substring_equals_brute_force(docs, rows, levels):
    """All rows: null, repeated and equal keys, nulls and empty texts, copies."""
    got = substring.digests(docs, levels=levels).collect()
    assert Counter(tuple(r) for r in got) == digest_rows(removed(rows))


def test_substring_key_zero_is_not_a_null_key(spark, rows):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(45))
    for more in ([(None, a), (0, a)], [(None, a), (0, a), (0, b), (None, b)], [(0, a), (3, a), (0, b), (5, b), (5, a), (None, b)], [(0, a), (0, a), (None, "x"), (1, a)]):
        every = [(*r, "en", "s") for r in more] + [r for r in rows if r[0] is None or r[0] > 40]
        got = substring.digests(frame(spark, every).repartition(3)).collect()
        assert Counter(tuple(r) for r in got) == digest_rows(removed(every)), more
        kept = Counter(r.doc_id for r in substring.without_repeats(frame(spark, every)).collect())
        want = Counter(d for d, rs in removed(every).items() for w, gone in rs if not w or not all(gone))
        assert kept == want


def test_keys_must_be_whole_numbers(spark):
    docs = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    for f in (simhash.near_duplicates, substring.digests, substring.without_repeats):
        with pytest.raises(TypeError, match="doc_id is string"):
            f(docs)


def test_substring_rows_of_equal_key_and_different_text(spark):
    a, b = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(10, 50))
    docs = spark.createDataFrame([(1, a), (1, b), (2, a)], "doc_id long, text string")
    got = sorted((r.key, r.n_words, r.n_removed) for r in substring.digests(docs).collect())
    assert got == sorted([(1, 40, 0), (1, 40, 30), (2, 40, 40)])


def test_without_repeats_keeps_columns(docs):
    out = substring.without_repeats(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r for r in out.collect()}
    assert 76 not in texts and texts[86].text == "  two  spaces \n\n and\tmore é　ü  "
    assert texts[79].text is None and texts[80].text == ""
    assert all(r.n_chars == len(r.text) for r in texts.values() if r.text is not None)


def test_windows_of_every_level_agree():
    assert substring.lengths(20, 3) == [5, 10, 20] and substring.lengths(7, 9) == [1, 2, 4, 7]
    values = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for width in (1, 2, 3, 5, 8, 11, 16):
        expected = [i + int(values[i : i + width].argmin()) for i in range(300 - width + 1)]
        assert substring.smallest(values, width).tolist() == expected


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert similar.first_of_groups(empty).count() == 0
    assert substring.digests(empty).count() == 0
    assert substring.without_repeats(empty).count() == 0
    assert simhash.near_duplicates(empty.withColumn("doc_id", F.col("doc_id"))).columns == ["key", "fp", "component"]
