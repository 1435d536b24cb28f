import random
import re
from collections import Counter

import numpy as np
import pytest

from lumenframe.llm import collocations

from .conftest import frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, fewest, longest=5, top=2000):
    counts, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        c = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                c.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= fewest}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        scored = []
        for p, a in found.items():
            if inside[p] < a:
                score, k = min((1000 * a * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, rank, p.decode(), -a, first, rest, n[lang], -score) for rank, (score, a, p, first, rest) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def mined(df, **options):
    return sorted(map(tuple, collocations.mine(df, **options).collect()))


def texts(df):
    return [(r.text, r.lang) for r in df.select("text", "lang").collect()]


@pytest.mark.parametrize("fewest, top", [(4, 2000), (15, 7)])
def test_mining_equals_brute_force(docs, fewest, top):
    """Null texts and languages, a very long text, repeated rows, columns of clashing names."""
    got = mined(docs, fewest=fewest, top=top)
    assert got == brute(texts(docs), fewest, top=top) and len(got) >= 10


def test_small_shards_and_stretches_find_the_same(docs):
    """Many shards, segments, rounds of the tree, read by each task one after the other."""
    some = docs.where("doc_id % 4 = 0")
    small = collocations.Limits(shard_slots=7, segment=3, branches=2, text_bytes=300, positions=50, held_shards=1, bucket_bits=4, kept_bytes=0)
    assert mined(some, fewest=4, limits=small) == brute(texts(some), 4)


def test_pieces_white_space_and_ties(spark):
    rng = random.Random(1)
    words = ["A", "b", "Ä", "z z", "\x00", "new", "york", "d-e"]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ". ", "\n", " \x0b", "!?"]) for _ in range(60)), rng.choice(["x", "y", None, "und"]), "s") for i in range(60)]
    df = frame(spark, rows)
    assert mined(df, fewest=3) == brute(texts(df), 3)


def test_few_and_empty(spark, empty):
    assert mined(empty) == []
    assert mined(frame(spark, [(1, None, "en", "s"), (2, "", "en", "s"), (3, "once only", "en", "s")])) == []
    assert mined(frame(spark, [(k, "a b", "en", "s") for k in range(99)])) == []
    assert mined(frame(spark, [(k, "a b", "en", "s") for k in range(100)])) == [("en", 1, "a b", 100, 100, 100, 200, 2000)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_perfect_hash_is_minimal_and_verifies(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**20, n, np.uint64), np.arange(n, dtype=np.uint64)
    table = collocations.PerfectHash.load(collocations.PerfectHash.build(a, b).dump())
    assert sorted(table.look_up(a, b).tolist()) == list(range(n))
    assert (table.look_up(a, b + np.uint64(n)) == -1).all()
