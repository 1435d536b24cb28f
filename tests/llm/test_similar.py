import random
from collections import Counter

import numpy as np

import corpus_pipeline
from lumenframe.llm import similar

from .conftest import frame, prose
from .test_text_dedup import groups


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def alike(a, b):
    a, b = grams(a), grams(b)
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def edited():
    """Texts with copies of one to many edits, many copies of one text, a line that most texts have, rows of equal key and without."""
    rng = random.Random(5)
    line = prose(rng, "en", 30)
    texts = [prose(rng, "en", rng.randint(1, 150)) + (" " + line if k % 2 else "") for k in range(60)]
    texts += [None, "", " \n"]
    for base in texts[:40]:
        for n in (1, 2, 4):
            words = base.split()
            for _ in range(n):
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
    hub = prose(rng, "de", 120).split()
    for _ in range(60):
        words = list(hub)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def test_stage_links_every_pair_of_the_similarity(spark, tmp_path):
    rows = [(i, t, "en", "s") for i, t in enumerate(edited())]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if alike(rows[a][1], rows[b][1])]
    want = groups(pairs, range(len(rows)))
    docs = frame(spark, rows)
    got = similar.near_duplicates(docs).toPandas()
    assert (got.groupby("component").key.transform("min") == got.key.map(want)).all() and got.component.nunique() == len(set(want.values()))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in out.collect()) == sorted(set(want.values())) and out.columns == docs.columns


def test_small_blocks_find_the_same(spark, monkeypatch):
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(edited())])
    some = lambda: sorted(tuple(g) for _, g in similar.near_duplicates(docs).toPandas().sort_values("key").groupby("component").key)
    usual = some()
    monkeypatch.setattr(similar, "BLOCK", 7)
    monkeypatch.setattr(similar, "HELD", 4096)
    monkeypatch.setattr(similar, "SENT", 0)
    assert some() == usual


def test_radii_lose_next_to_no_pair():
    """Sets of many sizes at exactly the similarity: their fingerprints are within both radii."""
    rng, first, radius = np.random.default_rng(7), *similar.radii(0.8)
    near = []
    for _ in range(1500):
        both = 4 * int(rng.integers(3, 60))
        alone = both // 4
        cut = int(rng.integers(0, alone + 1))
        values = rng.integers(0, 1 << 63, both + alone, np.uint64)
        a, b = (similar.wide_fingerprint(np.unique(x)).view(np.uint64) for x in (values[: both + cut], np.concatenate([values[:both], values[both + cut :]])))
        bits = np.bitwise_count(a ^ b)
        near.append(bits[0] <= first and bits.sum() <= radius)
    assert np.mean(near) >= 0.998


def test_common_members_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300))) for _ in range(30)]
    left, right = np.arange(12), np.arange(12, 30)
    wanted = rng.random((12, 18)) < 0.7
    want = np.array([[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]) * wanted
    for held in (1 << 26, 2048):
        monkeypatch.setattr(similar, "HELD", held)
        assert (similar.common_members(sets, left, right, wanted) == want).all()


def test_stage_decides_by_row(spark):
    rng = random.Random(8)
    a, b, c = (prose(rng, "en", 50) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, c), (None, c), (3, ""), (4, None)]
    out = corpus_pipeline.near_duplicates(spark, frame(spark, [(*r, "en", "s") for r in rows]), "")
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter([(1, a), (2, b), (None, c), (3, "")])
