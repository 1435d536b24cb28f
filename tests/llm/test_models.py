import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import caps, langid, mixing, quality, suffix_lm
from lumenframe.llm.common import text_crc_mod

from .conftest import WORDS as VOCABULARY
from .conftest import frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def filled(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        share = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * share >= most * sizes[s] - 1e-9}
        for s in over or free:
            target[s] = float(min(most * sizes[s], w[s] * share))
        left -= sum(target[s] for s in over or free)
        free -= over or free
    return target


def test_mixing_targets_and_takes(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(words(t))
    target = filled(sizes, (5, 2, 1))
    taken, longest = Counter(), Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        longest[r.source] = max(longest[r.source], r.size)
    assert all(abs(taken[s] - target[s]) <= longest[s] / 2 + 1e-6 for s in sizes)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def expectations(sizes, target, preference, most=3):
    """Expected copies by making the largest preferences full one after the other."""
    level, full = None, set()
    for w in sorted(set(preference), reverse=True):
        rest = sum(s * p for s, p in zip(sizes, preference, strict=True) if p not in full)
        level = (target - most * sum(s for s, p in zip(sizes, preference, strict=True) if p in full)) / rest if rest else 0.0
        if level * w <= most:
            break
        full.add(w)
    return [float(most) if p in full else level * p for p in preference]


def test_mixing_odds_are_unequal_and_add_up(spark):
    rows = [(i, "w " * (1 + i % 97), "ab"[i % 3 > 0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.key: r for r in mixing.mix(docs, weights=(1, 1), seed=5).collect()}
    for name in "ab":
        keys = [k for k, _, s in rows if s == name]
        sizes = [out[k]["size"] for k in keys]
        target = out[keys[0]].target
        want = expectations(sizes, target, [max(1, math.isqrt(n)) for n in sizes])
        assert sum(e * n for e, n in zip(want, sizes, strict=True)) == pytest.approx(target)
        assert all(math.floor(e + 1e-9) <= out[k].copies <= min(3, math.floor(e) + 1) for k, e in zip(keys, want, strict=True))
        assert abs(sum(out[k].taken for k in keys) - target) <= 97 / 2 + 1e-6
    longer, shorter = ([out[k].copies for k, *_ in rows if (out[k]["size"] > 48) == x] for x in (True, False))
    assert np.mean(longer) > 1.3 * np.mean(shorter)


def test_mixing_by_preference_takes_more_of_the_preferred(spark):
    docs = spark.createDataFrame([(i, "w w w", "ab"[i % 2], 8 if i % 4 < 2 else 1) for i in range(4000)], "doc_id long, text string, source string, p int")
    out = {r.key: r.copies for r in mixing.mix(docs, weights=(1, 3), preference=F.col("p")).where("source = 'a'").collect()}
    high, low = (sum(c for k, c in out.items() if (k % 4 < 2) == x) for x in (True, False))
    assert high > 1.5 * low and 3 * (high + low) == pytest.approx(3000, abs=3)


@pytest.mark.parametrize("key", [None, 7])
def test_mixing_draws_for_each_row_of_null_and_equal_keys(spark, key):
    """Rows of null or equal key, with different texts and with the same: each source is within half a document of its target."""
    rows = [(key, f"w{i} " + "w " * 9, "a") for i in range(100)] + [(key, "v " * 10, "b")] * 100 + [(i, "x " * 10, "c") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == 300 and all(abs(taken[s] - target[s]) <= 5 + 1e-6 for s in "abc")
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    mixed = Counter(r.source for r in mixing.mixed_documents(docs).select("source").collect())
    assert all(10 * mixed[s] == taken[s] for s in "abc")


def test_mixed_documents_repeat_rows(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    copies = {(r.key, r["size"]): r.copies for r in mixing.mix(docs.where("doc_id IS NOT NULL AND doc_id <> 75")).collect()}
    seen = Counter(r.doc_id for r in mixing.mixed_documents(docs.where("doc_id IS NOT NULL AND doc_id <> 75")).select("doc_id").collect())
    assert {k: n for (k, _), n in copies.items() if n} == dict(seen)


def base(text):
    w = words(text)
    counts = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = [False] * len(w)
    for i in range(len(w) - 4):
        if counts[tuple(w[i : i + 5])] > 1:
            covered[i : i + 5] = [True] * 5
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), sum(covered)


def test_quality_base_columns_and_verdict(docs, rows, spark):
    junk = [(1000 + i, " ".join(f"{w}%%%" for w in prose(__import__("random").Random(i), "en", 60).split()), "en", "s0") for i in range(30)]
    every = docs.unionByName(frame(spark, junk))
    trusted = spark.createDataFrame([(i,) for i in range(60)] + [(None,), (5,)], "doc_id long")
    got = quality.judge(every, trusted).collect()
    assert len(got) == len(rows) + 30
    by = {}
    for d, t, *_ in rows + junk:
        by.setdefault(d, set()).add(base(t))
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in by[r.key]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    verdict = {r.key: r for r in got}
    assert not any(verdict[1000 + i].kept for i in range(30))
    clean = [verdict[i] for i in range(60) if not verdict[i].base_failed]
    assert np.mean([r.kept for r in clean]) > 0.7 and min(r.score for r in clean) > max(verdict[1000 + i].score for i in range(30))


def test_quality_score_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a c")], "doc_id long, text string")
    ratios = quality.log_ratios(docs, spark.createDataFrame([(1,)], "doc_id long"), buckets=1 << 16)
    # Six n-grams in all, three of them trusted; a is in both.
    low, high = math.log(1 / (3 + 65536)) - math.log(2 / (6 + 65536)), math.log(2 / (3 + 65536)) - math.log(2 / (6 + 65536))
    values = Counter(round(x, 9) for x in ratios)
    assert values[round(low, 9)] == 2 and values[round(high, 9)] == 2
    assert quality.log_ratios(docs, spark.createDataFrame([], "doc_id long"), buckets=8) == [0.0] * 8


def test_good_documents_keep_columns(docs, spark):
    trusted = spark.createDataFrame([(i,) for i in range(60)], "doc_id long")
    out = quality.good_documents(docs, trusted)
    assert out.columns == docs.columns
    told = {r.key: r.kept for r in quality.judge(docs, trusted).collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} - {None} == {k for k, v in told.items() if v} - {None}


def test_language_of_words_and_documents(spark):
    rng = __import__("random").Random(8)
    rows = [(i, prose(rng, la := list(VOCABULARY)[i % 3], rng.randint(5, 80)), la, "s") for i in range(400)]
    docs = frame(spark, rows)
    out = langid.identify(docs, learn_from=text_crc_mod("doc_id", 4) != 2).collect()
    truth = {d: la for d, _, la, _ in rows}
    held = [r for r in out if zlib.crc32(str(r.key).encode()) % 4 == 2]
    assert sum(r.lang_pred == truth[r.key] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    model = langid.fit([(la, t) for _, t, la, _ in rows])
    switched = prose(rng, "en", 12) + " " + prose(rng, "de", 12)
    _, posterior, flat = langid.word_posteriors(model, [switched])
    told = [model.languages[k] for k in posterior.argmax(1)]
    assert np.mean([a == b for a, b in zip(told, ["en"] * 12 + ["de"] * 12, strict=True)]) > 0.85 and len(flat) == 24


def test_language_of_odd_texts(docs, empty):
    out = langid.identify(docs, learn_from=F.col("doc_id") < 60).collect()
    by = {r.key: r for r in out}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (79, 80, 81, 83)) and by[85].lang_pred in ("en", "fr", "de")
    assert langid.identify(empty, learn_from=F.lit(True)).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, learn_from=F.lit(False)).collect()} == {"und"}


def test_numerals_part_words(spark, rows):
    assert langid.chains("x² Ⅳa ªb² no_1 Ω²é") == [["x", "a", "ªb", "no", "ω", "é"]]
    docs = frame(spark, [*rows, (500, "x²", None, None), (501, "²³ Ⅳ 12 _", None, None), (502, "Ⅳa", None, None)])
    got = {r.key: r.lang_pred for r in langid.identify(docs, learn_from=F.col("doc_id") < 60).collect()}
    assert got[500] != "und" and got[501] == "und" and got[502] != "und"


def test_language_sample_has_a_bound(spark):
    rows = [(i, "word " * 5000, f"l{i % 30:02d}", "s") for i in range(300)]
    got = langid.sample(frame(spark, rows), per_language=4, languages=5, spans=2, span_words=10)
    assert {name for name, _ in got} <= {f"l{i:02d}" for i in range(5)} and len(got) <= 5 * 10 * 2 and all(len(x.split()) <= 10 for _, x in got)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    e, t = rng.random((4, 3)) + 0.1, rng.random((3, 3)) + 0.1
    _, alive, place = langid.packed(np.array([4]))
    posterior, pairs, norms = langid.forward_backward(e[np.argsort(place)], alive, t)
    weight, total = np.zeros((4, 3)), 0.0
    seen = np.zeros((3, 3))
    for path in np.ndindex(3, 3, 3, 3):
        p = np.prod([e[i, s] for i, s in enumerate(path)]) * np.prod([t[a, b] for a, b in zip(path, path[1:], strict=False)])
        total += p
        for i, s in enumerate(path):
            weight[i, s] += p
        for a, b in zip(path, path[1:], strict=False):
            seen[a, b] += p
    assert np.allclose(posterior, weight / total) and np.allclose(pairs, seen / total) and np.isclose(np.prod(norms), total)


def vectors(spark, rng):
    x = rng.standard_normal((120, 16)).astype(np.float32)
    near = x[:30] + 0.05 * rng.standard_normal((30, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in z]) for i, z in enumerate(np.concatenate([x, near, x[:5], x[5:9] * 3, [x[0] * 1.0] * 20]).astype(np.float32))]
    odd = [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0] * 15 + [None]), (904, [float("inf")] + [1.0] * 15), (905, []), (906, [1.0] * 8), (907, [1.0] * 8), (None, rows[3][1]), (908, [0.0] * 15 + [5.0]), (908, [-0.0] * 15 + [5.0])]
    return rows, odd, spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("class", F.lit("x"))


@pytest.mark.parametrize("block", [3, 1024])
def test_cap_filters_equal_brute_force(spark, block):
    rows, odd, df = vectors(spark, np.random.default_rng(6))
    got = caps.near_duplicates(df, block=block, code_words=6, average_list=12).collect()
    assert len(got) == len(rows) + len(odd)
    good = rows + [r for r in odd if r[0] in (906, 907, 908, None)]
    links, parent = Counter(), {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and np.dot(np.array(x), np.array(y)) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                links[a] += 1
                links[b] += 1
                if a is not None and b is not None:
                    p, q = root(a), root(b)
                    parent[max(p, q)] = min(p, q)
    for r in got:
        if r.key in (908, None):
            continue
        assert r.n_links == links[r.key], r
        assert r.component == root(r.key) and r.kept == (r.component == r.key)
    assert [r for r in got if r.key == 900][0].n_links == 0
    assert {r.n_links for r in got if r.key == 908} == {1}


@pytest.mark.parametrize("vectors", [10_000, 4_000_000, 10**9])
def test_recall_of_the_default_code(vectors):
    """Pairs at a cosine of 0.951 share a filter of the code that so many vectors get."""
    rng, n = np.random.default_rng(1), 400
    a, b = (rng.standard_normal((n, 64)) for _ in range(2))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.951 * a + math.sqrt(1 - 0.951**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = caps.CapCode.for_vectors(vectors, 64)
    assert len(code.words) == (3 if vectors > 10**8 else 2)
    one, two = (set(zip(*map(np.ndarray.tolist, code.decode(x)), strict=True)) for x in (a, b))
    assert len({who for who, _ in one & two}) >= 0.97 * n


def test_list_decoding_finds_all_exceeding_filters():
    rng = np.random.default_rng(3)
    code = caps.CapCode.build(12, code_words=9, parts=3, average_list=10, least=4)
    x = rng.standard_normal((50, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    who, number = code.decode(x)
    turned, sums = x @ code.rotation, np.zeros((50, 1))
    for k, w in enumerate(code.words):
        sums = (sums[:, :, None] + (turned[:, 4 * k : 4 * k + 4] @ w.T)[:, None, :]).reshape(50, -1)
    bound = np.minimum(code.bound, np.sort(sums, axis=1)[:, -4])
    assert set(zip(who.tolist(), number.tolist(), strict=True)) == {(i, int(j)) for i in range(50) for j in np.flatnonzero(sums[i] >= bound[i] - 1e-12)}


def test_cap_filters_on_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert caps.near_duplicates(df).count() == 0
    assert [tuple(r) for r in caps.near_duplicates(spark.createDataFrame([(3, None)], "vec_id long, embedding array<float>")).collect()] == [(3, 0, 3, True)]


def fold(d):
    return d is not None and zlib.crc32(str(d).encode()) % 7 == 2


def test_language_model_base_score(docs, rows):
    learn = F.coalesce(text_crc_mod("doc_id", 7) != 2, F.lit(True))
    got = suffix_lm.score_texts(docs, learn_from=learn, divergence=1.0).collect()
    assert len(got) == len(rows)
    counts = Counter()
    for d, t, *_ in rows:
        if not fold(d):
            counts.update([w.translate(LOWER) for w in words(t)] + [None])
    n, v = sum(counts.values()), len(counts)
    by = {}
    for d, t, *_ in rows:
        w = [x.translate(LOWER) for x in words(t)] + [None]
        by.setdefault(d, []).append((fold(d), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 6)))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) in by[r.key] and r.train_tokens == n
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def brute_tree(train, fewest, divergence, heaps, max_depth):
    """The same model, by dictionaries: log10 of the probability of the word at a place of a text, and the contexts that are kept."""
    uni = Counter(w for t in train for w in t)
    n, v = sum(uni.values()), len(uni)
    counts = Counter(tuple(t[i - k : i]) for t in train for i in range(len(t) + 1) for k in range(1, min(i, max_depth) + 1))
    after = {}
    for t in train:
        for i in range(1, len(t)):
            for k in range(1, min(i, max_depth) + 1):
                after.setdefault(tuple(t[i - k : i]), Counter())[t[i]] += 1

    kept = set()

    def p(c, w, chain, less=0):
        """Smoothed over all shorter contexts, or over those of chain."""
        if not c:
            return (uni[w] + 1) / (n + v + 1)
        below = next((c[j:] for j in range(1, len(c)) if chain is None or c[j:] in chain), ())
        weight = counts[c] ** heaps
        return (max(0, after.get(c, {}).get(w, 0) - less) + weight * p(below, w, chain)) / (counts[c] - less + weight)

    level = {(w,) for w, m in uni.items() if m >= fewest and w is not None}
    for depth in range(1, max_depth + 1):
        kept |= {c for c in level if sum(m * math.log(p(c, w, None, 1) / p(c[1:], w, None)) for w, m in after.get(c, {}).items()) >= divergence}
        level = {c for c in after if len(c) == depth + 1 and c[1:] in level and c[:-1] in level and counts[c] >= fewest}

    def log10(text, i):
        c = next((c for k in range(min(i, max_depth), 0, -1) if (c := tuple(text[i - k : i])) in kept), ())
        return math.log10(p(c, text[i], kept))

    return log10, kept


@pytest.mark.parametrize("divergence", [0.5, 10.0])
@pytest.mark.parametrize("chunk", [300, 1 << 19])
def test_language_model_equals_brute_force(docs, rows, divergence, chunk, monkeypatch):
    monkeypatch.setattr(suffix_lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(suffix_lm, "BUCKET_KEYS", 2000)
    rows = [r for r in rows if r[0] != 87]  # all sequences of any length are too many for dictionaries
    learn = F.coalesce(text_crc_mod("doc_id", 7) != 2, F.lit(True))
    options = dict(fewest=2, divergence=divergence, heaps=0.7, max_depth=6)
    got = suffix_lm.score_texts(frame(docs.sparkSession, rows).repartition(5), learn_from=learn, **options).collect()
    texts = [(d, [x.translate(LOWER) for x in words(t)] + [None]) for d, t, *_ in rows]
    log10, kept = brute_tree([t for d, t in texts if not fold(d)], **options)
    assert max(map(len, kept)) >= (3 if divergence < 1 else 2)
    want = {}
    for d, t in texts:
        want.setdefault(d, []).append(sum(log10(t, i) for i in range(len(t))))
    assert len(got) == len(rows)
    for r in got:
        assert min(abs(r.score - x) for x in want[r.key]) < 1e-6 * max(1, abs(r.score)), (r, want[r.key])


def test_texts_that_occur_twice_score_higher(spark):
    """Contexts and words that occur twice in the corpus count, however large it is."""
    rng = __import__("random").Random(12)
    texts = [" ".join(f"w{int(1000 * rng.random() ** 3)}" for _ in range(200)) for _ in range(300)]
    rows = list(enumerate(texts + texts[:20]))
    got = {r.key: r for r in suffix_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), learn_from=F.lit(True)).collect()}
    gain = {k: (r.score - r.base_score) / r.n_tokens for k, r in got.items()}
    assert min(gain[k] for k in range(20)) > max(gain[k] for k in range(20, 300)) + 0.3


def test_language_model_without_training(docs, rows, empty):
    got = suffix_lm.score_texts(docs, learn_from=F.lit(False)).collect()
    assert len(got) == len(rows) and all(r.base_score == r.score == 0 and r.train_tokens == r.n_known == 0 for r in got)
    assert suffix_lm.score_texts(empty, learn_from=F.lit(True)).count() == 0
