import random

from lumenframe.llm import quality

from .conftest import frame, prose


def test_threshold_follows_the_trusted_scores(spark):
    """Where all trusted texts score above -0.08, so does the threshold; where some are below, they are kept."""
    rng = random.Random(4)
    good = [prose(rng, "en", 150) for _ in range(40)]
    words = prose(rng, "fr", 12).split()
    far = [" ".join(w for k, x in enumerate(prose(rng, "en", 150).split()) for w in ([x, rng.choice(words)] if k % (2 * n + 3) == 0 else [x])) for n in range(24)]
    near = [" ".join(good[n].split() + [f"x{n}y{k}" for k in range(3 * n)]) for n in range(24)]
    trusted = spark.range(40).withColumnRenamed("id", "doc_id")
    for bad, above in ((far, True), (near, False)):
        docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(good + bad)])
        out = {r.key: r for r in quality.judge(docs, trusted).collect()}
        lowest = min(out[k].score for k in range(40))
        threshold = quality.trusted_threshold(docs, trusted, quality.log_ratios(docs, trusted))
        assert threshold == round(lowest, 9) and (threshold > -0.08) == above
        assert all(out[k].kept for k in range(40)) and any(not out[k].kept for k in range(40, 64))
        assert all(r.kept == (round(r.score, 9) >= threshold) for r in out.values())


def test_all_trusted_documents_count(spark):
    """The lowest of 41,000 trusted keys sets the threshold, whichever it is, and whether the keys are sent or joined."""
    rng = random.Random(9)
    rows = [(i, prose(rng, "en", 30), "en", "s") for i in range(30)]
    trusted = spark.range(41_000).withColumnRenamed("id", "doc_id")
    docs = frame(spark, rows)
    found = [quality.log_ratios(docs, trusted, most_sent=most) for most in (100_000, 10)]
    assert max(abs(a - b) for a, b in zip(*found, strict=True)) < 1e-12
    # All documents are trusted, so both multinomials are the same.
    assert max(map(abs, found[0])) < 1e-12
    thresholds = [quality.trusted_threshold(docs, trusted, [0.001 * b for b in range(8192)], most_sent=most) for most in (100_000, 10)]
    scores = [r.score for r in quality._scored(docs, [0.001 * b for b in range(8192)], key="doc_id", text="text", keep=None, prior=quality.PRIOR_GRAMS, buckets=8192).where("not base_failed").collect()]
    assert thresholds == [round(min(scores), 9)] * 2
