from collections import Counter

import numpy as np

import corpus_pipeline
from lumenframe.llm import mixing, quality

from .conftest import frame
from .test_models import base
from .test_similar import alike
from .test_text_dedup import groups, place_of, removed
from .test_tokens import WORD_LIBRARY


def test_pipeline_equals_brute_force(spark, rows, tmp_path):
    """Each stage by brute force over what the one before it keeps; verdicts and copies come from operators tested elsewhere."""
    named = rows
    folder = f"file://{tmp_path}"
    frame(spark, named).write.parquet(f"{folder}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(70, 0, 0), (71, 1, 1)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {(r.key, r.n_words, r.word_chars, r.n_dup_lines): r.kept for r in quality.judge(docs, quality.trusted_labels(labels)).collect()}
    now = [r for r in named if kept[(r[0], base(r[1])[0], base(r[1])[1], base(r[1])[3])]]
    component = groups([(a, b) for a in range(len(now)) for b in range(a) if alike(now[a][1], now[b][1])], range(len(now)))
    first = {}
    for k, r in enumerate(now):
        best = (r[0] is None, r[0] or 0, place_of(*r[:2])[2])
        if component[k] not in first or best < first[component[k]][0]:
            first[component[k]] = best, k
    now = [now[k] for k in sorted(k for _, k in first.values())]
    left = []
    for d, t, la, s in now:
        words, gone = next(x for x in removed(now)[d] if x[0] == (t or "").split())
        text = " ".join(w for w, g in zip(words, gone, strict=True) if not g) if any(gone) else t
        if text or not any(gone):
            left.append((d, text, la, s))
    copies = {(r.key, r["size"]): r.copies for r in mixing.mix(frame(spark, left)).collect()}
    want = Counter({(d, t): n for d, t, *_ in left if (n := copies[d, len(t.split())])})
    out = corpus_pipeline.run(spark, folder)
    got = out.select("doc_id", "text", "n_chars", "n_tokens", "ids", "decoded").collect()
    assert Counter((r.doc_id, r.text) for r in got) == want and len(want) > 30
    for r in got:
        ids = WORD_LIBRARY.encode(r.text, add_special_tokens=False).ids
        assert r.n_chars == len(r.text) and r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert r.decoded == WORD_LIBRARY.decode(ids, skip_special_tokens=False)
    assert set(docs.columns) < set(out.columns)


def test_stages_return_the_columns_of_documents_and_take_empty_tables(spark, empty, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == empty.columns, name
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        assert docs.count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "substring_dedup", "source_mixing", "bpe_encoding"]
