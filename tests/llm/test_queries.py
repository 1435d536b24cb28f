"""Every registered query runs on small tables and derives its columns as agreed."""

import hashlib
import zlib

import numpy as np

from lumenframe.llm import queries

from .conftest import frame
from .test_collocations import brute as phrases
from .test_merkle import brute as manifest
from .test_models import base, fold
from .test_pii import by_patterns
from .test_text_dedup import digest_rows, fingerprint, removed, words
from .test_tokens import BYTE_LIBRARY, WORD_LIBRARY


def test_queries_equal_brute_force(spark, rows, tmp_path):
    folder = f"file://{tmp_path}"
    rows = [r for r in rows if r[0] != 87] + [(300, "mail a.b@c.example.com or 4111 1111 1111 1111, 1.2.3.4; +1 (017) 555-7713", "en", "s0")]
    frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    vectors = [(0, [1.0, 0.0]), (1, [0.99, 0.1]), (2, [0.0, 1.0]), (3, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    got = {name: f(spark, folder).collect() for name, f in queries.QUERIES.items()}
    assert all(len(got[f"op{n}_{name}"]) == len(rows) for n, name in ((1, "simhash"), (2, "language_id"), (3, "substring"), (5, "quality_rules"), (7, "token_store"), (8, "word_bpe"), (9, "mixing"), (10, "suffix_lm"), (12, "personal_data"), (13, "merkle")))
    key = lambda d: (d is not None, d or 0)
    assert sorted(((key(r.doc_id), r.fingerprint) for r in got["op1_simhash"])) == sorted((key(d), f"{fingerprint(t):016x}") for d, t, *_ in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got["op2_language_id"])
    assert sorted(map(str, digest_rows(removed(rows)).elements())) == sorted(str(tuple(r)) for r in got["op3_substring"])
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got["op4_cap_filters"]} == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (0, 3, True)}
    assert sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got["op5_quality_rules"]) == sorted((key(d), *base(t)) for d, t, *_ in rows)
    assert sum(r.n_docs for r in got["op6_token_counts"]) == len(rows)
    bytes_of = lambda ids: np.array(ids, "<u4").tobytes()
    stored = [(key(d), len(ids) + 1, zlib.crc32(bytes_of([*ids, 2]))) for d, t, *_ in rows for ids in [BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids]]
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got["op7_token_store"]) == sorted(stored)
    coded = [(key(d), len(ids), hashlib.sha256(bytes_of(ids)).hexdigest(), hashlib.sha256(WORD_LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for d, t, *_ in rows for ids in [WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids]]
    assert sorted((key(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got["op8_word_bpe"]) == sorted(coded)
    assert sorted((key(r.doc_id), r["size"]) for r in got["op9_mixing"]) == sorted((key(d), len(words(t))) for d, t, *_ in rows)
    assert sorted((key(r.doc_id), r.held_out, r.n_tokens) for r in got["op10_suffix_lm"]) == sorted((key(d), fold(d), len(words(t)) + 1) for d, t, *_ in rows)
    assert sorted(map(tuple, got["op11_collocations"])) == phrases([(t, la) for _, t, la, _ in rows], 100)
    sha = lambda spans: hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    spans = [(key(d), *(sum(s[0] == k for s in found) for k in ("email", "ip", "card", "phone")), sha(found)) for d, t, *_ in rows for found in [by_patterns(t)]]
    assert sorted((key(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got["op12_personal_data"]) == sorted(spans)
    whole = next(r for r in got["op12_personal_data"] if r.doc_id == 300)
    assert (whole.n_email, whole.n_ip, whole.n_card, whole.n_phone) == (1, 1, 1, 1) and whole.spans == "email:5:22,card:26:45,ip:47:54,phone:56:73"
    columns = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    assert sorted((tuple(r[c] for c in columns) for r in got["op13_merkle"]), key=str) == sorted(manifest(frame(spark, rows).collect()), key=str)
