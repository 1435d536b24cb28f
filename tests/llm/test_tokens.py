import hashlib
import random
import zlib
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from lumenframe.llm import token_counts, token_store, word_bpe
from lumenframe.llm.common import get_file, put_file
from lumenframe.llm.piece_encoder import PieceEncoder

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def library(path):
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


BYTE_LIBRARY, WORD_LIBRARY = library(BYTES), library(WORDS)
ODD = ["", " ", "  ", " a", "a ", "a  b", "a \n b", "a\nb c.\nDé, x\n'ti", "a\n\nb", "a\nb\n", "\na b", "a\n b", "a\r\nb", "\n\nfoo  \t bar", "x\x1c y", "é　 b", "foo<|endoftext|> bar <|endoftext|>\n \n<|endoftext|>", "it's  don't 've", "½ ²x 12a_b ٣٤ Ⅷ", "ΑΣ Σας ΟΔΟΣ", "İstanbul ẞ Ǆ é ̈a", "日本語 한국어 😀👩‍👩‍👧", "a" * 700 + " b", "<|ENDOFTEXT|>x<|startoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from(" \n\t'abcdeSTR.,1é<|>Σß\x1f "), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_encoders_equal_the_library(texts):
    texts = texts + random.Random(len(texts)).sample(ODD, 3)
    for ids, want in zip(PieceEncoder.shared(BYTES).encode(texts), BYTE_LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
    bpe = word_bpe.WordBPE.shared(WORDS)
    for ids, want in zip(bpe.encode(texts), WORD_LIBRARY.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids
        assert bpe.decode(ids).decode() == WORD_LIBRARY.decode(want.ids, skip_special_tokens=False)


def test_decoding_is_of_ids_alone():
    bpe = word_bpe.WordBPE.shared(WORDS)
    ids = random.Random(2).choices(range(49_408), k=500)
    assert bpe.decode(ids).decode() == WORD_LIBRARY.decode(ids, skip_special_tokens=False)
    assert bpe.decode([5, 10**6, -1, 7]) == bpe.decode([5, 7]) and bpe.decode([]) == b""


def test_long_words_by_heap_equal_the_scan():
    bpe, rng = word_bpe.WordBPE.shared(WORDS), random.Random(1)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, word_bpe.SHORT))).encode() for _ in range(300)]
    for a, b in zip(bpe._short(words), map(bpe._long, words), strict=True):
        assert a.tolist() == b.tolist()


def test_caches_that_turn_over_change_nothing():
    encoder = PieceEncoder(BYTES)
    encoder.pieces.limit = encoder.words.limit = encoder.starts.limit = 3
    text = "one two three four, five six seven.\none two\nthree\nfour,\nfive, six\none two three four, five"
    assert encoder.encode([text] * 3) == PieceEncoder(BYTES).encode([text] * 3)


def test_word_bpe_over_documents(docs, rows):
    got = {}
    for r in word_bpe.encode_and_decode(docs, WORDS).collect():
        got.setdefault(r.key, []).append((hashlib.sha256(r.ids).hexdigest(), r.decoded))
    want = {}
    for d, t, *_ in rows:
        ids = WORD_LIBRARY.encode(t or "", add_special_tokens=False).ids
        want.setdefault(d, []).append((hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), WORD_LIBRARY.decode(ids, skip_special_tokens=False)))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_encoded_documents_keep_their_columns(docs):
    out = word_bpe.encoded_documents(docs, WORDS)
    assert out.columns == [*docs.columns, "ids", "decoded"]
    assert word_bpe.encoded_documents(out, WORDS).columns == out.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(-(2**40), 2**40)), st.lists(st.integers(0, 2**32 - 1), max_size=90)), max_size=30), st.integers(0, 33))
def test_token_file_round_trip(docs, shift):
    ids = [np.array(x, np.uint32) >> np.uint32(min(shift, 31)) for _, x in docs]
    file = token_store.TokenFile(token_store.pack([k for k, _ in docs], ids, before=7))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    assert file.ids().tolist() == flat.tolist()
    assert [file.token(i) for i in range(len(flat))] == flat.tolist()
    assert file.keys == [k for k, _ in docs] and np.diff(file.offsets.astype(int)).tolist() == list(map(len, ids)) and file.before == 7
    with pytest.raises(IndexError):
        file.token(len(flat))


def test_token_file_over_many_blocks():
    ids = np.random.default_rng(0).integers(0, 70_000, 5000).astype(np.uint32)
    file = token_store.TokenFile(token_store.pack([1], [ids]))
    assert len(file.levels) == 3 and [file.token(i) for i in range(5000)] == ids.tolist()


@pytest.mark.parametrize("file_tokens", [50, 4_000_000])
def test_token_store_reads_back(docs, rows, tmp_path, file_tokens):
    folder = f"file://{tmp_path}/t{file_tokens}"
    written = token_store.write_token_files(docs, folder, BYTES, end_id=2, file_tokens=file_tokens)
    written = docs.sparkSession.createDataFrame(written.collect(), written.schema)
    got = token_store.read_token_files(docs.sparkSession, folder, written).collect()
    encoded = {}
    for d, t, *_ in rows:
        ids = [*BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids, 2]
        encoded.setdefault(d, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start and (r.n_tokens, r.ids_crc32) in encoded[r.key]
        start += r.n_tokens
    keys = [r.key for r in sorted(got, key=lambda r: r.start)]
    assert len(keys) == len(rows) and keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_token_store_splits_hot_keys_and_writes_again(spark, tmp_path):
    rows = [(None, f"none {i}") for i in range(400)] + [(7, f"seven {i}") for i in range(300)] + [(i, f"t {i}") for i in range(-150, 150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/files"
    written = [token_store.write_token_files(docs, folder, BYTES, end_id=2).collect() for _ in range(2)]
    parts = [{r.part: r.n_tokens for r in x} for x in written]
    assert parts[0] == parts[1] and len(parts[0]) == 4 and max(parts[0].values()) < 0.5 * sum(parts[0].values())
    named = spark.createDataFrame(written[0], "part int, file string, n_tokens long")
    got = sorted(token_store.read_token_files(spark, folder, named).collect(), key=lambda r: r.start)
    assert [r.key for r in got] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k or 0))
    (tmp_path / "files" / written[0][0].file).unlink()
    with pytest.raises(PythonException, match=written[0][0].file):
        token_store.read_token_files(spark, folder, named).collect()


def test_two_attempts_at_a_file_leave_it_whole(tmp_path):
    """Attempts that overlap, one of them stopped on its way: the file is there, whole, once any has ended, and no later one takes it away."""
    folder, data = f"file://{tmp_path}/f", b"x" * 100_000
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda k: put_file(folder, f"n{k % 3}", data), range(48)))
    put_file(folder, "n0", b"another attempt's")
    assert sorted(p.name for p in (tmp_path / "f").iterdir() if not p.name.startswith(".")) == ["n0", "n1", "n2"]
    assert all(get_file(folder, f"n{k}") == data for k in range(3)) and get_file(folder, "none", needed=False) is None
    with pytest.raises(FileNotFoundError):
        get_file(folder, "none")


@pytest.mark.parametrize("n", [1, 2, 3, 10, 50])
def test_ranges_are_found_as_by_counting(spark, n):
    rng = random.Random(n)
    bounds = sorted((rng.randint(0, 1), rng.randint(-5, 5), rng.randint(0, 1 << 62)) for _ in range(n))
    rows = [(rng.choice([None, *range(-6, 7)]), rng.randint(0, (1 << 63) - 1)) for _ in range(200)]
    got = spark.createDataFrame(rows, "key long, order long").select("key", "order", token_store._part(bounds).alias("part")).collect()
    assert all(r.part == sum(b <= (int(r.key is not None), r.key or 0, r.order) for b in bounds) for r in got)


def test_length_histogram_answers(docs, rows, spark):
    lengths = sorted(len(BYTE_LIBRARY.encode(t or "", add_special_tokens=False).ids) for _, t, *_ in rows)
    histogram = token_counts.length_histogram(token_counts.encoded_lengths(docs, BYTES)).persist()
    got = {r.n_tokens: r for r in histogram.collect()}
    assert sorted(got) == sorted(set(lengths))
    for n, r in got.items():
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (lengths.count(n), sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_at_most, r.truncated_total, r.total_tokens, r.total_docs) == (sum(x <= n for x in lengths), sum(min(x, n) for x in lengths), sum(lengths), len(lengths))
    limits = [0, 1, 17, 100, 10**6]
    assert {r.context_limit: (r.docs_cut, r.kept_tokens) for r in token_counts.truncated_totals(histogram, limits).collect()} == {m: (sum(x > m for x in lengths), sum(min(x, m) for x in lengths)) for m in limits}
    for r in token_counts.length_quantiles(histogram, [0.1, 0.5, 1.0]).collect():
        assert r.n_tokens == lengths[-(-int(r.share * len(lengths) * 1000) // 1000) - 1] or sum(x <= r.n_tokens for x in lengths) >= r.share * len(lengths) > sum(x < r.n_tokens for x in lengths)


def test_empty_tables(empty):
    assert word_bpe.encode_and_decode(empty, WORDS).count() == 0
    assert token_store.store_and_read(empty, BYTES, end_id=2).count() == 0
    assert token_counts.length_histogram(token_counts.encoded_lengths(empty, BYTES)).count() == 0
