"""BPE with word ends, encoded and decoded by a contiguous rank array for each word.

A word is an array of parts and an array of the merge ranks of neighbouring parts.
The smallest rank is found by scanning the array, the boundary behind that part is
deleted, and the two ranks beside the new part are refreshed; this repeats until no
neighbours can merge.  Words of up to SHORT symbols are done many at a time, a word
for each row of a matrix; longer ones, rare in text, are done one at a time with a
heap of ranks, since scanning costs the square of the length.
"""

from __future__ import annotations

import heapq
import json
from array import array

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import LATIN_END, byte_symbols, give_back, kept_by_worker, slices

#: Up to so many symbols, a word is encoded by scanning its ranks.
SHORT = 48
#: White-space runs and the words between them whose ids a Python worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 250_000

NO_RANK = np.int32(2**31 - 1)

#: Unicode's White_Space, which str.split() exceeds by four controls.
_SPACE = regex.compile(r"\p{White_Space}+")
_CONTROLS = regex.compile("[\x1c-\x1f]")


class WordBPE:
    """Reads a tokenizer file whose pipeline is: added tokens, NFC, white space, lower case, a split pattern, bytes, BPE with a word-end suffix, no decoder."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None or not model["end_of_word_suffix"]:
            raise ValueError("not a vocabulary of the kind this encoder reproduces")
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        library = Tokenizer.from_file(path)
        self.normalize, self.split_words = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.byte_of = {s: b for b, s in enumerate(byte_symbols())}
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokens = [""] * (max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        for token, i in self.added.items():
            self.tokens[i] = token
        self.added_cut = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")")
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int32)
        self.last = np.array([vocab[s + end] for s in symbols], np.int32)
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in model["merges"]]
        self.merged = np.array([m[2] for m in merges], np.int32)
        pairs = np.array([a << 32 | b for a, b, _ in merges], np.int64)
        order = np.argsort(pairs, kind="stable")
        first = np.concatenate([[True], np.diff(pairs[order]) > 0])
        self.pair_keys, self.pair_ranks = pairs[order][first], order[first].astype(np.int32)
        self.rank_of = dict(zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), strict=True))
        self.text_of = [t.encode("utf-8") for t in self.tokens]
        self._all_named = all(self.text_of)
        del spec, model, vocab, merges
        give_back()
        self.cache: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> WordBPE:
        """One per Python worker, so that tasks of the same worker share its cache."""
        return kept_by_worker(f"words {path}", lambda: cls(path))

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (right >= 0) & (left >= 0), self.pair_ranks[at], NO_RANK)

    def _short(self, words: list[bytes]) -> list[array]:
        """Words of up to SHORT bytes: parts and ranks are rows of two matrices."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        wide = int(sizes.max()) + 1
        parts = np.full((len(words), wide), -1, np.int32)
        inside = np.arange(wide) < sizes[:, None]
        raw = np.frombuffer(b"".join(words), np.uint8)
        parts[inside] = self.inner[raw]
        parts[np.arange(len(words)), sizes - 1] = self.last[raw[np.cumsum(sizes) - 1]]
        ranks = np.full((len(words), wide), NO_RANK, np.int32)
        ranks[:, :-1] = self._ranks(parts[:, :-1], parts[:, 1:])
        out = np.empty((len(words), wide), np.int32)
        live = np.arange(len(words))
        columns = np.arange(wide - 1)
        while live.size:
            least = ranks.argmin(1)  # the leftmost of equal ranks
            rows = np.arange(len(live))
            best = ranks[rows, least]
            over = best == NO_RANK
            if over.any():
                out[live[over]] = parts[over]
                stay = ~over
                live, parts, ranks, least, best = live[stay], parts[stay], ranks[stay], least[stay], best[stay]
                rows = np.arange(len(live))
                if not live.size:
                    break
            parts[rows, least] = self.merged[best]
            moved = columns + (columns > least[:, None])  # the boundary behind the part goes: what follows moves up
            parts[:, :-1] = np.take_along_axis(parts, moved, 1)
            parts[:, -1] = -1
            moved = columns + (columns >= least[:, None])
            ranks[:, :-1] = np.take_along_axis(ranks, moved, 1)
            ranks[:, -1] = NO_RANK
            ranks[rows, least] = self._ranks(parts[rows, least], parts[rows, np.minimum(least + 1, wide - 1)])
            before = np.flatnonzero(least > 0)
            at = least[before]
            ranks[before, at - 1] = self._ranks(parts[before, at - 1], parts[before, at])
        flat, sizes = out[out >= 0], (out >= 0).sum(1)
        cuts = np.cumsum(sizes)
        return [flat[b - n : b] for b, n in zip(cuts.tolist(), sizes.tolist(), strict=True)]

    def _long(self, word: bytes) -> np.ndarray:
        """One word of any length, by a heap of (rank, position) over linked parts."""
        raw = np.frombuffer(word, np.uint8)
        parts = self.inner[raw].tolist()
        parts[-1] = int(self.last[raw[-1]])
        after = [*range(1, len(parts)), -1]
        before = list(range(-1, len(parts) - 1))
        get = self.rank_of.get
        heap = [(r, k) for k in range(len(parts) - 1) if (r := get(parts[k] << 32 | parts[k + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, k = heapq.heappop(heap)
            n = after[k]
            if parts[k] < 0 or n < 0 or get(parts[k] << 32 | parts[n]) != r:
                continue
            parts[k], parts[n] = int(self.merged[r]), -1
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (r := get(parts[a] << 32 | parts[b])) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([p for p in parts if p >= 0], np.int32)

    def words(self, chunk: str) -> list[bytes]:
        """The words of a stretch of text without added tokens."""
        if chunk.isascii() or max(chunk) <= LATIN_END:
            return [w.encode("utf-8") for w in self.pattern.findall(chunk.lower())]
        # Which characters are letters, compose or have lower case is a matter of the Unicode version: the library's counts.
        return [bytes(map(self.byte_of.__getitem__, w)) for w, _ in self.split_words(self.normalize(chunk))]

    def _encode_new(self, chunks: list[str]) -> None:
        """Put the ids of stretches without white space into the cache."""
        split = [self.words(c) for c in chunks]
        names = list({w for ws in split for w in ws})
        known: dict[bytes, bytes] = {}
        short = sorted((w for w in names if len(w) <= SHORT), key=len)
        for k in range(0, len(short), 8192):
            part = short[k : k + 8192]
            known.update((w, ids.astype("<u4").tobytes()) for w, ids in zip(part, self._short(part), strict=True))
        known.update((w, self._long(w).astype("<u4").tobytes()) for w in names if len(w) > SHORT)
        for c, ws in zip(chunks, split, strict=True):
            self.cache[c] = known[ws[0]] if len(ws) == 1 else b"".join(known[w] for w in ws)

    def _chunks(self, text: str) -> list[str]:
        """Stretches without white space. What stands on either side of white space never meets in a word."""
        return [x for x in _SPACE.split(text) if x] if _CONTROLS.search(text) else text.split()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers. Null counts as empty."""
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, cut, new = self.cache, [], set()
        for token, i in self.added.items():
            cache[token] = i.to_bytes(4, "little")
        for text in texts:
            text = text or ""
            chunks = self._chunks(text)
            if any(token in text for token in self.added):
                chunks = [c for x in self.added_cut.split(text) for c in ([x] if x in self.added else self._chunks(x))]
            new |= set(chunks).difference(cache)
            cut.append(chunks)
        names = list(new)
        self._encode_new(names)
        out = [b"".join(map(cache.__getitem__, chunks)) for chunks in cut]
        for name in names:
            if len(name) > SHORT:
                del cache[name]
        return out

    def decode(self, ids: bytes | np.ndarray | list[int]) -> bytes:
        """The text of ids, in UTF-8: their tokens joined by spaces, as the vocabulary has no decoder. Unknown ids are left out."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, np.int64)
        try:
            return b" ".join(map(self.text_of.__getitem__, ids.tolist())) if self._all_named and (not len(ids) or ids.min() >= 0) else self._decode_some(ids)
        except IndexError:
            return self._decode_some(ids)

    def _decode_some(self, ids: np.ndarray) -> bytes:
        return b" ".join([self.text_of[i] for i in ids.tolist() if 0 <= i < len(self.text_of) and self.text_of[i]])


def encode_and_decode(docs: DataFrame, vocabulary_path: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids binary, decoded string) of every whole text: one pass, no shuffle. decoded is made from ids alone.

    A null or empty text has no ids and decodes to ''. A text of any length is encoded whole. Rows of equal or null key
    are encoded each by its own text; the key may be of any type. An empty table gives none. Other columns are not read.
    """

    def work(batches):
        bpe = WordBPE.shared(vocabulary_path)
        for batch in slices(batches, 128):
            got = bpe.encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.binary()), pa.array(map(bpe.decode, got), pa.binary()).cast(pa.string())], names=["key", "ids", "decoded"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"key {rows.schema[0].dataType.simpleString()}, ids binary, decoded string")


def encoded_documents(docs: DataFrame, vocabulary_path: str, *, text: str = "text") -> DataFrame:
    """The documents with ids and decoded beside their own columns; a column of these names, in upper or lower case, is replaced.

    Rows stay as they are, repeated ones and those of null key or text too; a null text has no ids and decodes to ''. A
    text of any length is encoded whole. An empty table gives none.
    """
    own = [f for f in docs.schema.fields if f.name.lower() not in ("ids", "decoded")]
    place = [f.name for f in own].index(text)

    def work(batches):
        bpe = WordBPE.shared(vocabulary_path)
        for batch in slices(batches, 128):
            got = bpe.encode(batch.column(place).to_pylist())
            more = [pa.array(got, pa.binary()), pa.array(map(bpe.decode, got), pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*(f.name for f in own), "ids", "decoded"])

    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in own), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return docs.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(work, schema)
