"""Scores of whole texts under a probabilistic suffix tree of words.

The tree's states are contexts of preceding words, up to max_depth of them.  A context is tried if it occurs often enough (twice, by
default) and so do the contexts without its first and without its last word, which were tried: so every sequence that occurs again is
looked at, and evidence is absolute, it does not have to grow with the corpus.  A tried context is kept if a divergence test finds that the words
after it are told better by it than by the context without its first word (a leave-one-out log-likelihood ratio of
divergence or more).  Next-word distributions are smoothed from each context to the shorter one, p = (n + m p') / (N + m),
down to the add-one distribution of single words; m = N ** heaps, as the number of words that follow a context grows by
Heaps' law.  A token is scored in the longest kept state, smoothed by the kept ones that it ends in.

Texts are dealt once into chunks of about CHUNK_TOKENS tokens: numbers of words, and the chunk's distinct words.  All else is
asked: a chunk counts its own sequences and sends each distinct one, with its count, to the sequence's bucket, which
answers the sum over all chunks.  So counts stay distributed; nothing is cut off and nothing that grows with the corpus
is sent to every task.  Frequent sequences are sent once for each chunk that has them, however often it does.  What
only one chunk has is told by its parts: a sequence whose beginning or end no other chunk has needs no question.
There is a round of questions for each depth; the divergences of a depth's contexts go along with the next.

What a chunk comes to know in a round, and what it is answered, are files of its own in the shared folder: texts are
never shuffled.  A task that runs again reads the files of the rounds before and writes the same bytes.

Sequences are told apart by 56 bits of a hash.  Questions and files are packed: whole numbers go by their bytes, all lowest ones
first, compressed; sorted hashes by their differences; an answer is a bit for each key in the order of the question, and sums of those that have it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, get_file, kept_by_worker, put_file, slices

#: Occurrences in the training texts that make a context worth trying.
FEWEST = 2
#: Log-likelihood gain, in nats, that a context must bring over its suffix.
DIVERGENCE = 4.0
#: Steps of a nat in which divergences are summed: of whole numbers, the sum does not hang on the order.
STEPS = 256
#: Exponent of a context's count that gives the weight of its suffix.
HEAPS = 0.7
#: Words of the longest context.
MAX_DEPTH = 4
#: Tokens of a chunk, about (a text is never cut), and distinct sequences of a bucket.
CHUNK_TOKENS, BUCKET_KEYS = 3 << 18, 1 << 20

END = np.uint64(0)
_FACTORS = np.random.default_rng(10).integers(0, 2**63, 2, np.uint64) * np.uint64(2) + np.uint64(1)


def words_in(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z lower-cased, as binary; and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, sizes = lists.flatten().cast(pa.binary()), lists.value_lengths().to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # white space at the ends of a text leaves empty ones
    if not pc.all(full).as_py():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes), full.to_numpy(zero_copy_only=False), len(sizes)).astype(np.int64)
        words = words.filter(full)
    return words, sizes


def word_hashes(words: pa.Array) -> np.ndarray:
    return np.maximum(np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words)), np.uint64(1))


def packed(values: np.ndarray) -> bytes:
    """Whole numbers of 0 and above, by byte planes, compressed."""
    top = int(values.max()) if len(values) else 0
    width = max(1, -(-top.bit_length() // 8))
    planes = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + len(values).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(planes), codec="zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    width, n = data[0], int.from_bytes(data[1:9], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[9:], decompressed_size=width * n, codec="zstd"), np.uint8).reshape(width, n).T
    return out.view("<i8").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys, by their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data)).view(np.uint64)


@dataclass
class Settings:
    fewest: int
    divergence: float
    heaps: float
    tokens: int = 0  # of the training texts
    distinct: int = 0


#: Rows of a round: questions of a chunk to a bucket (keys, amounts), answers (bits, sums), and counts (chunk below 0).
_ROW = "chunk long, bucket int, keys binary, amounts binary, grown long, distinct long, total long"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _rows(chunks: list[int], buckets: list[int], keys: list[bytes], amounts: list[bytes], grown: int = 0, distinct: int = 0, total: int = 0) -> pa.RecordBatch:
    n = len(chunks)
    longs = lambda x: pa.array([x] * n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(buckets, pa.int32()), pa.array(keys, pa.binary()), pa.array(amounts, pa.binary()), longs(grown), longs(distinct), longs(total)], names=_NAMES)


def _write(folder: str, chunk: int, parts: list[bytes]) -> None:
    """A file of byte strings for a chunk; they are the same whenever the task runs."""
    put_file(folder, str(chunk), _joined(parts))


def _read(folder: str, chunk: int, needed: bool = True) -> list[bytes]:
    """The byte strings of a chunk's file; none if it has no file and needs none. FileNotFoundError if a file is missing."""
    data = get_file(folder, str(chunk), needed=bool(needed))
    return [] if data is None else _parted(data)


def chunked(docs: DataFrame) -> DataFrame:
    """Rows (key, held_out, text) dealt into chunks: chunk, the keys, held_out, and parts: held_out again, the numbers of tokens (each text is closed by its end), the distinct words, and each token's."""

    def work(batches):
        kept_by_worker("chunks")
        number = TaskContext.get().partitionId() << 33
        keys, held, sizes, names, hashes, ids = [], [], [], pa.array([], pa.binary()), np.zeros(0, np.uint64), []
        total = 0

        def row():
            every, at = np.unique(np.concatenate([[END], hashes]), return_inverse=True)
            flat = at[np.concatenate(ids)]
            kinds, place = np.unique(flat, return_inverse=True)
            frequent = np.argsort(-np.bincount(place), kind="stable")  # frequent words have low numbers, which pack well
            number_of = np.empty(len(kinds), np.int64)
            number_of[frequent] = np.arange(len(kinds))
            used = every[kinds]
            parts = [np.packbits(np.asarray(pa.concat_arrays(held).to_numpy(zero_copy_only=False), bool)).tobytes(), packed(np.concatenate(sizes)), packed_keys(used), packed(number_of), packed(number_of[place])]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in (pa.concat_arrays(keys), pa.concat_arrays(held))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([parts], pa.list_(pa.binary()))], names=["chunk", "key", "held_out", "parts"])

        for batch in slices(batches):
            words, lengths = words_in(batch.column(2))
            met = words.dictionary_encode()
            place = pc.index_in(met.dictionary, value_set=names)
            new = pc.is_null(place)
            more = met.dictionary.filter(new)
            place = pc.fill_null(place, -1).to_numpy().astype(np.int64)
            place[place < 0] = len(names) + np.arange(len(more))
            names, hashes = pa.concat_arrays([names, more]), np.concatenate([hashes, word_hashes(more)])
            out = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # 0 is the end, words are from 1
            inner = np.ones(len(out), bool)
            inner[np.cumsum(lengths + 1) - 1] = False
            out[inner] = place[met.indices.to_numpy()] + 1
            keys.append(batch.column(0))
            held.append(batch.column(1))
            sizes.append(lengths + 1)
            ids.append(out)
            total += len(out)
            if total >= CHUNK_TOKENS:
                yield row()
                keys, held, sizes, names, hashes, ids = [], [], [], pa.array([], pa.binary()), np.zeros(0, np.uint64), []
                total, number = 0, number + 1
        if keys:
            yield row()

    return docs.select("key", "held_out", "text").mapInArrow(work, f"chunk long, key array<{docs.schema['key'].dataType.simpleString()}>, held_out array<boolean>, parts array<binary>")


class Chunk:
    """A chunk's tokens, and how far the tree is known at each."""

    def __init__(self, parts: list[bytes], known: Settings) -> None:
        self.known = known
        held_out, sizes, words, number_of, ids = parts
        self.sizes, self.words = unpacked(sizes), unpacked_keys(words)
        word_of = np.empty(len(self.words), np.int64)
        word_of[unpacked(number_of)] = np.arange(len(self.words))
        self.ids = word_of[unpacked(ids)]
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.train = ~_bits(held_out)[: len(self.sizes)][self.text]

    def own_words(self) -> np.ndarray:
        return np.bincount(self.ids, self.train, len(self.words)).astype(np.int64)

    def follow(self, totals: bytes, seen: list[bytes]) -> None:
        """Go down the tree: totals are codes of the words' counts, seen those of the sequences at the positions of each depth.

        A code is twice the count, and one more if other chunks have the word or sequence too.  Afterwards levels has for each depth the positions
        whose contexts are tried, the contexts' counts, those of the words after them, and whether others have the context; at are the
        positions of the next depth.
        """
        code = unpacked(totals)[self.ids]
        self.count, self.shared = code >> 1, code & 1 > 0
        first = np.zeros(len(self.ids), bool)
        first[np.cumsum(self.sizes) - self.sizes] = True
        at = np.flatnonzero(~first)
        self.at = at[self.count[at - 1] >= self.known.fewest]
        self.n_context, self.levels, self.depth = self.count[self.at - 1], [], 1
        for data in seen:
            code = unpacked(data)
            at, n = self.at, code >> 1
            self.levels.append((at, self.n_context, n, self.shared[at - 1]))
            after, self.shared = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), bool)
            after[at], self.shared[at] = n, code & 1
            self.at = at[after[at - 1] >= self.known.fewest]
            self.n_context = after[self.at - 1]
            self.depth += 1

    def smoothed(self, n, n_context, below):
        weight = self.weights(n_context)
        return (n + weight * below) / (n_context + weight)

    def weights(self, n_context):
        few = np.arange(1024.0) ** self.known.heaps
        out = few[np.minimum(n_context, 1023)]
        many = n_context > 1023
        out[many] = n_context[many].astype(float) ** self.known.heaps
        return out

    def sequences(self, last: np.ndarray, length: int) -> np.ndarray:
        """Hashes of the sequences of so many words that end at the given places."""
        out = self.words[self.ids[last]] + np.uint64(length)
        for k in range(1, length):
            out = (out ^ (out >> np.uint64(31))) * _FACTORS[0] + self.words[self.ids[last - k]] * _FACTORS[1]
        return (out ^ (out >> np.uint64(29))) >> np.uint64(8)

    def asked(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct sequences of a context to be tried and the word after it, sorted: keys, own counts, whether others may have them, and each position's."""
        keys, place = np.unique(self.sequences(self.at, self.depth + 1), return_inverse=True)
        own = np.bincount(place, self.train[self.at], len(keys)).astype(np.int64)
        asks = np.zeros(len(keys), bool)
        asks[place] = self.shared[self.at - 1] & self.shared[self.at]
        return keys, own, asks, place

    def contexts(self, depth: int, some: np.ndarray | slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """Distinct tried contexts of a depth, sorted, at some of its positions; and each position's place among them."""
        return np.unique(self.sequences(self.levels[depth - 1][0][some] - 1, depth), return_inverse=True)

    def tested(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contexts of the last depth: keys, own divergences (in STEPS), whether others have them, and each position's place."""
        p = self.root()
        for at, n_context, n, _ in self.levels[:-1]:
            p[at] = self.smoothed(n, n_context, p[at])
        at, n_context, n, shared = self.levels[-1]
        keys, place = self.contexts(len(self.levels))
        weight, below, train = self.weights(n_context), p[at], self.train[at]
        without = (np.maximum(n - 1, 0) + weight * below) / (n_context - 1 + weight)
        gain = np.rint(STEPS * np.bincount(place, np.where(train, np.log(without / below), 0.0), len(keys))).astype(np.int64)
        others = np.zeros(len(keys), bool)
        others[place] = shared
        return keys, gain, others, place

    def root(self) -> np.ndarray:
        return (self.count + 1) / (self.known.tokens + self.known.distinct + 1)

    def scores(self, own: list[bytes], answers: list[list[bytes]], buckets: int) -> np.ndarray:
        """Each token's probability in its longest kept state: own tells of contexts that only this chunk has, answers of the others."""
        p = self.root()
        for depth, (at, n_context, n, shared) in enumerate(self.levels, 1):
            stays = _bits(own[depth - 1])[: len(at)].copy()
            keys, place = self.contexts(depth, shared)
            stays[shared] = _told(keys, answers[depth - 1], buckets, buckets)[0][place]
            p[at[stays]] = self.smoothed(n[stays], n_context[stays], p[at[stays]])
        return p


def _bits(data: bytes) -> np.ndarray:
    """As many bits as fill whole bytes."""
    return np.unpackbits(np.frombuffer(data, np.uint8)).view(bool)


def _buckets_of(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[slice]]:
    """The buckets of sorted keys, and where each one's are."""
    names, first = np.unique((keys >> np.uint64(24)).astype(np.int64) * buckets >> 32, return_index=True)
    return names, [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(keys)], strict=False)]


def _asks(chunk: int, keys: np.ndarray, amounts: np.ndarray, buckets: int, *, contexts: bool = False) -> pa.RecordBatch:
    """A row for each bucket that some of the sorted keys belong to. Amounts are counts; divergences of contexts have buckets of their own, after the others."""
    names, parts = _buckets_of(keys, buckets)
    amounts = _signs_last(amounts) if contexts else amounts
    return _rows([chunk] * len(names), (names + buckets * contexts).tolist(), [packed_keys(keys[s]) for s in parts], [packed(amounts[s]) for s in parts])


def _signs_last(x: np.ndarray) -> np.ndarray:
    return x << 1 ^ x >> 63


def _with_signs(x: np.ndarray) -> np.ndarray:
    return x >> 1 ^ -(x & 1)


def _told(keys: np.ndarray, answers: list[bytes], buckets: int, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Which of the sorted keys of a question were answered, and the sums of those. answers are triples (bucket, bits, sums), first the number of the first bucket."""
    of = {int.from_bytes(answers[k], "little") - first: answers[k + 1 : k + 3] for k in range(0, len(answers), 3)}
    told, sums = np.zeros(len(keys), bool), [np.zeros(0, np.int64)]
    for name, where in zip(*_buckets_of(keys, buckets), strict=True):
        if name in of:
            told[where] = _bits(of[name][0])[: where.stop - where.start]
            sums.append(unpacked(of[name][1]))
    return told, np.concatenate(sums)


def _tells(answers: list[bytes], buckets: int) -> list[bytes]:
    """Those answers that are on contexts."""
    return [x for k in range(0, len(answers), 3) if int.from_bytes(answers[k], "little") >= buckets for x in answers[k : k + 3]]


def _codes(keys: np.ndarray, own: np.ndarray, asks: np.ndarray, answers: list[bytes], buckets: int) -> np.ndarray:
    """Codes of sorted keys: those that were answered have their sums, the others their own counts."""
    codes = 2 * own
    told, sums = _told(keys[asks], answers, buckets)
    codes[np.flatnonzero(asks)[told]] = 2 * sums + 1
    return codes


def _joined(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<u8").tobytes() + b"".join(parts)


def _parted(data: bytes) -> list[bytes]:
    n = int.from_bytes(data[:8], "little")
    ends = 8 * (n + 1) + np.cumsum([0, *np.frombuffer(data, "<u8", n, 8).tolist()])
    return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


@dataclass
class Known:
    """What a chunk knows of the tree: codes of its words, and for each depth codes of the sequences, marks of the contexts that only it has, and answers on the others."""

    totals: bytes
    seen: list[bytes]
    own: list[bytes]
    tells: list[list[bytes]]

    @classmethod
    def read(cls, folder: str, chunk: int, rounds: int) -> Known:
        """Each round but the first adds a file: codes and marks of a depth, and answers on the one before."""
        files = [_read(f"{folder}/round{k}/known", chunk) for k in range(1, rounds + 1)]
        return cls(files[0][0], [f[0] for f in files[1:]], [f[1] for f in files[1:]], [_parted(f[2]) for f in files[2:]])


def _chunk_round(known: Settings, buckets: int, depth: int, last: bool, folder: str):
    """Questions of all chunks: of words (depth 0), or of sequences that go on depth words (but in the last round) and of the divergences of the contexts before those.

    folder has a folder for each round, of answers and of what the chunks have come to know.
    """

    def work(batches):
        kept_by_worker("tree")
        for batch in batches:
            for i in range(batch.num_rows):
                number = batch.column(0)[i].as_py()
                chunk = Chunk(batch.column(1)[i].as_py(), known)
                words = chunk.words >> np.uint64(8)
                if depth == 0:
                    yield _asks(number, words, chunk.own_words(), buckets)
                    continue
                before = f"{folder}/round{depth - 1}/answers"
                if depth == 1:
                    answers = _read(before, number, len(words))
                    totals = packed(_codes(words, chunk.own_words(), np.ones(len(words), bool), answers, buckets))
                    chunk.follow(totals, [])
                    _write(f"{folder}/round1/known", number, [totals])
                else:
                    held = Known.read(folder, number, depth - 1)
                    chunk.follow(held.totals, held.seen)
                    keys, own, asks, place = chunk.asked()
                    answers = _read(before, number, asks.any())
                    seen = packed(_codes(keys, own, asks, answers, buckets)[place])
                    del keys, own, asks, place
                    chunk.follow(held.totals, [*held.seen, seen])
                    keys, gain, others, place = chunk.tested()
                    alone = ~others & (gain >= STEPS * known.divergence)
                    _write(f"{folder}/round{depth}/known", number, [seen, np.packbits(alone[place]).tobytes(), _joined(_tells(answers, buckets))])
                    yield _asks(number, keys[others], gain[others], buckets, contexts=True)
                    del keys, gain, others, place
                if not last:
                    keys, own, asks, _ = chunk.asked()
                    yield _asks(number, keys[asks], own[asks], buckets)
                yield _rows([-1], [-1 - number % 1000], [b""], [b""], grown=len(chunk.at))

    return work


def _bucket_round(buckets: int, least: float):
    """Answers of a bucket: the sums of keys that more than one chunk asks for, or, of divergences, which keys reach least."""

    def work(table: pa.Table) -> pa.Table:
        if table["bucket"][0].as_py() < 0:
            return table
        contexts = table["bucket"][0].as_py() >= buckets
        keys = [unpacked_keys(k) for k in table["keys"].to_pylist()]
        amount = np.concatenate([unpacked(x) for x in table["amounts"].to_pylist()])
        amount = _with_signs(amount) if contexts else amount
        sizes = np.array(list(map(len, keys)))
        flat = np.concatenate(keys)
        del keys
        order = np.argsort(flat, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(flat[order]) != 0))
        times = np.diff(np.append(heads, len(flat)))
        at = np.empty(len(flat), np.int64)
        at[order] = np.repeat(np.arange(len(heads)), times)
        sums = np.add.reduceat(amount[order], heads)
        told = (sums >= STEPS * least if contexts else times > 1)[at]
        bits, found = [], []
        for a, b in zip((np.cumsum(sizes) - sizes).tolist(), np.cumsum(sizes).tolist(), strict=True):
            some = told[a:b]
            bits.append(np.packbits(some).tobytes())
            found.append(packed(np.zeros(0, np.int64) if contexts else sums[at[a:b][some]]))
        counts = (0, 0) if contexts else (int((sums > 0).sum()), int(sums.sum()))
        answers = _rows(table["chunk"].to_pylist(), table["bucket"].to_pylist(), bits, found)
        return pa.Table.from_batches([answers, _rows([-1], [-1], [b""], [b""], distinct=counts[0], total=counts[1])])

    return work


def _answer_files(folder: str):
    """One file for the answers to a chunk."""

    def work(table: pa.Table) -> pa.Table:
        number = table["chunk"][0].as_py()
        if number < 0:
            return table
        table = table.sort_by("bucket")
        parts = [x for row in zip([b.to_bytes(8, "little") for b in table["bucket"].to_pylist()], table["keys"].to_pylist(), table["amounts"].to_pylist(), strict=True) for x in row]
        _write(folder, number, parts)
        return table.slice(0, 0)

    return work


def grow(chunks: DataFrame, known: Settings, scratch: Scratch, max_depth: int) -> tuple[str, int, int]:
    """The folder that holds what each chunk knows of the tree, the number of rounds in it, and that of buckets. Sets the counts of known."""
    buckets = int(max(1, chunks.count() * CHUNK_TOKENS // BUCKET_KEYS))
    texts, folder = chunks.select("chunk", "parts"), scratch.path("rounds")

    def asked(depth: int, last: bool = False) -> list[int]:
        asks = texts.mapInArrow(_chunk_round(known, buckets, depth, last, folder), _ROW)
        answers = asks.groupBy("bucket").applyInArrow(_bucket_round(buckets, known.divergence), _ROW)
        # Rows of counts are few for each bucket and chunk, and summed at last; the others are written by the tasks.
        spread = F.when(F.col("chunk") < 0, -1 - F.abs(F.hash("distinct", "total", "grown")) % 1000).otherwise(F.col("chunk")).alias("chunk")
        files = answers.select(spread, *_NAMES[1:]).groupBy("chunk").applyInArrow(_answer_files(f"{folder}/round{depth}/answers"), _ROW)
        sums = scratch.keep(files.select("grown", "distinct", "total"), "counts")
        del asks, answers, files
        scratch.release()
        if depth:
            scratch.delete(f"{folder}/round{depth - 1}/answers")
        return [int(x or 0) for x in sums.agg(F.sum("grown"), F.sum("distinct"), F.sum("total")).first()]

    _, known.distinct, known.tokens = asked(0)
    depth, grown = 0, 1
    while grown and depth <= max_depth:
        depth += 1
        grown = asked(depth, depth == max_depth + 1)[0]
    return folder, depth, buckets


def score_texts(docs: DataFrame, *, learn_from: Column, key: str = "doc_id", text: str = "text", fewest: int = FEWEST, divergence: float = DIVERGENCE, heaps: float = HEAPS, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    The model is learned from the rows where learn_from holds; held_out says where it does not (null does not).
    Null and empty texts have their end token only.  Where nothing can be learned, every
    token has probability 1 (add-one over no words).  Rows of equal or null key are scored, and learned from, each by
    its own text; keys may be of any type.  Texts of any length are read whole.  An empty table gives none.
    Columns but the two named are not read.  The shared folder's file system must be one that pyarrow opens by URI.
    """
    scratch = Scratch(docs.sparkSession, "suffix-lm")
    rows = docs.select(F.col(key).alias("key"), (~F.coalesce(learn_from, F.lit(False))).alias("held_out"), F.col(text).alias("text"))
    chunks = scratch.keep(chunked(rows), "chunks")
    known = Settings(fewest, divergence, heaps)
    folder, rounds, buckets = grow(chunks, known, scratch, max_depth)
    kind = rows.schema["key"].dataType.simpleString()

    def score(batches):
        kept_by_worker("tree")
        for batch in batches:
            for i in range(batch.num_rows):
                number, chunk = batch.column(0)[i].as_py(), Chunk(batch.column(3)[i].as_py(), known)
                held = Known.read(folder, number, rounds)
                chunk.follow(held.totals, held.seen)
                asked = chunk.levels and chunk.levels[-1][3].any()  # contexts of the last depth that others have, too
                last = _tells(_read(f"{folder}/round{rounds}/answers", number, asked), buckets)
                p, n = chunk.scores(held.own, [*held.tells, last], buckets), len(chunk.sizes)
                base = np.bincount(chunk.text, np.log10(chunk.root()), n)
                columns = [batch.column(1)[i].values, batch.column(2)[i].values, pa.array(chunk.sizes), pa.array(np.bincount(chunk.text, chunk.count > 0, n).astype(np.int64)), pa.array(np.full(n, known.tokens)), pa.array(base), pa.array(np.bincount(chunk.text, np.log10(p), n))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return chunks.select("chunk", "key", "held_out", "parts").mapInArrow(score, f"key {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
