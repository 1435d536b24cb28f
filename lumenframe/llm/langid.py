"""Languages of words in code-switched text by a linear-chain conditional random field.

A word's emission scores are sums of learned weights of its character n-grams (those
that touch the word's ends are its affixes) and of its place in a lexicon, and
neighbouring words are tied by learned transitions.  Forward-backward gives each word
a distribution over the languages; a document's is the mean over its words.

Words are maximal runs of letters, lower-cased; the lines of a text are the chains.
The model is fitted on the driver from a bounded sample of labelled rows: spans of words, cut out in
the tasks, so that a text of any length sends no more than its spans.  Spans of different documents and languages are
strung together, so that changes of language are seen in training.  Everything else works on every whole text, in one
pass and without a shuffle.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept_by_worker, slices

#: Labelled documents of each language that the model is fitted on, at most about so many (a hash of the key picks them).
DOCUMENTS_PER_LANGUAGE = 400
#: Spans of a sampled document, and words of a span, that the sample holds. The lexicon is made from all words of the sample.
SPANS, SPAN_WORDS = 3, 40
#: Languages that are learned at most, those of the most labelled documents: a label column may be dirty, and the model has a weight for each.
LANGUAGES = 200
FEATURES = 1 << 17
GRAMS = (1, 2, 3, 4)
EPOCHS = 4
#: Words whose scores a Python worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 300_000

_LETTERS = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def letter_runs(line: str) -> list[str]:
    """Maximal runs of letters. What the pattern finds may hold numerals that are no digits: those part words too."""
    words = _LETTERS.findall(line)
    if all(map(str.isalpha, words)):
        return words
    return [run for w in words for run in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def chains(text: str | None) -> list[list[str]]:
    """The words of each line; lines without words are left out."""
    return [words for line in (text or "").lower().split("\n") if (words := letter_runs(line))]


def gram_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, index of its word) for the n-grams of every word between its end marks."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    points = np.frombuffer("".join([f"\2{w}\3" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    features, owners = [], []
    for n in GRAMS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        inside = word[:m] == word[n - 1 :]
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + m]) * _MULTIPLIERS[k]
            h ^= h >> np.uint64(29)
        features.append((h % np.uint64(FEATURES)).astype(np.int64)[inside])
        owners.append(word[:m][inside])
    return np.concatenate(features), np.concatenate(owners)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # FEATURES x languages
    lexicon: dict[str, np.ndarray]  # log shares of the languages, for words of the sample
    lexicon_weight: np.ndarray
    transitions: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        """Emission scores, a row for each word."""
        features, owners = gram_features(words)
        out = np.zeros((len(words), len(self.languages)), np.float32)
        got = self.weights[features]
        for k in range(out.shape[1]):
            out[:, k] = np.bincount(owners, got[:, k], len(words))
        rows = [(i, v) for i, w in enumerate(words) if (v := self.lexicon.get(w)) is not None]
        if rows:
            out[[i for i, _ in rows]] += np.array([v for _, v in rows]) * self.lexicon_weight
        return out


def packed(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chains from the longest on, by time: order of the chains, chains alive at each step, and each word's place."""
    order = np.argsort(-sizes, kind="stable")
    alive = np.searchsorted(-sizes[order], -np.arange(sizes.max()), side="left") if len(sizes) else np.zeros(0, np.int64)
    starts = np.cumsum(alive) - alive
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    time = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return order, alive, starts[time] + np.repeat(rank, sizes)


def forward_backward(emissions: np.ndarray, alive: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of every word and of every transition (summed), from exponentiated scores in packed order; and the forward norms."""
    starts = np.cumsum(alive) - alive
    alpha, beta = np.empty_like(emissions), np.ones_like(emissions)
    norms = np.empty(len(emissions), emissions.dtype)
    for t, (n, a) in enumerate(zip(alive.tolist(), starts.tolist(), strict=True)):
        now = emissions[a : a + n] if t == 0 else (alpha[before : before + n] @ transitions) * emissions[a : a + n]  # noqa: F821
        norm = now.sum(1)
        norms[a : a + n] = norm
        alpha[a : a + n] = now / norm[:, None]
        before = a
    pairs = np.zeros_like(transitions)
    for t in range(len(alive) - 2, -1, -1):
        a, b, n = starts[t], starts[t + 1], alive[t + 1]
        ahead = emissions[b : b + n] * beta[b : b + n] / norms[b : b + n, None]
        beta[a : a + n] = ahead @ transitions.T
        pairs += (alpha[a : a + n].T @ ahead) * transitions
    posterior = alpha * beta
    return posterior / posterior.sum(1, keepdims=True), pairs, norms


def fit(samples: list[tuple[str, str]], *, epochs: int = EPOCHS, rate: float = 0.3, seed: int = 5) -> Model:
    """Fit the model to (language, span of words) samples by stochastic gradient steps on the likelihood."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in samples})
    n = len(languages)
    spans = [(languages.index(lang), words) for lang, text in samples if (words := [w for chain in chains(text) for w in chain])]
    vocabulary: dict[str, int] = {}
    tokens = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]) for _, words in spans]
    counts = np.zeros((len(vocabulary), n))
    for (lang, _), ids in zip(spans, tokens, strict=True):
        np.add.at(counts, (ids, lang), 1)
    names = list(vocabulary)
    common = [i for i in np.argsort(-counts.sum(1), kind="stable").tolist() if counts[i].sum() > 1]
    share = np.log((counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * n)).astype(np.float32)
    model = Model(languages, np.zeros((FEATURES, n), np.float32), {names[i]: share[i] for i in common}, np.zeros(n, np.float32), np.zeros((n, n), np.float32))
    in_lexicon = np.zeros((len(names), n), np.float32)
    in_lexicon[common] = share[common]
    features, owners = gram_features(names)
    first = np.searchsorted(owners_sorted := owners[order := np.argsort(owners, kind="stable")], np.arange(len(names) + 1))
    features = features[order]
    grown = np.full(model.weights.shape, 1e-6, np.float32), np.full(n, 1e-6, np.float32), np.full((n, n), 1e-6, np.float32)
    for _ in range(epochs):
        deal = rng.permutation(len(spans))
        for k in range(0, len(deal), 96):
            # Chains of one to four spans: most words follow one of their language, some do not.
            dealt = np.split(part := deal[k : k + 96], np.cumsum(rng.integers(1, 5, len(part)))) if len(deal) else []
            groups = [g for g in dealt if len(g)]
            sizes = np.array([sum(len(tokens[i]) for i in g) for g in groups])
            ids = np.concatenate([tokens[i] for g in groups for i in g])
            truth = np.concatenate([np.full(len(tokens[i]), spans[i][0]) for g in groups for i in g])
            _, alive, place = packed(sizes)
            used, local = np.unique(ids, return_inverse=True)
            mine = np.concatenate([np.arange(first[u], first[u + 1]) for u in used])
            owner = np.repeat(np.arange(len(used)), first[used + 1] - first[used])
            score = in_lexicon[used] * model.lexicon_weight
            for j in range(n):
                score[:, j] += np.bincount(owner, model.weights[features[mine], j], len(used))
            at = np.empty(len(ids), np.int64)
            at[place] = np.arange(len(ids))
            rows = score[local[at]]
            posterior, pairs, _ = forward_backward(np.exp(rows - rows.max(1, keepdims=True)), alive, np.exp(model.transitions))
            wrong = posterior
            wrong[np.arange(len(ids)), truth[at]] -= 1
            by_word = np.zeros((len(used), n), np.float32)
            np.add.at(by_word, local[at], wrong)
            slope = np.zeros((FEATURES, n), np.float32)
            np.add.at(slope, features[mine], by_word[owner])
            follow = np.concatenate([truth[1:], [0]])
            last = np.cumsum(sizes) - 1
            inner = np.ones(len(ids), bool)
            inner[last] = False
            seen = np.zeros((n, n), np.float32)
            np.add.at(seen, (truth[inner], follow[inner]), 1)
            touched = np.unique(features[mine])
            for value, slopes, total in ((model.lexicon_weight, (by_word * in_lexicon[used]).sum(0), grown[1]), (model.transitions, pairs - seen, grown[2])):
                total += slopes**2
                value -= rate * slopes / np.sqrt(total)
            grown[0][touched] += slope[touched] ** 2
            model.weights[touched] -= rate * slope[touched] / np.sqrt(grown[0][touched])
    return model


class _Words:
    """Exponentiated scores of the words a worker has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.ids: dict[str, int] = {}
        self.table = np.zeros((0, len(model.languages)), np.float32)
        self.fill = 0

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > CACHE_WORDS:
            self.ids, self.fill = {}, 0
        new = list(set(words).difference(self.ids))
        if new:
            score = np.concatenate([self.model.scores(new[k : k + 20_000]) for k in range(0, len(new), 20_000)])
            score = np.exp(score - score.max(1, keepdims=True)) + np.float32(1e-12)
            if self.fill + len(new) > len(self.table):
                grown = np.zeros((max(2 * len(self.table), self.fill + len(new)), score.shape[1]), np.float32)
                grown[: self.fill] = self.table[: self.fill]
                self.table = grown
            self.table[self.fill : self.fill + len(new)] = score
            self.ids.update(zip(new, range(self.fill, self.fill + len(new)), strict=True))
            self.fill += len(new)
        return self.table[np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))]


def word_posteriors(model: Model, texts: list[str | None], words: _Words | None = None) -> tuple[list[int], np.ndarray, list[str]]:
    """For every word of the texts, in order: its text's index, its distribution over the languages, and itself."""
    words = words or _Words(model)
    cut = [(i, chain) for i, text in enumerate(texts) for chain in chains(text)]
    flat = [w for _, c in cut for w in c]
    if not flat:
        return [], np.zeros((0, len(model.languages)), np.float32), []
    sizes = np.array([len(c) for _, c in cut])
    _, alive, place = packed(sizes)
    emissions = np.empty((len(flat), len(model.languages)), np.float32)
    emissions[place] = words.look_up(flat)
    posterior, _, _ = forward_backward(emissions, alive, np.exp(model.transitions))
    return np.repeat([i for i, _ in cut], sizes), posterior[place], flat


def predict_texts(model: Model | None, texts: list[str | None], words: _Words | None = None) -> list[tuple[str, float]]:
    """(language, mean probability) of each text; ('und', 0.0) for a text without letters, or without a model."""
    out = [("und", 0.0)] * len(texts)
    if model is None:
        return out
    owner, posterior, flat = word_posteriors(model, texts, words)
    if not flat:
        return out
    sums = np.stack([np.bincount(owner, posterior[:, k], len(texts)) for k in range(posterior.shape[1])], 1)
    counts = np.bincount(owner, minlength=len(texts))
    best = sums.argmax(1)
    return [(model.languages[b], float(min(1.0, s[b] / c))) if c else o for b, s, c, o in zip(best.tolist(), sums, counts.tolist(), out, strict=True)]


def spans_of(text: str | None, seed: int, spans: int, span_words: int) -> list[str]:
    """So many runs of span_words words of a text, from places that the seed picks, in order; all of a shorter text."""
    words = [w for chain in chains(text) for w in chain]
    at = range(0, len(words), span_words)
    picked = sorted(np.random.default_rng(seed % (1 << 63)).choice(len(at), min(spans, len(at)), replace=False).tolist()) if len(at) else []
    return [" ".join(words[at[k] : at[k] + span_words]) for k in picked]


def sample(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCUMENTS_PER_LANGUAGE, languages: int = LANGUAGES, spans: int = SPANS, span_words: int = SPAN_WORDS) -> list[tuple[str, str]]:
    """(language, span) of about per_language labelled texts of each language, the ones whose keys hash lowest, in a fixed order.

    At most languages * per_language * spans spans of span_words words come to the driver, whatever the table holds.
    """
    labelled = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("key IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    counts = labelled.groupBy(F.col("lang").alias("lang_")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang_").limit(languages)
    slots = 1 << 30
    bound = F.least(F.lit(slots), F.floor(F.lit(float(slots) * per_language) / F.col("n")) + 1)
    wanted = labelled.join(F.broadcast(counts), F.col("lang") == F.col("lang_")).where(F.pmod(F.xxhash64("key", F.lit(11)), F.lit(slots)) < bound)  # languages rows

    def cut(batches):
        for batch in slices(batches):
            owners, out = [], []
            for i, (value, seed) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                found = spans_of(value, seed, spans, span_words)
                owners += [i] * len(found)
                out += found
            took = pa.array(owners, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(took), batch.column(3).take(took), pa.array(out, pa.string())], names=["lang", "seed", "span"])

    rows = wanted.select("lang", F.lit(0).alias("unused"), "text", F.xxhash64("key", F.lit(5)).alias("seed")).mapInArrow(cut, "lang string, seed long, span string")
    return sorted(((r.lang, r.span) for r in rows.collect()), key=lambda r: r)


def identify(docs: DataFrame, *, learn_from: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = DOCUMENTS_PER_LANGUAGE, languages: int = LANGUAGES, spans: int = SPANS, span_words: int = SPAN_WORDS) -> DataFrame:
    """(key, lang_pred, score) of every document; only rows where learn_from holds are learned from.

    The sample that the model is fitted on is bounded by per_language, languages, spans and span_words, see sample().
    A text that is null or has no letter gives 'und' with score 0, and so does every text
    where nothing can be learned.  Rows of equal key are told each by its own text; of equally likely languages the first by name is told.
    An empty table gives none.  A text of any length is read whole.  Columns but the
    three named are not read; key and language play no part in a prediction.
    """
    texts = sample(docs.where(learn_from), key=key, text=text, lang=lang, per_language=per_language, languages=languages, spans=spans, span_words=span_words)
    model = fit(texts) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def predict(batches):
        model = shared.value
        words = kept_by_worker(f"scores {name}", lambda: _Words(model) if model else None)
        for batch in slices(batches):
            got = predict_texts(model, batch.column(1).to_pylist(), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["key", "lang_pred", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, f"key {rows.schema[0].dataType.simpleString()}, lang_pred string, score double")
