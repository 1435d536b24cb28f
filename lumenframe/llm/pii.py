"""Personal data in whole texts: fixed patterns, and a skip-chain conditional random field that finds more of what they find.

The patterns (e-mail addresses, internet addresses, card and telephone numbers) give the base spans, which stay.  The field labels words: those
that have a digit or an at sign, or stand by a spelled-out one; all others are no entity by constraint, and cut the chain.  A word's
potential comes from its shape, its digits and its neighbours; neighbouring words are tied by learned transitions; and words far apart
that are the same, or that are parts of runs of the same digits however they are written, share a learned potential, so labels agree across a document: what the
patterns know at one place carries over to others.  Marginals come from loopy message passing.

The field is fitted on the driver from a bounded sample of short windows of text (see sample()): the base spans in them are the
labels, and each is also written in other ways that the patterns do not match, with the label kept.  What it adds is checked for what its kind must have (digits,
check sum, parts) and never overlaps a base span.
"""

from __future__ import annotations

import random
import re
import uuid
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept_by_worker, slices

KINDS = ("email", "ip", "card", "phone")
#: Documents whose windows may be sampled, about; windows of each kind, and of none, that come to the driver at most; characters on each side.
SAMPLE_DOCUMENTS, WINDOWS, AROUND = 20_000, 400, 80
#: The mean probability that an added span must have.
LEAST = 0.8
FEATURES = 1 << 16
EPOCHS = 6
#: Rounds of messages at most.
ROUNDS = 40

#: Fixed by the contract of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MARK = re.compile(r"[0-9@]|[\[(](?:[aA][tT]|[dD][oO][tT])[\])]")
_DOT = re.compile(r"(?<![^\x20\x09-\x0D])[dD][oO][tT](?![^\x20\x09-\x0D])")
_RUNS = re.compile(r"[0-9]+|[a-z]+|[A-Z]+|[^\x00-\x7f]+|.", re.S)
_SPELLED = re.compile(r"[\[(]?(?:@|at|dot)[\])]?", re.I)
#: Words that may stand between the parts of a number.
_BETWEEN = frozenset("-./\u2013")
#: Signs that do not belong to a span at its ends.
_BEFORE, _AFTER = "\"'`#$%&*|<>!,;:.?)]}{=~/\\^_-", "\"'`#$%&*|<>!,;:.?([{}=~/\\^_-+"


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    """Whether the check sum of a card number holds."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(map(int, (str(2 * int(d)) for d in digits[-2::-2] if d < "5"))) + sum(2 * int(d) - 9 for d in digits[-2::-2] if d >= "5")) % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _emails(text: str):
    """Leftmost matches of name@host.tld: for each at sign, the name is all before it that a name may have, after the last match."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _DOMAIN.match(text, at + 1)):
            yield start, host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of what the patterns match, in code points, by start and then kind; none for null. In time linear in the text."""
    text = text or ""
    found = [("email", a, b) for a, b in _emails(text)]
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@dataclass
class Candidates:
    """Words of a text that may belong to an entity: their spans, places among all words, and hashed features; links between them."""

    spans: list[tuple[int, int]]
    places: list[int]
    features: list[list[int]]
    links: list[tuple[int, int]]
    begins: list[bool]  # preceded by a word that is no candidate, or by none
    ends: list[bool]


def _shape(word: str, exact: bool) -> str:
    out = []
    for run in _RUNS.findall(word[:64]):
        c = run[0]
        kind = "9" if "0" <= c <= "9" else "a" if "a" <= c <= "z" else "A" if "A" <= c <= "Z" else "u" if c > "\x7f" else c
        out.append(f"9{len(run)}" if exact and kind == "9" else kind)
    return "".join(out)


def _features(words: Sequence[str], k: int, run: str) -> list[int]:
    """Hashed features of word k; run is all digits of the numbers that it stands among."""
    word = words[k].strip("\"'`#$%&*|<>!,;:?{}=~\\^")
    near = lambda j: _shape(words[j], False)[:12] if 0 <= j < len(words) else "<>"
    plain = lambda j: words[j].lower()[:12] if 0 <= j < len(words) else "<>"
    exact, digits = _shape(word, True), digits_of(word)
    quads = re.split(r"[\[(]?\.[\])]?", word)
    names = [
        "",
        f"e{exact}",
        f"s{_shape(word, False)}",
        f"d{min(len(digits), 20)}",
        f"r{min(len(run), 21)}.{12 <= len(run) <= 19 and luhn(run)}",
        f"l{12 <= len(digits) <= 19 and luhn(digits)}.{min(len(digits), 20)}",
        f"q{len(quads) == 4 and all(q.isascii() and q.isdigit() and len(q) <= 3 and int(q) <= 255 for q in quads)}",
        f"@{bool(re.search(r'@|[\[(]at[\])]', word, re.I))}.{bool(re.search(r'\.|[\[(]dot[\])]', word, re.I))}",
        f"<{near(k - 1)}",
        f">{near(k + 1)}",
        f"p{word[:1] if not word[:1].isalnum() else ''}.{exact[:3]}",
        f"b{near(k - 1)}.{_shape(word, False)[:8]}.{near(k + 1)}",
    ]
    if not digits:
        names.append(f"w{word.lower()[:12]}")
        names += [f"w<{plain(k - 1)}", f"w>{plain(k + 1)}"]
    return [zlib.crc32(n.encode()) % FEATURES for n in names]


def candidates(text: str) -> Candidates | None:
    """What the field labels of a text, if anything."""
    marks = [m.start() for m in _MARK.finditer(text)]
    spelled = [m.start() for m in _DOT.finditer(text)] if "dot" in text or "DOT" in text or "Dot" in text else []
    if not marks and not spelled:
        return None
    spans = [m.span() for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in spans])
    chosen = set((np.searchsorted(starts, marks, "right") - 1).tolist())
    for k in (np.searchsorted(starts, spelled, "right") - 1).tolist():
        chosen.update(range(max(0, k - 4), min(len(spans), k + 3)))
    words = [text[a:b] for a, b in spans]
    for k in [k for k in chosen if _SPELLED.fullmatch(words[k])]:
        chosen.update((max(0, k - 1), min(len(spans) - 1, k + 1)))
    chosen.update([k + 1 for k in chosen if k + 2 in chosen and words[k + 1] in _BETWEEN])
    places = sorted(chosen)
    # Numbers that follow one another are a run; its digits are what tells it from others.
    runs, keys, links, last = {}, [], [], {}
    for k in places:
        if digits_of(words[k]) and "@" not in words[k]:
            runs[k] = runs.get(k - 1) or (runs.get(k - 2) if words[k - 1] in _BETWEEN else None) or []
            runs[k].append(digits_of(words[k]))
    for at, k in enumerate(places):
        run = runs.get(k)
        digits = "".join(run) if run else ""
        keys.append(digits[:64])
        name = digits if len(digits) >= 6 else re.sub(r"[^0-9a-z]", "", words[k].lower()) if len(words[k]) >= 5 else ""
        if name:
            if name in last and not (run and runs.get(places[last[name]]) is run):
                links.append((last[name], at))
            last[name] = at
    near = lambda k: k in chosen
    return Candidates([spans[k] for k in places], places, [_features(words, k, run) for k, run in zip(places, keys, strict=True)], links, [not near(k - 1) for k in places], [not near(k + 1) for k in places])


@dataclass
class Model:
    """Weights of features, of neighbouring labels, and of linked labels (0 is no entity, then KINDS)."""

    weights: np.ndarray
    follow: np.ndarray
    linked: np.ndarray


def new_model() -> Model:
    n = len(KINDS) + 1
    return Model(np.zeros((FEATURES, n)), np.zeros((n, n)), np.zeros((n, n)))


@dataclass
class Graph:
    """Candidates of several texts, as one graph."""

    owners: np.ndarray  # of each feature
    features: np.ndarray
    n: int
    a: np.ndarray  # edges
    b: np.ndarray
    linked: np.ndarray
    begins: np.ndarray
    ends: np.ndarray


def graph(found: Sequence[Candidates]) -> Graph:
    base, a, b, linked = 0, [], [], []
    for c in found:
        chain = [(i, i + 1) for i in range(len(c.places) - 1) if c.places[i] + 1 == c.places[i + 1]]
        links = [x for x in c.links if c.places[x[0]] + 1 != c.places[x[1]]]
        a += [base + i for i, _ in chain + links]
        b += [base + j for _, j in chain + links]
        linked += [0] * len(chain) + [1] * len(links)
        base += len(c.places)
    sizes = [len(f) for c in found for f in c.features]
    flat = np.array([x for c in found for f in c.features for x in f], np.int64)
    of = lambda name: np.array([x for c in found for x in getattr(c, name)], bool)
    return Graph(np.repeat(np.arange(base), sizes), flat, base, np.array(a, np.int64), np.array(b, np.int64), np.array(linked, np.int64), of("begins"), of("ends"))


def _normal(log: np.ndarray) -> np.ndarray:
    top = log.max(-1, keepdims=True)
    return log - top - np.log(np.exp(log - top).sum(-1, keepdims=True))


def scores(model: Model, g: Graph) -> np.ndarray:
    """Each word's potentials: its features, and no entity beside it where the chain is cut."""
    out = np.stack([np.bincount(g.owners, model.weights[g.features, k], g.n) for k in range(model.weights.shape[1])], 1)
    out[g.begins] += model.follow[0]
    out[g.ends] += model.follow[:, 0]
    return out


def marginals(model: Model, g: Graph, unary: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(probabilities of each word's labels, of each edge's pairs of labels) by sum-product messages; exact where the graph has no cycle and rounds are enough."""
    n = unary.shape[1]
    potentials = np.stack([model.follow, model.linked])[g.linked]
    to_b, to_a = np.zeros((len(g.a), n)), np.zeros((len(g.a), n))
    damping = 0.5 if g.linked.any() else 0.0

    def gathered():
        total = unary.copy()
        np.add.at(total, g.b, to_b)
        np.add.at(total, g.a, to_a)
        return total

    for _ in range(rounds if len(g.a) else 0):
        total = gathered()
        from_a, from_b = total[g.a] - to_a, total[g.b] - to_b
        up = _normal(np.logaddexp.reduce(from_a[:, :, None] + potentials, axis=1))
        down = _normal(np.logaddexp.reduce(from_b[:, None, :] + potentials, axis=2))
        change = max(np.abs(up - to_b).max(), np.abs(down - to_a).max())
        to_b, to_a = damping * to_b + (1 - damping) * up, damping * to_a + (1 - damping) * down
        if change < 1e-4:
            break
    total = gathered()
    pairs = (total[g.a] - to_a)[:, :, None] + potentials + (total[g.b] - to_b)[:, None, :]
    pairs = np.exp(_normal(pairs.reshape(len(g.a), n * n))).reshape(-1, n, n)
    return np.exp(_normal(total)), pairs


def labels_of(c: Candidates, spans: Sequence[tuple[str, int, int]]) -> np.ndarray:
    """The label of each candidate: that of the first span that it overlaps, else 0."""
    out = np.zeros(len(c.places), np.int64)
    for k, (a, b) in enumerate(c.spans):
        out[k] = next((1 + KINDS.index(kind) for kind, x, y in spans if x < b and a < y), 0)
    return out


def other_ways(kind: str, text: str, rng: random.Random) -> str:
    """A base span written as the patterns do not match it."""
    digits = digits_of(text)
    if kind == "email":
        name, _, host = text.partition("@")
        return rng.choice([f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name} at {host.replace('.', ' dot ')}", f"{name}(at){host}", f"{name} @ {host}", f"{name}[at]{host.replace('.', '[dot]')}", f"{name} (at) {host}"])
    if kind == "ip":
        return text.replace(".", rng.choice(["[.]", "(.)"]))
    if kind == "card":
        return rng.choice([".", "/", "_", "  ", " - "]).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    rest = digits[-10:]
    return rng.choice([f"({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"{digits[:-10] or '1'} ({rest[:3]}) {rest[3:6]}-{rest[6:]}", f"00{digits[:-10] or '1'} {rest[:3]} {rest[3:6]} {rest[6:]}", f"{rest[:3]}-{rest[3:6]}-{rest[6:]}", f"{rest[:3]}/{rest[3:6]}-{rest[6:]}"])


def examples(windows: Sequence[str], seed: int = 3) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans) to learn from: the windows, the windows with their spans written in other ways, and both behind one another."""
    rng, out = random.Random(seed), []
    for window in windows:
        spans = base_spans(window)
        out.append((window, spans))
        for _ in range(2 if spans else 0):
            parts, at, moved = [], 0, []
            for kind, a, b in spans:
                if a < at:
                    continue
                new = other_ways(kind, window[a:b], rng)
                parts.append(window[at:a])
                start = sum(map(len, parts))
                moved.append((kind, start, start + len(new)))
                parts.append(new)
                at = b
            text = "".join([*parts, window[at:]])
            out.append((text, moved))
            gap = len(window) + 1
            out.append((f"{window}\n{text}", spans + [(k, a + gap, b + gap) for k, a, b in moved]))
    return out


def fit(windows: Sequence[str], *, epochs: int = EPOCHS, rate: float = 0.4, seed: int = 5) -> Model:
    """The field that makes the examples' labels likely, by adaptive gradient steps."""
    rng, model = np.random.default_rng(seed), new_model()
    known = [(c, labels_of(c, spans)) for text, spans in examples(windows) if (c := candidates(text))]
    grown = [np.full(x.shape, 1e-3) for x in (model.weights, model.follow, model.linked)]
    for _ in range(epochs):
        order = rng.permutation(len(known))
        for k in range(0, len(order), 32):
            some = [known[i] for i in order[k : k + 32]]
            g, truth = graph([c for c, _ in some]), np.concatenate([y for _, y in some])
            nodes, pairs = marginals(model, g, scores(model, g), 15)
            nodes[np.arange(g.n), truth] -= 1
            slope = np.zeros_like(model.weights)
            np.add.at(slope, g.features, nodes[g.owners])
            pairs[np.arange(len(g.a)), truth[g.a], truth[g.b]] -= 1
            follow, linked = pairs[g.linked == 0].sum(0), pairs[g.linked == 1].sum(0)
            follow[0] += nodes[g.begins].sum(0)
            follow[:, 0] += nodes[g.ends].sum(0)
            for value, slopes, total in zip((model.weights, model.follow, model.linked), (slope, follow, linked), grown, strict=True):
                slopes += 1e-3 * value
                total += slopes**2
                value -= rate * slopes / np.sqrt(total)
    return model


def _holds(kind: str, text: str) -> bool:
    """Whether an added span has what its kind must have."""
    digits = digits_of(text)
    if kind == "email":
        return bool(re.fullmatch(r"\S+?\s*[\[(]?(?:@|\bat\b)[\])]?\s*\S+?(?:\s*[\[(]?(?:\.|\bdot\b)[\])]?\s*[^\s.]+)+", text, re.I)) and any(c.isalnum() for c in text[:1])
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits) and not re.search("[A-Za-z]", text)
    return 9 <= len(digits) <= 15 and not re.search("[A-Za-z]", text)


def found_spans(model: Model | None, texts: Sequence[str | None], least: float = LEAST) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int, float]]]]:
    """(base spans, all spans with their probability, 1 for base spans) of each text, by start and then kind."""
    base = [base_spans(t) for t in texts]
    every = [[(*s, 1.0) for s in spans] for spans in base]
    if model is None:
        return list(zip(base, every, strict=True))
    held = [(i, c) for i, t in enumerate(texts) if t and (c := candidates(t))]
    if not held:
        return list(zip(base, every, strict=True))
    g = graph([c for _, c in held])
    unary = scores(model, g)
    known = np.concatenate([labels_of(c, base[i]) for i, c in held])
    given = np.flatnonzero(known)
    unary[given] -= 30.0
    unary[given, known[given]] += 30.0  # what the patterns have found is certain
    nodes, _ = marginals(model, g, unary)
    best, at = nodes.argmax(1), 0
    for i, c in held:
        text, k, n = texts[i], 0, len(c.places)
        while k < n:
            label, j = best[at + k], k + 1
            while j < n and best[at + j] == label and c.places[j] == c.places[j - 1] + 1 and not known[at + j] and not known[at + k]:
                j += 1
            if label and not known[at + k]:
                a, b = c.spans[k][0], c.spans[j - 1][1]
                piece = text[a:b]
                a, b = a + len(piece) - len(piece.lstrip(_BEFORE)), b - (len(piece) - len(piece.rstrip(_AFTER)))
                kind, sure = KINDS[label - 1], float(nodes[at + k : at + j, label].mean())
                if sure >= least and a < b and _holds(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                    every[i].append((kind, a, b, sure))
            k = j
        at += n
        every[i].sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return list(zip(base, every, strict=True))


def windows_of(text: str | None, around: int = AROUND) -> list[tuple[str, str]]:
    """(kind, window): a stretch of text around each base span, and around other words that have digits or at signs ('none')."""
    text = text or ""
    spans = base_spans(text)
    inside = lambda p: any(a <= p < b for _, a, b in spans)
    out, last = [(kind, text[max(0, a - around) : b + around]) for kind, a, b in spans], -1
    for m in _MARK.finditer(text):
        if m.start() > last and not inside(m.start()):
            out.append(("none", text[max(0, m.start() - around) : m.start() + around]))
            last = m.start() + around
    return out


def sample(docs: DataFrame, *, text: str = "text", documents: int = SAMPLE_DOCUMENTS, windows: int = WINDOWS, around: int = AROUND) -> list[str]:
    """Windows to learn from, windows of each kind and of none at most, of about so many documents at most, by hashes of texts: at most 5 * windows short texts, whatever the table holds."""
    rows = docs.select(F.col(f"`{text}`").alias("text"))
    total = rows.count()
    if not total:
        return []
    share = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1 << 30)) < F.lit(int(min(1.0, documents / total) * (1 << 30)))

    def cut(batches):
        for batch in slices(batches):
            found = [w for t in batch.column(0).to_pylist() for w in windows_of(t, around)]
            yield pa.RecordBatch.from_arrays([pa.array([w[k] for w in found], pa.string()) for k in (0, 1)], names=["kind", "span"])

    some = rows.where(share).mapInArrow(cut, "kind string, span string").distinct()
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy(F.xxhash64("span"), "span"))).where(F.col("rank") <= windows)
    return [r.span for r in sorted(ranked.collect(), key=lambda r: (r.kind, r.rank))]


_SPANS = "array<struct<kind:string,start:long,end:long,score:double>>"


def find(docs: DataFrame, *, key: str = "doc_id", text: str = "text", documents: int = SAMPLE_DOCUMENTS, windows: int = WINDOWS, least: float = LEAST, keep: Column | None = None) -> DataFrame:
    """(key, base, spans[, text, keep]) of every document: the base spans, and all spans; each (kind, start, end, score) in code points, end exclusive.

    spans are the base spans (score 1) and what the field adds with a mean probability of least or more. A null or empty text has none. Texts of any
    length are read whole, in one pass. Rows of equal or null key are read each by its own text; equal texts have equal spans. Where nothing can be learned, and for an empty
    table, only base spans are told. Columns but the two named are not read, unless kept.
    """
    learned = sample(docs, text=text, documents=documents, windows=windows)
    shared = docs.sparkSession.sparkContext.broadcast(fit(learned) if learned else None)
    name, carried = uuid.uuid4().hex, keep is not None
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *([keep.alias("keep")] if carried else []))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def work(batches):
        model = kept_by_worker(f"personal data {name}", lambda: shared.value)
        for batch in slices(batches):
            got = found_spans(model, batch.column(1).to_pylist(), least)
            base = pa.array([[dict(kind=k, start=a, end=b, score=1.0) for k, a, b in x] for x, _ in got], kind)
            spans = pa.array([[dict(kind=k, start=a, end=b, score=s) for k, a, b, s in x] for _, x in got], kind)
            more = [batch.column(1), batch.column(2)] if carried else []
            yield pa.RecordBatch.from_arrays([batch.column(0), base, spans, *more], names=["key", "base", "spans", "text", "keep"][: 3 + len(more)])

    schema = f"key {rows.schema['key'].dataType.simpleString()}, base {_SPANS}, spans {_SPANS}"
    if carried:
        schema += f", text string, keep {rows.schema['keep'].dataType.simpleString()}"
    return rows.mapInArrow(work, schema)


def listed(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents with each span replaced by its kind in brackets, as in [email]; of overlapping spans the first. All else as it is; nulls stay."""
    rows = find(docs, key=key, text=text, keep=F.struct("*"), **options)
    step = lambda at, s: F.when(s["start"] < at["to"], at).otherwise(F.struct(F.concat(at["done"], F.substr(F.col("text"), (at["to"] + 1).cast("int"), (s["start"] - at["to"]).cast("int")), F.lit("["), s["kind"], F.lit("]")).alias("done"), s["end"].alias("to")))
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("long").alias("to"))
    new = F.aggregate("spans", start, step, lambda at: F.concat(at["done"], F.substr(F.col("text"), (at["to"] + 1).cast("int"))))
    return rows.select(F.col("keep").alias("doc"), new.alias("new")).select(*[F.col("new").alias(c) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
