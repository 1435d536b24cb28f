import itertools
import random
import re

import numpy as np
import pytest

from lumenframe.llm import pii

from .conftest import documents, frame, prose


def by_patterns(text):
    """Base spans straight from the patterns."""
    text, found = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        total = sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d)))
        if 12 <= len(d) <= 19 and total % 10 == 0:
            found.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def card(rng, n=16):
    d = [rng.randrange(10) for _ in range(n - 1)]
    return next(t for c in "0123456789" if pii.luhn(t := "".join(map(str, d)) + c))


def entity(rng, kind):
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    if kind == "email":
        return f"{rng.choice('abcdefg')}{number(2)}@mail{number(1)}.example.{rng.choice(['com', 'org'])}"
    if kind == "ip":
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    if kind == "card":
        return card(rng)
    return f"+1 ({number(3)}) 555-{number(4)}"


def with_entities(rng, n, share=0.5):
    """Texts of which a share has one entity each; others have numbers that are none."""
    out = []
    for _ in range(n):
        words = prose(rng, "en", rng.randint(20, 60)).split()
        new = entity(rng, rng.choice(pii.KINDS)) if rng.random() < share else rng.choice(["version 4.0", "in 1984", "12,000", "4111111111111112", "token = ab12cd34ef56ab12", "a dot on", "at 5"])
        words.insert(rng.randrange(len(words)), new)
        out.append(" ".join(words))
    return out


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(2)
    signs = ["a", "B", "7", "12", "300", "@", ".", "-", " ", "+", "(", ")", "4111 1111-11111111", "é", "\n", "_", "%", "a@b.c", "1.2.3.4", "+1 (017) 555-7713"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == by_patterns(text), text
    for text in ("1.2.3.4.5.6.7.8", "a@b.c@d.e", "@b.c", "a@@b.c", "001.0002.3.255 256.1.1.1", "4111111111111111", "4111 1111 1111 1111", "4111--1111", "+123456789 ", "+1 2", None, "", "0" * 5000, "x@" * 500, "1." * 3000):
        assert pii.base_spans(text) == by_patterns(text), text


@pytest.mark.parametrize("n", [100_000])
def test_long_texts_take_time_in_proportion(n):
    for text in ("x" * n, "7" * n, "7 " * n, "+1 " + " " * n, "a@" * n, "." * n, "a." * n):
        assert isinstance(pii.base_spans(text), list)


def small_graph(rng, n, edges, model):
    features = [rng.integers(0, pii.FEATURES, 3) for _ in range(n)]
    for f in features:
        model.weights[f] = rng.normal(size=(3, model.weights.shape[1]))
    a, b, kinds = zip(*edges, strict=True) if edges else ((), (), ())
    none = np.zeros(n, bool)
    return pii.Graph(np.repeat(np.arange(n), 3), np.concatenate(features), n, np.array(a, int), np.array(b, int), np.array(kinds, int), none, none.copy())


def enumerated(model, g, unary):
    k = unary.shape[1]
    nodes, total = np.zeros((g.n, k)), 0.0
    for y in itertools.product(range(k), repeat=g.n):
        w = np.exp(sum(unary[i, y[i]] for i in range(g.n)) + sum((model.linked if kind else model.follow)[y[i], y[j]] for i, j, kind in zip(g.a, g.b, g.linked, strict=True)))
        total += w
        for i in range(g.n):
            nodes[i, y[i]] += w
    return nodes / total


@pytest.mark.parametrize("edges", [[], [(0, 1, 0), (1, 2, 0), (2, 3, 0)], [(0, 1, 0), (1, 3, 1), (2, 3, 0)], [(0, 2, 1), (1, 2, 1), (2, 3, 0)]])
def test_messages_are_exact_without_cycles(edges):
    rng = np.random.default_rng(7)
    model = pii.new_model()
    model.follow[:], model.linked[:] = rng.normal(size=model.follow.shape), rng.normal(size=model.linked.shape)
    g = small_graph(rng, 4, edges, model)
    unary = pii.scores(model, g)
    nodes, pairs = pii.marginals(model, g, unary, 200)
    assert np.abs(nodes - enumerated(model, g, unary)).max() < 1e-3
    assert np.abs(pairs.sum((1, 2)) - 1).max(initial=0) < 1e-9


def test_messages_on_a_cycle_are_near():
    rng = np.random.default_rng(8)
    model = pii.new_model()
    model.follow[:], model.linked[:] = 0.5 * rng.normal(size=model.follow.shape), 0.5 * np.eye(len(model.linked))
    g = small_graph(rng, 4, [(0, 1, 0), (1, 2, 0), (2, 3, 0), (0, 3, 1)], model)
    unary = pii.scores(model, g)
    nodes, _ = pii.marginals(model, g, unary, 300)
    assert np.abs(nodes - enumerated(model, g, unary)).max() < 0.05


def test_links_carry_labels_across_a_text():
    """A word whose own potential tells nothing takes the label of the linked one."""
    c = pii.candidates("call 4111.1111.1111.1111 now, not 12 or 7; it was 4111 1111 1111 1111 before, and 4111/1111/1111/1111 too")
    words = [c.places.index(p) for p in c.places]
    assert c.links and all(a < b for a, b in c.links) and len(words) == len(c.places)
    model = pii.new_model()
    model.linked[:] = 3 * np.eye(len(model.linked))
    model.follow[:] = np.eye(len(model.follow))
    g = pii.graph([c])
    unary = np.zeros((g.n, len(pii.KINDS) + 1))
    unary[:, 0] = 0.5
    unary[c.links[0][0], 3] = 20.0
    nodes, _ = pii.marginals(model, g, unary)
    assert nodes[c.links[0][1]].argmax() == 3


@pytest.fixture(scope="module")
def model():
    rng = random.Random(4)
    return pii.fit([w for t in with_entities(rng, 600) for _, w in pii.windows_of(t)], epochs=4)


def test_field_finds_other_ways_of_writing(model):
    rng, hits, wrong, n = random.Random(6), 0, 0, 200
    for _ in range(n):
        kind = rng.choice(pii.KINDS)
        new = pii.other_ways(kind, entity(rng, kind), rng)
        head, tail = prose(rng, "en", 20), prose(rng, "en", 20)
        text = f"{head} {new} {tail}"
        found = pii.found_spans(model, [text])[0][1]
        hits += any(k == kind and text[a:b] == new for k, a, b, _ in found)
        wrong += sum(not (a < len(head) + 1 + len(new) and len(head) < b) for _, a, b, _ in found)
    assert hits >= 0.9 * n and wrong <= 2


def test_field_leaves_clean_texts_alone_and_base_spans_as_they_are(model):
    texts = with_entities(random.Random(8), 300) + [t for _, t, *_ in documents()] + [None, ""]
    for text, (base, every) in zip(texts, pii.found_spans(model, texts), strict=True):
        assert base == by_patterns(text)
        assert [s[:3] for s in every if s[3] == 1.0] == base
        assert all(not any(x < b and a < y for _, x, y in base) for _, a, b, s in every if s < 1)
    added = [text[a:b] for text, (_, every) in zip(texts, pii.found_spans(model, texts), strict=True) for _, a, b, s in every if s < 1]
    assert len(added) <= 2, added


def test_find_and_redact(spark, rows, empty):
    rng = random.Random(11)
    more = [(200 + i, t, "en", "s0") for i, t in enumerate(with_entities(rng, 150))]
    df = frame(spark, rows + more).repartition(4)
    got = pii.find(df).collect()
    assert len(got) == len(rows) + len(more)
    want = sorted(str((d, by_patterns(t))) for d, t, *_ in rows + more)
    assert sorted(str((r.key, [(s.kind, s.start, s.end) for s in r.base])) for r in got) == want
    assert sorted(map(str, got)) == sorted(map(str, pii.find(df.repartition(2)).collect()))
    out = pii.redacted_documents(df)
    assert out.columns == df.columns
    spans = {r.key: r.spans for r in got if r.key is not None and r.key >= 200}
    for r in out.where("doc_id >= 200").collect():
        text, at, parts = dict((d, t) for d, t, *_ in more)[r.doc_id], 0, []
        for s in spans[r.doc_id]:
            parts += [text[at : s.start], f"[{s.kind}]"]
            at = s.end
        assert r.text == "".join(parts) + text[at:]
    assert {r.text for r in out.where("doc_id = 79").collect()} == {None}
    assert pii.find(empty).collect() == [] and pii.redacted_documents(empty).collect() == []
    plain = pii.find(frame(spark, [(1, "no numbers", "en", "s"), (None, None, None, None)])).collect()
    assert all(r.base == [] and r.spans == [] for r in plain) and len(plain) == 2
