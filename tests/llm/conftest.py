import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, text_ string, id long, hash long, copy boolean, doc string, keep int, source_ string, gone_ long, trusted_ long, key_ long, row_ long, own_ long, of_ long, path string, filter long, name string, component long, index long, row long, u double, preference long, name_ string, hash_ long, words long, size long, mark long, copies long, range long"

WORDS = {"en": "the of and to in is that it was for on with as be by this from".split(), "fr": "le la les de des et une en que qui dans pour sur pas est".split(), "de": "der die das und ein eine ist nicht mit von zu den auf für sich".split()}
ENDS = {"en": "ing tion ed ly er".split(), "fr": "eau eux ment que ée".split(), "de": "ung heit keit lich schaft".split()}


def prose(rng, lang, n):
    out = []
    for _ in range(n):
        w = rng.choice(WORDS[lang]) if rng.random() < 0.6 else "".join(rng.choice(WORDS[lang]) for _ in range(2)) + rng.choice(ENDS[lang])
        out.append(w.capitalize() if rng.random() < 0.1 else w)
    return " ".join(out)


def documents():
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, repeats, odd white space, nulls, a very long text."""
    rng = random.Random(3)
    rows = []
    langs = ["en", "fr", "de"]
    for i in range(60):
        lang = langs[i % 3]
        rows.append((i, prose(rng, lang, rng.randint(1, 120)), lang, f"s{i % 4}"))
    passage = prose(rng, "en", 35)
    for i in range(60, 75):
        rows.append((i, prose(rng, "en", 20) + "\n" + passage + " " + prose(rng, "en", 15), "en", "s0"))
    base = prose(rng, "de", 300)
    rows += [(75, base, "de", "s1"), (76, base, "de", "s2"), (77, base.replace("und", "UND"), "de", None), (78, base + " ende", None, "s1")]
    rows += [(79, None, "en", "s0"), (80, "", "en", "s0"), (81, " \t\n ", None, None), (82, "A", "en", "s1"), (83, "12 %% --", "fr", "s3")]
    rows += [(84, "na " * 400, "en", "s0"), (85, "x" * 5000, "en", "s0"), (86, "  two  spaces \n\n and\tmore é　ü  ", "fr", "s2")]
    rows += [(87, " ".join(prose(rng, "en", 3000) for _ in range(3)), "en", "s3"), (None, prose(rng, "fr", 40), "fr", "s1"), (None, base, "de", "s1"), (75, base, "de", "s1")]
    rows += [(88, "\n".join(["same line here", "other", "same line here", "", "same line here"]), "en", "s1"), (89, "<|endoftext|> x <|startoftext|>", "en", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return documents()


def frame(spark, rows):
    extra = ("k", "t", 1, 2, True, "d", 3, "s", 4, 5, 6, 7, 8, 9, "p", 10, "n", 11, 12, 13, 0.5, 14, "m", 15, 16, 17, 18, 19, 20)
    return spark.createDataFrame([(d, t, la, s, None if t is None else len(t), *extra) for d, t, la, s in rows], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).persist()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
