from __future__ import annotations

import random

import pytest

WORDS = "the of and mar lodi tern kelp osu vint gram pell dorn asti quen rubo lism taf neri oxal bem curo dap".split()


def words_of(text):
    """Words by the definition, the plain way."""
    out, word = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return out + [word] if word else out


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): copies, near copies, shared passages, null, empty and odd texts."""
    rng = random.Random(5)
    texts = [None, "", "   \n\t ", "one", "ONE", "one two", "a " * 120, "été à la mer " * 30, "x" * 30_000, " ".join(["longer"] * 3000)]
    base = [prose(rng, n) for n in (12, 40, 60, 90, 150, 400)]
    passage = prose(rng, 55)
    for text in base:
        texts += [text, text, text.upper()]
        w = text.split()
        for changes in (1, 2, max(1, len(w) // 60)):
            v = list(w)
            for _ in range(changes):
                v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
        texts.append(prose(rng, 30) + " " + passage + "\n" + prose(rng, 25))
    texts += [prose(rng, rng.randrange(1, 80)) for _ in range(40)]
    return [(i, t, "ab"[i % 2], f"s{i % 3}") for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with one repeated row, a null id and extra columns whose names the operators use inside."""
    rows = [(*r, "x", 1) for r in [*corpus, corpus[12], (None, "nobody knows this text", None, None)]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, id string, node int").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
