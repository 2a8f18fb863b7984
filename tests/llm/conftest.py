from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta river stone cloud paper window garden silver engine travel morning winter letter".split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture
def make_docs(spark):
    def make(texts, ids=None, lang="en", parts=3):
        ids = list(range(len(texts))) if ids is None else ids
        made = [(i, t, lang, "web", None if t is None else len(t)) for i, t in zip(ids, texts)]
        return spark.createDataFrame(made, DOCS).repartition(parts)

    return make


@pytest.fixture
def odd_texts():
    """Null, empty, blank, very long, repeated, other scripts, other white space, controls."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    return [
        None, "", " \t\n", long, long + " end", "same words here " * 4, "same words here " * 4, "same  words\there " * 4, "Été à l'école — naïve ☃ 漢字かな交じり文 🎈👩‍👩‍👧",
        "x", "I'll we've DON'T 'tis    nbsp　wide", "\x00\x01\x1f\x7f", "12345 67.89 1,000", "a" * 5000, "\r\n\r\n\x0b\x0c", None, "",
    ]


def thue_morse(k: int, letters: str = "ab") -> str:
    """2**k letters; with those of swapped letters it collides under any polynomial hash modulo 2**64, from k = 11 on."""
    out = letters[0]
    for _ in range(k):
        out += out.translate(str.maketrans(letters, letters[::-1]))
    return out
