from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisark.llm import bpe
from palisark.llm import textbytes as tb

from .conftest import thue_morse

PATH = bpe.default_vocabulary()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.no_truncation()
LIBRARY.no_padding()


def library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def ours(texts):
    import pyarrow as pa

    body, offsets = tb.utf8(pa.array(texts, pa.string()))
    ids, ends = bpe.encode_piece(bpe.vocabulary(PATH), body, offsets)
    return [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]


def test_odd_texts_as_the_library(odd_texts):
    texts = [*odd_texts, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", " <|endoftext|>x", "he's we'VE 'll'll ''s", "tab\t tab  \n x \n\n y"]
    assert ours(texts) == [library(t) for t in texts]


@settings(max_examples=150, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \t\n'aeio stTHré12!?-<|>"), st.characters(codec="utf-8")), max_size=60), max_size=6))
def test_any_texts_as_the_library(texts):
    assert ours(texts) == [library(t) for t in texts]


def test_words_as_the_library():
    rng = random.Random(1)
    letters = "etaoinshrdlucmfwypvbgk"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 24))) for _ in range(200)) for _ in range(20)]
    assert ours(texts) == [library(t) for t in texts]


def test_digests(make_docs, odd_texts):
    found = {r.doc_id: r for r in bpe.digests(make_docs(odd_texts).withColumn("ids", F.lit(1))).collect()}
    assert len(found) == len(odd_texts)
    for i, t in enumerate(odd_texts):
        ids = library(t)
        assert found[i].n_tokens == len(ids)
        assert found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_decode_columns(make_docs, odd_texts):
    docs = make_docs(odd_texts).withColumn("rank", F.lit("clash"))
    out = bpe.decode(bpe.encode(docs)).collect()
    assert all(r.decoded == (r.text or "") and list(r.ids) == library(r.text) and r["rank"] == "clash" for r in out)


def test_empty_table(make_docs):
    assert bpe.digests(make_docs([])).collect() == []
    assert bpe.encode(make_docs([])).collect() == []


def test_colliding_words_stay_apart():
    a, b = thue_morse(11), thue_morse(11, "ba")
    texts = [f"x {a} {b}", b, a, f"{b}{a}"]
    assert ours(texts) == [library(t) for t in texts]


def test_distinct_compares_bytes():
    """Also under a hash that tells nothing of what stands behind the first eight bytes."""
    words = ["same-beginning-one", "same-beginning-two", "short", "same-beginning-one", "same-beginning", "short"]
    body = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    start = np.concatenate([[0], end[:-1]])

    def weak(body, start, end):
        return np.array([int.from_bytes(body[a : min(b, a + 8)].tobytes().ljust(8, b"\0"), "big") + 0 * b for a, b in zip(start, end)], np.uint64)

    for hashes in (tb.word_hash, weak):
        first, which = bpe.distinct(body, start, end, hashes)
        assert [words[first[k]] for k in which] == words and len(first) == 4


def test_columns_that_are_there_are_refused(make_docs):
    docs = make_docs(["a b", "a b"], ids=[1, 1])
    assert bpe.digests(docs).count() == 2
    encoded = bpe.encode(docs)
    assert encoded.count() == 2
    for call in (lambda: bpe.encode(encoded), lambda: bpe.decode(docs.withColumn("ids", F.array(F.lit(1))), text_col="text")):
        with pytest.raises(ValueError, match="already"):
            call()
