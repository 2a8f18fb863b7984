from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palisark.llm import substring_dedup as sd

from .conftest import prose


def brute(rows, window=50):
    """Every window of every document against the smallest document that has it."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = True
        gone = gone[: len(b)]
        spans = int((gone & ~np.concatenate([[False], gone[:-1]])[: len(b)]).sum()) if len(b) else 0
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    passages = [prose(rng, rng.randrange(8, 60)) for _ in range(5)]
    texts = []
    for _ in range(60):
        parts = [prose(rng, rng.randrange(0, 30))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), prose(rng, rng.randrange(0, 20))]
        texts.append(rng.choice([" ", "\n", ""]).join(parts))
    return [*texts, texts[3], texts[3] + "x", "é" * 40, "é" * 41 + "z", None, "", "a" * 400, "a" * 90, "ab" * 200, "b" + "ab" * 60, "\x00" * 120, "\x00" * 70]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(make_docs, rows, seed):
    texts = corpus(seed)
    assert sorted(rows(sd.find(make_docs(texts, parts=5)))) == brute(list(enumerate(texts)))


def test_hot_anchor_is_split(make_docs, rows, monkeypatch):
    """With a low bound every shared anchor goes the way of very frequent ones, by its windows."""
    monkeypatch.setattr(sd, "HOT_SEGMENTS", 1)
    rng = random.Random(5)
    passage = prose(rng, 40)
    texts = [f"{prose(rng, 5)} {passage} {prose(rng, 5)}" for _ in range(40)]
    assert sorted(rows(sd.find(make_docs(texts, parts=4)))) == brute(list(enumerate(texts)))


def test_repeated_ids_are_one_document(make_docs, rows):
    passage = "the quick brown fox jumps over the lazy dog and runs away into the deep dark wood"
    texts = [passage, passage, "x " + passage]
    found = rows(sd.find(make_docs(texts, ids=[4, 4, None])), "doc_id", "n_removed")
    assert found == [(4, 0), (4, 0), (None, len(passage))]


def test_with_text_empty_table_and_extra_columns(make_docs):
    assert sd.find(make_docs([])).collect() == []
    docs = make_docs(["a" * 60, "b" + "a" * 60]).withColumn("home", F.lit("x")).withColumn("z", F.lit(1))
    found = {r.doc_id: bytes(r.kept) for r in sd.find(docs, with_text=True).collect()}
    assert found == {0: b"a" * 60, 1: b"b"}


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(x % 4 for x in b)))
def test_suffix_array(data):
    text = np.frombuffer(data, np.uint8)
    found = sd.suffix_array(text, 16)
    key = lambda i: data[i : i + 16]
    assert sorted(found.tolist()) == list(range(len(data)))
    ordered = [key(i) for i in found]
    if 0 not in data:  # a zero byte and the end of the text count alike
        assert ordered == sorted(ordered)


def test_common_anchors_alone_move_no_text():
    """Phrases of 30 bytes in every document share no window of 50: no segment is asked for. Windows of 50 bytes are."""
    rng = random.Random(7)
    phrases = [prose(rng, 12)[:30] for _ in range(5)]
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def asked(texts):
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        sent = pa.Table.from_batches(sd.send_anchors(1)(iter([batch]))).to_pylist()
        answers = sd.answer_anchors(1, 1)(pa.Table.from_pylist([r for r in sent if r["bucket"] < 1], sd.SENT))
        return sum(len(r["ids"]) // 8 for r in answers.to_pylist() if r["kind"] != sd.FLAG)

    assert asked([own(40).join(["", *phrases, ""]) for _ in range(50)]) == 0
    shared = own(50)
    assert asked([own(40) + shared + own(40) for _ in range(50)]) >= 50


def test_windows_at_the_edges_of_what_is_shared(make_docs, rows):
    """Shared strings of 49 to 52 bytes, at the start, in the middle and at the end of documents."""
    rng = random.Random(11)
    own = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    texts = []
    for n in [49, 50, 51, 52] * 15:
        x = own(n)
        texts += [own(rng.choice([0, 0, 5, 16, 17, 18, 60])) + x + own(rng.choice([0, 0, 5, 16, 17, 18, 60])) for _ in range(3)]
    found = sorted(rows(sd.find(make_docs(texts, parts=4))))
    assert found == brute(list(enumerate(texts))) and sum(r[2] > 0 for r in found) >= 90
