from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisark.llm import near_dedup as nd
from palisark.llm import textbytes as tb

from .conftest import prose, thue_morse


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent=80):
    sets = [shingle_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):
        words = prose(rng, rng.randrange(3, 120)).split()
        texts.append(" ".join(words))
        for _ in range(rng.randrange(8)):  # chains: each copy of the copy before
            for _ in range(rng.randrange(1 + len(words) // 12)):
                words[rng.randrange(len(words))] = prose(rng, 1)
            texts.append((" \n" if rng.random() < 0.3 else " ").join(words).upper() if rng.random() < 0.2 else " ".join(words))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "width"), [(1, 2), (2, 5)])
def test_equals_brute_force(make_docs, rows, odd_texts, seed, width):
    texts = corpus(seed) + odd_texts
    assert sorted(rows(nd.find(make_docs(texts), width=width))) == brute(list(enumerate(texts)), width)


def test_large_bucket_with_several_components(make_docs, rows):
    """A boilerplate puts texts in common buckets that aren't all near duplicates."""
    rng = random.Random(8)
    base = prose(rng, 60)
    texts = [f"{base} {prose(rng, 8 + i % 13)}" for i in range(60)]
    assert sorted(rows(nd.find(make_docs(texts), width=2))) == brute(list(enumerate(texts)), 2)


def test_deduplicated(make_docs, odd_texts):
    texts = corpus(3) + odd_texts
    keep = {r[0] for r in brute(list(enumerate(texts)), 5) if r[3]}
    docs = make_docs(texts).withColumn("kept", F.lit("x")).withColumn("h", F.lit(2))
    out = nd.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == keep


def test_empty_table(make_docs):
    assert nd.find(make_docs([])).collect() == []
    assert nd.find(make_docs([None, ""])).count() == 2


def test_sketch_distance_tells_similarity():
    """Sketches of sets of known similarity: the bound keeps those at the threshold and excludes those far under it."""
    rng = np.random.default_rng(3)
    kept = {0.8: 0, 0.3: 0}
    for share in kept:
        for _ in range(60):
            common, own = int(1000 * share), (1000 - int(1000 * share)) // 2
            pool = rng.integers(0, 2**64, common + 2 * own, dtype=np.uint64)
            a, b = np.sort(pool[: common + own]), np.sort(np.concatenate([pool[:common], pool[common + own :]]))
            _, sketch = nd.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]))
            kept[share] += int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) <= nd.most_different(80)
    assert kept[0.8] == 60
    assert kept[0.3] < 20


def test_shingles_are_exact():
    body = np.frombuffer(b"A b  a B\ta b c", np.uint8)
    _, count = nd.shingles(body, np.array([0, len(body)]), 2)
    assert count.tolist() == [len(shingle_set(body.tobytes().decode(), 2))]
    assert tb.SPACE[0x0B] and not tb.SPACE[0x1C]


def test_colliding_words_are_no_copies(make_docs, rows):
    a, b = thue_morse(11), thue_morse(11, "ba")
    texts = [a, b, f"{a} x", f"{b} x", a]
    assert sorted(rows(nd.find(make_docs(texts), width=2))) == brute(list(enumerate(texts)), 2)


def near_threshold(seed, sets=60):
    """Pairs whose similarity is just at or just under 0.8, by the number of words that differ."""
    rng = random.Random(seed)
    texts = []
    for k in range(sets):
        words = [f"w{k}x{i}" for i in range(rng.randrange(60, 260))]
        texts.append(" ".join(words))
        n = len(words) - 1
        spoilt = round(n / 9 / 2) + rng.randrange(-1, 2)  # each changed word costs two shingles of two words on either side
        for i in rng.sample(range(2, len(words) - 2, 3), spoilt):
            words[i] = f"new{k}x{i}"
        texts.append(" ".join(words))
    return texts


def test_recall_near_the_threshold(make_docs, rows):
    texts = near_threshold(5)
    found, expected = sorted(rows(nd.find(make_docs(texts), width=2))), brute(list(enumerate(texts)), 2)
    assert found == expected
    assert 20 <= sum(not kept for *_, kept in expected) <= 100


def test_boilerplate_and_near_copies_in_one_bucket(make_docs, rows):
    """Groups that only rare shingles tell apart, among them pairs of near copies that no leader has met."""
    rng = random.Random(11)
    base = prose(rng, 80)
    texts = []
    for i in range(70):
        own = " ".join(f"own{i}x{j}" for j in range(25 + i % 9))
        texts.append(f"{base} {own}")
        if i % 5 == 0:
            texts.append(f"{base} {own} end")
    assert sorted(rows(nd.find(make_docs(texts), width=2))) == brute(list(enumerate(texts)), 2)


def test_whole_sketch_never_excludes_a_pair_at_the_threshold():
    rng = np.random.default_rng(8)
    for n in (5, 50, 400, 3000):
        shared, own = 8 * n, n
        pool = rng.integers(0, 2**64, shared + 2 * own, dtype=np.uint64)
        a, b = np.concatenate([pool[:shared], pool[shared : shared + own]]), np.concatenate([pool[:shared], pool[shared + own :]])
        sketch = nd.whole_sketch(np.concatenate([a, b]), np.array([len(a), len(b)]))
        assert int(np.bitwise_count(sketch[0] ^ sketch[1]).sum()) * 180 <= (len(a) + len(b)) * 20


def test_one_id_with_different_texts_and_clashing_columns(make_docs):
    base = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([base, f"{base} end", "something else than that", "something else than that"], ids=[1, 2, 2, 2])
    docs = docs.withColumn("text_hash", F.lit(1)).withColumn("gone", F.lit("x")).withColumn("cid", F.lit(2)).withColumn("component_id", F.lit(None).cast("long"))
    out = nd.deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id, r.text[:4]) for r in out.collect()) == [(1, "w0 w"), (2, "some"), (2, "some")]
    assert nd.find(docs).count() == 4


def test_classes_that_stay_apart_meet_few_others(make_docs, rows, monkeypatch):
    """Texts with a common boilerplate share many buckets; what they meet there doesn't grow with the number of buckets."""
    rng = random.Random(12)
    base = prose(rng, 90)
    texts = [f"{base} {' '.join(f'own{i}x{j}' for j in range(14))}" for i in range(120)]
    met = []
    plausible = nd.plausible
    monkeypatch.setattr(nd, "plausible", lambda pairs, reps, percent: (met.append(pairs.count()), plausible(pairs, reps, percent))[1])
    assert sorted(rows(nd.find(make_docs(texts), width=2))) == brute(list(enumerate(texts)), 2)
    assert met[0] > 0 and met[1] <= nd.LEADERS * len(texts)
