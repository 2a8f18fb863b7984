from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisark.llm import sharding


def check(found, texts, shards):
    assert sorted(r.doc_id for r in found) == list(range(len(texts)))
    for r in found:
        b = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
    slots: dict[int, list[int]] = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(k, [])) for k in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == len(texts)


@pytest.mark.parametrize(("n", "bucket_rows"), [(500, 8192), (500, 7), (5, 8192)])
def test_sizes_and_slots(make_docs, odd_texts, n, bucket_rows):
    texts = (odd_texts * n)[:n]
    docs = make_docs(texts, parts=6).withColumn("row_no", F.lit("x")).withColumn("bucket", F.lit(1))
    check(sharding.assign(docs, bucket_rows=bucket_rows).collect(), texts, 16)


def test_empty_table(make_docs):
    assert sharding.assign(make_docs([])).collect() == []


def test_null_and_repeated_ids(make_docs):
    found = sharding.assign(make_docs(["a"] * 40, ids=[None] * 20 + [3] * 20)).collect()
    assert len(found) == 40 and max(Counter(r.shard for r in found).values()) == 3


def test_same_seed_same_result(make_docs, rows):
    docs = make_docs([f"t{i}" for i in range(100)], parts=4)
    assert rows(sharding.assign(docs)) == rows(sharding.assign(docs))
    assert rows(sharding.assign(docs)) != rows(sharding.assign(docs, seed=8))


def test_matrix_margins_are_exact():
    rng = np.random.default_rng(0)
    counts, buckets = rng.integers(0, 50, 13), None
    buckets = sharding.even(int(counts.sum()), 9)
    matrix = np.stack([sharding.matrix_row(counts, buckets, p, 3) for p in range(len(counts))])
    assert (matrix >= 0).all()
    assert matrix.sum(1).tolist() == counts.tolist()
    assert matrix.sum(0).tolist() == buckets.tolist()


def test_matrix_follows_the_hypergeometric_law():
    """Over many seeds a cell has the mean and variance of a uniform arrangement."""
    counts, buckets = np.array([30, 10, 20]), np.array([15, 15, 30])
    cell = np.array([sharding.matrix_row(counts, buckets, 1, s)[0] for s in range(4000)])
    n, k, m = 60, 15, 10
    variance = m * k / n * (1 - k / n) * (n - m) / (n - 1)
    assert abs(cell.mean() - m * k / n) < 4 * (variance / 4000) ** 0.5
    assert abs(cell.var() / variance - 1) < 0.15


def test_large_populations():
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 1000) for _ in range(800)])
    assert abs(drawn.mean() - 400) < 3 and abs(drawn.var() / 240 - 1) < 0.25


def test_places_are_uniform(make_docs):
    """Where one document lands over many seeds: chi-squared over shards."""
    docs = make_docs([f"t{i}" for i in range(64)], parts=4)
    landed = Counter()
    for seed in range(12):
        landed.update(r.shard for r in sharding.assign(docs, shards=4, seed=seed).where("doc_id < 16").collect())
    chi = sum((landed[k] - 48) ** 2 / 48 for k in range(4))
    assert chi < 16.3  # 0.1 % at 3 degrees of freedom


@pytest.mark.parametrize(("good", "bad", "sample"), [(10**12 // 16, 10**12 * 15 // 16, 819_200), (7, 10**12, 10**11), (10**12, 10**12, 10**12), (5, 10**10, 10**10 + 5)])
def test_draws_at_any_population(good, bad, sample):
    """Mean and variance against the law's, and no time that grows with the population."""
    rng = np.random.default_rng(3)
    drawn = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(300)], float)
    n = good + bad
    mean = sample * (good / n)
    variance = mean * (bad / n) * ((n - sample) / (n - 1))
    assert abs(drawn.mean() - mean) <= 5 * (variance / 300) ** 0.5
    assert variance == 0 or 0.6 < drawn.var() / variance < 1.5


def test_large_draws_follow_the_exact_law(monkeypatch):
    """The sampler for large populations on a small one, against the exact probabilities: chi-squared."""
    from math import comb

    monkeypatch.setattr(sharding, "NUMPY_LIMIT", 0)
    rng = np.random.default_rng(4)
    good, bad, sample = 12, 20, 9
    drawn = Counter(sharding.hypergeometric(rng, good, bad, sample) for _ in range(3000))
    p = {k: comb(good, k) * comb(bad, sample - k) / comb(good + bad, sample) for k in range(sample + 1)}
    cells = [k for k in p if p[k] * 3000 >= 5]
    assert sum((drawn[k] - 3000 * p[k]) ** 2 / (3000 * p[k]) for k in cells) < 25  # 0.1 % at 7 degrees of freedom


def test_log_factorial():
    from math import factorial, lgamma

    for n in (0, 1, 999, 1000, 5000):
        exact = sharding._EXACT.ln(sharding.decimal.Decimal(factorial(n)))
        assert abs(sharding.log_factorial(n) - exact) < sharding.decimal.Decimal("1e-25")
    assert abs(float(sharding.log_factorial(10**12)) / lgamma(10**12 + 1) - 1) < 1e-14


def test_work_of_a_task_does_not_grow_with_the_rows(monkeypatch):
    calls = []
    draw = sharding.hypergeometric
    monkeypatch.setattr(sharding, "hypergeometric", lambda *a: calls.append(1) or draw(*a))
    for partitions, rows in ((16, 10**3), (1600, 10**7)):
        calls.clear()
        counts = np.full(partitions, rows, np.int64)
        row = sharding.matrix_row(counts, sharding.even(int(counts.sum()), 16), 5, 1)
        assert row.sum() == rows and len(calls) <= 16 * (partitions.bit_length() + 1)


def test_names_that_clash(make_docs):
    docs = make_docs(["a", "b"])
    for name in ("shard", "slot", "first_slot", "n", "size", "law"):
        docs = docs.withColumn(name, F.lit("x"))
    assert sharding.assign(docs).count() == 2


def test_permutations_without_arrays():
    import numpy as np

    for n in (1, 2, 3, 17, 1000, 70_001):
        for key in ([1, 2], [3, 4]):
            got = sharding.permuted(np.arange(n), n, key)
            assert sorted(got.tolist()) == list(range(n))
            pieces = np.concatenate([sharding.permuted(x, n, key) for x in np.array_split(np.arange(n), 3)])
            assert np.array_equal(pieces, got)
    first = np.array([sharding.permuted(np.arange(1), 64, [7, k])[0] for k in range(6400)])
    counts = np.bincount(first, minlength=64)
    assert ((counts - 100) ** 2 / 100).sum() < 63 + 5 * (2 * 63) ** 0.5  # chi-squared, five deviations
    near = np.abs(np.diff(sharding.permuted(np.arange(100_000), 100_000, [5]))).mean()
    assert abs(near / (100_000 / 3) - 1) < 0.02


def test_a_large_partition_read_in_pieces(spark):
    docs = spark.range(5000).selectExpr("id as doc_id", "concat('t', id) as text", "'en' as lang", "'web' as source", "5L as n_chars").coalesce(1)
    size = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(size, "4k")
    try:
        found = sharding.assign(docs, small_partition=50).collect()
    finally:
        spark.conf.unset(size)
    by = {}
    for r in found:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(found) == 5000 and sorted(map(len, by.values())) == [312] * 8 + [313] * 8
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
