from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palisark.llm import quality
from palisark.llm.language_id import held_out

from .conftest import prose


@pytest.fixture
def labelled(spark):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(400):
        good = i % 2
        text = prose(rng, rng.randrange(20, 80)) + "." if good else " ".join(rng.choice("BUY NOW!!! $$$ click >>> free WIN".split()) for _ in range(40))
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, good, 0))
    return (
        spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_held_out_accuracy(labelled):
    docs, labels = labelled
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 400 and len(held) > 50
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)


def test_only_allowed_inputs(labelled):
    docs, labels = labelled
    machine = quality.fit(docs, labels)
    lied = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.fit(docs.repartition(7), lied.repartition(3))
    assert np.array_equal(machine.weights, again.weights) and np.array_equal(machine.factors, again.factors)
    key = lambda df: {r.doc_id: r.score for r in quality.score(df, machine).collect()}
    assert key(docs) == key(docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None), "quality": F.lit(1), "score": F.lit("c")}))


def test_odd_texts_and_empty_tables(labelled, make_docs, odd_texts):
    docs, labels = labelled
    machine = quality.fit(docs, labels)
    found = quality.score(make_docs(odd_texts).drop("n_chars"), machine).collect()
    assert len(found) == len(odd_texts) and all(0 <= r.score <= 1 for r in found)
    assert quality.score(make_docs([]), machine).collect() == []
    untrained = quality.fit(docs, labels.limit(0))
    assert {r.score for r in quality.score(docs, untrained).collect()} == {0.5}
    none = quality.fit(make_docs([]), labels)
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_identity_equals_all_pairs():
    """The sum-of-squares identity against the sum over all pairs."""
    rng = np.random.default_rng(2)
    machine = quality.Machine(0.3, rng.normal(size=quality.N_FEATURES).astype(np.float32), rng.normal(size=(quality.N_FEATURES, quality.FACTORS)).astype(np.float32))
    (number, value, at) = next(quality.features(pa.array(["one two three. FOUR", None, "a a b"]), np.array([19, -1, 5])))
    for d, got in enumerate(machine.margins(number, value, at)):
        own = slice(at[d], at[d + 1])
        n, x = number[own], value[own].astype(float)
        pairs = sum(float(machine.factors[n[i]].astype(float) @ machine.factors[n[j]]) * x[i] * x[j] for i, j in itertools.combinations(range(len(n)), 2))
        assert got == pytest.approx(machine.bias + float(machine.weights[n] @ x) + pairs, rel=1e-4, abs=1e-4)


def test_repeated_rows_and_long_texts(labelled):
    """A text has a bounded number of features, however long; repeated rows and clashing names change nothing."""
    docs, labels = labelled
    long = " ".join(f"w{i}" for i in range(120_000))
    more = docs.limit(3).union(docs.limit(3)).union(docs.sparkSession.createDataFrame([(9001, long, "en", "s", len(long))], docs.schema))
    machine = quality.fit(docs.union(more), labels.union(labels.sparkSession.createDataFrame([(9001, 1, 0)], labels.schema)))
    found = quality.score(more.withColumn("score", F.lit("x")).withColumn("number", F.lit(1)), machine).collect()
    assert len(found) == 7 and len({(r.doc_id, r.score) for r in found}) == 4
    number, value, at = next(quality.features(pa.array([long]), np.array([len(long)])))
    assert len(number) <= quality.WORD_BUCKETS + len(quality.STATISTICS) + 1 and len(set(number.tolist())) == len(number)


def test_held_out_accuracy_on_the_tables(spark):
    """On the provided tables: rows that weren't learnt from, by their labels."""
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    found = quality.score(docs, quality.fit(docs, labels)).where("held_out").join(labels, "doc_id").select("quality", "predicted", "score").collect()
    good, bad = [r.score for r in found if r.quality == 1], [r.score for r in found if r.quality == 0]
    assert sum(r.quality == r.predicted for r in found) >= 0.95 * len(found)
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)
