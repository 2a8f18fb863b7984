from __future__ import annotations

import random

import corpus_pipeline
import pytest

from palisark.llm import queries

from .conftest import DOCS
from .test_bpe import library
from .test_exact_dedup import normal
from .test_near_dedup import brute

WORDS = {
    "en": "the of and to in is that with house street because through people water night between under above".split(),
    "de": "der die und das nicht ist mit auf eine haus straße weil durch leute wasser nacht zwischen unter".split(),
}
QUESTION = "what is the name of the long process by which green plants turn light into chemical energy"


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(11)
    texts = []
    for i in range(120):
        lang = ("en", "de")[i % 2]
        texts.append((" ".join(rng.choice(WORDS[lang]) + rng.choice(["", "s", "er", "t"]) for _ in range(60)), lang))
    texts += [texts[4], (texts[5][0].replace(" ", "  "), "de"), (texts[6][0] + " also", "en"), (texts[7][0] + f" {QUESTION}", "de")]
    texts += [(None, "en"), ("", "en"), ("12 34", None), (texts[8][0] + f" {QUESTION} " + texts[10][0], "en")]
    docs = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, QUESTION)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), docs


def test_stages(spark, folder):
    """Each stage against a brute-force version on what its predecessor kept."""
    path, docs = folder
    have = spark.read.parquet(f"{path}/documents.parquet")
    columns = have.columns
    alive = {i: t for i, t, *_ in docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        have = stage(spark, have, path)
        assert have.columns == columns
        kept = {r.doc_id for r in have.collect()}
        if name == "language ID":
            must = {i for i, t in alive.items() if any(c.isalpha() for c in t or "")}
            assert kept <= must and len(kept) >= 0.95 * len(must)
        elif name == "exact dedup":
            first = {}
            for i in sorted(alive):
                first.setdefault(normal(alive[i]), i)
            assert kept == set(first.values())
        elif name == "near dedup":
            assert kept == {r[0] for r in brute(sorted(alive.items()), 5) if r[3]}
        else:
            assert kept == {i for i, t in alive.items() if QUESTION not in t}
        alive = {i: alive[i] for i in kept}
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id: r.n_tokens for r in out} == {i: len(library(t)) for i, t in alive.items()}


def test_near_copies_and_questions_are_gone(spark, folder):
    path, docs = folder
    kept = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert {6, 7, 8, 10} <= kept or len({6, 7, 8, 10} - kept) <= 1
    assert not kept & {120, 121, 122, 124, 125, 126, 127}


def test_empty_table(spark, folder, tmp_path):
    path, _ = folder
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).collect() == []


def test_every_operator_has_its_query():
    assert [q.split("_")[0] for q in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5
