from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from palisark.llm import exact_dedup


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    return sorted(
        (i, min(g), len(g), i == min(g), hashlib.sha256(normal(t).encode()).hexdigest()) for i, t in rows for g in [groups[normal(t)]]
    )


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_groups_equal_brute_force(make_docs, rows, odd_texts, parts):
    texts = odd_texts + [f"copy {i % 3}" for i in range(60)] + ["hot"] * 80
    found = exact_dedup.groups(make_docs(texts, parts=parts), fan_in=3)
    assert sorted(rows(found)) == expected(list(enumerate(texts)))


def test_repeated_ids_keep_one_row(make_docs, rows):
    docs = make_docs(["a", "a", "a", "b"], ids=[1, 1, 2, 2])
    found = rows(exact_dedup.groups(docs), "doc_id", "keep_id", "group_size", "kept")
    assert sum(kept for *_, kept in found) == 2
    assert {(k, n) for _, k, n, _ in found} == {(1, 3), (2, 1)}
    assert sorted(r.text for r in exact_dedup.deduplicated(docs).collect()) == ["a", "b"]


def test_null_ids_lose(make_docs, rows):
    docs = make_docs(["a", "a", "b", "b"], ids=[None, 7, None, None])
    assert rows(exact_dedup.deduplicated(docs), "doc_id", "text") == [(7, "a"), (None, "b")]


def test_empty_table_and_extra_columns(make_docs, rows):
    docs = make_docs([]).withColumn("digest", F.lit(1))
    assert exact_dedup.groups(docs).collect() == []
    docs = make_docs(["a", "a "]).withColumn("digest", F.lit("x")).withColumn("cell", F.lit(3)).withColumn("kept", F.lit(None).cast("int"))
    assert len(exact_dedup.groups(docs).collect()) == 2
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns


def test_deduplicated_keeps_first(make_docs, rows, odd_texts):
    kept = {r[0] for r in expected(list(enumerate(odd_texts))) if r[3]}
    out = exact_dedup.deduplicated(make_docs(odd_texts))
    assert {r.doc_id for r in out.collect()} == kept


def test_hot_texts_and_names_that_clash(make_docs, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_COPIES", 5)
    texts = ["hot"] * 40 + ["warm"] * 4 + ["b", "c "]
    docs = make_docs(texts)
    for name in ("__digest", "__id", "__sha", "__stays", "id", "sha", "stays", "_id", "text_sha256"):
        docs = docs.withColumn(name, F.lit("kept as it is"))
    assert sorted(rows(exact_dedup.groups(docs, fan_in=3))) == expected(list(enumerate(texts)))
    out = exact_dedup.deduplicated(docs)
    assert out.columns == docs.columns
    assert {r.doc_id for r in out.collect()} == {0, 40, 44, 45}
    assert out.where("`__digest` <> 'kept as it is' or `_id` <> 'kept as it is'").count() == 0
