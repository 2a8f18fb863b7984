from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisark.llm import language_id

LEXICON = {
    "en": "the of and to in is that with house street because through people water night between".split(),
    "de": "der die und das nicht ist mit auf eine haus straße weil durch leute wasser nacht zwischen".split(),
    "fr": "le la les et des une dans est que avec maison rue parce travers gens eau nuit entre".split(),
}


@pytest.fixture
def docs(spark):
    rng = random.Random(1)
    made = []
    for i in range(240):
        lang = ("en", "de", "fr")[i % 3]
        made.append((i, " ".join(rng.choice(LEXICON[lang]) for _ in range(rng.randrange(15, 80))), lang if i % 7 else None, "s", 5))
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")


def test_held_out_accuracy(docs):
    found = language_id.predict(docs, language_id.fit(docs)).collect()
    truth = lambda i: ("en", "de", "fr")[i % 3]
    held = [r for r in found if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    assert sum(r.lang_pred == truth(r.doc_id) for r in held) >= 0.98 * len(held) > 0
    assert all(0 <= r.score <= 1 for r in found)


def test_labels_of_held_out_rows_play_no_part(docs):
    lied = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert language_id.fit(lied) == language_id.fit(docs)
    assert language_id.fit(docs.repartition(9)) == language_id.fit(docs.coalesce(1))


def test_odd_texts(docs, make_docs, odd_texts):
    model = language_id.fit(docs)
    odd = make_docs(odd_texts).withColumn("margin", F.lit("x")).withColumn("cell", F.lit(1))
    found = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    for i, t in enumerate(odd_texts):
        und = not any(c.isalpha() for c in t or "")
        assert (found[i].lang_pred == "und") == und
        assert not und or (found[i].score == 0 and found[i].rejected)


def test_narrow_margins_are_rejected(docs, make_docs):
    model = language_id.fit(docs)
    clear = " ".join(LEXICON["de"] * 3)
    texts = [clear, "zzzz qqqq xxxx", None]
    out = language_id.accepted(make_docs(texts), model)
    assert [r.doc_id for r in out.collect()] == [0]
    assert out.columns == make_docs(texts).columns


def test_nothing_learnt(make_docs):
    docs = make_docs(["a b c"], lang=None)
    model = language_id.fit(docs)
    assert model.languages == ()
    assert [r.lang_pred for r in language_id.predict(docs, model).collect()] == ["und"]
    empty = make_docs([])
    assert language_id.predict(empty, language_id.fit(empty)).collect() == []


def test_null_ids_are_learnt_from_and_predicted(docs):
    nulls = docs.withColumn("doc_id", F.lit(None).cast("long"))
    found = language_id.predict(nulls, language_id.fit(docs)).collect()
    assert len(found) == 240 and not any(r.held_out for r in found)


@pytest.fixture
def many(spark):
    """80 languages of words of their own, the last ones rare."""
    rng = random.Random(3)
    lexicon = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(80 * 12)]
    made = [(k * 40 + j, " ".join(rng.choice(lexicon[k * 12 : k * 12 + 12]) for _ in range(40)), f"l{k:02}", "s", 5) for k in range(80) for j in range(16 if k < 64 else 8)]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")


def test_every_language_is_learnt(many):
    model = language_id.fit(many)
    assert sorted(model.languages) == [f"l{k:02}" for k in range(80)]
    found = language_id.predict(many, model).collect()
    assert all(r.lang_pred == f"l{r.doc_id // 40:02}" and not r.rejected for r in found)
    assert language_id.accepted(many, model).count() == many.count()


def test_blocks_of_languages_give_the_same(many, rows):
    model = language_id.fit(many)
    whole = rows(language_id.predict(many, model, block_languages=80))
    assert rows(language_id.predict(many, model, block_languages=7)) == whole
    assert rows(language_id.predict(many, model, block_languages=1)) == whole


def brute_sizes(model, text):
    import re

    import zstandard

    found = re.findall(r"[^\W\d_]+", text.lower())
    said = [w for i, w in enumerate(found) if i == 0 or w != found[i - 1]]
    joined = " ".join(said)
    out = []
    for d in model.dictionaries:
        data = zstandard.ZstdCompressionDict(d.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        encode = zstandard.ZstdCompressor(level=language_id.LEVEL, dict_data=data, write_content_size=False).compress
        out.append(sum(len(encode(joined[i : i + language_id.BLOCK_CHARS].encode())) for i in range(0, len(joined), language_id.BLOCK_CHARS)))
    return out


def test_equals_brute_force(docs, make_docs):
    """Every text against every dictionary, plainly; also long texts, ties, repeated rows and columns that clash."""
    model = language_id.fit(docs)
    rng = random.Random(6)
    texts = [" ".join(rng.choice(LEXICON[x]) for _ in range(n)) for x in LEXICON for n in (1, 3, 40, 4000)] + ["zz qq", "a", "1 2 drei"] * 2
    odd = make_docs(texts, ids=[k // 2 for k in range(len(texts))]).withColumn("found", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("phrase", F.lit("y"))
    got = sorted((r.doc_id, r.lang_pred, round(r.margin, 12)) for r in language_id.predict(odd, model).collect())
    want = []
    for k, t in enumerate(texts):
        sizes = brute_sizes(model, t)
        first, second = sorted(sizes)[:2]
        want.append((k // 2, model.languages[sizes.index(first)], round((second - first) / second, 12)))
    assert got == sorted(want)


def test_dictionary_is_that_of_whole_texts(spark):
    """Phrases of every part of a long text count, most frequent last, cut between phrases."""
    text = " ".join(f"wort{i % 97:02x}z" for i in range(6000)) + " ganz am ende " * 50
    docs = spark.createDataFrame([(0, text, "xx", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    learnt = language_id.fit(docs).dictionaries[0].decode()
    count = language_id.phrases(text)
    ranked = sorted(count, key=lambda p: (-count[p], p))
    assert learnt == language_id.dictionary(ranked).decode() and "ganz am ende" in learnt and learnt.endswith(ranked[0])


def test_repeated_ids_give_one_model(spark):
    rows = [(1, f"text number {i} of this id", "en", "s", 1) for i in range(20)] + [(2, "der zweite text", "de", "s", 1)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert language_id.fit(docs.repartition(7)) == language_id.fit(docs.orderBy("text").coalesce(1))


def test_held_out_accuracy_on_the_tables(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language_id.predict(docs, language_id.fit(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null and lang_pred <> 'und'")
    right = [r.lang == r.lang_pred for r in found.collect()]
    assert sum(right) >= 0.98 * len(right) > 100
