from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from palisark.llm import merkle
from palisark.llm.queries import ORACLE_SQL

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
OUT = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def enc(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def tree(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha(*x[i : i + 2]) for i in range(0, len(x), 2)])
    return levels


def walk(levels, i, x):
    siblings = []
    for level in levels[:-1]:
        run = level[i // 2 * 2 : i // 2 * 2 + 2]
        if len(run) == 2:
            siblings.append(run[1 - i % 2])
            run[i % 2] = x
        else:
            run = [x]
        x, i = sha(*run), i // 2
    return siblings, x


def expected(docs):
    """docs: (doc_id, text, lang, source, n_chars)."""
    leaf = lambda d, more=0: sha(*map(enc, (d[0], d[3], d[2], None if d[4] is None else d[4] + more, d[1])))
    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {g: sorted((d for d in docs if d[2] == g), key=lambda d: (d[0] is not None, d[0] or 0, leaf(d))) for g in langs}
    trees = {g: tree([leaf(d) for d in x]) for g, x in groups.items()}
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for i, d in enumerate(groups[g]):
            hit = d[0] is not None and zlib.crc32(str(d[0]).encode()) % 7 == 0
            low, x = walk(trees[g], i, leaf(d, int(hit)))
            high, x = walk(top, k, x)
            out.append((d[0], leaf(d), trees[g][-1][0], top[-1][0], sha(*low, *high), x, x == top[-1][0]))
    return sorted(out, key=repr)




def made(spark, docs, parts=3):
    return spark.createDataFrame(docs, COLUMNS).repartition(parts)


def sample(n, langs, seed=5):
    rng = random.Random(seed)
    return [(i * 3, rng.choice([f"text {i} é☃", "", None]), rng.choice(langs), rng.choice(["web", None]), rng.choice([i, None, 9, 99])) for i in range(n)]


def test_manifest_equals_brute_force(spark, rows):
    docs = sample(41, ["en", "en", "en", "fr", None, "", "é", "zz"])
    assert rows(merkle.manifest(made(spark, docs)), *OUT) == expected(docs)


def test_trees_of_several_cuts(spark, rows):
    docs = sample(9, ["en", "en", "fr", None, "de"])
    assert rows(merkle.manifest(made(spark, docs), cut=1), *OUT) == expected(docs)


@pytest.mark.parametrize("n", [1, 4, 5])
def test_small_trees(spark, rows, n):
    docs = sample(n, ["en"], seed=n)
    found = rows(merkle.manifest(made(spark, docs), cut=2), *OUT)
    assert found == expected(docs)
    if n == 1:
        assert found[0][1] == found[0][3] and found[0][4] == hashlib.sha256(b"").hexdigest()


def test_repeated_rows_null_ids_and_names_that_clash(spark, rows):
    docs = [(7, "same", "en", "web", 4)] * 6 + [(None, "x", "en", None, 1), (None, "y", None, "web", None), (7, "other", "en", "web", 2**63 - 1)]
    docs += [(i, "z" * 70_000, "de", "web", 2**63 - 1) for i in range(12)]
    df = made(spark, docs)
    for name in ("tree", "h", "leaf", "rank", "n", "root", "row_no", "bucket"):
        df = df.withColumn(name, F.lit("other"))
    found = rows(merkle.manifest(df), *OUT)
    assert found == expected(docs)
    assert {x[6] for x in found} == {True, False}


def test_empty_table(spark):
    out = merkle.manifest(made(spark, []))
    assert out.collect() == [] and tuple(out.columns) == OUT


def test_sql_says_the_same(spark, rows):
    docs = [d for d in sample(60, ["en", "fr", None, "é"])]
    con = duckdb.connect()
    frame = spark.createDataFrame(docs, COLUMNS).toArrow()
    con.register("documents", frame)
    found = con.sql(f"SELECT {', '.join(OUT)} FROM ({ORACLE_SQL['op13_merkle_manifest']})").fetchall()
    assert sorted(found, key=repr) == expected(docs)
