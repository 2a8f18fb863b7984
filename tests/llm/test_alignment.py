from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from palisark.llm import alignment

OUT = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    a = Tokenizer.from_file(path_a)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=path_b)


def groups_of(libraries, text):
    """The groups of a text, from the libraries' tokens of the whole text; None where a side doesn't give it back."""
    a, b = libraries
    alphabet = alignment.byte_symbols()
    body = f" {text}".encode()
    tokens_a = [(i, bytes(alphabet[c] for c in a.id_to_token(i))) for i in a.encode(f" {text}", add_special_tokens=False).ids]
    tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if not text or b"".join(x for _, x in tokens_a) != body or b"".join(x for _, x in tokens_b) != body:
        return None
    ends = []
    for tokens in (tokens_a, tokens_b):
        at, own = 0, []
        for _, x in tokens:
            at += len(x)
            own.append(at)
        ends.append(own)
    out, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        left, right = [], []
        while i < len(ends[0]) and ends[0][i] <= cut:
            left.append(tokens_a[i][0])
            i += 1
        while j < len(ends[1]) and ends[1][j] <= cut:
            right.append(tokens_b[j][0])
            j += 1
        out.append((left, right))
    return out


def expected(libraries, texts, ids=None):
    links, groups = [], [groups_of(libraries, t or "") for t in texts]
    for found in groups:
        links.append(Counter((x, y) for left, right in found or () for x in left for y in right))
    counts = Counter(p for c in links for p in c)
    best = defaultdict(int)
    for (x, _), n in counts.items():
        best[x] = max(best[x], n)
    out = []
    for k, (found, own) in enumerate(zip(groups, links)):
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in found or ())
        out.append((
            k if ids is None else ids[k], sum(len(x) for x, _ in found or ()), sum(len(y) for _, y in found or ()), len(found or ()), sum(own.values()),
            sum(n for p, n in own.items() if counts[p] == best[p[0]]), sum(n * counts[p] for p, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if found else "",
        ))
    return sorted(out, key=repr)


TRICKY = [
    "", " ", "  ", "a ", " a", "a  b", "a \n b\t\tc  ", "\n\n x", "x\x1c y", "  a 　b  c", "don't we'll  'tis", "▁ looks like a space", "a▁b",
    "<|endoftext|> <s> </s> <unk> <0x0A>", "aaaaaaaaaaaaaaaa" * 40, "=" * 500 + " " + "-" * 300, "ﬁ ﬀ Å Å é", "😀😀 👩‍👩‍👧 é", "\x00 \x7f", "12345 678 9", "漢字かな交じり文" * 9,
]


def test_equals_brute_force(make_docs, rows, odd_texts, libraries):
    texts = odd_texts + TRICKY
    found = alignment.align(make_docs(texts, parts=4))
    assert rows(found, *OUT) == expected(libraries, texts)


def test_lots_that_are_split(make_docs, rows, libraries):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["the", "cat", "straße", "naïve", "catalogue", "of", "xylo"]) + str(rng.randrange(30)) for _ in range(60)) for _ in range(40)]
    texts += ["the cat of the"] * 30
    assert rows(alignment.align(make_docs(texts, parts=20), group_bytes=64), *OUT) == expected(libraries, texts)


def test_blocks_slices_and_caches(libraries, monkeypatch):
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["".join(rng.choice(["ab", " ", "\n", "é", "x", "  "]) for _ in range(rng.randrange(400))) for _ in range(60)]
    monkeypatch.setattr(alignment, "SLICE", 7)
    monkeypatch.setattr(alignment, "CACHED", 20)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 500)
    monkeypatch.setattr(alignment, "WIDE_GROUP", 1)
    cache, column = alignment.Cache(alignment.sides(*alignment.default_paths())), pa.array(texts)
    got = []
    for first, last in alignment._blocks(column):
        figures, _ = alignment.block_rows(cache, column.slice(first, last - first))
        got += zip(*(figures[k] for k in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")))
    want = sorted(expected(libraries, texts), key=lambda x: x[0])
    assert got == [(x[1], x[2], x[3], x[4], x[7]) for x in want]
    assert all(" " + " ".join(p) == " " + t for t in texts for p in [[s for part in alignment.segments(t) for s in part]])


def test_repeated_ids_and_names_that_clash(make_docs, rows, libraries):
    texts, ids = ["one two"] * 5 + [None, "two"], [1, 1, 1, None, 2, 2, None]
    docs = make_docs(texts, ids=ids)
    for name in ("block", "lot", "place", "n_a", "pairs", "salt", "count_sum"):
        docs = docs.withColumn(name, F.lit("other"))
    assert rows(alignment.align(docs), *OUT) == expected(libraries, texts, ids)


def test_empty_table(make_docs):
    out = alignment.align(make_docs([]))
    assert out.collect() == [] and tuple(out.columns) == OUT


def test_a_side_that_strips_is_refused(tmp_path):
    import json

    path_a, path_b = alignment.default_paths()
    spec = json.load(open(path_a, encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        alignment.Sides(str(other), path_b)
