"""Alignment of two tokenizers over a corpus by a cogroup of postings.

Where a token of A and a token of B end at the same byte of a document, the text is cut; what lies between two cuts is a
group, and each A token of a group is linked with each of its B tokens. A posting says how often a document links a pair
of ids. Postings are shuffled by the A id (in ``SIDES`` lots of ids, split further by origin until a lot is small enough),
each as a stream sorted by pair and document; the number of documents of each pair is added up along the same keys, and
its largest value for each A id is known where all pairs of that id are together, which the vocabularies bound. The two
streams meet in a cogroup, which gives what each document gets from each lot, and that is added up by document.

Tokens are made once for each distinct segment of a task's cache: texts are cut before a space that follows a character
that isn't white space. Neither tokenizer has a token across such a place (A splits words there; no piece of B has its
space mark anywhere but in front, which is checked), so the segments' tokens in turn are those of the text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.llm.bpe import byte_symbols
from palisark.session import written

#: Lots into which the ids of side A are dealt.
SIDES = 32
#: Documents of a block at most, and bytes of text from which a block is full.
BLOCK_DOCS = 4096
BLOCK_BYTES = 4 << 20
#: Bytes of postings that a task gathers in one group, about; what a lot has beyond them is split by origin.
GROUP_BYTES = 16 << 20
#: Segments that a task's cache keeps from block to block.
CACHED = 200_000
#: Characters of a long text that are cut into segments at a time.
SLICE = 1 << 20
#: Groups with more links than this are counted by distinct ids.
WIDE_GROUP = 1024
MARK = "▁"
COMMA, BAR, SEMICOLON = b",|;"


def default_paths() -> tuple[str, str]:
    """Where the public vocabularies of the sides A and B lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(size) - size, size


class Sides:
    """Both tokenizers, with the bytes of each id's token."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError("side A must be byte-level BPE that splits words itself and normalises nothing")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        to_byte, special = byte_symbols(), {t["content"] for t in spec["added_tokens"]}
        pieces = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            pieces[i] = token.encode() if token in special else bytes(to_byte[c] for c in token)
        self.bytes_a = _table(pieces)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in x.lstrip(MARK) for x in names) or self.b.encode("a ")[-1:] != [self.b.piece_to_id(MARK)]:
            raise ValueError("side B must keep all spaces, and have its space mark at the start of pieces only")
        self.space = self.b.piece_to_id(MARK)
        self.bytes_b = _table([bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(names)])
        self.n_a, self.n_b = len(pieces), len(names)
        self.digits = _table([str(i).encode() for i in range(max(self.n_a, self.n_b))])

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """The ids of both sides of each segment, which is given without the space before it."""
        a = [e.ids for e in self.a.encode_batch([f" {p}" for p in segments], add_special_tokens=False)]
        return a, [ids or [self.space] for ids in self.b.encode(segments, num_threads=1)]


@functools.cache
def sides(path_a: str, path_b: str) -> Sides:
    return Sides(path_a, path_b)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


def _joined(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    body, at, size = table
    return body[tb.ranges(at[ids], size[ids])], size[ids]


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The sum of each run of n[i] values."""
    total = np.concatenate([[0], np.cumsum(values)])
    end = np.cumsum(n)
    return total[end] - total[end - n]


class Aligned:
    """What distinct segments have: fit (both sides give back its bytes), numbers of tokens, groups and links, groups as
    text, and pairs (a * n_b + b) with how often they are linked."""

    def __init__(self, sides: Sides, segments: list[str]):
        lists_a, lists_b = sides.encode(segments)
        a, n_a = _flat(lists_a)
        b, n_b = _flat(lists_b)
        raw = [f" {p}".encode() for p in segments]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.fit = np.ones(len(segments), bool)
        for ids, n, table in ((a, n_a, sides.bytes_a), (b, n_b, sides.bytes_b)):
            body, own = _joined(ids, table)
            self.fit &= _sums(own, n) == size
            if len(body) != size.sum() or not np.array_equal(body, np.frombuffer(b"".join(raw), np.uint8)):
                end = np.cumsum(_sums(own, n))
                self.fit &= [body[e - k : e].tobytes() == r if k == len(r) else False for e, k, r in zip(end, _sums(own, n), raw)]
        a, b = a[np.repeat(self.fit, n_a)], b[np.repeat(self.fit, n_b)]
        n_a, n_b, size = n_a * self.fit, n_b * self.fit, size * self.fit
        end_a, end_b = np.cumsum(sides.bytes_a[2][a]), np.cumsum(sides.bytes_b[2][b])
        marked = np.zeros(int(size.sum()) + 1, bool)
        marked[end_b] = True
        cuts = end_a[marked[end_a]]
        in_a, in_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        count_a, count_b = np.bincount(in_a, minlength=len(cuts)), np.bincount(in_b, minlength=len(cuts))
        home = np.searchsorted(np.cumsum(size), cuts)  # the segment of each group
        links = count_a * count_b
        self.n_a, self.n_b = n_a, n_b
        self.n_groups = np.bincount(home, minlength=len(segments))
        self.n_links = _sums(links, self.n_groups)
        self._pairs(sides, a, b, count_a, count_b, links, home, len(segments))
        self._texts(sides, a, b, in_a, in_b, count_a, count_b)

    def _pairs(self, sides: Sides, a, b, count_a, count_b, links, home, n) -> None:
        first_a, first_b = np.cumsum(count_a) - count_a, np.cumsum(count_b) - count_b
        plain = np.flatnonzero(links <= WIDE_GROUP)
        own_a = tb.ranges(first_a[plain], count_a[plain])  # tokens of A, each with all tokens of B of its group
        times = np.repeat(count_b[plain], count_a[plain])
        at_b = tb.ranges(np.repeat(first_b[plain], count_a[plain]), times)
        pair = np.repeat(a[own_a] * sides.n_b, times) + b[at_b]
        segment, weight = np.repeat(home[plain], links[plain]), np.ones(len(pair), np.int64)
        parts = [(segment, pair, weight)]
        for g in np.flatnonzero(links > WIDE_GROUP):
            x, n_x = np.unique(a[first_a[g] : first_a[g] + count_a[g]], return_counts=True)
            y, n_y = np.unique(b[first_b[g] : first_b[g] + count_b[g]], return_counts=True)
            parts.append((np.full(len(x) * len(y), home[g]), (x[:, None] * sides.n_b + y).ravel(), np.outer(n_x, n_y).ravel()))
        segment, pair, weight = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((pair, segment))
        segment, pair, weight = segment[order], pair[order], weight[order]
        new = np.ones(len(pair), bool)
        new[1:] = (segment[1:] != segment[:-1]) | (pair[1:] != pair[:-1])
        self.pair = pair[new]
        self.times = np.add.reduceat(weight, np.flatnonzero(new)) if len(pair) else weight
        self.n_pairs = np.bincount(segment[new], minlength=n)

    def _texts(self, sides: Sides, a, b, in_a, in_b, count_a, count_b) -> None:
        ids, end = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), COMMA, np.uint8)
        upto_a, upto_b = np.cumsum(count_a), np.cumsum(count_b)
        ids[np.arange(len(a)) + (upto_b - count_b)[in_a]] = a
        ids[np.arange(len(b)) + upto_a[in_b]] = b
        end[upto_a + upto_b - count_b - 1] = BAR
        end[upto_a + upto_b - 1] = SEMICOLON
        body, at, size = sides.digits
        room = size[ids] + 1
        start = np.cumsum(room) - room
        out = np.empty(int(room.sum()), np.uint8)
        out[tb.ranges(start, room - 1)] = body[tb.ranges(at[ids], room - 1)]
        out[start + room - 1] = end
        out, long = out.tobytes(), np.cumsum(_sums(room, self.n_a + self.n_b)).tolist()
        self.text = [out[x : max(x, y - 1)] for x, y in zip([0, *long], long)]


def segments(text: str) -> Iterator[list[str]]:
    """The segments of a text, each without the space before it (the first has one, too), some thousands at a time."""
    at = 0
    while True:
        cut = at + SLICE
        while (cut := text.find(" ", cut)) >= 0 and text[cut - 1].isspace():
            cut += 1
        parts = (text[at:cut] if cut >= 0 else text[at:]).split(" ")
        if any(not p or p[-1].isspace() for p in parts[:-1]):
            held, whole = "", []
            for p in parts[:-1]:
                held += p
                if not held or held[-1].isspace():
                    held += " "
                else:
                    whole.append(held)
                    held = ""
            parts = [*whole, held + parts[-1]]
        yield parts
        if cut < 0:
            return
        at = cut + 1


class Cache:
    """Segments by number, with their alignments as columns; emptied between blocks when it has grown large."""

    def __init__(self, sides: Sides):
        self.sides = sides
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.text: list[bytes] = []
        self.columns = {k: np.zeros(0, np.int64) for k in ("fit", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "pair", "times")}

    def numbers(self, parts: list[str]) -> np.ndarray:
        known, out = self.number, []
        for p in parts:
            i = known.get(p)
            if i is None:
                i = known[p] = len(known)
                self.new.append(p)
            out.append(i)
        return np.array(out, np.int64)

    def align(self) -> None:
        """Aligns the segments that are new."""
        if self.new:
            made = Aligned(self.sides, self.new)
            self.text += made.text
            for k, old in self.columns.items():
                self.columns[k] = np.concatenate([old, getattr(made, k).astype(np.int64)])
            self.pair_at = np.cumsum(self.columns["n_pairs"]) - self.columns["n_pairs"]
            self.new = []


def _blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
    _, offsets = tb.utf8(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
        last = min(max(first + 1, last), first + BLOCK_DOCS, len(column))
        yield first, last
        first = last


def block_rows(cache: Cache, texts: pa.Array) -> tuple[dict[str, list], list[tuple]]:
    """Of a block of documents: columns of their own figures, and (lot, pairs, documents of each, documents, times) for each
    lot that has postings; pairs ascend, documents of a pair ascend."""
    if len(cache.number) > CACHED:
        cache.clear()
    docs: list[np.ndarray] = []
    for x in texts:
        text = x.as_py()
        parts = [cache.numbers(p) for p in segments(text)] if text else []
        docs.append(np.concatenate(parts) if parts else np.zeros(0, np.int64))
    cache.align()
    col, text = cache.columns, cache.text
    fit = [bool(col["fit"][d].all()) for d in docs]
    docs = [d if ok else d[:0] for d, ok in zip(docs, fit)]
    figures: dict[str, list] = {k: [int(col[k][d].sum()) for d in docs] for k in ("n_a", "n_b", "n_groups", "n_links")}
    figures["groups_sha256"] = []
    for d in docs:
        sha = hashlib.sha256()
        for k in range(0, len(d), 1 << 16):
            sha.update((b";" if k else b"") + b";".join([text[i] for i in d[k : k + (1 << 16)].tolist()]))
        figures["groups_sha256"].append(sha.hexdigest() if len(d) else "")
    found = [(np.full(len(u), i, np.int64), u, n) for i, d in enumerate(docs) for u, n in [np.unique(d, return_counts=True)] if len(u)]
    if not found:
        return figures, []
    doc, segment, times = (np.concatenate(x) for x in zip(*found))
    many = col["n_pairs"][segment]
    at = tb.ranges(cache.pair_at[segment], many)
    pair, weight, doc = col["pair"][at], col["times"][at] * np.repeat(times, many), np.repeat(doc, many)
    lot = pair // cache.sides.n_b % SIDES
    key = (lot * (cache.sides.n_a * cache.sides.n_b) + pair) * BLOCK_DOCS + doc
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[new], np.add.reduceat(weight, new)
    doc, pair = key % BLOCK_DOCS, key // BLOCK_DOCS
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    lots, pair = np.divmod(pair[first], cache.sides.n_a * cache.sides.n_b)
    ends = np.append(first[1:], len(doc))
    out = []
    for k in np.unique(lots).tolist():
        x, y = np.searchsorted(lots, [k, k + 1])
        out.append((k, pair[x:y], ends[x:y] - first[x:y], doc[first[x] : ends[y - 1]], weight[first[x] : ends[y - 1]]))
    return figures, out


_FIGURES = "place int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_POSTINGS = "lot int, n_bytes long, pairs binary, per_pair binary, docs binary, times binary, wide boolean"


def _local(path: str) -> str:
    """A vocabulary as a task finds it: the file that the driver added, else the path itself."""
    added = SparkFiles.get(os.path.basename(path))
    return added if os.path.exists(added) else path


def postings(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Rows of two kinds: the figures of a document (lot is null), and the postings of a block for a lot."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    kind = pa.schema([
        ("block", pa.int64()), ("place", pa.int32()), *((k, pa.int64()) for k in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string()),
        ("lot", pa.int32()), ("n_bytes", pa.int64()), *((k, pa.binary()) for k in ("pairs", "per_pair", "docs", "times")), ("wide", pa.bool_()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, block = Cache(sides(_local(path_a), _local(path_b))), TaskContext.get().partitionId() << 32
        for x in batches:
            for first, last in _blocks(x.column(1)):
                figures, lots = block_rows(cache, x.column(1).slice(first, last - first))
                n, rows = last - first, []
                for k, pair, per_pair, doc, times in lots:
                    wide = bool(times.max() > 255)
                    blobs = pair.astype("<i8"), per_pair.astype("<u2"), doc.astype("<u2"), times.astype("<i8" if wide else "u1")
                    rows.append((k, sum(b.nbytes for b in blobs), *(b.tobytes() for b in blobs), wide))
                columns = dict(zip(("lot", "n_bytes", "pairs", "per_pair", "docs", "times", "wide"), zip(*rows)))
                columns = {"block": [block] * (n + len(rows)), "place": list(range(n)) + [None] * len(rows)}
                columns |= {k: [*v, *[None] * len(rows)] for k, v in figures.items()}
                for i, k in enumerate(("lot", "n_bytes", "pairs", "per_pair", "docs", "times", "wide")):
                    columns[k] = [None] * n + [r[i] for r in rows]
                arrays = [pa.array(columns[f.name], f.type) for f in kind]
                ids = pa.concat_arrays([x.column(0).slice(first, n), pa.nulls(len(rows), x.column(0).type)])
                yield pa.RecordBatch.from_arrays([ids, *arrays], names=["doc_id", *kind.names])
                block += 1

    return docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, f"doc_id {id_type}, block long, {_FIGURES}, {_POSTINGS}")


def _blob(x: pa.Scalar, kind: str) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), kind)


def _counted(rows: pa.Table) -> pa.Table:
    """The counts of all rows of a lot, added up by pair."""
    wide = "n_rows" not in rows.column_names
    pair = np.concatenate([_blob(x, "<i8") for x in rows.column("pairs")])
    n = np.concatenate([_blob(x, "<u2" if wide else "<i8").astype(np.int64) for x in rows.column("per_pair")])
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
    out = {"lot": pa.array([rows.column("lot")[0].as_py()], pa.int32()), "salt": pa.array([rows.column("salt")[0].as_py()], pa.int64())}
    return pa.table(out | {"pairs": [pair[new].tobytes()], "per_pair": [np.add.reduceat(n, new).astype("<i8").tobytes()], "n_rows": [len(rows)]})


def counts(rows: DataFrame, salts: int, fan_in: int = 16) -> DataFrame:
    """A row for each lot: its pairs in order, and in how many documents each is linked; added up in rounds of ``fan_in``.

    Its size is bounded by the vocabularies: a lot has no more pairs than there are ids of B for its ids of A.
    """
    kind = "lot int, salt long, pairs binary, per_pair binary, n_rows long"
    level = rows.select("lot", "salt", "pairs", "per_pair").groupBy("lot", "salt").applyInArrow(_counted, kind)
    while salts > 1:
        level = level.withColumn("salt", F.floor(F.col("salt") / fan_in)).groupBy("lot", "salt").applyInArrow(_counted, kind)
        salts = -(-salts // fan_in)
    return level.select("lot", F.col("pairs").alias("all_pairs"), F.col("per_pair").alias("all_counts"))


def _contributions(n_b: int):
    def meet(rows: pa.Table, known: pa.Table) -> pa.Table:
        sums: dict[int, np.ndarray] = {}
        if len(rows):
            pairs, n = _blob(known.column("all_pairs")[0], "<i8"), _blob(known.column("all_counts")[0], "<i8")
            own = pairs // n_b
            first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            most = np.repeat(np.maximum.reduceat(n, first), np.diff(np.append(first, len(n))))
            best = (n == most).astype(np.int64)
        for r in rows.to_batches():
            for block, pair, per_pair, docs, times, wide in zip(*(r.column(c) for c in ("block", "pairs", "per_pair", "docs", "times", "wide"))):
                at = np.searchsorted(pairs, _blob(pair, "<i8"))
                at = np.repeat(at, _blob(per_pair, "<u2"))
                docs, times = _blob(docs, "<u2").astype(np.int64), _blob(times, "<i8" if wide.as_py() else "u1").astype(np.int64)
                got = sums.setdefault(block.as_py(), np.zeros((2, BLOCK_DOCS), np.int64))
                np.add.at(got[0], docs, times * n[at])
                np.add.at(got[1], docs, times * best[at])
        out: dict[str, list] = {"block": [], "docs": [], "count_sums": [], "bests": []}
        for block, got in sums.items():
            docs = np.flatnonzero(got[0])
            out["block"].append(block)
            out["docs"].append(docs.astype("<u2").tobytes())
            out["count_sums"].append(got[0][docs].astype("<i8").tobytes())
            out["bests"].append(got[1][docs].astype("<i8").tobytes())
        return pa.table({k: pa.array(v, pa.int64() if k == "block" else pa.binary()) for k, v in out.items()})

    return meet


def _summed(figures: pa.Table, parts: pa.Table) -> pa.Table:
    """The figures of a block's documents with the sums of what each lot contributed."""
    sums = np.zeros((2, BLOCK_DOCS), np.int64)
    for docs, count_sums, bests in zip(*(parts.column(c) for c in ("docs", "count_sums", "bests"))):
        docs = _blob(docs, "<u2").astype(np.int64)
        sums[0][docs] += _blob(count_sums, "<i8")
        sums[1][docs] += _blob(bests, "<i8")
    place = figures.column("place").to_numpy()
    out = figures.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for name, x in (("n_best", sums[1]), ("count_sum", sums[0])):
        out = out.append_column(name, pa.array(x[place], pa.int64()))
    return out.append_column("groups_sha256", figures.column("groups_sha256"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 (see the contract of the query).

    ``path_a``: a byte-level BPE file of the tokenizers library, ``path_b``: a SentencePiece BPE model; default: the public
    vocabularies. Both are sent to the executors. Texts are encoded whole and without special tokens, those of side A behind
    a space. A null or empty text, and one that a side doesn't give back byte by byte (such as one with U+2581), has no
    tokens: zeros, '' as digest, and no part in any count. Documents with equal texts or ids, and repeated rows, count
    each. Of pairs whose counts tie as the highest of an A id, all are best. An empty table gives an empty result. Columns
    other than doc_id and text play no part, whatever their names.
    """
    default_a, default_b = (None, None) if path_a and path_b else default_paths()
    path_a, path_b = path_a or default_a, path_b or default_b
    for path in (path_a, path_b):
        docs.sparkSession.sparkContext.addFile(path)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = sides(path_a, path_b)
    if both.n_a * both.n_b * SIDES * BLOCK_DOCS >= 2**63:
        raise ValueError("the vocabularies are too large for pairs in 64 bits")
    made = written(postings(docs, path_a, path_b), "postings")
    origin = F.shiftrightunsigned("block", 32)
    rows = made.where(F.col("lot").isNotNull())
    held = rows.groupBy("lot", origin.alias("origin")).agg(F.sum("n_bytes").alias("n_bytes")).agg(F.max("n_bytes"), F.max("origin")).first()
    most, origins = held[0] or 0, (held[1] or 0) + 1
    together, apart = max(1, group_bytes // max(most, 1)), max(1, -(-most // group_bytes))
    rows = rows.withColumn("salt", F.floor(origin / together) * apart + F.col("block") % apart)
    salts = -(-origins // together) * apart
    known = counts(rows, salts).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    parts = rows.groupBy("lot", "salt").cogroup(known.groupBy("lot", "salt")).applyInArrow(
        _contributions(both.n_b), "block long, docs binary, count_sums binary, bests binary"
    )
    figures = made.where(F.col("lot").isNull()).select("block", "place", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    return figures.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(
        _summed, f"doc_id {id_type}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    )
