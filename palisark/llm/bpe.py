"""Byte-level BPE with a published vocabulary, by an index of pair occurrences.

All distinct pretokens of a piece of a partition lie in one symbol array. The index holds the positions of every
mergeable pair in that array, the lists of neighbouring ranks side by side. Active ranks are applied in ascending order,
each to all positions of its pair at once, and the lists of the pairs to the left and right of a merge are updated.

The lists aren't taken rank by rank, but by levels: a level is a run of consecutive ranks whose pairs hold no symbol that
one of them makes (about 120 levels for 50,000 merges). The result is the same: inside a level no merge can create an
occurrence of another of its ranks, so all its occurrences are known when it begins; where two of them share a symbol the
lower rank wins, then the left one, as if the ranks had come one after another.

Pretokens are distinct by their bytes: equal hashes are only a first guess, and the bytes behind them are compared.

Tokenizers are read from their published files, never trained.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb

PIECE_BYTES = 1 << 20
NONE = np.int32(2**31 - 1)
BLANK, SPACE, LETTER, NUMBER, OTHER = range(5)
#: The endings that the published pattern cuts off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: The code points with the Unicode property White_Space.
WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def default_vocabulary() -> str:
    """Where the public 50k byte-level vocabulary lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.cache
def code_point_classes() -> np.ndarray:
    """The class of each code point: white space (the blank apart), letter, number or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8)
    out[list(WHITE)] = SPACE
    out[0x20] = BLANK
    return out


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself, or one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges as sorted pair keys with rank and product, ids of bytes, bytes of ids, special tokens, levels of ranks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, to_byte = spec["model"]["vocab"], byte_symbols()
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        self.size = 1 + max([*ids.values(), *self.special.values()])
        self.byte_id = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.byte_id[b] = ids[c]
        pieces = [b""] * self.size
        for token, i in ids.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            pieces[i] = token
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        self.piece_size = sizes
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([ids[a] for a, _ in pairs], np.int64)
        right = np.array([ids[b] for _, b in pairs], np.int64)
        self.product = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = left * self.size + right
        self.rank_order = np.argsort(keys)
        self.keys = keys[self.rank_order]
        level, made, levels = 0, set(), []
        for a, b, c in zip(left.tolist(), right.tolist(), self.product.tolist()):
            if a in made or b in made:
                level, made = level + 1, set()
            made.add(c)
            levels.append(level)
        self.level = np.array([*levels, level + 1], np.int32)
        self.n_levels = level + 1

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it has no merge; a negative symbol is a pretoken's end."""
        key = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank_order[at], NONE).astype(np.int32)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def classes(body: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each byte's character, and which bytes begin a character."""
    table = code_point_classes()
    out = table[:128][np.minimum(body, 127)]
    leads = (body & 0xC0) != 0x80
    at = np.flatnonzero(body >= 0xC0)
    if len(at):
        b = body[np.minimum(at[:, None] + np.arange(4), len(body) - 1)].astype(np.int64)
        size = 2 + (b[:, 0] >= 0xE0) + (b[:, 0] >= 0xF0)
        rest = b[:, 1:] & 0x3F
        point = np.where(
            size == 2, (b[:, 0] & 0x1F) << 6 | rest[:, 0],
            np.where(size == 3, (b[:, 0] & 0x0F) << 12 | rest[:, 0] << 6 | rest[:, 1],
                     (b[:, 0] & 0x07) << 18 | rest[:, 0] << 12 | rest[:, 1] << 6 | rest[:, 2]),
        )
        kind = table[np.minimum(point, sys.maxunicode)]
        for k in range(4):
            own = (size > k) & (at + k < len(body))
            out[at[own] + k] = kind[own]
    return out, leads


def pretoken_starts(body: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where pretokens start. ``edges``: the first byte of each segment; no pretoken crosses one.

    The rule is that of the published pattern: a run of letters, numbers or other characters takes one blank before it
    along; white space before such a run leaves its last character to itself; contractions are cut off.
    """
    n = len(body)
    kind, leads = classes(body)
    run = np.maximum(kind, SPACE)  # blank and other white space are one kind of run
    edge = np.zeros(n, bool)
    edge[edges[edges < n]] = True
    begins = edge.copy()
    begins[1:] |= run[1:] != run[:-1]
    at = np.flatnonzero(begins)
    white = run[at] == SPACE
    start = np.zeros(n, bool)
    start[at[white]] = True
    words = at[~white]
    after_white = (words > 0) & ~edge[words] & (run[words - 1] == SPACE)
    last = words[after_white] - 1
    for _ in range(3):  # back to the first byte of the character
        last = np.where(leads[last], last, last - 1)
    start[last] = True
    start[words[~after_white]] = True
    start[words[after_white][body[last] != 0x20]] = True
    quote = np.flatnonzero(start & (body == 0x27))
    for ending in CONTRACTIONS:
        size = len(ending)
        here = quote[quote + size < n]
        for k, c in enumerate(ending.encode(), 1):
            here = here[(body[here + k] == c) & ~edge[here + k]]
        if len(here):
            start[here + 1] = False
            after = here + 1 + size
            start[after[after < n]] = True
            quote = np.setdiff1d(quote, here)
    return np.flatnonzero(start)


def merged(vocab: Vocabulary, body: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all given pretokens in turn, and how many each has."""
    words = len(start)
    room = size + 1  # each pretoken has its end behind it
    first = np.concatenate([[0], np.cumsum(room)])[:-1]
    total = int(room.sum())
    symbol = np.full(total + 1, -1, np.int32)
    symbol[tb.ranges(first, size)] = vocab.byte_id[body[tb.ranges(start, size)]]
    after = np.arange(1, total + 2, dtype=np.int32)
    before = np.arange(-1, total, dtype=np.int32)
    before[0] = total  # the last cell is nobody's: it ends everything
    rank = np.full(total + 1, NONE, np.int32)
    rank[:total] = vocab.rank(symbol[:-1], symbol[1:])
    index: list[list[np.ndarray]] = [[] for _ in range(vocab.n_levels)]

    def enter(at: np.ndarray) -> None:
        """Put positions into the lists of their pairs, sorted by level."""
        at = at[rank[at] != NONE]
        if not len(at):
            return
        level = vocab.level[rank[at]]
        order = np.argsort(level, kind="stable")
        at, level = at[order], level[order]
        cut = np.flatnonzero(np.diff(level)) + 1
        for part, k in zip(np.split(at, cut), level[np.concatenate([[0], cut])]):
            index[k].append(part)

    enter(np.arange(total))
    for k in range(vocab.n_levels):
        if not index[k]:
            continue
        at = np.unique(np.concatenate(index[k]))
        index[k] = []
        while len(at):
            at = at[vocab.level[np.minimum(rank[at], len(vocab.level) - 1)] == k]
            if not len(at):
                break
            own, left, right = rank[at], rank[before[at]], rank[np.minimum(after[at], total)]
            # Overlapping occurrences of one pair form a chain: its first, third, ... are merged.
            linked = np.zeros(len(at), bool)
            linked[1:] = (before[at[1:]] == at[:-1]) & (own[1:] == own[:-1])
            head = np.flatnonzero(~linked)
            chain = np.cumsum(~linked) - 1
            place = np.arange(len(at)) - head[chain]
            wins = (own < left)[head][chain] & (place % 2 == 0) & (own <= right)
            p = at[wins]
            q = after[p]
            symbol[p] = vocab.product[rank[p]]
            symbol[q] = -2
            rank[q] = NONE
            r = after[q]
            after[p] = r
            before[r] = p
            touched = np.unique(np.concatenate([p, before[p]]))
            touched = touched[symbol[touched] >= 0]
            rank[touched] = vocab.rank(symbol[touched], symbol[after[touched]])
            enter(touched)
            at = np.setdiff1d(at, p, assume_unique=True)
            if index[k]:  # a level's merges make no pairs of the level; what comes back is an occurrence seen anew
                at = np.unique(np.concatenate([at, *index[k]]))
                index[k] = []
    alive = symbol[:total] >= 0
    counts = np.add.reduceat(np.concatenate([alive, [False]]).astype(np.int64), first) if words else np.zeros(0, np.int64)
    return symbol[:total][alive], counts


def distinct(body: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: Callable = tb.word_hash) -> tuple[np.ndarray, np.ndarray]:
    """The first of each group of spans with equal bytes, and the group of each span.

    ``hashes`` must be one to one on spans of up to eight bytes; longer ones of equal hash are compared byte by byte.
    """
    _, first, which = np.unique(hashes(body, start, end), return_index=True, return_inverse=True)
    size, model = end - start, first[which]
    long = np.flatnonzero((size > 8) | (size[model] > 8))
    same = np.array_equal(size[long], size[model[long]])
    if same and np.array_equal(body[tb.ranges(start[long], size[long])], body[tb.ranges(start[model[long]], size[long])]):
        return first, which
    # Spans collide (2**-64 for two of them): group by the bytes themselves.
    known: dict[bytes, int] = {}
    which = np.array([known.setdefault(body[a:b].tobytes(), len(known)) for a, b in zip(start.tolist(), end.tolist())], np.int64)
    return np.unique(which, return_index=True)[1], which


def encode_piece(vocab: Vocabulary, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all documents in turn, and the offset of each document's first id."""
    edges, fixed = offsets[:-1], {}
    if len(body):
        raw = body.tobytes()
        for token, i in vocab.special.items():
            p = raw.find(token)
            while p >= 0:
                doc = int(np.searchsorted(offsets, p, "right")) - 1
                if p + len(token) <= offsets[doc + 1]:
                    fixed[p] = (p + len(token), i)
                    p = raw.find(token, p + len(token))
                else:
                    p = raw.find(token, p + 1)
        if fixed:
            edges = np.unique(np.concatenate([edges, list(fixed), [e for e, _ in fixed.values()]]))
    if not len(body):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    start = pretoken_starts(body, edges)
    if fixed:
        inside = np.zeros(len(body), bool)
        for p, (e, _) in fixed.items():
            inside[p + 1 : e] = True
        start = start[~inside[start]]
    end = np.append(start[1:], len(body))
    size = end - start
    first, which = distinct(body, start, end)
    pool, counts = merged(vocab, body, start[first], size[first])
    pool_at = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = counts[which]
    ids = pool[tb.ranges(pool_at[which], n)].astype(np.uint32)
    token_at = np.concatenate([[0], np.cumsum(n)])
    if fixed:
        # The pretoken that a special token's text made is replaced by its one id.
        keep, put = np.ones(len(ids), bool), {}
        for p, (_, i) in fixed.items():
            k = int(np.searchsorted(start, p))
            keep[token_at[k] + 1 : token_at[k + 1]] = False
            put[int(token_at[k])] = i
        for at, i in put.items():
            ids[at] = i
        shift = np.concatenate([[0], np.cumsum(keep)])
        ids, token_at = ids[keep], shift[token_at]
    return ids, token_at[np.searchsorted(start, offsets)]


def decode_piece(vocab: Vocabulary, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all documents in turn, and their offsets."""
    size = vocab.piece_size[ids]
    body = vocab.piece_bytes[tb.ranges(vocab.piece_at[ids], size)]
    return body, np.concatenate([[0], np.cumsum(size)])[offsets]


def pieces(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    body, offsets = tb.utf8(column)
    for a, b in tb.chunks(offsets, PIECE_BYTES):
        yield body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _sent(docs: DataFrame, path: str | None) -> str:
    """The vocabulary's path on the driver; the file is sent to the executors, which needn't have it there."""
    path = path or default_vocabulary()
    docs.sparkSession.sparkContext.addFile(path)
    return path


def _local(path: str) -> str:
    """The vocabulary as a task finds it: the file that the driver has added."""
    return SparkFiles.get(os.path.basename(path))


def _refuse(docs: DataFrame, name: str) -> None:
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"there is a column {name} already")


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array of int) for the whole text; null and empty texts have no ids.

    ``path``: a byte-level BPE file in the JSON form of the tokenizers library; default: the public 50k vocabulary. Its
    special tokens are recognised in texts. Other columns go through unchanged; if ``ids_col`` is one of them, it is a
    ValueError. Repeated rows are encoded each; an empty table gives an empty result.
    """
    _refuse(docs, ids_col)
    path = _sent(docs, path)
    docs = docs.withColumn(ids_col, F.lit(None).cast("array<int>"))
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_local(path))
        for x in batches:
            parts, at, base = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
            for body, offsets in pieces(x.column(where)):
                ids, ends = encode_piece(vocab, body, offsets)
                parts.append(ids)
                at.append(ends[1:] + base)
                base += len(ids)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(parts).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], lists], names=x.schema.names)

    return docs.mapInArrow(run, docs.schema)


def decode(docs: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``docs`` with the text that a column of ids stands for; ids cut inside a character give U+FFFD.

    Null ids give an empty text. A column ``text_col`` that is there already is a ValueError.
    """
    _refuse(docs, text_col)
    path = _sent(docs, path)
    docs = docs.withColumn(text_col, F.lit(None).cast("string"))
    where = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_local(path))
        for x in batches:
            out = []
            for ids in x.column(where):
                ids = np.asarray(ids.values.to_numpy() if ids.is_valid else [], np.int64)
                out.append(decode_piece(vocab, ids, np.array([0, len(ids)]))[0].tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*x.columns[:-1], pa.array(out, pa.string())], names=x.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256 (see the contract of the query).

    Encodes and decodes the whole text in the task that reads it: only digests leave it. Null counts as empty; an empty
    text has no tokens and the digests of no bytes; an empty table gives an empty result. No row depends on another, so
    repeated rows and ids have a row each. Further columns, whatever their names, play no part.
    """
    path = _sent(docs, path)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(_local(path))
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for x in batches:
            n, ids_sha, text_sha = [], [], []
            for body, offsets in pieces(x.column(1)):
                ids, ends = encode_piece(vocab, body, offsets)
                text, text_at = decode_piece(vocab, ids, ends)
                n.append(np.diff(ends))
                little = ids.astype("<u4")
                ids_sha += [sha(little[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                # What isn't UTF-8 decodes to replacement characters, as for anyone who decodes ids to a string.
                text_sha += [sha(text[a:b].tobytes().decode("utf-8", "replace").encode()) for a, b in zip(text_at[:-1], text_at[1:])]
            count = np.concatenate([np.zeros(0, np.int64), *n])
            yield pa.RecordBatch.from_arrays(
                [x.column(0), pa.array(count), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
