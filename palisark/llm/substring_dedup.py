"""Removal of repeated substrings with suffix arrays, exact for every string of WINDOW bytes.

A suffix array of a whole corpus would move every suffix. Here only text that can repeat moves:

1. Every WINDOW-byte string has an anchor, the smallest hash among its GRAM-byte substrings, so equal strings meet at
   equal anchors. Each anchor with its surroundings (every window that may have it as anchor lies in them) is a segment;
   (anchor, hash of the segment, document) is sent to the anchor's bucket, copies within a batch only once. Two hashes
   go with it, of the anchor and the HALF bytes before it, and of the anchor and the HALF bytes behind it.
2. A bucket answers: documents whose segment a smaller document has are done there, all of the segment goes. Different
   segments of an anchor that share a WINDOW-byte string share the anchor's bytes and HALF bytes on one side of it. Where
   documents share such a half, the smallest document of each segment with it sends its text. An anchor alone decides
   nothing: in a large corpus nearly every GRAM bytes stand somewhere else too, and nearly all text would move.
3. A bucket builds the suffix array of the segments it gets by two-stage sorting: suffixes smaller than their successor
   are sorted directly, the others follow by a scan of the buckets of first bytes; then common prefixes of neighbours.
   Runs of neighbours that share WINDOW bytes are one string; all but the smallest document remove it.

An anchor with very many different segments (the edge of a passage that a third of all documents have) is split by the
content of its windows, so no bucket holds an unbounded group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import written

WINDOW = 50
GRAM = 16
#: Of the WINDOW - GRAM bytes of a window that aren't its anchor, the longer side has so many at least.
HALF = -(-(WINDOW - GRAM) // 2)
#: Bytes of text behind one bucket, the least number of buckets, and buckets of texts for each one of anchors.
BUCKET_BYTES = 16 << 20
TEXT_BUCKETS = 3
MIN_BUCKETS = 64
#: An anchor with more different segments than this is split by the content of its windows.
HOT_SEGMENTS = 20_000
PIECE_BYTES = 2 << 20
#: Bytes whose anchors are sought at once: eight bytes for each of them stay in a core's cache.
CACHE_BYTES = 128 << 10
NO_ID = np.int64(2**63 - 1)
FLAG, NEED, HOT = 0, 1, 2
_LOW = np.uint64(0xFFFFFFFF)
_U = np.uint64


def anchors(body: np.ndarray, offsets: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each anchor: place, document, start and end of its segment, hash g of the gram, 48-bit hash of the segment,
    32-bit hashes of the gram with what is left and right of it (0: the document has too little there)."""
    parts = []
    for a, b in tb.chunks(offsets, CACHE_BYTES):
        f = _anchors(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], window, gram)
        parts.append(f | {"at": f["at"] + offsets[a], "doc": f["doc"] + a, "start": f["start"] + offsets[a], "end": f["end"] + offsets[a]})
    return {k: np.concatenate([f[k] for f in parts]) for k in parts[0]} if parts else _anchors(body, offsets, window, gram)


def _anchors(body: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray]:
    n, width, half = len(body) - gram + 1, window - gram + 1, -(-(window - gram) // 2)
    if len(body) < window:
        z = np.zeros(0, np.int64)
        return {"at": z, "doc": z, "start": z, "end": z, "g": z.astype(_U), "segment": z.astype(_U), "left": z.astype(np.uint32), "right": z.astype(np.uint32)}
    prefix = tb.prefix_hash(body)
    _, down = tb.powers(len(prefix))
    h = tb.mixed((prefix[gram:] - prefix[:-gram]) * down[:n])
    least = (h & ~_LOW) | np.arange(n, dtype=_U)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    doc_of = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    whole = doc_of[: len(least)] == doc_of[window - 1 :]
    at = (least[whole] & _LOW).astype(np.int64)
    at = at[np.flatnonzero(np.diff(at, prepend=-1))]
    doc = doc_of[at].astype(np.int64)
    start = np.maximum(offsets[doc], at - (window - gram))
    end = np.minimum(offsets[doc + 1], at + window)
    shape = ((at - start) * 256 + (end - start)).astype(_U)
    segment = tb.mixed(tb.span_hash(prefix, start, end) + tb.mixed(shape)) >> _U(16)
    side = lambda p, q: np.maximum(tb.mixed(tb.span_hash(prefix, p, q)) >> _U(32), _U(1))
    left = np.where(at - half >= start, side(np.maximum(at - half, start), at + gram), _U(0)).astype(np.uint32)
    right = np.where(at + gram + half <= end, side(at, np.minimum(at + gram + half, end)), _U(0)).astype(np.uint32)
    return {"at": at, "doc": doc, "start": start, "end": end, "g": tb.mixed(h[at] ^ _U(0xA5A5A5A5A5A5A5A5)), "segment": segment, "left": left, "right": right}


def _six(x: np.ndarray) -> bytes:
    """48-bit numbers in six bytes each."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(data: bytes | memoryview) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel().astype(_U)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts in sorted keys."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


def _in_order(*keys: np.ndarray) -> np.ndarray:
    """The order by the first key, then the next ones: most first keys stand alone, only ties are sorted further."""
    order = np.argsort(keys[0])
    tied = np.zeros(len(order), bool)
    head = keys[0][order]
    tied[1:] = head[1:] == head[:-1]
    tied[:-1] |= tied[1:]
    t = order[tied]
    order[tied] = t[np.lexsort([k[t] for k in keys[::-1]])]
    return order


def _by(groups: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(groups, kind="stable")
    first = _runs(groups[order])
    for part in np.split(order, first[1:]):
        if len(part):
            yield int(groups[part[0]]), part


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def _home(ids: np.ndarray, homes: int) -> np.ndarray:
    return (tb.mixed(ids.view(_U)) % _U(homes)).astype(np.int64)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


SENT = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("which", pa.binary()), ("g", pa.binary()), ("segments", pa.binary()), ("left", pa.binary()), ("right", pa.binary())])
SENT_SQL = "bucket long, ids binary, which binary, g binary, segments binary, left binary, right binary"
ANSWER = pa.schema([("home", pa.int64()), ("kind", pa.int32()), ("ids", pa.binary()), ("segments", pa.binary()), ("masks", pa.binary())])
ANSWER_SQL = "home long, kind int, ids binary, segments binary, masks binary"
TEXTS = pa.schema([("bucket", pa.int64()), ("ids", pa.binary()), ("segments", pa.binary()), ("first", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary())])
TEXTS_SQL = "bucket long, ids binary, segments binary, first binary, sizes binary, data binary"


def send_anchors(buckets: int):
    """Step 1, on batches of (doc_id, text). Buckets from ``buckets`` on carry what a batch has decided itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = _ids(x.column(0))
            body, offsets = tb.utf8(x.column(1))
            f = anchors(body, offsets)
            order = _in_order(f["g"], f["segment"], ids[f["doc"]])
            g, segment, doc, left, right = (f[k][order] for k in ("g", "segment", "doc", "left", "right"))
            if not len(g):
                continue
            first = _runs(g, segment)
            least = np.repeat(ids[doc[first]], np.diff(np.append(first, len(g))))
            known = ids[doc] > least
            again = np.zeros(len(g), bool)  # the same document once more
            again[1:] = (ids[doc[1:]] == ids[doc[:-1]]) & (segment[1:] == segment[:-1]) & (g[1:] == g[:-1])
            send = np.zeros(len(g), bool)
            send[first] = True
            bucket = np.where(send, (g % _U(buckets)).astype(np.int64), buckets + (doc % buckets))
            take = np.flatnonzero(send | (known & ~again))
            rows = []
            for k, part in _by(bucket[take]):
                part = take[part]
                own, which = np.unique(doc[part], return_inverse=True)
                kind = np.uint16 if len(own) < 1 << 16 else np.uint32
                rows.append({
                    "bucket": k, "ids": ids[own].tobytes(), "which": which.astype(kind).tobytes(),
                    "g": (g[part] >> _U(32)).astype(np.uint32).tobytes(), "segments": _six(segment[part]),
                    "left": left[part].tobytes() if k < buckets else b"", "right": right[part].tobytes() if k < buckets else b"",
                })
            yield _batch(rows, SENT)

    return run


def _shared(g: np.ndarray, half: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which segments have a half of an anchor (0: none) that is in several documents."""
    out = np.zeros(len(g), bool)
    own = np.flatnonzero(half)
    key = g[own].astype(_U) << _U(32) | half[own]
    order = np.argsort(key)
    own = own[order]
    first = _runs(key[order])
    if len(first):
        several = np.minimum.reduceat(ids[own], first) != np.maximum.reduceat(ids[own], first)
        out[own] = np.repeat(several, np.diff(np.append(first, len(own))))
    return out


def _answers(kind: int, ids: np.ndarray, segments: np.ndarray, homes: int, masks: np.ndarray | None = None) -> list[dict]:
    rows = []
    for home, part in _by(_home(ids, homes)):
        part = part[np.argsort(ids[part], kind="stable")]
        row = {"home": home, "kind": kind, "ids": ids[part].tobytes(), "segments": _six(segments[part])}
        rows.append(row | {"masks": None if masks is None else masks[part].tobytes()})
    return rows


def answer_anchors(buckets: int, homes: int):
    """Step 2, on all that a bucket was sent."""

    def run(x: pa.Table) -> pa.Table:
        ids, g, segment, left, right = [], [], [], [], []
        for row in x.to_pylist():
            which = np.frombuffer(row["which"], np.uint16 if len(row["ids"]) // 8 < 1 << 16 else np.uint32)
            ids.append(np.frombuffer(row["ids"], np.int64)[which])
            g.append(np.frombuffer(row["g"], np.uint32))
            segment.append(_from_six(row["segments"]))
            left.append(np.frombuffer(row["left"], np.uint32))
            right.append(np.frombuffer(row["right"], np.uint32))
        ids, g, segment, left, right = map(np.concatenate, (ids, g, segment, left, right))
        if x.column("bucket")[0].as_py() >= buckets:
            return pa.Table.from_batches([_batch(_answers(FLAG, ids, segment, homes), ANSWER)])
        order = _in_order(g, segment, ids)
        ids, g, segment = ids[order], g[order], segment[order]
        first = _runs(g, segment)
        size = np.diff(np.append(first, len(g)))
        flag = ids > np.repeat(ids[first], size)
        # Of the segments: those with a half that a different segment, of another document, has too.
        heads, head_ids = g[first], ids[first]
        shared = _shared(heads, left[order[first]], head_ids) | _shared(heads, right[order[first]], head_ids)
        group = _runs(heads)
        members = np.diff(np.append(group, len(heads)))
        many = np.repeat((np.add.reduceat(shared, group, dtype=np.int64) if len(group) else members) > HOT_SEGMENTS, members)
        need, hot = shared & ~many, shared & many
        rows = _answers(FLAG, ids[flag], segment[flag], homes)
        rows += _answers(NEED, head_ids[need], segment[first][need], homes)
        rows += _answers(HOT, head_ids[hot], segment[first][hot], homes)
        return pa.Table.from_batches([_batch(rows, ANSWER)])

    return run


def pack(homes: int):
    """Documents as they travel: home, doc_id, compressed text."""
    schema = pa.schema([("home", pa.int64()), ("id", pa.int64()), ("z", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zip_ = zstandard.ZstdCompressor(level=1)
        for x in batches:
            body, offsets = tb.utf8(x.column(1))
            packed = [zip_.compress(body[a:b]) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(_home(_ids(x.column(0)), homes)), x.column(0), pa.array(packed, pa.binary())], schema=schema)

    return run


def _unpacked(docs: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, int]]]:
    """Bytes, offsets and ids of pieces of a home's documents."""
    unzip = zstandard.ZstdDecompressor()
    ids = _ids(docs.column("id").combine_chunks())
    texts, first, size = [], 0, 0
    for i, z in enumerate(docs.column("z")):
        texts.append(unzip.decompress(z.as_py()))
        size += len(texts[-1])
        if size >= PIECE_BYTES or i == len(docs) - 1:
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            yield np.frombuffer(b"".join(texts), np.uint8), offsets, ids[first : i + 1], (first, i + 1)
            texts, first, size = [], i + 1, 0


def _key(ids: np.ndarray, segments: np.ndarray) -> np.ndarray:
    return tb.mixed(tb.mixed(ids.view(_U)) + segments)


def _answered(answers: pa.Table, *kinds: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of (document, segment) with these answers, and their masks (all ones: the whole segment)."""
    keys, masks = [np.zeros(0, _U)], [np.zeros(0, _U)]
    for row in answers.to_pylist():
        if row["kind"] in kinds:
            keys.append(_key(np.frombuffer(row["ids"], np.int64), _from_six(row["segments"])))
            masks.append(np.full(len(keys[-1]), ~_U(0)) if row["masks"] is None else np.frombuffer(row["masks"], _U))
    keys, masks = np.concatenate(keys), np.concatenate(masks)
    order = np.argsort(keys)
    keys, masks = keys[order], masks[order]
    first = _runs(keys)
    return keys[first], np.bitwise_or.reduceat(masks, first) if len(first) else masks


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted are among the sorted keys, and where."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return (keys[at] == wanted) if len(keys) else np.zeros(len(wanted), bool), at


def send_texts(buckets: int):
    """Step 2's second half, on a home's documents and answers: the texts of the segments that are asked for."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        need, _ = _answered(answers, NEED)
        hot, _ = _answered(answers, HOT)
        out: list[tuple[np.ndarray, ...]] = []  # bucket, id, segment, first bit, size
        data: list[np.ndarray] = []
        for body, offsets, ids, _ in _unpacked(docs) if len(need) + len(hot) else ():
            f = anchors(body, offsets)
            key = _key(ids[f["doc"]], f["segment"])
            own, _ = _lookup(need, key)
            _append(out, data, body, f["g"][own] % _U(buckets), ids[f["doc"][own]], f["segment"][own], f["start"][own], f["end"][own], np.zeros(own.sum()))
            own, _ = _lookup(hot, key)
            if own.any():
                windows = np.maximum(f["end"][own] - f["start"][own] - WINDOW + 1, 0)
                start = tb.ranges(f["start"][own], windows)
                bit = start - np.repeat(f["start"][own], windows)
                h = tb.mixed(tb.span_hash(tb.prefix_hash(body), start, start + WINDOW))
                doc, segment = np.repeat(ids[f["doc"][own]], windows), np.repeat(f["segment"][own], windows)
                order = np.lexsort((doc, h))
                first = _runs(h[order])
                least = np.repeat(doc[order][first], np.diff(np.append(first, len(order))))
                late = doc[order] > least  # decided here: a smaller document of this home has the window
                send = np.zeros(len(order), bool)
                send[first] = True
                bucket = np.where(send, h[order] % _U(buckets), _U(buckets) + h[order] % _U(buckets))
                take = send | late
                o = order[take]
                _append(out, data, body, bucket[take], doc[o], segment[o], start[o], start[o] + WINDOW, bit[o])
        if not out:
            return TEXTS.empty_table()
        bucket, ids, segment, first, size = map(np.concatenate, zip(*out))
        text = np.concatenate(data)
        at = np.concatenate([[0], np.cumsum(size)])[:-1]
        rows = []
        for k, part in _by(bucket):
            rows.append({
                "bucket": k, "ids": ids[part].tobytes(), "segments": _six(segment[part]), "first": first[part].astype(np.uint8).tobytes(),
                "sizes": size[part].astype(np.uint8).tobytes(), "data": text[tb.ranges(at[part], size[part])].tobytes(),
            })
        return pa.Table.from_batches([_batch(rows, TEXTS)])

    return run


def _append(out, data, body, bucket, ids, segment, start, end, first) -> None:
    out.append((bucket.astype(np.int64), ids, segment, first.astype(np.int64), end - start))
    data.append(body[tb.ranges(start, end - start)])


def suffix_array(text: np.ndarray, depth: int = WINDOW, codes: np.ndarray | None = None) -> np.ndarray:
    """All suffixes in the order of their first ``depth`` bytes, by two-stage sorting.

    Only suffixes smaller than their successor are sorted directly. Every other suffix follows its successor: scanning
    the buckets of first bytes upwards, each suffix found places the one before it at the front of its bucket, if that
    begins with no smaller byte. (Beyond ``depth`` the order is left open; a suffix ends with the text.)
    """
    n = len(text)
    if n < 2:
        return np.arange(n, dtype=np.int32)
    wide = np.append(text.astype(np.int16), np.int16(-1))
    change = np.flatnonzero(wide[1:] != wide[:-1])  # the last byte is larger than the end
    smaller = np.repeat(wide[change + 1] > wide[change], np.diff(change, prepend=-1))  # than the successor
    codes = _codes(text) if codes is None else codes
    small = _direct(codes, np.flatnonzero(smaller).astype(np.int32), depth)
    first_small = text[small]
    bounds = np.searchsorted(first_small, np.arange(257))
    # Each bucket of a first byte: larger suffixes, induced in order, before the smaller ones.
    front: list[list[np.ndarray]] = [[] for _ in range(256)]
    front[text[n - 1]].append(np.array([n - 1], np.int32))
    out = []
    for c in range(256):
        queue, front[c] = front[c], []
        while queue:
            now = np.concatenate(queue) if len(queue) > 1 else queue[0]
            out.append(now)
            _induce(now, text, smaller, front)
            queue, front[c] = front[c], []
        now = small[bounds[c] : bounds[c + 1]]
        out.append(now)
        _induce(now, text, smaller, front)
    return np.concatenate(out)


def _induce(now: np.ndarray, text: np.ndarray, smaller: np.ndarray, front: list[list[np.ndarray]]) -> None:
    before = now[now > 0] - 1
    before = before[~smaller[before]]
    if len(before):
        for c, part in _by(text[before].astype(np.int64)):
            front[c].append(before[part])


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number; 0 behind the end."""
    padded = np.concatenate([text, np.zeros(WINDOW + 16, np.uint8)]).astype(_U)
    for shift in (1, 2, 4):
        padded[:-shift] = (padded[:-shift] << _U(8 * shift)) | padded[shift:]
    return padded


def _codes(text: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as their rank among all of the text; two of them are one number to sort by."""
    words = _words(text)
    order = np.argsort(words)
    key = words[order]
    codes = np.zeros(len(words), np.int32)
    codes[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32)
    return codes


def _direct(codes: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their first ``depth`` bytes: by sixteen bytes, then ties by the next eight, and so on."""
    both = lambda high, places: high.astype(_U) << _U(32) | codes[np.minimum(places, len(codes) - 1)].astype(_U)
    key = both(codes[at], at + 8)
    by = np.argsort(key)
    order, key = at[by], key[by]
    rank = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]), dtype=np.int32) if len(order) else np.zeros(0, np.int32)
    for d in range(16, depth, 8):
        tied = np.zeros(len(order), bool)
        same = rank[1:] == rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        t = np.flatnonzero(tied)
        if not len(t):
            break
        key = both(rank[t], order[t] + d)
        by = np.argsort(key)
        order[t], key = order[t][by], key[by]
        new = np.ones(len(order), bool)
        new[1:] = rank[1:] != rank[:-1]
        new[t[1:]] |= key[1:] != key[:-1]
        rank = np.cumsum(new, dtype=np.int32) - 1
    return order


def repeated_windows(ids: np.ndarray, sizes: np.ndarray, text: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each segment a bit mask of its windows (by start) that a segment of a smaller document has too."""
    gap = sizes + 1  # a zero byte between segments
    start = np.concatenate([[0], np.cumsum(gap)])[:-1]
    joined = np.zeros(int(gap.sum()), np.uint8)
    joined[tb.ranges(start, sizes)] = text
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), gap)
    offset = np.arange(len(joined), dtype=np.int32) - start.astype(np.int32)[owner]
    codes = _codes(joined)
    sa = suffix_array(joined, window, codes)
    sa = sa[offset[sa] + window <= sizes[owner[sa]]]
    if not len(sa):
        return np.zeros(len(sizes), _U)
    # The common prefix of neighbours reaches `window` bytes where all its words of eight agree.
    same = np.ones(len(sa) - 1, bool)
    for d in [*range(0, window - 7, 8), window - 8]:
        w = codes[sa + d]
        same &= w[1:] == w[:-1]
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    who = ids[owner[sa]]
    least = np.repeat(np.minimum.reduceat(who, first), np.diff(np.append(first, len(sa))))
    late = sa[who > least]
    masks = np.zeros(len(sizes), _U)
    np.bitwise_or.at(masks, owner[late], _U(1) << offset[late].astype(_U))
    return masks


def answer_texts(buckets: int, homes: int):
    """Step 3, on all texts that a bucket was sent."""

    def run(x: pa.Table) -> pa.Table:
        rows = x.to_pylist()
        join = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])
        ids, sizes, first, text = join("ids", np.int64), join("sizes", np.uint8).astype(np.int64), join("first", np.uint8), join("data", np.uint8)
        segments = np.concatenate([_from_six(r["segments"]) for r in rows])
        if rows[0]["bucket"] >= buckets:
            masks = np.ones(len(ids), _U)
        else:
            masks = repeated_windows(ids, sizes, text)
        masks = masks << first.astype(_U)
        own = masks != 0
        return pa.Table.from_batches([_batch(_answers(FLAG, ids[own], segments[own], homes, masks[own]), ANSWER)])

    return run


RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])


def remove(with_text: bool):
    """Step 4, on a home's documents and all answers to them."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        keys, masks = _answered(answers, FLAG)
        tables = []
        for body, offsets, ids, (a, b) in _unpacked(docs):
            edge = np.zeros(len(body) + 1, np.int32)
            if len(keys):
                f = anchors(body, offsets)
                own, at = _lookup(keys, _key(ids[f["doc"]], f["segment"]))
                start, end, mask = f["start"][own], f["end"][own], masks[at[own]]
                whole = mask == ~_U(0)
                np.add.at(edge, start[whole], 1)
                np.add.at(edge, end[whole], -1)
                start, mask = start[~whole], mask[~whole]
                for bit in range(WINDOW - GRAM + 1):
                    here = start[(mask >> _U(bit)) & _U(1) == 1] + bit
                    np.add.at(edge, here, 1)
                    np.add.at(edge, here + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            starts = offsets[:-1][offsets[:-1] < len(body)]
            opens[starts] |= gone[starts]
            total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[offsets])
            kept = [body[p:q][~gone[p:q]].tobytes() for p, q in zip(offsets[:-1], offsets[1:])]
            tables.append(pa.Table.from_arrays([
                docs.column("id").slice(a, b - a).combine_chunks(), pa.array(np.diff(offsets)), pa.array(total(gone)), pa.array(total(opens)),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept if with_text else [None] * len(kept), pa.binary()),
            ], schema=RESULT))
        return pa.concat_tables(tables) if tables else RESULT.empty_table()

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, its bytes, if ``with_text``).

    A byte goes if a WINDOW-byte string that covers it also starts in a document with a smaller doc_id. Texts are UTF-8
    bytes; null counts as empty, and what is shorter than WINDOW bytes stays whole. Rows that repeat a doc_id don't
    count as smaller than one another; a null doc_id is larger than any. An empty table gives an empty result.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    buckets = homes = max(MIN_BUCKETS, -(-int(total) // BUCKET_BYTES))
    sent = rows.mapInArrow(send_anchors(buckets), SENT_SQL)
    answers = written(sent.groupBy("bucket").applyInArrow(answer_anchors(buckets, homes), ANSWER_SQL), "anchors")
    packed = rows.mapInArrow(pack(homes), "home long, id long, z binary")
    asked = answers.where(F.col("kind") != FLAG)
    texts = packed.groupBy("home").cogroup(asked.groupBy("home")).applyInArrow(send_texts(TEXT_BUCKETS * buckets), TEXTS_SQL)
    found = texts.groupBy("bucket").applyInArrow(answer_texts(TEXT_BUCKETS * buckets, homes), ANSWER_SQL)
    flags = answers.where(F.col("kind") == FLAG).unionByName(found)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    out = packed.groupBy("home").cogroup(flags.groupBy("home")).applyInArrow(remove(with_text), schema)
    return out if with_text else out.drop("kept")
