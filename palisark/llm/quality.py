"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a text is logistic(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairs are never formed: with
S_f = sum v_if x_i the last term is (sum_f S_f**2 - sum_i |v_i|**2 x_i**2) / 2, so that a text costs time linear in its
features. The model is fitted with Adam on a bounded sample of labelled rows; every text is then scored whole, in the
task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.llm.language_id import held_out

#: The fit's bound: labelled rows of each label. The sample is that of the least hashes of the id.
SAMPLE_ROWS = 2048
WORD_BUCKETS = 1 << 14
FACTORS = 8
EPOCHS = 12
SEED = 5
PIECE_BYTES = 2 << 20

_is = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
UPPER, DIGIT = _is(bytes(range(0x41, 0x5B))), _is(bytes(range(0x30, 0x3A)))
MARKS = _is(b"#$%&*@^~<>{}[]\\=+_`|/")
PAUSES = _is(b".,;:")
CRIES = _is(b"!?")
LINE = _is(b"\n")
HIGH = np.arange(256) >= 0x80
STATISTICS = (
    "upper case", "digits", "marks", "pauses", "cries", "white space", "lines", "beyond ASCII", "repeats of the word before",
    "distinct words", "words ending in a mark", "words of one mark", "mean word length", "longest word", "log of the length",
    "most frequent word", "upper-case words",
)
METADATA = 34  # the power of two of n_chars, shifted by whether it agrees with the text; the last one: no n_chars
N_FEATURES = WORD_BUCKETS + len(STATISTICS) + METADATA


def features(column: pa.Array, n_chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a column: feature numbers, values, and the offset of each document's first feature.

    Words are lower-cased (A to Z) and hashed; a document's words share a length of 1. ``n_chars``: -1 where missing.
    """
    body, offsets = tb.utf8(column)
    for a, b in tb.chunks(offsets, PIECE_BYTES):
        yield _piece(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n_chars[a:b])


def _piece(body: np.ndarray, offsets: np.ndarray, n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs = len(offsets) - 1
    n_bytes = np.diff(offsets).astype(float)
    per_byte = np.maximum(n_bytes, 1)
    share = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[body])])[offsets]) / per_byte
    start, end, doc = tb.word_spans(body, offsets)
    size = end - start
    key = tb.word_hash(tb.LOWER[body], start, end)
    per_doc = lambda x: np.bincount(doc, x, docs)
    n_words = np.bincount(doc, minlength=docs)
    per_word = np.maximum(n_words, 1)
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (doc[1:] == doc[:-1])
    first, last = body[start], body[end - 1] if len(end) else body[:0]
    order = np.lexsort((key, doc))
    key, by = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (by[1:] != by[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(key)))
    owner = by[at]
    distinct = np.bincount(owner, minlength=docs)
    # Distinct words of one bucket are one feature: a document has WORD_BUCKETS of them at most, however long it is.
    cell, held = np.unique(owner * WORD_BUCKETS + (key[at] >> np.uint64(64 - 14)).astype(np.int64), return_counts=True)
    in_bucket, word = np.divmod(cell, WORD_BUCKETS)
    filled = np.bincount(in_bucket, minlength=docs)
    most = np.zeros(docs)
    np.maximum.at(most, owner, times)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, size)
    table = np.stack([
        share(UPPER), share(DIGIT), share(MARKS), share(PAUSES), share(CRIES), share(tb.SPACE), share(LINE), share(HIGH),
        per_doc(again) / per_word, distinct / per_word, per_doc(MARKS[last]) / per_word, per_doc((size == 1) & MARKS[first]) / per_word,
        np.minimum(per_doc(size) / per_word / 16, 2), np.log1p(longest) / 8, np.log1p(n_bytes) / 12, most / per_word,
        per_doc(UPPER[first] & UPPER[last] & (size > 1)) / per_word,
    ], 1)
    chars = np.diff(np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])[offsets])
    meta = np.where(n_chars < 0, METADATA - 1, np.minimum(np.log2(np.maximum(n_chars, 1)).astype(int), 15) + 16 * (n_chars != chars))
    # One row of features for each document: its words, the statistics, one of the metadata.
    fixed = len(STATISTICS) + 1
    at = np.concatenate([[0], np.cumsum(filled + fixed)])
    number, value = np.empty(at[-1], np.int32), np.empty(at[-1], np.float32)
    words_at = tb.ranges(at[:-1], filled)
    number[words_at] = word
    value[words_at] = held * (1 / np.sqrt(np.maximum(distinct, 1)))[in_bucket]
    tail = (at[1:] - fixed)[:, None] + np.arange(fixed)
    number[tail] = np.concatenate([np.broadcast_to(WORD_BUCKETS + np.arange(fixed - 1), (docs, fixed - 1)), WORD_BUCKETS + fixed - 1 + meta[:, None]], 1)
    value[tail] = np.concatenate([table, np.ones((docs, 1))], 1)
    return number, value, at


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # one a feature
    factors: np.ndarray  # FACTORS a feature

    def margins(self, number: np.ndarray, value: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The log-odds of each document, in time linear in the features."""
        if len(at) < 2:
            return np.zeros(0)
        row = self.factors[number] * value[:, None]
        sums = np.add.reduceat(row, at[:-1])
        squares = np.add.reduceat((row * row).sum(1), at[:-1])
        return self.bias + np.add.reduceat(self.weights[number] * value, at[:-1]) + ((sums * sums).sum(1) - squares) / 2


def fit_machine(number: np.ndarray, value: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Machine:
    """Adam on the weighted logistic loss, in batches of 64 rows; the same rows in the same order give the same model."""
    rng = np.random.default_rng(SEED)
    m = Machine(0.0, np.zeros(N_FEATURES, np.float32), rng.normal(0, 0.02, (N_FEATURES, FACTORS)).astype(np.float32))
    state = [np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.zeros((N_FEATURES, FACTORS)), np.zeros((N_FEATURES, FACTORS)), 0.0, 0.0]
    step, rate, decay = 0, 0.02, 1e-5
    for _ in range(EPOCHS):
        order = rng.permutation(len(label))
        for i in range(0, len(order), 64):
            docs = order[i : i + 64]
            size = at[docs + 1] - at[docs]
            pick = tb.ranges(at[docs], size)
            n, x = number[pick], value[pick]
            ends = np.concatenate([[0], np.cumsum(size)])
            p = 1 / (1 + np.exp(-m.margins(n, x, ends)))
            error = (p - label[docs]) * weight[docs] / len(docs)
            sums = np.add.reduceat(m.factors[n] * x[:, None], ends[:-1])
            e = np.repeat(error, size) * x
            touched, where = np.unique(n, return_inverse=True)
            g_w = np.bincount(where, e, len(touched)) + decay * m.weights[touched]
            pull = np.repeat(sums, size, axis=0) - m.factors[n] * x[:, None]
            g_v = np.stack([np.bincount(where, e * pull[:, f], len(touched)) for f in range(FACTORS)], 1) + decay * m.factors[touched]
            step += 1
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            for g, value_of, (a, b) in ((g_w, m.weights, (0, 1)), (g_v, m.factors, (2, 3))):
                state[a][touched] = 0.9 * state[a][touched] + 0.1 * g
                state[b][touched] = 0.999 * state[b][touched] + 0.001 * g * g
                value_of[touched] -= rate * (state[a][touched] / c1) / (np.sqrt(state[b][touched] / c2) + 1e-8)
            state[4] = 0.9 * state[4] + 0.1 * error.sum()
            state[5] = 0.999 * state[5] + 0.001 * error.sum() ** 2
            m.bias -= rate * (state[4] / c1) / (np.sqrt(state[5] / c2) + 1e-8)
    return m


def _columns(docs: DataFrame, id_col: str, text_col: str, n_chars_col: str) -> DataFrame:
    n_chars = F.coalesce(docs[n_chars_col].cast("long"), F.lit(-1)) if n_chars_col in docs.columns else F.lit(-1).cast("long")
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), n_chars.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> Machine:
    """Learns from at most SAMPLE_ROWS labelled rows of each label whose crc32(id) modulo 3 isn't 1.

    Rows with a null label, or that no document has, are no sample. The labels' frequencies over all labelled rows
    weight the sample, so that the score is that of the whole. Without any label the score is 1/2 everywhere. What the
    driver gathers is bounded: a row has at most N_FEATURES numbers of 8 bytes, whatever the length of its text.
    """
    usable = labels.where(~held_out(labels[id_col]) & labels["quality"].isin(0, 1)).select(labels[id_col].alias("doc_id"), "quality")
    share = {x["quality"]: x["count"] for x in usable.groupBy("quality").count().collect()}
    chosen = None
    for q in share:
        one = usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
        chosen = one if chosen is None else chosen.unionByName(one)
    if chosen is None:
        return Machine(0.0, np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, FACTORS), np.float32))
    # At most 2 * SAMPLE_ROWS ids and labels are broadcast; what comes back are that many rows of feature numbers.
    rows = _columns(docs, id_col, text_col, n_chars_col).join(F.broadcast(chosen.distinct()), "doc_id")
    found = _sampled(rows).orderBy("doc_id", "quality", "number").limit(4 * SAMPLE_ROWS).collect()
    if not found:
        return Machine(0.0, np.zeros(N_FEATURES, np.float32), np.zeros((N_FEATURES, FACTORS), np.float32))
    number = np.concatenate([np.frombuffer(x["number"], np.int32) for x in found])
    value = np.concatenate([np.frombuffer(x["value"], np.float32) for x in found])
    at = np.concatenate([[0], np.cumsum([len(x["number"]) // 4 for x in found])])
    label = np.array([x["quality"] for x in found], float)
    sampled = {q: max(1, int((label == q).sum())) for q in share}
    total = sum(share.values())
    weight = np.array([share[int(q)] / total * len(label) / sampled[int(q)] for q in label])
    return fit_machine(number, value, at, label, np.sqrt(weight))


def _sampled(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            number, value = [], []
            for n, v, at in features(x.column(1), x.column(2).to_numpy()):
                number += [n[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                value += [v[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [x.column(0), x.column(3), pa.array(number, pa.binary()), pa.array(value, pa.binary())], names=["doc_id", "quality", "number", "value"]
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "text", "n_chars", F.col("quality").cast("int").alias("quality")).mapInArrow(
        run, f"doc_id {kind}, quality int, number binary, value binary"
    )


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """One row per document: doc_id, held_out, score (of label 1), predicted.

    Null and empty texts are scored from their statistics alone. Repeated rows are scored alike, a row each; columns other
    than the text and its declared length (n_chars, may be null or absent) are no input, whatever their names. An empty
    table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = _columns(docs, id_col, text_col, n_chars_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for x in batches:
            parts = [machine.margins(*piece) for piece in features(x.column(1), x.column(2).to_numpy())]
            p = 1 / (1 + np.exp(-np.clip(np.concatenate([np.zeros(0), *parts]), -500, 500)))
            yield pa.RecordBatch.from_arrays([x.column(0), pa.array(p)], names=["doc_id", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
