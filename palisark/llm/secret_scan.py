"""Secret scan: fixed shapes, and a battery of randomness tests for everything that has none.

Candidates of the battery are long tokens of an encoding's alphabet with letters and digits. For each one the encoding
(hexadecimal, base32, base64) is inferred, and its symbols are put to three tests: a chi-squared test of the alphabet's
uniformity, a runs test about the alphabet's middle, and a serial-correlation test. Fisher's sum of the three p-values is
a token's distance from randomness. A token that is further away than one random string in a thousand is none.

How often an ordinary string comes as close is learnt from the data: all text but the long candidates that may be random
gives, for each alphabet, how often each symbol follows each other one. Strings drawn from these counts, of the least
length of each class of length, go through the same battery, and their distances are the null law. So a p-value falls
with length, and short tokens can't win by luck.

Benjamini and Hochberg's rule holds the false-discovery rate over all candidates, apart for each class of length. Counts
and histograms are tables of fixed size, however many documents there are.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import written

#: The shapes, in the order in which kinds are listed, with the least length that counts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Candidates of the battery: maximal runs of base64 and base64url symbols.
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}
_VALUES = {name: {c: i for i, c in enumerate(chars)} for name, chars in ALPHABETS.items()}
ENCODINGS = tuple(ALPHABETS)
#: Classes of length for the false-discovery control, by their least length.
LENGTH_CLASSES = (16, 20, 24, 32, 40, 64)
FALSE_DISCOVERIES = 0.05
#: What one random string in a thousand exceeds: half the quantile of chi-squared with six degrees of freedom.
MOST_DISTANT = 11.23
#: From this length on hardly any ordinary string is as near as MOST_DISTANT: a shorter one that is counts as ordinary text
#: for the null law, because leaving it out would make ordinary strings seem further away than they are.
TELLING_LENGTH = 32
#: Strings of the null law for an alphabet and a class of length.
DRAWN = 20_000
BINS = 2000
BIN_WIDTH = 0.05  # of -ln p, and of distances
PIECE_BYTES = 1 << 20
#: The number of a byte in each alphabet; 255: not in it. The first cell of each alphabet's pairs of symbols.
_CODES = np.full((len(ENCODINGS), 256), 255, np.uint8)
for _e, _chars in enumerate(ALPHABETS.values()):
    _CODES[_e, np.frombuffer(_chars.encode(), np.uint8)] = np.arange(len(_chars))
_SIZES = [len(x) for x in ALPHABETS.values()]
_CELLS = np.concatenate([[0], np.cumsum(np.square(_SIZES))])


def infer_encoding(token: str) -> str | None:
    """The smallest alphabet that holds the token; None where letters or digits are missing."""
    body = token.rstrip("=")
    if not (any(c.isdigit() for c in body) and any(c.isalpha() for c in body)):
        return None
    return next((name for name, values in _VALUES.items() if all(c in values for c in body)), None)


_tail = np.vectorize(lambda z: math.erfc(z / math.sqrt(2)) / 2, otypes=[float])


def p_values(x: np.ndarray, size: int) -> np.ndarray:
    """Chi-squared, runs and serial-correlation p-values, as a random string, of each row of symbols below ``size``."""
    rows, n = x.shape
    counts = np.bincount((np.arange(rows)[:, None] * size + x).ravel(), minlength=rows * size).reshape(rows, size)
    # Chi-squared is a line in the number of equal pairs; its law is taken from their mean and variance.
    pairs = n * (n - 1) / 2
    matches = (counts * (counts - 1)).sum(1) / 2
    uniform = _tail((matches - pairs / size) / math.sqrt(pairs / size * (1 - 1 / size)))
    above = x >= size / 2
    n1 = above.sum(1)
    n0 = n - n1
    runs = 1 + (above[:, 1:] != above[:, :-1]).sum(1)
    mean = 2 * n0 * n1 / n + 1
    var = (mean - 1) * (mean - 2) / max(1, n - 1)
    z = np.maximum(0, np.abs(runs - mean) - 0.5) / np.sqrt(np.maximum(var, 1e-12))
    one_sided = (n0 == 0) | (n1 == 0)
    run_p = np.where(one_sided, 2.0 ** (1 - n), np.where(var > 0, np.minimum(1, 2 * _tail(z)), 1.0))
    c = x - x.mean(1, keepdims=True)
    total = (c * c).sum(1)
    serial = np.where(total > 0, (c[:, 1:] * c[:, :-1]).sum(1) / np.where(total > 0, total, 1), 1.0)
    serial_p = np.minimum(1, 2 * _tail(np.abs(serial + 1 / n) * math.sqrt(n)))
    return np.maximum(np.stack([uniform, run_p, serial_p], 1), 1e-300)


def distance(p: np.ndarray) -> np.ndarray:
    """Fisher's sum of each row of p-values."""
    return -np.log(p).sum(1)


def battery(token: str, encoding: str) -> tuple[float, float, float, float]:
    """The distance from randomness, and the p-values of chi-squared, runs and serial correlation."""
    values = _VALUES[encoding]
    p = p_values(np.array([[values[c] for c in token.rstrip("=")]]), len(values))
    return float(distance(p)[0]), *map(float, p[0])


def length_class(size: int) -> int:
    return bisect.bisect_right(LENGTH_CLASSES, size) - 1


def pair_counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each symbol follows each other one in a document's text in each alphabet, other bytes left out."""
    out = np.zeros(int(_CELLS[-1]), np.int64)
    for e, size in enumerate(_SIZES):
        code = _CODES[e][body]
        at = np.flatnonzero(code != 255)
        if len(at) < 2:
            continue
        code = code[at].astype(np.int64)
        cell = code[:-1] * size + code[1:]
        apart = np.searchsorted(at, offsets[1:-1]) - 1  # the last symbol of a document and the first of the next
        inside = np.ones(len(cell), bool)
        inside[apart[(apart >= 0) & (apart < len(cell))]] = False
        out[_CELLS[e] : _CELLS[e + 1]] += np.bincount(cell[inside], minlength=size * size)
    return out


def null_distances(pairs: np.ndarray, size: int, length: int, drawn: int = DRAWN, seed: int = 3) -> np.ndarray:
    """Sorted distances of strings that follow the counts of pairs; a symbol that nothing follows is followed by any."""
    counts = pairs.reshape(size, size).astype(float)
    first = counts.sum(1)
    if not first.sum():
        return np.zeros(0)
    counts[first == 0] = first
    steps = np.cumsum(counts / counts.sum(1, keepdims=True), axis=1)
    steps[:, -1] = 1
    steps = (steps + np.arange(size)[:, None]).ravel()
    rng = np.random.default_rng([seed, size, length])
    x = np.empty((drawn, length), np.int64)
    x[:, 0] = rng.choice(size, drawn, p=first / first.sum())
    for i in range(1, length):
        x[:, i] = np.minimum(np.searchsorted(steps, x[:, i - 1] + rng.random(drawn), "right"), x[:, i - 1] * size + size - 1) - x[:, i - 1] * size
    return np.sort(distance(p_values(x, size)))


def null_table(pairs: np.ndarray, wanted: list[tuple[int, int]]) -> list[tuple[int, int, int, float]]:
    """(encoding, class, bin of distance, -ln p) for the wanted encodings and classes: p is the share of ordinary strings as near.

    Without any ordinary text p is 1.
    """
    out = []
    for e, k in wanted:
        null = null_distances(pairs[_CELLS[e] : _CELLS[e + 1]], _SIZES[e], LENGTH_CLASSES[k])
        for b in range(math.ceil(MOST_DISTANT / BIN_WIDTH)):
            near = np.searchsorted(null, (b + 1) * BIN_WIDTH, "right")
            out.append((e, k, b, float(-math.log((1 + near) / (1 + len(null))))))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes, leftmost and not overlapping in each kind; in the order of the result."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> Iterator[tuple[int, int, str, float]]:
    """(start, end, encoding, distance) of all candidate tokens."""
    for m in TOKEN.finditer(text):
        encoding = infer_encoding(m.group())
        if encoding:
            yield m.start(), m.end(), encoding, battery(m.group(), encoding)[0]


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def thresholds(found: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, float]:
    """For each class of length the least -ln p that is a discovery, from a histogram of all candidates' p-values.

    The tests of a class are its candidates. A bin's p-value is its largest, so the rate is kept.
    """
    bins = F.least(F.lit(BINS - 1), F.floor(F.col("evidence") / BIN_WIDTH)).cast("int")
    rows = found.groupBy("length_class", bins.alias("bin")).count().collect()  # at most classes * BINS rows
    out = {}
    for k in range(len(LENGTH_CLASSES)):
        histogram = np.zeros(BINS)
        for x in rows:
            if x["length_class"] == k:
                histogram[x["bin"]] = x["count"]
        at_least = np.cumsum(histogram[::-1])[::-1]
        p = np.exp(-np.arange(BINS) * BIN_WIDTH)
        ok = np.flatnonzero((at_least > 0) & (p <= rate * at_least / max(1, histogram.sum())))
        out[k] = float(ok[0] * BIN_WIDTH) if len(ok) else math.inf
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Whole texts are searched; null counts as empty, and has no spans (base_sha256 is then that of no bytes). Spans are
    kind:start:end in code points. The battery adds spans of kind 'random', also where a fixed shape lies. Repeated rows
    are rows of their own; an empty table gives an empty result; further columns, whatever their names, play no part.
    What is found is written to the shared folder before the thresholds are known, so that texts are read once.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            body, offsets = tb.utf8(x.column(1))
            for a, b in tb.chunks(offsets, PIECE_BYTES):
                yield _scanned(x.slice(a, b - a), body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, base string, random {RANDOM_SQL}, pairs {PAIRS_SQL}"
    found = written(rows.mapInArrow(run, schema), "secrets")
    pairs = np.zeros(int(_CELLS[-1]), np.int64)
    for x in found.select(F.inline("pairs")).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # a cell for two symbols of an alphabet
        pairs[x["cell"]] = x["n"]
    tokens = found.select(F.inline("random"))
    wanted = [(x["encoding"], x["length_class"]) for x in tokens.select("encoding", "length_class").distinct().orderBy("encoding", "length_class").collect()]
    table = null_table(pairs, wanted)
    null = F.broadcast(spark.createDataFrame(table, "encoding int, length_class int, bin int, evidence double"))
    bin_ = F.floor(F.col("distance") / BIN_WIDTH).cast("int")
    judged = tokens.withColumn("bin", bin_).join(null, ["encoding", "length_class", "bin"], "left").fillna(0.0, ["evidence"])
    least = thresholds(judged.select("length_class", "evidence"), rate)
    # -ln p falls with the distance: a threshold of one is a threshold of the other.
    most = {(e, k): 0.0 for e in range(len(ENCODINGS)) for k in range(len(LENGTH_CLASSES))}
    for e, k, b, evidence in table:
        if evidence >= least[k]:
            most[e, k] = max(most[e, k], (b + 1) * BIN_WIDTH)
    cuts = F.array(*[F.lit(x) for x in most.values()])
    added = F.filter("random", lambda x: x["distance"] < F.element_at(cuts, x["encoding"] * len(LENGTH_CLASSES) + x["length_class"] + 1))
    base = F.transform(
        F.filter(F.split("base", ","), lambda s: s != ""),
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("int").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).cast("int").alias("kind"),
            s.alias("span"),
        ),
    )
    more = F.transform(
        added, lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), F.concat_ws(":", F.lit("random"), x["start"], x["end"]).alias("span"))
    )
    spans = F.array_join(F.transform(F.array_sort(F.concat(base, more)), lambda x: x["span"]), ",")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(added).cast("long").alias("n_random"))


def _scanned(x: pa.RecordBatch, body: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
    """The rows of a piece; the first one also has the piece's counts of ordinary pairs of symbols."""
    out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "base", "random")}
    ordinary = body.copy()
    for i, text in enumerate(x.column(1)):
        text = text.as_py() or ""
        base = base_spans(text)
        for k, name in enumerate(("n_assign", "n_access", "n_hex")):
            out[name].append(sum(kind == k for _, kind, _ in base))
        out["base"].append(said := joined(base))
        out["base_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
        tokens, at, seen = [], int(offsets[i]), 0
        for a, b, encoding, far in candidates(text):
            tokens.append({"start": a, "end": b, "encoding": ENCODINGS.index(encoding), "length_class": length_class(b - a), "distance": far})
            at, seen = at + len(text[seen:a].encode()), a
            if far <= MOST_DISTANT and b - a >= TELLING_LENGTH:  # a token is ASCII
                ordinary[at : at + b - a] = 0x20
        out["random"].append(tokens)
    counts = pair_counts(ordinary, offsets)
    cells = np.flatnonzero(counts)
    pairs = [[{"cell": int(c), "n": int(counts[c])} for c in cells]] + [[]] * (len(x) - 1)
    kinds = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "base": pa.string(), "random": RANDOM}
    made = [*(pa.array(v, kinds[k]) for k, v in out.items()), pa.array(pairs, PAIRS)]
    return pa.RecordBatch.from_arrays([x.column(0), *made], names=["doc_id", *out, "pairs"])


RANDOM = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("encoding", pa.int32()), ("length_class", pa.int32()), ("distance", pa.float64())])
)
RANDOM_SQL = "array<struct<start:int,end:int,encoding:int,length_class:int,distance:double>>"
PAIRS = pa.list_(pa.struct([("cell", pa.int32()), ("n", pa.int64())]))
PAIRS_SQL = "array<struct<cell:int,n:bigint>>"
