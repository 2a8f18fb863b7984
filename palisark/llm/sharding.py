"""A uniform shuffle of all rows into shards of exact size.

The rows of input partition p that go to shard s are counted before anything moves: the counts of all partitions and
shards form a matrix with fixed margins, drawn from the multivariate hypergeometric law that a uniformly random
arrangement would follow. Each partition permutes its rows and deals them out by its row of the matrix, rows are
exchanged, and each shard permutes again. The result is a uniformly random arrangement with exact shard sizes, in one
exchange of narrow rows.

No matrix is kept anywhere: it is defined by a tree over the partitions, each node of which splits what its shards get
between its two halves with a generator seeded by the node. A task walks from the root to the partition it has, in
O(shards * log(partitions)) draws, however many rows there are, and every task finds the same matrix.

A shard is permuted by buckets that a task can hold: each row draws its bucket in the shard, uniformly and for itself,
the buckets' sizes are counted, buckets lie one after the other, and each is permuted. That is the first digit of a sort
by random keys, so that every arrangement of the shard is equally likely.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import small_side, written

SHARDS = 16
#: Rows that a task permutes after the exchange, about.
BUCKET_ROWS = 8192
#: Partitions up to so many rows are permuted as an array; larger ones by a function, so that a task's memory and work
#: follow the rows that it has, also where a large partition is read in many pieces.
SMALL_PARTITION = 1 << 18
HELD_PARTITIONS = 8
#: numpy draws hypergeometric counts from populations below this.
NUMPY_LIMIT = 10**9
_EXACT = decimal.Context(prec=50)
_LOG_2PI = decimal.Decimal("1.83787706640934548356065947281123527972279494727556682563430308")


def log_factorial(n: int) -> decimal.Decimal:
    """ln n! to 30 digits after the point: by multiplication, or for larger n by Stirling's series."""
    if n < 1000:
        return _EXACT.ln(decimal.Decimal(math.factorial(n)))
    x, c = decimal.Decimal(n), _EXACT
    out = c.add(c.multiply(c.add(x, decimal.Decimal("0.5")), c.ln(x)), c.subtract(c.divide(_LOG_2PI, 2), x))
    power = x
    for numerator, denominator in ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188)):  # Bernoulli numbers
        out = c.add(out, c.divide(decimal.Decimal(numerator), c.multiply(decimal.Decimal(denominator), power)))
        power = c.multiply(power, c.multiply(x, x))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Of ``sample`` draws without replacement, the number of good ones; any population.

    Beyond numpy's populations: rejection under the envelope that every log-concave law has about its mode (Devroye),
    with probabilities from factorials to 30 digits; about five tries, whatever the population.
    """
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, sample))
    least, most = max(0, sample - bad), min(good, sample)
    if least == most:
        return least
    mode = min(most, max(least, (sample + 1) * (good + 1) // (good + bad + 2)))
    terms = lambda k: sum((log_factorial(x) for x in (k, good - k, sample - k, bad - sample + k)), decimal.Decimal(0))
    with decimal.localcontext(_EXACT):
        at_mode = terms(mode)
        whole = sum(map(log_factorial, (good, bad, sample, good + bad - sample))) - log_factorial(good + bad)
        peak = math.exp(whole - at_mode)
        width = 1 + peak / 2
        while True:
            if rng.random() <= width / (1 + width):
                y = rng.random() * width / peak
            else:
                y = (width + rng.exponential()) / peak
            k = mode + round(y) * (1 if rng.random() < 0.5 else -1)
            if least <= k <= most and rng.random() * min(1.0, math.exp(width - peak * y)) <= math.exp(at_mode - terms(k)):
                return k


def split(rng: np.random.Generator, shards: np.ndarray, sample: int) -> np.ndarray:
    """How many of ``sample`` random places lie in each shard (multivariate hypergeometric)."""
    out, rest = np.zeros(len(shards), np.int64), int(shards.sum())
    for b, size in enumerate(map(int, shards)):
        rest -= size
        if sample:
            out[b] = hypergeometric(rng, size, rest, sample)
            sample -= int(out[b])
    return out


def matrix_row(counts: np.ndarray, shards: np.ndarray, p: int, seed: int) -> np.ndarray:
    """Row p of the communication matrix for partitions of ``counts`` rows and shards of the given sizes."""
    before = np.concatenate([[0], np.cumsum(counts)])
    lo, hi, own = 0, len(counts), np.asarray(shards, np.int64)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, lo, hi])))
        left = split(rng, own, int(before[mid] - before[lo]))
        lo, hi, own = (lo, mid, left) if p < mid else (mid, hi, own - left)
    return own


def even(total: int, parts: int) -> np.ndarray:
    """Sizes at most one apart."""
    return np.array([total // parts + (i < total % parts) for i in range(parts)], np.int64)


def drawn_bucket(at: np.ndarray, key: list[int], buckets: int) -> np.ndarray:
    """A uniform bucket for each row, from its place alone."""
    start = np.random.Generator(np.random.Philox(np.random.SeedSequence(key))).integers(0, 2**63, dtype=np.uint64)
    h = tb.mixed(tb.mixed(at.astype(np.uint64) + start) + start)
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def permuted(at: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """The places that a pseudo-random permutation of range(n) gives to ``at``, without the permutation itself.

    A Feistel network of eight rounds over the next larger square of a power of two, walked until the place is below n.
    """
    half = np.uint64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.Generator(np.random.Philox(np.random.SeedSequence(key))).integers(0, 2**63, 8, dtype=np.uint64)
    out, todo = at.astype(np.uint64), np.arange(len(at))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & mask
        for k in keys:
            left, right = right, left ^ (tb.mixed(right + k) & mask)
        out[todo] = (left << half) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def assign(
    docs: DataFrame, shards: int = SHARDS, seed: int = 7, id_col: str = "doc_id", text_col: str = "text",
    bucket_rows: int = BUCKET_ROWS, small_partition: int = SMALL_PARTITION,
) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null).

    Shard sizes are at most one apart, slots gapless from 0. Size: UTF-8 bytes of the text plus 1; a null text has none.
    Repeated rows and ids are rows of their own; null ids are carried. An empty table gives an empty result. Equal texts
    aren't kept together: the law is that of the row counts. Further columns, whatever their names, play no part. The
    arrangement is fixed once the narrow rows are written, so a lost executor's tasks come out as before.
    """
    spark = docs.sparkSession
    text = F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")
    rows = written(
        docs.select(
            F.monotonically_increasing_id().alias("row_no"),
            docs[id_col].alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ),
        "shard-rows",
    )
    # A count for each input partition, of which Spark's driver keeps far more itself.
    counted = rows.groupBy(F.shiftrightunsigned("row_no", 33).alias("run")).count().orderBy("run").collect()
    runs = {int(x["run"]): i for i, x in enumerate(counted)}
    counts = np.array([x["count"] for x in counted], np.int64)
    total = int(counts.sum())
    sizes = even(total, shards)
    per_shard = max(1, -(-total // (shards * bucket_rows)))
    shared = spark.sparkContext.broadcast((runs, counts, sizes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, counts, sizes = shared.value
        cuts: dict[int, np.ndarray] = {}  # of the last partitions that were met
        places: dict[int, np.ndarray] = {}
        for x in batches:
            row_no = x.column("row_no").to_numpy()
            run = row_no >> 33
            shard, bucket = np.empty(len(row_no), np.int32), np.empty(len(row_no), np.int64)
            for r in np.unique(run):
                p = runs[int(r)]
                n = int(counts[p])
                if r not in cuts:
                    if len(cuts) >= HELD_PARTITIONS:
                        cuts.clear()
                        places.clear()
                    cuts[r] = np.cumsum(matrix_row(counts, sizes, p, seed))
                    if n <= small_partition:
                        places[r] = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, p, 1]))).permutation(n)
                mine = run == r
                at = row_no[mine] & ((1 << 33) - 1)
                place = places[r][at] if n <= small_partition else permuted(at, n, [seed, p, 1])
                shard[mine] = np.searchsorted(cuts[r], place, "right")
                bucket[mine] = drawn_bucket(at, [seed, p, 3], per_shard)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array(shard), pa.array(bucket)], names=[*x.schema.names, "shard", "bucket"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    dealt = rows.mapInArrow(deal, f"row_no long, doc_id {id_type}, size long, text_crc32 long, shard int, bucket long")
    dealt = written(dealt, "dealt")
    held = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")
    starts = small_side(held.select("shard", "bucket", before.alias("first_slot")), "buckets")
    shuffled = dealt.join(starts, ["shard", "bucket"]).groupBy("shard", "bucket").applyInArrow(
        _second_permutation(seed), f"doc_id {id_type}, size long, text_crc32 long, shard int, slot long"
    )
    return shuffled.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _second_permutation(seed: int):
    def permute(x: pa.Table) -> pa.Table:
        x = x.sort_by("row_no")  # rows arrive in no fixed order
        shard, bucket = x.column("shard")[0].as_py(), x.column("bucket")[0].as_py()
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, shard, bucket, 2])))
        slot = x.column("first_slot")[0].as_py() + rng.permutation(len(x))
        return x.select(["doc_id", "size", "text_crc32", "shard"]).append_column("slot", pa.array(slot, pa.int64()))

    return permute
