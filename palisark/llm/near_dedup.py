"""Near-duplicate detection: MinHash bands, odd sketches, and a check on full sets.

A document's set is that of its word shingles. Documents with equal sets are one class from the start, so copies cost
nothing further. MinHash samples of the classes go into bands; classes that share a band are candidates. In a band's
bucket not all pairs are formed: its members meet the bucket's leader, and members that are then still in different
components meet a few more, each in the largest of its buckets. Members that are apart even then, such as texts that share a boilerplate, leave their
buckets: they meet by the rarest of their shingles. Two sets of the required similarity share one of the first
n - ceil(0.8 n) + 1 shingles under any common order, so with the rarest first no link is lost, and what many have in
common comes last and brings nobody together.

Each class also folds its samples into a bitmap of parities (an odd sketch). The XOR of two sketches holds the parity of
their symmetric difference, and its population count estimates high similarities closely. A second bitmap folds the
whole set in the same way; the population count of its XOR is never above the symmetric difference, so that it excludes
pairs for certain. What is left is decided on the full sets. Links join classes to components by alternating large-star
and small-star rounds. Nothing of all this passes through the driver.

A shingle is known by a 64-bit hash. It isn't polynomial: words of up to eight bytes never collide, and any other two
shingles do with a chance of 2**-64.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisark.llm import textbytes as tb
from palisark.session import small_side, written

WIDTH = 5
PERCENT = 80
#: At a similarity of 0.8, 32 bands of 4 rows miss a pair with probability 5e-8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
SKETCH_WORDS = 8
SKETCH_BITS = 64 * SKETCH_WORDS
#: A sketch excludes a pair whose distance is this many standard deviations above that of the threshold.
DEVIATIONS = 5.5
#: A class that is apart from others of its buckets after their leaders have met them meets this many drawn members of one.
LEADERS = 6
PIECE_BYTES = 1 << 20
#: Odd; makes a shingle depend on the order of its words.
_STEP = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.Philox(77))
_FACTORS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_TERMS = _rng.integers(0, 2**32, SAMPLES, dtype=np.uint32)
_SALTS = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)


def shingles(body: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each document in turn, sorted, as 64-bit hashes; how many each document has.

    Words are runs of bytes that aren't ASCII white space, A to Z lower-cased; a document of fewer words than ``width``
    has one shingle, of all its words; without words, none.
    """
    docs = len(offsets) - 1
    start, end, doc = tb.word_spans(body, offsets)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(docs, np.int64)
    word = tb.word_hash(tb.LOWER[body], start, end)
    words = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(words)])[:-1]
    count = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    at = tb.ranges(first, count)
    owner = np.repeat(np.arange(docs), count)
    size = np.minimum(words, width)[owner]
    h = tb.mixed(word[at] ^ (size.astype(np.uint64) * _STEP))
    for j in range(1, width):
        more = size > j
        h[more] = tb.mixed(h[more] * _STEP + word[at[more] + j])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=docs)


def signatures(h: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band hashes (documents x BANDS) and odd sketches (documents x SKETCH_WORDS); zeros for an empty set."""
    full = np.flatnonzero(count)
    at = np.concatenate([[0], np.cumsum(count[full])])[:-1]
    least = np.zeros((len(count), SAMPLES), np.uint32)
    if len(full):
        x = (h >> np.uint64(32)).astype(np.uint32)
        for i in range(SAMPLES):
            least[full, i] = np.minimum.reduceat(x * _FACTORS[i] + _TERMS[i], at)
    samples = tb.mixed(least.astype(np.uint64) + _SALTS)
    parts = samples.reshape(len(count), BANDS, ROWS)
    bands = tb.mixed((parts * np.array([1, 3, 5, 7], np.uint64)).sum(2, dtype=np.uint64))
    bit = samples % np.uint64(SKETCH_BITS)
    sketch = parities(np.repeat(np.arange(len(count)), SAMPLES), bit.ravel(), len(count))
    bands[count == 0] = 0
    sketch[count == 0] = 0
    return bands, sketch


def parities(owner: np.ndarray, bit: np.ndarray, owners: int) -> np.ndarray:
    """A bitmap (owners x SKETCH_WORDS) of which bits each owner has an odd number of times."""
    times = np.bincount(owner * SKETCH_BITS + bit.astype(np.int64), minlength=owners * SKETCH_BITS)
    return np.packbits((times & 1).astype(np.uint8).reshape(owners, SKETCH_BITS), axis=1).view(np.uint64)


def whole_sketch(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The parity bitmap of each full set."""
    return parities(np.repeat(np.arange(len(count)), count), h % np.uint64(SKETCH_BITS), len(count))


def _lists(x: np.ndarray) -> pa.Array:
    n, k = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(x.ravel().view(np.int64)))


def features(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """row_no, doc_id, text_hash, n (set size), k1 and k2 (hashes of the set), bands, sketch, whole of each document."""
    text = docs[text_col].cast("string")
    rows = docs.select(F.monotonically_increasing_id().alias("row_no"), docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            body, offsets = tb.utf8(x.column(3))
            for a, b in tb.chunks(offsets, PIECE_BYTES):
                h, n = shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                bands, sketch = signatures(h, n)
                k1, k2 = _set_keys(h, n)
                own = [x.column(i).slice(a, b - a) for i in range(3)]
                made = [pa.array(n), pa.array(k1), pa.array(k2), _lists(bands), _lists(sketch), _lists(whole_sketch(h, n))]
                yield pa.RecordBatch.from_arrays([*own, *made], names=["row_no", "doc_id", "text_hash", "n", "k1", "k2", "bands", "sketch", "whole"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    bitmaps = "bands array<long>, sketch array<long>, whole array<long>"
    return rows.mapInArrow(run, f"row_no long, doc_id {kind}, text_hash long, n long, k1 long, k2 long, {bitmaps}")


def _set_keys(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(n)])
    total = lambda x: np.diff(np.concatenate([np.zeros(1, np.uint64), np.cumsum(x)])[at])
    return total(tb.mixed(h)).view(np.int64), total(tb.mixed(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64)


def most_different(percent: int) -> int:
    """The largest population count of an XOR of sketches that the threshold still allows, with a margin."""
    differing = SAMPLES * (1 - percent / 100)  # samples; each flips two bits
    left = math.exp(-4 * differing / SKETCH_BITS)  # what collisions leave of a further flip
    expected = SKETCH_BITS / 2 * (1 - left)
    deviation = math.sqrt((2 * left) ** 2 * differing * percent / 100 + expected * (1 - left))
    return math.ceil(expected + DEVIATIONS * deviation)


def sketch_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("int")), F.lit(0), lambda s, x: s + x)


def whole_allows(n_a: str, n_b: str, whole_a: str, whole_b: str, percent: int) -> Column:
    """False only for pairs whose symmetric difference is above what the threshold allows."""
    return sketch_distance(F.col(whole_a), F.col(whole_b)) * (100 + percent) <= (F.col(n_a) + F.col(n_b)) * (100 - percent)


def plausible(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that sizes and sketches don't exclude."""
    side = lambda c: reps.select(F.col("cid").alias(c), *(F.col(x).alias(f"{x}_{c}") for x in ("n", "sketch", "whole")))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        .where(whole_allows("n_a", "n_b", "whole_a", "whole_b", percent))
        .where(sketch_distance(F.col("sketch_a"), F.col("sketch_b")) <= most_different(percent))
        .select("a", "b")
    )


def full_sets(members: DataFrame, reps: DataFrame, docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """cid and set of the classes that occur among ``members``; only their texts are read again, one for each class."""
    wanted = reps.join(members.select("cid").distinct(), "cid").select("cid", "k1", "k2", "min_doc")
    wanted = written(wanted, "wanted")
    named = small_side(wanted.select("min_doc").distinct(), "wanted-ids")
    texts = docs.join(named, docs[id_col].eqNullSafe(named["min_doc"]), "left_semi").select(docs[text_col].cast("string").alias("text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            body, offsets = tb.utf8(x.column(0))
            for a, b in tb.chunks(offsets, PIECE_BYTES):
                h, n = shingles(body[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], width)
                k1, k2 = _set_keys(h, n)
                at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1), pa.array(k2), pa.ListArray.from_arrays(at, pa.array(h.view(np.int64)))], names=["k1", "k2", "set"]
                )

    return texts.mapInArrow(sets, "k1 long, k2 long, set array<long>").join(wanted, ["k1", "k2"]).select("cid", "set").dropDuplicates(["cid"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets have 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("cid").alias(c), F.col("set").alias(f"set_{c}"))
    common = F.size(F.array_intersect("set_a", "set_b"))
    return (
        pairs.join(side("a"), "a")
        .join(side("b"), "b")
        .where(common * (100 + percent) >= (F.size("set_a") + F.size("set_b")) * percent)
        .select("a", "b")
    )


def by_rare_shingles(apart: DataFrame, sets: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that may be similar, by prefixes of the sets in order of rarity.

    apart: cid, comp. A class enters under each shingle of its prefix that another class has too. In a shingle's group
    those of the component with most members don't meet one another, and a pair meets only where sizes, places in the
    prefix and whole sketches allow the threshold.
    """
    held = sets.join(apart, "cid").select("cid", "comp", F.size("set").alias("n"), F.explode("set").alias("s"))
    shared = written(held.groupBy("s").count().where("count > 1").withColumnRenamed("count", "df"), "shared")
    ranked = held.join(shared, "s").groupBy("cid", "comp", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("ranked"))
    alone = F.col("n") - F.size("ranked")  # shingles that no other class has come first
    left = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    prefix = ranked.where(left > 0).select("cid", "comp", "n", alone.alias("alone"), F.posexplode(F.slice("ranked", 1, left.cast("int"))).alias("i", "x"))
    prefix = prefix.join(reps.select("cid", "whole"), "cid")
    prefix = written(prefix.select(F.col("x.s").alias("s"), "cid", "comp", "n", "whole", (F.col("n") - F.col("alone") - F.col("i")).alias("rest")), "prefixes")
    groups = prefix.groupBy("s", "comp").count().groupBy("s").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"), F.count("*").alias("comps"))
    groups = written(groups.where("comps > 1").select("s", "main"), "prefix-groups")
    rows = prefix.join(groups, "s")
    side = lambda c: rows.select("s", *(F.col(x).alias(f"{x}_{c}") for x in ("cid", "comp", "n", "whole", "rest")), F.col("main").alias(f"main_{c}"))
    met = (
        (F.col("comp_a") != F.col("comp_b"))
        & ((F.col("comp_b") == F.col("main_b")) | (F.col("cid_a") < F.col("cid_b")))
        & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
        & (F.least("rest_a", "rest_b") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent)
        & whole_allows("n_a", "n_b", "whole_a", "whole_b", percent)
    )
    x, y = side("a").where("comp_a <> main_a"), side("b")
    pairs = x.join(y, (x["s"] == y["s"]) & met)
    return pairs.select(F.least("cid_a", "cid_b").alias("a"), F.greatest("cid_a", "cid_b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """cid, comp (its component's smallest cid) of every class that has a link."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select("u", F.col("m").alias("v")).union(small.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()
        after = written(small, "edges")
        edges = after
        # Stable: every class points at one class, and what is pointed at doesn't point.
        ends = after.select("u").union(after.select("v").distinct())
        if not ends.groupBy("u").count().where("count > 1").limit(1).count():
            break
    return edges.select(F.col("u").alias("cid"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())


def _judged(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of each row."""
    found = written(features(docs, width, id_col, text_col), "features")
    signs = F.min_by(F.struct("bands", "sketch", "whole"), "row_no").alias("x")
    reps = found.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row_no").alias("cid"), F.min("doc_id").alias("min_doc"), signs)
    reps = written(reps.select("cid", "n", "k1", "k2", "min_doc", "x.*"), "classes")
    banded = reps.select("cid", F.explode("bands").alias("h"))
    leaders = banded.groupBy("h").agg(F.min("cid").alias("leader"), F.count("*").alias("m")).where("m > 1").select("h", "leader")
    members = written(banded.join(written(leaders, "leaders"), "h"), "members")
    sets = written(full_sets(members, reps, docs, width, id_col, text_col), "sets")
    linked = lambda pairs: verified(written(plausible(pairs, reps, percent), "plausible"), sets, percent)
    comps = written(components(linked(members.where("cid <> leader").select(F.col("leader").alias("a"), F.col("cid").alias("b")).distinct())), "components")
    # Members of a bucket that are in different components; a member without links is a component.
    apart = written(_apart(members, comps), "apart")
    comps = written(_joined(comps, linked(_with_drawn(apart))), "components")
    apart = written(_apart(members, comps).select("cid", "comp").distinct(), "apart")
    comps = written(_joined(comps, linked(by_rare_shingles(apart, sets, reps, percent))), "components")
    placed = reps.select("cid", "k1", "k2", "n", "min_doc").join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    placed = written(placed, "placed")
    lowest = small_side(placed.groupBy("comp").agg(F.min("min_doc").alias("component_id")), "lowest")  # written: a large component's rows can be split
    named = placed.join(lowest, "comp").select("k1", "k2", "n", "component_id")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    rows = found.select("doc_id", "text_hash", "n", "k1", "k2").join(named, ["k1", "k2", "n"], "left")
    kept = F.coalesce(F.col("doc_id") == own, F.lit(False))
    return rows.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), own.alias("component_id"), kept.alias("kept"))


def _apart(members: DataFrame, comps: DataFrame) -> DataFrame:
    """h, cid, comp of the members of buckets that hold more than one component, and m, how many the bucket has."""
    placed = members.select("h", "cid").join(comps, "cid", "left").select("h", "cid", F.coalesce("comp", "cid").alias("comp"))
    placed = written(placed, "members-placed")
    mixed = placed.groupBy("h").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("h", "m")
    return placed.join(small_side(mixed, "mixed"), "h")


def _with_drawn(apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of each class that is apart (h, cid, comp, m) with up to LEADERS drawn members of one of its buckets.

    It is the largest one. Links that only its other buckets would have shown are left to the rare shingles, which lose none.
    """
    drawn = [F.min_by(F.struct("cid", "comp"), F.xxhash64("cid", "h", F.lit(i))) for i in range(LEADERS)]
    met = apart.groupBy("h").agg(F.array_distinct(F.array(*drawn)).alias("drawn")).select("h", F.explode("drawn").alias("x"))
    met = small_side(met.select("h", F.col("x.cid").alias("other"), F.col("x.comp").alias("other_comp")), "drawn")
    each = apart.groupBy("cid", "comp").agg(F.max_by("h", F.struct("m", "h")).alias("h"))
    pairs = each.join(met, "h").where("comp <> other_comp")
    return pairs.select(F.least("cid", "other").alias("a"), F.greatest("cid", "other").alias("b")).distinct()


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """Components of what ``comps`` holds together and the further links."""
    return components(links.select("a", "b").union(comps.where("cid <> comp").select("cid", "comp")))


def find(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their shingle sets; component_id is the
    smallest doc_id that links lead to, itself included; kept: doc_id is component_id. Null, empty and blank texts have
    an empty set and are linked with nothing. Repeated rows and equal texts are linked. A null doc_id is larger than
    any; a component of null ids alone has a null component_id. An empty table gives an empty result. Further columns,
    whatever their names, don't matter.
    """
    return _judged(docs, width, percent, id_col, text_col).drop("text_hash")


def deduplicated(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents of which no smaller doc_id is a near duplicate, all columns unchanged, whatever their names.

    A row without an identifier can't be named and stays. Rows that repeat identifier and text share their fate; rows
    of one identifier with different texts are judged each by its own text. An empty table gives an empty result.
    """
    gone = _judged(docs, width, percent, id_col, text_col).where("not kept and doc_id is not null")
    gone = small_side(gone.select("doc_id", "text_hash").distinct(), "gone")
    same = (docs[id_col] == gone["doc_id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["text_hash"])
    return docs.join(gone, same, "left_anti")
