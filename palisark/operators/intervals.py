"""Points in intervals: a join whose rows grow with its result, not with points times intervals of a key.

Points have ranks in the order of keys, and the points of an interval are those of a run of ranks. Points travel in blocks
of 4,096 consecutive ones, and an interval goes to the blocks of its run, of which it takes a slice each. The intervals of a
block are dealt to lots of 4,096 or so, and the block goes to each: what is shuffled is points and intervals, a few times
each, and of either side a row for each 4,096 rows of the result. Ranks are found by one range-partitioned sort of points
and bounds and prefix sums over its partitions: no key, however frequent, is gathered in a task.

The result may have thousands of rows for each of its inputs, so their order decides what it takes on disk. A lot lists, for
256 points after another, the intervals that hold them all, then those that hold some: an interval stays for 256 rows, and the
points repeat after as many, of which Parquet's usual encodings make a fraction of a byte a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark.session import fresh_name, small_side, written


#: Points of a block, as a power of two, and intervals of a lot of them, about.
BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
#: Points that the intervals of a lot are listed for together.
CHUNK = 256
#: Rows of the result that make a task, and rows that a lot counts as beside its own: a task gets 128 lots or so at most.
TASK_ROWS = 1 << 24
LOT_ROWS = TASK_ROWS >> 7


def interval_join(points: DataFrame, intervals: DataFrame, by: list[str], key: str, low: str, high: str) -> DataFrame:
    """Each point with each interval of the same ``by`` for which low <= key < high; ``key``, ``low`` and ``high`` are gone.

    Keys are of one type that can be sorted. A null bound is open; a null key or ``by`` lies in nothing. Columns other than
    those of ``by`` must differ between the two sides. Rows that repeat are joined each.
    """
    names = [*points.columns, *intervals.columns]
    rank, kind, tie, seq, part, before, here, first, n, block, held_in, a, b, at, lot, lots, found, base = (
        fresh_name(x, names) for x in ("rank", "kind", "tie", "seq", "part", "before", "here", "first", "n", "block", "held_in", "a", "b", "at", "lot", "lots", "found", "base")
    )
    own, theirs = [c for c in points.columns if c not in (*by, key)], [c for c in intervals.columns if c not in (low, high)]
    points = points.where(F.col(key).isNotNull())
    # A bound comes before the points of its own key: what is counted before it is the rank of the first point from it on.
    bounds = intervals.select(*by, F.explode(F.array_compact(F.array(low, high))).alias(key)).where(F.col(key).isNotNull()).distinct()
    marks = bounds.select(*by, key, F.lit(0).alias(kind)).unionByName(points.select(*by, key, F.lit(1).alias(kind), F.struct(*(own or [key])).alias(at)), allowMissingColumns=True)
    order = [*by, key, kind, tie]  # a key that very many points share may be split
    marks = marks.withColumn(tie, F.monotonically_increasing_id())
    spread = written(marks.repartitionByRange(*order).sortWithinPartitions(*order).drop(tie).withColumn(seq, F.monotonically_increasing_id()), "marks")
    spread = spread.withColumn(part, F.shiftrightunsigned(seq, 33))
    held = spread.groupBy(part).agg(F.count_if(F.col(kind) == 1).alias(here))
    held = small_side(held.withColumn(before, F.sum(here).over(W.orderBy(part)) - F.col(here)).drop(here), "marks-parts")
    number = F.count_if(F.col(kind) == 1).over(W.partitionBy(part).orderBy(seq).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = spread.withColumn(rank, number).join(held, part).withColumn(rank, F.col(rank) + F.col(before) - F.col(kind))
    placed = written(placed.drop(seq, part, before), "ranks")
    ranked = placed.where(F.col(kind) == 1)
    groups = written(ranked.groupBy(*by).agg(F.min(rank).alias(first), F.count("*").alias(n)), "groups")
    runs = intervals.join(groups, by)
    for bound, out, open_end in ((low, a, F.col(first)), (high, b, F.col(first) + F.col(n))):
        known = placed.where(F.col(kind) == 0).select(*by, F.col(key).alias(bound), F.col(rank).alias(out))
        runs = runs.join(known, [*by, bound], "left").withColumn(out, F.when(F.col(bound).isNull(), open_end).otherwise(F.col(out)))
    runs = written(runs.where(F.col(a) < F.col(b)).select(*theirs, a, b).withColumn(tie, F.monotonically_increasing_id()), "runs")
    runs = runs.withColumn(block, F.explode(F.sequence(F.shiftright(a, BLOCK_BITS), F.shiftright(F.col(b) - 1, BLOCK_BITS))))
    base_of = F.shiftleft(F.col(block), BLOCK_BITS)
    in_block = F.least(F.col(b), base_of + BLOCK) - F.greatest(F.col(a), base_of)
    held = small_side(runs.groupBy(block).agg(F.ceil(F.count("*") / BLOCK).alias(lots), F.sum(in_block).alias(found)), "runs-blocks")
    tasks = 2 + (held.agg(F.sum(F.col(found) + F.col(lots) * LOT_ROWS)).first()[0] or 0) // TASK_ROWS  # of one, Spark would deal both sides out again
    by_rank = lambda x, y: (x["rank"] - y["rank"]).cast("int")
    listed = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), F.col(at).alias("at"))), by_rank)
    needed = ranked.withColumn(block, F.shiftright(rank, BLOCK_BITS)).join(held.drop(found), block)
    blocks = needed.groupBy(block, lots).agg(F.transform(listed, lambda x: x["at"]).alias(held_in))
    blocks = blocks.withColumn(lot, F.explode(F.sequence(F.lit(0).cast("long"), F.col(lots) - 1))).drop(lots).repartition(tasks, block, lot)
    dealt = runs.join(held.drop(found), block).withColumn(lot, F.pmod(F.xxhash64(tie), lots)).repartition(tasks, block, lot)
    dealt = dealt.groupBy(block, lot).agg(F.collect_list(F.struct(a, b, F.struct(*theirs).alias(at))).alias(found))
    met = dealt.join(blocks.hint("merge"), [block, lot]).withColumn(base, F.explode(F.sequence(base_of, base_of + BLOCK - CHUNK, F.lit(CHUNK).cast("long"))))
    holds_all = lambda x: (x[a] <= F.col(base)) & (x[b] >= F.col(base) + CHUNK)
    holds_some = lambda x: (x[a] < F.col(base) + CHUNK) & (x[b] > F.col(base)) & ~holds_all(x)
    met = met.select(base, F.slice(held_in, (F.col(base) - base_of + 1).cast("int"), CHUNK).alias(held_in), found)
    met = met.withColumn(found, F.explode(F.concat(F.filter(found, holds_all), F.filter(found, holds_some))))
    start, end = F.greatest(F.col(found)[a], F.col(base)), F.least(F.col(found)[b], F.col(base) + CHUNK)
    held = F.slice(held_in, (start - F.col(base) + 1).cast("int"), (end - start).cast("int"))
    met = met.select(f"{found}.{at}.*", F.explode(F.when(holds_all(F.col(found)), F.col(held_in)).otherwise(held)).alias(at))
    return met.select(*by, *[F.col(at)[c].alias(c) for c in own], *[c for c in theirs if c not in by])
