"""Numbers for the rows of a table of any size, in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from palisark.session import fresh_name, small_side, written


def numbered(rows: DataFrame, *order: str | Column, name: str = "n") -> DataFrame:
    """``rows`` with ``name``: 0 for the first by ``order``, 1 for the next, and so on without gaps; equal ones in any order.

    Rows are range-partitioned and sorted, each partition counts its own, and a prefix sum over the partitions' counts
    tells where each begins: no task and no driver holds more than a partition's rows or one count a partition.
    """
    seq, part, first, before = (fresh_name(x, rows.columns) for x in ("seq", "part", "first", "before"))
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(seq, F.monotonically_increasing_id())
    spread = written(spread, "ordered").withColumn(part, F.shiftrightunsigned(seq, 33))
    held = spread.groupBy(part).agg(F.count("*").alias(before), F.min(seq).alias(first))
    held = held.withColumn(before, F.sum(before).over(W.orderBy(part)) - F.col(before))  # a row for each partition
    return spread.join(small_side(held, "parts"), part).withColumn(name, F.col(seq) - F.col(first) + F.col(before)).drop(seq, part, first, before)


def first_titles(rows: DataFrame, by: list[str], *order: str | Column, most: int = 5, name: str = "first_titles") -> DataFrame:
    """For each group the first ``most`` distinct titles by ``order`` (columns of ``rows``), as an array.

    Repeated rows are dropped in the tasks that read them, and each task sends ``most`` rows of a group at most.
    """
    place = fresh_name("place", rows.columns)
    ranked = rows.distinct().withColumn(place, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(place) <= most)
    listed = F.array_sort(F.collect_list(F.struct(F.col(place).alias("place"), "title")))
    return ranked.groupBy(*by).agg(F.transform(listed, lambda x: x["title"]).alias(name))
