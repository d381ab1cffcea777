"""Points in intervals, and intervals that overlap, by cells of time whose lengths are powers of two.

An interval of at most 2 ** k seconds lies in one or two cells of level k; a point lies in one cell of each level, and is looked up in the levels that intervals have. So
the join is one on equal cells, whatever the lengths, with the exact test after it, and neither a hot moment nor a hot key meets all intervals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: the highest level; times are cut to cells of half its length on either side of 1970 (some 280,000 years)
LEVELS = 44


def _bounded(moment: Column) -> Column:
    half = float(2 ** (LEVELS - 1))
    return F.greatest(F.lit(-half), F.least(F.lit(half - 1), moment.cast("double")))


def _cell(moment: Column, level: Column) -> Column:
    return F.floor(_bounded(moment) / F.pow(F.lit(2.0), level)).cast("long")


def _level(start: Column, finish: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(_bounded(finish) - _bounded(start))))).cast("int"), F.lit(0))


def fused(ranges: DataFrame, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """(on.., start, end): fewer half-open ranges that hold the same points, and overlap the same intervals, as those of ``ranges`` with equal ``on``; an open end is infinite.

    Ranges that overlap become one; those that only touch do not, as an empty interval between them overlaps neither. Ranges of like lengths meet by cells of 16 lengths, so no task gets all
    ranges of a key, and a moment is left in at most two ranges of each power of two of the lengths.
    """
    keys, finish = [*(on or []), "_level", "_cell"], F.coalesce(F.col(end).cast("double"), F.lit(float("inf")))
    own = ranges.where(F.col(start).isNotNull() & (finish > F.col(start))).select(*(on or []), F.col(start), finish.alias(end))
    own = own.withColumn("_level", _level(F.col(start), F.col(end))).withColumn("_cell", _cell(F.col(start), F.col("_level") + 4))
    own = own.groupBy(*keys, start).agg(F.max(end).alias(end))
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("_reach") > F.col(start), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_reach", reach).withColumn("_island", island).groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).select(*(on or []), start, end)


def covered(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """All columns of both for each point ``at`` within [start, end), with equal ``on``; no other column may be in both tables.

    Times are epoch seconds. An end that is null is open, ranges without a start or that are empty hold nothing, a point that is null is nowhere.
    """
    keys = on or []
    finish = F.coalesce(F.col(end), F.lit(float("inf")))
    r = ranges.where(F.col(start).isNotNull() & (finish > F.col(start))).withColumn("_level", _level(F.col(start), finish))
    used = [x[0] for x in r.select("_level").distinct().collect()]  # LEVELS + 1 at most
    r = r.withColumn("_cell", F.explode(F.sequence(_cell(F.col(start), F.col("_level")), _cell(finish, F.col("_level")))))
    p = points.where(F.col(at).isNotNull()).withColumn("_level", F.explode(F.array(*map(F.lit, used)) if used else F.array().cast("array<int>")))
    p = p.withColumn("_cell", _cell(F.col(at), F.col("_level")))
    return p.join(r, [*keys, "_level", "_cell"]).where((F.col(start) <= F.col(at)) & (F.col(at) < finish)).drop("_level", "_cell")


def overlapping(rows: DataFrame, ranges: DataFrame, row_start: str, row_end: str, start: str, end: str, on: list[str] | None = None) -> DataFrame:
    """All columns of both for rows that overlap half-open ranges, each pair once; a row without an end is a point. No other column than ``on`` may be in both tables."""
    first = covered(rows, ranges, row_start, start, end, on)
    spans = rows.where(F.col(row_end).isNotNull())
    second = covered(ranges.where(F.col(end).isNull() | (F.col(end) > F.col(start))), spans, start, row_start, row_end, on).where(F.col(start) > F.col(row_start))
    both = first.unionByName(second.select(first.columns))
    return both.where(T.overlaps(F.col(row_start), F.col(row_end), F.col(start), F.coalesce(F.col(end), F.lit(float("inf")))))
