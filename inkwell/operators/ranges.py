"""Joins of ranges in one dimension or more: intervals of time, boxes on a page.

A range has a level by its longest side: cells of that level are at least as long as the range, so it lies in two of them in each dimension at most. Rows are dealt
to the cells of their own level and of the longer levels of the other side, meet there in an equi-join, and are compared exactly after it. A pair is found at the longer of its two
levels, in the cell where both have begun, and so once. Nothing is compared with all of the other side, however long a range is.

A cell of over a thousandth of a side's rows is split: each side's rows of it are dealt out and repeated for the parts of the other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.plans.lineage import cut

#: Bits between the cell sizes of two levels; hot: over one in so many rows of a side.
STEP, HOT_SHARE = 2, 1000
#: A range of numbers is cut in steps of a millionth.
SCALE = 1_000_000
Range = tuple[str, str]


def _ticks(df: DataFrame, name: str) -> Column:
    """A place on the axis as a long, in the order of the column: microseconds, days, whole numbers, or millionths of others (rounded down: cells alone depend on it)."""
    kind, c = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp"))
    if kind == "date":
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    if kind in ("tinyint", "smallint", "int", "bigint"):
        return c.cast("long")
    return F.floor(c * SCALE).cast("long")


def _sided(df: DataFrame, ranges: Sequence[Range], by: Sequence[str]) -> DataFrame:
    """(row, keys k0.., starts s0.., ends e0.., own): rows with a null or an end before its start meet nothing."""
    starts = [_ticks(df, a) for a, _ in ranges]
    ends = [_ticks(df, b) for _, b in ranges]
    out = df.select(F.struct("*").alias("row"), *(F.col(f"`{c}`").alias(f"k{k}") for k, c in enumerate(by)), *(c.alias(f"s{k}") for k, c in enumerate(starts)), *(c.alias(f"e{k}") for k, c in enumerate(ends)))
    good = reduce(lambda a, b: a & b, [F.col(f"s{k}") <= F.col(f"e{k}") for k in range(len(ranges))] + [F.col(f"k{k}").isNotNull() for k in range(len(by))])
    sides = [F.col(f"e{k}") - F.col(f"s{k}") for k in range(len(ranges))]
    longest = F.greatest(*sides) if len(sides) > 1 else sides[0]
    # STEP bits a level; a side of 0 has level 0
    return out.where(good).withColumn("own", F.when(longest > 0, F.ceil(F.length(F.bin(longest)) / STEP)).otherwise(0).cast("int"))


def _cell(x: Column, level: Column) -> Column:
    return F.call_function("shiftright", x, level * STEP)


def _celled(side: DataFrame, others: list[int], dims: int) -> DataFrame:
    """A row for each cell in which the range may meet one of the other side; others: the levels there."""
    longer = F.filter(F.array(*map(F.lit, others)).cast("array<int>"), lambda x: x > F.col("own"))
    out = side.withColumn("level", F.explode(F.concat(F.array("own"), longer)))
    for k in range(dims):
        out = out.withColumn(f"c{k}", F.explode(F.sequence(_cell(F.col(f"s{k}"), F.col("level")), _cell(F.col(f"e{k}"), F.col("level")))))
    return out


def overlapping(left: DataFrame, right: DataFrame, left_ranges: Sequence[Range], right_ranges: Sequence[Range], by: Sequence[str] = (), closed: bool = True) -> DataFrame:
    """All pairs of rows whose ranges overlap in every dimension and whose columns ``by`` are equal: structs ``left`` and ``right``.

    closed: ends belong to their ranges, so ranges that touch overlap and a point is a range of length 0; else ends do not. Rows with a null in a range or a key, or
    with an end before its start, meet nothing. Repeated rows meet as often as they stand. Empty sides give no pairs.
    """
    dims = len(left_ranges)
    keys = [f"k{k}" for k in range(len(by))]
    sides = [cut(_sided(df, r, by)) for df, r in ((left, left_ranges), (right, right_ranges))]
    levels = [sorted(r.own for r in s.select("own").distinct().collect()) for s in sides]  # 33 at most
    place = [*keys, "level", *(f"c{k}" for k in range(dims))]
    dealt = [_celled(s, o, dims) for s, o in zip(sides, reversed(levels), strict=True)]
    full = []
    for d in dealt:
        total = d.count()
        n = d.groupBy(*place).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * HOT_SHARE > total)  # under HOT_SHARE cells
        full.append(n.select(*place, F.ceil(F.col("n") * HOT_SHARE / F.lit(max(total, 1))).cast("int").alias("parts")))
    hot = cut(full[0].withColumnRenamed("parts", "a").join(full[1].withColumnRenamed("parts", "b"), place, "full").na.fill(1, ["a", "b"]))

    def split(d: DataFrame, own: str, other: str) -> DataFrame:
        found = d.join(F.broadcast(hot), place, "left").na.fill(1, ["a", "b"])  # under 2 HOT_SHARE rows
        found = found.withColumn(own, F.pmod(F.monotonically_increasing_id(), F.col(own)).cast("int"))
        return found.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))

    names = [c for c in dealt[0].columns if c not in place]
    one = split(dealt[0], "a", "b").withColumnsRenamed({c: f"l_{c}" for c in names})
    two = split(dealt[1], "b", "a").withColumnsRenamed({c: f"r_{c}" for c in names})
    both = one.join(two, [*place, "a", "b"])
    once = F.col("level") == F.greatest("l_own", "r_own")
    for k in range(dims):
        once = once & (F.col(f"c{k}") == _cell(F.greatest(f"l_s{k}", f"r_s{k}"), F.col("level")))
    found = both.where(once).select(F.col("l_row").alias("left"), F.col("r_row").alias("right"))
    for (ls, le), (rs, re) in zip(left_ranges, right_ranges, strict=True):
        a, b = (F.col("left")[ls], F.col("right")[re]), (F.col("right")[rs], F.col("left")[le])
        found = found.where((a[0] <= a[1]) & (b[0] <= b[1]) if closed else (a[0] < a[1]) & (b[0] < b[1]))
    return found


def covered(points: DataFrame, ranges: DataFrame, at: str, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of a point and a range that holds it, ends included: structs ``left`` (of ``points``) and ``right``."""
    return overlapping(points, ranges, [(at, at)], [(start, end)], by)


def box_overlaps(boxes: DataFrame, others: DataFrame, by: Sequence[str], share: float = 0.5) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1, ...) of a page of which the second covers more than ``share`` of the first's area: structs ``left`` and ``right``. A box without an area is covered by none."""
    corners = [("x0", "x1"), ("y0", "y1")]
    pairs = overlapping(boxes, others, corners, corners, by)
    side = lambda a, b: F.least(F.col("left")[b], F.col("right")[b]) - F.greatest(F.col("left")[a], F.col("right")[a])
    area = (F.col("left.x1") - F.col("left.x0")) * (F.col("left.y1") - F.col("left.y0"))
    return pairs.where((area > 0) & (side("x0", "x1") * side("y0", "y1") > area * share))
