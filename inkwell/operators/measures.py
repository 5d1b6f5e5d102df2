"""Column widths of tables by water filling, and exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkwell.plans.lineage import cut

#: What a cell needs beside its text.
PADDING = 12.0
#: Bins of a histogram; distinct values of a group that one window may sort; hot: over one in so many rows; groups that are broadcast.
BINS, FEW, HOT_SHARE = 1024, 100_000, 1000


def cell_sizes(cells: DataFrame, by: Sequence[str], column: str, text: str, character: float) -> DataFrame:
    """(by, column, weight, least): of each column the length of its longest cell, 1 at least, and the width of its longest word with the padding."""
    words = F.transform(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), F.length)
    return cells.groupBy(*by, column).agg(F.greatest(F.max(F.length(F.coalesce(F.col(text), F.lit("")))), F.lit(1)).cast("double").alias("weight"), (F.max(F.array_max(words)) * character + PADDING).alias("least"))


def widths(columns: DataFrame, by: Sequence[str], total: float) -> DataFrame:
    """``columns`` (by, column, weight, least) with ``width``: in proportion to the weights, none below its least width; where these alone are too wide, all in proportion to them.

    The water level, closed: with columns in the order of least / weight, the k first at their least width leave a level to the others; the level is the lowest of
    all k. A table's columns meet in a task, its cells do not.
    """
    order = Window.partitionBy(*by).orderBy(F.desc(F.col("least") / F.col("weight")), F.desc("least"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    sums = columns.withColumn("taken", F.coalesce(F.sum("least").over(before), F.lit(0.0))).withColumn("mass", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    level = F.min((F.lit(total) - F.col("taken")) / F.col("mass")).over(whole)
    least = F.sum("least").over(whole)
    return sums.withColumn("width", F.when(least >= total, F.col("least") * total / least).otherwise(F.greatest(F.col("least"), level * F.col("weight")))).drop("taken", "mass")


def _with(rows: DataFrame, groups: DataFrame, by: Sequence[str], total: int) -> DataFrame:
    """Rows with their group's row: hot groups, under HOT_SHARE, broadcast, the others by a shuffle."""
    named = groups.withColumnsRenamed({c: f"of_{c}" for c in by})
    on = [F.col(f"g_{c}").eqNullSafe(F.col(f"of_{c}")) for c in by]
    sided = rows.withColumnsRenamed({c: f"g_{c}" for c in by})
    hot = F.col("n") * HOT_SHARE > total
    often = F.broadcast(named.where(hot))
    both = sided.join(often, on).unionByName(sided.join(often, on, "left_anti").join(named.where(~hot), on))
    return both.drop(*(f"of_{c}" for c in by)).withColumnsRenamed({f"g_{c}": c for c in by})


def _bin(v: Column, low: Column, high: Column) -> Column:
    """-1 below, BINS above the range; within it the bin."""
    limited = (low > float("-inf")) & (high < float("inf")) & (high > low)
    share = F.when(limited, (v / 2 - low / 2) / (high / 2 - low / 2)).otherwise(0.0)  # halves: the range of all doubles is no double
    return F.when(v < low, -1).when(F.isnan(v) | (v > high), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1))).cast("int")


def medians(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """(by, n, median): the exact median of each group's values that are not null; of an even number the mean of the two in the middle. NaN is the largest value.

    A group is never sorted or held whole: its values are counted in bins, and only the bins that hold its middle are looked into, in smaller bins, until few
    distinct values are left. All counts are summed before they are shuffled.
    """
    rows = df.select(*by, F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL")
    finite = F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min(finite), F.lit(0.0)).alias("low"), F.coalesce(F.max(finite), F.lit(0.0)).alias("high"))
    groups = cut(groups.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("rank", F.floor((F.col("n") + 1 + F.col("side")) / 2)).withColumn("skipped", F.lit(0).cast("long")))
    total = groups.where("side = 0").agg(F.sum("n")).first()[0] or 0
    order = Window.partitionBy(*by, "side").orderBy("bin")
    known = []
    while True:
        # a bin beyond the finite range holds one or two values: infinities, NaN
        binned = _with(rows, groups, by, total).withColumn("bin", _bin(F.col("v"), F.col("low"), F.col("high")))
        if known:
            binned = binned.where(F.col("v").between(F.col("low"), F.col("high")))
        counts = binned.groupBy(*by, "n", "side", "rank", "skipped", "bin").agg(F.count(F.lit(1)).alias("here"), F.min("v").alias("least"), F.max("v").alias("most"), F.approx_count_distinct("v").alias("kinds"))
        upto = counts.withColumn("upto", F.col("skipped") + F.sum("here").over(order))
        middle = cut(upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("here") < F.col("rank"))).withColumn("skipped", F.col("upto") - F.col("here")))
        single = (F.col("least") == F.col("most")) | (F.isnan("least") & F.isnan("most"))
        known.append(middle.where(single).select(*by, "n", "side", F.col("least").alias("v")))
        groups = cut(middle.where(~single).select(*by, "n", F.col("least").alias("low"), F.col("most").alias("high"), "side", "rank", "skipped", "kinds"))
        left = groups.agg(F.count(F.lit(1)), F.max("kinds")).first()
        groups = groups.drop("kinds")
        if not left[0]:
            break
        if left[1] <= FEW:
            inside = _with(rows, groups, by, total).where((F.col("v") >= F.col("low")) & (F.col("v") <= F.col("high")))
            values = inside.groupBy(*by, "n", "side", "rank", "skipped", "v").agg(F.count(F.lit(1)).alias("here"))
            upto = values.withColumn("upto", F.col("skipped") + F.sum("here").over(Window.partitionBy(*by, "side").orderBy("v")))
            known.append(upto.where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("here") < F.col("rank"))).select(*by, "n", "side", "v"))
            break
    found = known[0]
    for more in known[1:]:
        found = found.unionByName(more)
    low, high = F.max(F.when(F.col("side") == 0, F.col("v"))), F.max(F.when(F.col("side") == 1, F.col("v")))
    return found.groupBy(*by, "n").agg(F.when(low == high, low).otherwise((low + high) / 2).alias("median"))
