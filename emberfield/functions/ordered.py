"""Order-dependent results without a single-task global sort.

A window with no partition key, or ``percentile`` over a whole table, moves
every row into one task. These helpers split the value range at approximate
quantiles, work inside the ranges, and add the totals of the ranges before
them. The split points only balance the work; the results are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Ranges are found in two steps, a coarse one and one inside it, so that a row is compared with 2 * 32 split points.
_RANGES = 32 * 32
#: Rank error of the split points, as a part of the rows.
_ACCURACY = 20_000


def _split_points(df: DataFrame, key: str, value: Column, parts: int) -> DataFrame:
    """``(key, _splits)``: ascending values that cut the rows of a key into about equal parts, all and every step-th."""
    points = df.groupBy(key).agg(
        F.percentile_approx(value, F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(_ACCURACY)).alias("all")
    )
    every = F.coalesce(F.col("all"), F.array().cast("array<double>"))
    coarse = F.filter(every, lambda s, i: (i + 1) % math.isqrt(parts) == 0)
    return points.select(key, F.struct(every.alias("all"), coarse.alias("coarse")).alias("_splits"))


def _range_of(value: Column, splits: Column, parts: int) -> Column:
    """How many split points lie below the value: first whole steps of them, then single ones."""
    step = math.isqrt(parts)
    coarse = F.size(F.filter(splits["coarse"], lambda s: s < value))
    inside = F.slice(splits["all"], coarse * step + 1, F.lit(step))
    return coarse * step + F.size(F.filter(inside, lambda s: s < value))


def running_totals(
    df: DataFrame, order_by: str, sums: list[str], by: str | None = None, parts: int = _RANGES
) -> DataFrame:
    """Add ``<name>_upto``: inclusive running sums in ascending ``order_by``.

    ``order_by`` must be numeric, and unique inside each group of ``by`` (fold
    equal values first). ``by`` names a handful of independent series. A task sorts one range of
    ``parts``; Spark joins small ranges into one task.
    """
    series = df.withColumn("_series", F.col(by) if by else F.lit(0))
    # One row per series, an array of at most `parts - 1` numbers in each. The
    # summed columns are named in the condition so that both uses of the input
    # read the same columns and Spark runs its shuffle once.
    usable = F.lit(True)
    for s in sums:
        usable = usable & (F.col(s) >= 0)
    splits = _split_points(series, "_series", F.when(usable, F.col(order_by).cast("double")), parts)
    if by:
        located = series.join(F.broadcast(splits), "_series")
    else:
        located = series.withColumn("_splits", splits.select("_splits").scalar())
    place = _range_of(F.col(order_by).cast("double"), F.col("_splits"), parts)
    ranged = located.withColumn("_range", place).drop("_splits")
    # At most `parts` rows per series, in the totals and in the window on them.
    totals = ranged.groupBy("_series", "_range").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    earlier = (
        Window.partitionBy("_series").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    )
    before = totals.select(
        "_series",
        "_range",
        *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums],
    )
    inside = (
        Window.partitionBy("_series", "_range")
        .orderBy(order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = ranged.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums])
    return running.join(F.broadcast(before), ["_series", "_range"]).select(
        *df.columns,
        *[(F.col(f"_i_{s}") + F.col(f"_b_{s}")).alias(f"{s}_upto") for s in sums],
    )


def _narrowed(values: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of the values that hold an asked rank, and the ranks inside these.

    ``values`` has ``(key, v, n)``, distinct values with their counts; ``asked`` has ``(key, column, share, end,
    rank)``: which value of ``key`` stands at ``rank``, counted from 0. The result has the same columns, with
    ``key`` now the old key and the number of the range.
    """
    # All of n is named, so that Spark reads the values once for split points and ranges.
    splits = _split_points(values, "key", F.when(F.col("n") > 0, F.col("v")), _RANGES)
    # Keys are columns, or ranges that hold an asked rank: at most two per asked share, each with 1023 numbers.
    ranged = values.join(F.broadcast(splits), "key").select(
        F.struct("key", _range_of(F.col("v"), F.col("_splits"), _RANGES).alias("at")).alias("key"), "v", "n"
    )
    # At most 1024 rows per key.
    totals = ranged.groupBy("key").agg(F.sum("n").alias("n")).withColumn("old", F.col("key.key"))
    earlier = Window.partitionBy("old").orderBy("key.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = totals.withColumn("upto", F.sum("n").over(earlier)).withColumn("before", F.col("upto") - F.col("n"))
    inner = asked.withColumnRenamed("key", "old").join(bounds, "old").where("before <= rank and rank < upto").select(
        "key", "column", "share", "end", (F.col("rank") - F.col("before")).alias("rank")
    )
    return ranged.join(F.broadcast(inner.select("key").distinct()), "key", "left_semi"), inner


def exact_quantiles(df: DataFrame, wanted: dict[str, list[float]]) -> DataFrame:
    """Exact quantiles with linear interpolation: rows ``(column, share, value)``.

    Selection by narrowing: values are counted per range and only ranges that hold an asked rank are kept
    and sorted, about a thousandth of the distinct values per asked rank. All columns are unpivoted and counted in one scan. Equal values collapse before anything is
    ordered, so a value that fills a third of the table is one row from then on. Nulls and NaN are left out;
    a column without other values has no rows in the result.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in wanted]
    )
    values = (
        df.select(F.inline(pairs))
        .where("v is not null and not isnan(v)")
        .groupBy("column", "v")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumnRenamed("column", "key")
    )
    shares = F.lit(None).cast("array<double>")
    for c, own in wanted.items():
        shares = F.when(F.col("key") == c, F.array(*[F.lit(float(s)) for s in sorted(set(own))])).otherwise(shares)
    place = F.col("share") * (F.col("rows") - F.lit(1)).cast("double")
    ends = F.array(
        F.struct(F.lit("lo").alias("end"), F.floor(place).alias("rank")),
        F.struct(F.lit("hi").alias("end"), F.ceil(place).alias("rank")),
    )
    # Two rows per column and share.
    points = values.groupBy("key").agg(F.sum("n").alias("rows")).select("key", "rows", F.explode(shares).alias("share"))
    asked = points.select("key", F.col("key").alias("column"), "share", F.inline(ends))
    left, inner = _narrowed(values, asked)
    running = Window.partitionBy("key").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sorted_values = left.withColumn("upto", F.sum("n").over(running)).withColumn("before", F.col("upto") - F.col("n"))
    found = sorted_values.join(F.broadcast(inner), "key").where("before <= rank and rank < upto")
    picked = found.groupBy("column", "share").agg(
        F.max(F.when(F.col("end") == "lo", F.col("v"))).alias("lo"),
        F.max(F.when(F.col("end") == "hi", F.col("v"))).alias("hi"),
    )
    placed = points.select(F.col("key").alias("column"), "share", (place - F.floor(place)).alias("w"))
    lo, hi = F.col("lo"), F.col("hi")
    return picked.join(F.broadcast(placed), ["column", "share"]).select(
        "column", "share", (lo + (hi - lo) * F.col("w")).alias("value")
    )


def keep_one(
    df: DataFrame, keys: list[str], order: list[str | Column], last: bool = False
) -> DataFrame:
    """One row per key, the first (or last) in the given order.

    An aggregate with map-side combine instead of ``row_number``: copies of a
    key that repeats millions of times are folded before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    pick = F.max_by if last else F.min_by
    folded = df.groupBy(*keys).agg(pick(F.struct(*rest), by).alias("_row"))
    return folded.select(
        *[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns]
    )


def with_share(df: DataFrame, count: str = "n", share: str = "share") -> DataFrame:
    """Divide each group's count by the total, read as a scalar subquery."""
    total = df.agg(F.sum(count).alias("total")).scalar()
    return df.withColumn(share, F.col(count) / total)
