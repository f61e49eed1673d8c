"""Order-dependent operators that keep no whole group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from factweave.session import write_through

#: rows of a group that one task sorts at once
SMALL_GROUP = 4096


def large_groups(df: DataFrame, group: list[str], rows: int) -> DataFrame:
    """The groups of more than `rows` rows, as a written table that is cheap to look into."""
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    return write_through(counts.filter(F.col("_n") > rows).select(*group), "large-groups")


def previous_row(df: DataFrame, group: list[str], segments: list[str], order: list[str], carry: list[str], out: str = "previous", small: int = SMALL_GROUP) -> DataFrame:
    """Adds struct `out` with the `carry` columns of the row before, per group in `order`.

    Groups of up to `small` rows are sorted whole, in one exchange. `segments` are leading columns
    of the order. In a larger group the lag runs inside (group, segments); only the last row of
    each segment is then carried to the next one. A hot group is therefore spread over its
    segments instead of being sorted in one task. Columns must not be null.
    """
    large = large_groups(df, group, small)
    lagged = lambda rows: rows.withColumn(out, F.lag(F.struct(*carry)).over(Window.partitionBy(*group).orderBy(*order)))
    if large.isEmpty():
        return lagged(df)
    few, many = (df.join(large, group, how) for how in ("left_anti", "left_semi"))
    apart = _previous_by_segments(many, group, segments, order, carry, out)
    return lagged(few).unionByName(apart.select(*df.columns, out))


def _previous_by_segments(df: DataFrame, group: list[str], segments: list[str], order: list[str], carry: list[str], out: str) -> DataFrame:
    everything = F.struct(*carry)
    inner = Window.partitionBy(*group, *segments).orderBy(*order)
    lagged = df.withColumn("_inside", F.lag(everything).over(inner))
    tails = df.groupBy(*group, *segments).agg(F.max_by(everything, F.struct(*order)).alias("_tail"))
    heads = _carry_over(tails, group, segments)
    same = [F.col(c) for c in [*group, *segments]]
    joined = lagged.join(heads, [c for c in [*group, *segments]], "left") if same else lagged
    return joined.withColumn(out, F.coalesce("_inside", "_before")).drop("_inside", "_before")


def _carry_over(tails: DataFrame, group: list[str], segments: list[str]) -> DataFrame:
    """For each segment, the tail of the segment before it (`_before`)."""
    outer, last = segments[:-1], segments[-1]
    w = Window.partitionBy(*group, *outer).orderBy(last)
    here = tails.withColumn("_near", F.lag("_tail").over(w))
    if not outer:
        return here.select(*group, *segments, F.col("_near").alias("_before"))
    ends = tails.groupBy(*group, *outer).agg(F.max_by("_tail", last).alias("_tail"))
    far = _carry_over(ends, group, outer)
    return here.join(far, [*group, *outer], "left").select(
        *group, *segments, F.coalesce("_near", "_before").alias("_before")
    )


def carry_forward(df: DataFrame, group: list[str], segments: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the last non-null `value` up to and including the row, per group in `order`.

    Works segment by segment like `previous_row`; segments hand on their last value.
    """
    known = F.col(value).isNotNull()
    inner = Window.partitionBy(*group, *segments).orderBy(*order)
    filled = df.withColumn("_inside", F.last(value, True).over(inner))
    tails = df.groupBy(*group, *segments).agg(
        F.max_by(F.when(known, F.col(value)), F.when(known, F.struct(*order))).alias("_tail")
    )
    heads = _hand_on(tails, group, segments)
    return filled.join(heads, [*group, *segments], "left").withColumn(out, F.coalesce("_inside", "_before")).drop("_inside", "_before")


def _hand_on(tails: DataFrame, group: list[str], segments: list[str]) -> DataFrame:
    outer, last = segments[:-1], segments[-1]
    w = Window.partitionBy(*group, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = tails.withColumn("_near", F.last("_tail", True).over(w))
    if not outer:
        return here.select(*group, *segments, F.col("_near").alias("_before"))
    known = F.col("_tail").isNotNull()
    ends = tails.groupBy(*group, *outer).agg(F.max_by(F.when(known, F.col("_tail")), F.when(known, F.col(last))).alias("_tail"))
    far = _hand_on(ends, group, outer)
    return here.join(far, [*group, *outer], "left").select(*group, *segments, F.coalesce("_near", "_before").alias("_before"))


def positions(df: DataFrame, group: list[str], segments: list[str], order: list[str], out: str = "position") -> DataFrame:
    """Adds `out`: 1, 2, 3 ... per group in `order`; segments are numbered alone and shifted by
    the number of rows in the segments before them."""
    inner = Window.partitionBy(*group, *segments).orderBy(*order)
    numbered = df.withColumn("_inside", F.row_number().over(inner))
    shifts = _shift(df.groupBy(*group, *segments).agg(F.count(F.lit(1)).alias("_n")), group, segments)
    return numbered.join(shifts, [*group, *segments]).withColumn(out, (F.col("_inside") + F.col("_shift")).cast("int")).drop("_inside", "_shift")


def _shift(sizes: DataFrame, group: list[str], segments: list[str]) -> DataFrame:
    outer, last = segments[:-1], segments[-1]
    w = Window.partitionBy(*group, *outer).orderBy(last).rowsBetween(Window.unboundedPreceding, -1)
    here = sizes.withColumn("_near", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    if not outer:
        return here.select(*group, *segments, F.col("_near").alias("_shift"))
    far = _shift(sizes.groupBy(*group, *outer).agg(F.sum("_n").alias("_n")), group, outer)
    return here.join(far, [*group, *outer]).select(*group, *segments, (F.col("_near") + F.col("_shift")).alias("_shift"))


def first_rows(df: DataFrame, group: list[str], order: list[Column], n: int, tie: str, salts: int = 64) -> DataFrame:
    """The first n rows of each group; salted slices are cut to n before the groups meet."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(tie), F.lit(salts)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    short = salted.withColumn("_rn", F.row_number().over(part)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    return short.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= n)
