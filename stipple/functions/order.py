"""Exact order statistics that stay distributed when one group is huge.

``percentile`` keeps every distinct value of a group in one task's memory and a
ranking window sorts a whole group in one task.  Both helpers below first count
equal values (map-side combined, hashed on group *and* value) into a written
table, then look at the size of the largest group.  Small groups use the
built-in way.  Otherwise each group's value range is cut into slices at
approximate quantiles; slices only decide where work runs, ranks come from exact
slice totals, so both ways give the same exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stipple.session import cut

#: distinct values per group that one task may sort or hold
SMALL_GROUP = 500_000
SLICES = 64


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` that also matches null keys."""
    cond = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_r_{k}")
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(right, cond, how).drop(*[f"_r_{k}" for k in keys])


def _distinct(df: DataFrame, by: Sequence[str], value: str, weight: str | None,
              extra: Sequence[Column] = ()) -> tuple[DataFrame, int]:
    """Written table of distinct values with their count, and the largest
    number of them in a group."""
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    table = cut(df.groupBy(*by, value).agg(times.alias("_n"), *extra), "values")
    largest = table.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    return table, largest


def _sliced(table: DataFrame, by: Sequence[str], value: str, slices: int):
    """(values with slice number, slice totals with offset)."""
    probs = [i / slices for i in range(1, slices)]
    cuts = table.groupBy(*by).agg(
        F.percentile_approx(value, probs, 20 * slices).alias("_cuts"), F.sum("_n").alias("_total")
    )
    placed = _join(table, cuts, by).withColumn(
        "_slice", F.size(F.filter("_cuts", lambda c: c < F.col(value)))
    ).drop("_cuts")
    totals = placed.groupBy(*by, "_slice").agg(F.sum("_n").alias("_in_slice"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return placed, totals.withColumn(
        "_before", F.coalesce(F.sum("_in_slice").over(before), F.lit(0))
    )


def _running(by: Sequence[str], value: str):
    return Window.partitionBy(*by).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def average_ranks(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    extra: Sequence[Column] = (),
    weight: str | None = None,
    small_group: int = SMALL_GROUP,
    slices: int = SLICES,
) -> DataFrame:
    """Distinct values per group with their tie-averaged rank.

    Returns ``by, value, ties, rank, group_n`` plus the ``extra`` aggregates
    (for example one ``count_if`` per class), one row per distinct value.
    ``weight`` names a whole-number column saying how often a row counts.
    """
    by = list(by)
    one = not by
    if one:
        df, by = df.withColumn("_all", F.lit(1)), ["_all"]
    table, largest = _distinct(df, by, value, weight, extra)
    if largest <= small_group:
        upto = F.sum("_n").over(_running(by, value))
        total = F.sum("_n").over(Window.partitionBy(*by))
        out = table.withColumns({"_upto": upto, "_total": total})
    else:
        placed, totals = _sliced(table, by, value, slices)
        out = _join(placed, totals, [*by, "_slice"]).withColumn(
            "_upto", F.col("_before") + F.sum("_n").over(_running([*by, "_slice"], value))
        ).drop("_slice", "_in_slice", "_before")
    out = out.withColumn(
        "rank", (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).cast("double")
    ).drop("_upto").withColumnRenamed("_n", "ties").withColumnRenamed("_total", "group_n")
    return out.drop("_all") if one else out


def quantiles(
    df: DataFrame,
    by: Sequence[str],
    columns: Sequence[str],
    probs: dict[str, float],
    weight: str | None = None,
    small_group: int = SMALL_GROUP,
    slices: int = SLICES,
) -> DataFrame:
    """Exact linearly interpolated quantiles of several columns per group.

    Returns ``by, metric, n`` and one column per entry of ``probs``; nulls are
    skipped.  Works on the whole table when ``by`` is empty.  ``weight`` names
    a whole-number column saying how often a row counts, so a block of zeros
    can be one row.
    """
    also = [weight] if weight else []
    pairs = F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_v")) for c in columns
    ])
    long = (
        df.select(*by, *also, F.explode(pairs).alias("_p"))
        .select(*by, *also, "_p.metric", "_p._v")
        .where(F.col("_v").isNotNull())
    )
    if weight:
        long = long.where(F.col(weight) > 0)
    keys = [*by, "metric"]
    table, largest = _distinct(long, keys, "_v", weight)
    if largest <= small_group:
        got = table.groupBy(*keys).agg(
            F.sum("_n").alias("n"),
            F.percentile("_v", [float(p) for p in probs.values()], F.col("_n")).alias("_q"),
        )
        return got.select(*keys, "n", *[F.col("_q")[i].alias(a) for i, a in enumerate(probs)])
    return _sliced_quantiles(table, keys, probs, slices)


def _sliced_quantiles(table: DataFrame, keys: list[str], probs: dict[str, float], slices: int) -> DataFrame:
    placed, totals = _sliced(table, keys, "_v", slices)
    totals = totals.withColumn("_total", F.sum("_in_slice").over(Window.partitionBy(*keys)))
    lows = {a: F.floor((F.col("_total") - 1) * F.lit(float(p))) for a, p in probs.items()}
    highs = {a: F.ceil((F.col("_total") - 1) * F.lit(float(p))) for a, p in probs.items()}
    wanted = F.lit(False)
    for t in [*lows.values(), *highs.values()]:
        wanted = wanted | ((t >= F.col("_before")) & (t < F.col("_before") + F.col("_in_slice")))
    # only the few slices that hold a wanted rank are sorted
    rows = _join(placed, totals.where(wanted).drop("_total"), [*keys, "_slice"])
    rows = rows.withColumn(
        "_to", F.col("_before") + F.sum("_n").over(_running([*keys, "_slice"], "_v"))
    ).withColumn("_from", F.col("_to") - F.col("_n"))

    def at(t: Column) -> Column:
        return F.max(F.when((t >= F.col("_from")) & (t < F.col("_to")), F.col("_v")))

    picks = [at(lows[a]).alias(f"_lo_{a}") for a in probs] + [at(highs[a]).alias(f"_hi_{a}") for a in probs]
    picked = rows.groupBy(*keys).agg(F.max("_total").alias("n"), *picks)
    out = [*[F.col(k) for k in keys], F.col("n")]
    for a, p in probs.items():
        pos = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{a}"), F.col(f"_hi_{a}")
        out.append((lo + (hi - lo) * (pos - F.floor(pos))).alias(a))
    return picked.select(*out)


def median(df: DataFrame, by: Sequence[str], column: str, alias: str = "median") -> DataFrame:
    """Exact median of one column per group: ``by, alias``."""
    return quantiles(df, by, [column], {alias: 0.5}).select(*by, alias)


def numbered(df: DataFrame, order: Sequence[str], by: Sequence[str] = (), name: str = "rank",
             size: str | None = None, part: str | None = None) -> DataFrame:
    """Rows numbered 0, 1, ... in the order of ``order`` within each ``by``.

    The rows are cut into ranges of (by, order), sorted and written once with
    their place in the range; the few totals per (by, range) then give every
    range its first number.  No task sorts more than a range, however large
    the table or a group is.  ``size`` names a column for the rows of the
    group, ``part`` one for the number of the range, which ascends with the
    rows of a group.  Nulls come first and are a group of their own.  Rows that
    tie on ``by`` and ``order`` share a range and are numbered in any order.
    """
    by, keys = list(by), [*by, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    # the id of a row is its partition times 2^33 plus its place there
    placed = cut(placed, "numbered").withColumns({
        "_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    totals = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_in_range"), F.min("_at").alias("_first"))
    whole = Window.partitionBy(*by)  # one row per range
    before = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *by, "_range", (F.coalesce(F.sum("_in_range").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
        *([F.sum("_in_range").over(whole).alias(size)] if size else []))
    out = _join(placed, totals, [*by, "_range"]).withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_shift")
    return out.withColumnRenamed("_range", part) if part else out.drop("_range")


def running_min_from_end(df: DataFrame, value: Column, by: Sequence[str], at: str, part: str, name: str) -> DataFrame:
    """Adds the least ``value`` of a row and of all rows after it in its group.

    ``at`` and ``part`` are the number and the range of :func:`numbered`; the
    minima of the later ranges are carried over, so a window spans one range.
    """
    by = list(by)
    df = df.withColumn("_v", value)
    later = Window.partitionBy(*by).orderBy(F.desc(part)).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    after = df.groupBy(*by, part).agg(F.min("_v").alias("_low")).select(*by, part, F.min("_low").over(later).alias("_after"))
    here = Window.partitionBy(*by, part).orderBy(F.desc(at)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return _join(df, after, [*by, part]).withColumn(name, F.least(F.min("_v").over(here), "_after")).drop("_v", "_after")


def running_sum_before(df: DataFrame, value: Column, by: Sequence[str], at: str, part: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row in its group, 0 for the first.

    ``at`` and ``part`` are the number and the range of :func:`numbered`; the
    totals of the earlier ranges are carried over, so a window spans one range.
    """
    by = list(by)
    df = df.withColumn("_v", value)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    before = df.groupBy(*by, part).agg(F.sum("_v").alias("_s")).select(
        *by, part, F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_before"))
    here = Window.partitionBy(*by, part).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return _join(df, before, [*by, part]).withColumn(
        name, F.col("_before") + F.coalesce(F.sum("_v").over(here), F.lit(0))).drop("_v", "_before")
