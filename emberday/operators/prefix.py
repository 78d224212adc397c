"""Running totals, ranks and exact quantiles without a single-task sort.

A plain ``sum().over(partitionBy(keys).orderBy(value))`` sorts every row of a key in
one task, and one key (one model, or no key at all) may hold most of the data. Here
each key is cut into ordered cells whose bounds are approximate quantiles of the key's own
distinct values, from a mergeable summary: cells hold about the same number of values
however these crowd, and outliers or a missing stamp move no bound. Only the per-cell
totals, at most ``CELLS`` rows per key, are summed per key; the running sum inside a cell
is a window of its own. All totals are integers, so a recomputed task gives the same
answer as the lost one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from emberday.session import release, written

# A power of two: a value finds its cell in log2(CELLS) steps.
CELLS = 512
# Ranks of the bounds are off by at most one in so many values, a fortieth of a cell.
_SUMMARY = 40 * CELLS
# A key with at most so many values is not cut: one task orders them.
_ONE_CELL = 8 * CELLS
# Rows meet the bounds of their key in so many parts of it, so that no task gets a whole key.
_PARTS = 64


def splitters(value: Column) -> Column:
    """Aggregate: the ``CELLS - 1`` inner bounds of a numeric column's distinct values."""
    shares = F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)])
    return F.percentile_approx(value.cast("double"), shares, F.lit(_SUMMARY))


def cell_of(value: Column, bounds: Column) -> Column:
    """Number of bounds not above a value, by halving; null values are in the first cell."""
    steps = [1 << k for k in reversed(range(CELLS.bit_length() - 1))]
    number = value.cast("double")
    found = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: at + F.when(F.get(bounds, at + step - 1) <= number, step).otherwise(F.lit(0)),
    )
    return F.coalesce(found, F.lit(0))


def _celled(df: DataFrame, keys: Sequence[str], value: str, total: str) -> DataFrame:
    """``df``, one row per (keys, value), with the cell of each value within its key.

    Taking a total along keeps the summary on top of ``df``'s own aggregate, not of raw rows.
    Keys with few values are one cell, without a summary: of stations there may be millions.
    Rows are never exchanged by the keys alone: a key is dealt into parts by a hash of the value.
    """
    if keys:
        spread = [*keys, "_part"]
        dealt = df.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(_PARTS)).cast("int"))
        parts = dealt.groupBy(*spread).agg(F.count(F.lit(1)).alias("_values"), F.sum(total).alias("_some"))
        sizes = parts.groupBy(*keys).agg(F.sum("_values").alias("_values"), F.sum("_some").alias("_some"))
        sizes = sizes.filter(F.col("_some").isNotNull())
        large = sizes.filter(F.col("_values") > _ONE_CELL).select(*keys)
        crowded = dealt.join(parts.select(*spread).join(large, list(keys), "left_semi"), spread, "left_semi")
        bounds = crowded.groupBy(*keys).agg(splitters(F.col(value)).alias("_bounds"))
        per_part = parts.select(*spread).join(sizes.select(*keys).join(bounds, list(keys), "left"), list(keys))
        bounded = dealt.join(per_part, spread).drop("_part")
    else:
        found = df.agg(splitters(F.col(value)).alias("_bounds"), F.sum(total).alias("_some"))
        one = found.select(F.when(F.col("_some").isNotNull(), F.col("_bounds"))).scalar()
        bounded = df.withColumn("_bounds", one)
    return bounded.withColumn("_cell", cell_of(F.col(value), F.col("_bounds"))).drop("_bounds")


def running_totals(
    df: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str], descending: bool = False
) -> DataFrame:
    """Add inclusive running sums ``cum_*`` and key totals ``all_*`` of integer columns.

    ``df`` holds one row per (keys, value), neither null; ``value`` is numeric. The window
    inside the cells and the join of the offsets share one partitioning and order, so rows
    are exchanged once. With keys, ``df`` and its cells are computed once, when this is called.
    """
    direction = F.desc if descending else F.asc
    if keys:  # several steps read the rows, and two their cells
        rows = written(df, "totals")
        celled = written(_celled(rows, keys, value, sums[0]), "cells")
        release(rows)
    else:
        celled = _celled(df, keys, value, sums[0])
    cells = celled.groupBy(*keys, "_cell").agg(*[F.sum(s).alias(s) for s in sums])
    per_key = W.partitionBy(*keys)
    earlier = per_key.orderBy(direction("_cell")).rowsBetween(W.unboundedPreceding, -1)
    offsets = cells.select(
        *keys,
        "_cell",
        *[F.coalesce(F.sum(s).over(earlier), F.lit(0)).alias(f"_before_{s}") for s in sums],
        *[F.sum(s).over(per_key).alias(f"all_{s}") for s in sums],
    )

    inside = (
        W.partitionBy(*keys, "_cell")
        .orderBy(direction(value))
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    local = celled.select("*", *[F.sum(s).over(inside).alias(f"_in_{s}") for s in sums])
    return (
        local.join(offsets, [*keys, "_cell"])
        .withColumns({f"cum_{s}": F.col(f"_in_{s}") + F.col(f"_before_{s}") for s in sums})
        .drop("_cell", *[f"_in_{s}" for s in sums], *[f"_before_{s}" for s in sums])
    )


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct numeric values per key with their counts and running counts, ascending.

    Gives (keys, value, n, cum_n, all_n); null values and null keys are left out.
    """
    known = F.col(value).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    counts = df.filter(known).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counts, keys, value, ["n"])


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, quantiles: dict[str, float]
) -> DataFrame:
    """Exact quantiles per key, interpolated linearly between neighbours."""
    ranked = value_ranks(df, keys, value)
    first, last, total = F.col("cum_n") - F.col("n"), F.col("cum_n"), F.col("all_n")

    def at(rank: Column) -> Column:
        return F.max(F.when((first <= rank) & (rank < last), F.col(value).cast("double")))

    picks, result = [], []
    for name, q in quantiles.items():
        spot = F.lit(float(q)) * (total - 1)
        picks += [
            at(F.floor(spot)).alias(f"_lo_{name}"),
            at(F.ceil(spot)).alias(f"_hi_{name}"),
            F.max(spot - F.floor(spot)).alias(f"_w_{name}"),
        ]
        lo, hi, w = (F.col(f"_{p}_{name}") for p in ("lo", "hi", "w"))
        result.append((lo + (hi - lo) * w).alias(name))
    return ranked.groupBy(*keys).agg(*picks).select(*keys, *result)


def dense_index(df: DataFrame, value: str, index: str) -> DataFrame:
    """Distinct numeric values with their 0-based position in ascending order."""
    distinct = df.select(value).filter(F.col(value).isNotNull()).distinct()
    ranked = value_ranks(distinct, [], value)
    return ranked.select(value, (F.col("cum_n") - 1).cast("int").alias(index))


def sequential_ids(
    df: DataFrame, id_col: str, timestamp: str, tie_order: Sequence[str]
) -> DataFrame:
    """0-based row numbers in (timestamp, tie_order) order; rows without a timestamp last.

    Equal rows are counted per input partition first, so one row copied many times is not
    numbered in one task. These counts are dealt to tasks by ranges of the whole order, whose
    bounds Spark samples from them: neither one crowded moment nor one tie at it makes a long
    task. The counts of the ranges are added up, then those inside a range, and only equal
    rows of one input partition are numbered one by one. Input and ranges are written out,
    since the positions rows are numbered by must not change on a retry.
    """
    stamp = F.col(timestamp)
    # Wall-clock microseconds: no zone takes part, so they follow the order of the stamps.
    days = F.datediff(F.to_date(stamp), F.lit("1970-01-01").cast("date")).cast("long")
    minutes = days * 1440 + F.hour(stamp) * 60 + F.minute(stamp)
    micros = (F.date_part(F.lit("SECONDS"), stamp) * 1_000_000).cast("long")
    placed = written(df.withColumn("_row", F.monotonically_increasing_id()), "rows").withColumns(
        {
            "_moment": F.coalesce(minutes * 60_000_000 + micros, F.lit(2**60)),
            "_tie": F.struct(*tie_order),
            "_part": F.shiftright("_row", 33),
        }
    )
    order = ["_moment", "_tie", "_part"]
    groups = placed.groupBy(*order).agg(F.count(F.lit(1)).alias("_n"))
    ranges = written(ordered_ranges(groups, order), "ranges")
    totals = ranges.groupBy("_range").agg(F.sum("_n").alias("_total"))
    # one row for each range
    before = totals.select("_range", (F.sum("_total").over(W.orderBy("_range")) - F.col("_total")).alias("_ahead"))
    inside = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    first = (
        ranges.withColumn("_inside", F.sum("_n").over(inside) - F.col("_n"))
        .join(before, "_range")
        .select(*order, (F.col("_ahead") + F.col("_inside")).alias("_first"))
    )
    alike = W.partitionBy(*order).orderBy("_row")
    return (
        placed.withColumn("_place", F.row_number().over(alike))
        .join(first, order)
        .withColumn(id_col, F.col("_first") + F.col("_place") - 1)
        .select(*df.columns, id_col)
    )


def ordered_ranges(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` dealt to tasks by ranges of ``order``, with ``_range``, the number of each row's range.

    Numbers follow the order, but only hold for this plan's one execution: write the result.
    """
    return df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id())
