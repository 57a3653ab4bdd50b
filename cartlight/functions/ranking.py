"""Ranks, exact quantiles and dense numbering that never gather a whole column in one task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from cartlight.session import materialize

# Bits of a value located per pass: one histogram has at most 2^20 rows per wanted rank, whatever the
# size of the table. Once that many rows or fewer are left, their values are counted directly.
_DIGIT_BITS = 20
_FEW_ROWS = 1 << _DIGIT_BITS


def top_k(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_k_per(df: DataFrame, key: str | list[str], n: int, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """The first n rows of every key. Spark cuts each map task's groups to n rows before the shuffle."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= n).withColumn(
        rank, F.col(rank).cast("bigint")
    )


def is_small(df: DataFrame) -> bool:
    """Whether the values of ``df`` take no more bytes than the session lets a broadcast take.

    Adds up the bytes, so pass a materialized frame. With broadcasts turned off nothing is small.
    """
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    if limit <= 0:
        return False
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= limit


def values_at_ranks(
    rows: DataFrame, extent: dict[Any, tuple[int, int, int]], wanted: dict[Any, list[int]]
) -> dict[tuple[Any, int], int]:
    """Exact order statistics by histogram refinement.

    ``rows``: (grp, v bigint), read once per pass, so pass a materialized frame. ``extent``: number of
    rows, lowest and highest v per group. ``wanted``: 0-based positions per group. Groups and
    positions are a handful. Returns the value for each (group, position).

    Each pass counts the values per digit (pre-aggregated in the map tasks), finds the digit that
    holds the wanted position, and narrows the next pass to that digit. No sort of the table, and a
    value shared by a third of the rows is just one large count. Only the found digits, one row per
    wanted position, come to the driver.
    """
    bits = max((64 if (lo ^ hi) < 0 else (lo ^ hi).bit_length() for _, lo, hi in extent.values()), default=0)
    left = max((n for n, _, _ in extent.values()), default=0)
    # (group, position) -> [digits found so far, position within them]; None before the first pass
    state: dict[tuple[Any, int], list] = {(g, p): [None, p] for g, places in wanted.items() for p in places}
    while state:
        step = 0 if left <= _FEW_ROWS else max(bits - _DIGIT_BITS, 0)
        narrowed = rows
        prefix = F.lit(0)
        if any(found is not None for found, _ in state.values()):
            inside = {(g, found) for (g, _), (found, _) in state.items()}
            narrowed = rows.filter(_any_of((F.col("grp") == g) & (F.shiftright("v", bits) == d) for g, d in inside))
            prefix = F.shiftright("digit", bits - step)
        histogram = narrowed.groupBy("grp", F.shiftright("v", step).alias("digit")).agg(
            F.count(F.lit(1)).alias("n")
        ).withColumn("prefix", prefix.cast("bigint"))
        running = Window.partitionBy("grp", "prefix").orderBy("digit")
        upto = histogram.withColumn("upto", F.sum("n").over(running))

        def holds(g: Any, found: int | None, place: int) -> Column:
            here = (F.col("grp") == g) & (F.col("upto") - F.col("n") <= place) & (F.col("upto") > place)
            return here if found is None else here & (F.col("prefix") == found)

        hits = upto.filter(_any_of(holds(g, found, place) for (g, _), (found, place) in state.items())).collect()
        for (g, _), entry in state.items():
            found, place = entry
            for hit in hits:
                before = hit["upto"] - hit["n"]
                if hit["grp"] == g and found in (None, hit["prefix"]) and before <= place < hit["upto"]:
                    entry[:] = [hit["digit"], place - before]
                    break
        bits, left = step, max(hit["n"] for hit in hits)
        if bits == 0:
            break
    return {key: found for key, (found, _) in state.items()}


def extents(rows: DataFrame) -> dict[Any, tuple[int, int, int]]:
    """Number of rows, lowest and highest v of the few groups of (grp, v)."""
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    return {r["grp"]: (r["n"], r["lo"], r["hi"]) for r in sizes.collect()}


def _any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def exact_quantiles(
    df: DataFrame, values: dict[str, Column], probabilities: Sequence[float], scale: float = 1.0
) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of bigint columns, divided by ``scale``.

    The exact counterpart of ``approxQuantile``; all columns are located in the same passes. Pass a
    materialized frame. A column without values gives None.
    """
    columns = F.array(*[F.struct(F.lit(name).alias("grp"), value.alias("v")) for name, value in values.items()])
    rows = df.select(F.explode(columns).alias("c")).select("c.grp", "c.v").filter(F.col("v").isNotNull())
    extent = extents(rows)
    spots = {name: [p * (n - 1) for p in probabilities] for name, (n, _, _) in extent.items()}
    wanted = {
        name: sorted({place for s in at for place in (math.floor(s), math.ceil(s))}) for name, at in spots.items()
    }
    found = values_at_ranks(rows, extent, wanted)

    def at(name: str, spot: float) -> float:
        low, high = found[name, math.floor(spot)] / scale, found[name, math.ceil(spot)] / scale
        return low + (high - low) * (spot - math.floor(spot))

    return {
        name: [at(name, s) for s in spots[name]] if name in spots else [None] * len(probabilities)
        for name in values
    }


def dense_index(df: DataFrame, name: str, order: Sequence[Column] = ()) -> DataFrame:
    """Number the rows 0, 1, 2, ... without a one-task window.

    Rows are (optionally) range-sorted and written once to the checkpoint folder, so that the
    numbering cannot change when an executor is lost. The number is the size of the earlier
    partitions, a table with one row per partition, plus the place within the partition. Sort columns
    should end in a unique one, or equal rows share a partition.
    """
    arranged = df.orderBy(*order) if order else df
    tagged = materialize(arranged.withColumn("_row", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_row", 33)
    sizes = tagged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select(
        "_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_start")
    )
    within = F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_start") + within)
        .drop("_part", "_row", "_start")
    )
