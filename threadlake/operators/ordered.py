"""Exact ordered computations inside groups of any size.

A plain window puts a whole group into one task. That is right while groups are small, and
wrong once one room or one user holds a large share of all rows. ``windowed`` checks the
largest group first. Small groups get the plain window. Otherwise the rows are
range-partitioned on (keys, order), which cuts a hot group into many ranges, every range is
computed locally, and one carry row per (group, range) brings the running state of the
earlier ranges forward. Both ways give the same rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from threadlake.session import materialize

# Rows of one group that a single task may sort and scan.
MAX_GROUP_ROWS = 4_000_000

# Ranges at most. Each is a task in every step that follows and is sampled on the driver, so their number
# must not grow with the rows; a larger range is sorted outside of memory.
MAX_RANGES = 512

# kind -> needs the frame that ends before the current row
_KINDS = {
    "row_number": False,
    "sum": False,
    "sum_before": True,
    "min": False,
    "min_before": True,
    "max": False,
    "max_before": True,
    "lag": True,
}


def _columns(items: Sequence[str | Column]) -> list[Column]:
    return [F.col(i) if isinstance(i, str) else i for i in items]


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the biggest group; partial counts keep a hot key off any single task."""
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def _local(spec: tuple[str, str | None], window, order_window) -> Column:
    kind, col = spec
    if kind == "row_number":
        return F.row_number().over(order_window).cast("bigint")
    if kind == "lag":
        return F.lag(F.col(col)).over(order_window)
    frame = window.rowsBetween(Window.unboundedPreceding, -1 if _KINDS[kind] else 0)
    func = {"sum": F.sum, "min": F.min, "max": F.max}[kind.split("_")[0]]
    return func(F.col(col)).over(frame)


def windowed(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
             specs: dict[str, tuple[str, str | None]],
             max_group_rows: int = MAX_GROUP_ROWS, largest: int | None = None) -> DataFrame:
    """Add running columns. ``specs`` maps an output name to ``(kind, column)``.

    Kinds: ``row_number``; running ``sum``/``min``/``max``; their ``*_before`` forms, which
    leave the current row out; ``lag`` (the previous row's value; give it a struct when the
    value itself may be null). ``order`` must be a total order. ``largest`` is an upper bound
    on the group size, where a caller has already measured one.
    """
    unknown = {kind for kind, _ in specs.values()} - set(_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds: {sorted(unknown)}")
    keys = list(keys)
    if largest is None:
        largest = largest_group(df, keys)
    if largest <= max_group_rows:
        window = Window.partitionBy(*keys).orderBy(*_columns(order))
        return df.select("*", *[
            _local(spec, window, window).alias(name) for name, spec in specs.items()
        ])
    return _split(df, keys, order, specs, max_group_rows)


def _split(df, keys, order, specs, max_group_rows):
    ranges = min(MAX_RANGES, max(2, -(-2 * df.count() // max_group_rows)))
    # The range number is written with the rows, so a recomputed task cannot change it.
    staged = materialize(
        df.repartitionByRange(ranges, *keys, *_columns(order))
        .withColumn("_range", F.spark_partition_id()),
        "ranges",
    )
    window = Window.partitionBy(*keys, "_range").orderBy(*_columns(order))
    local = staged.select("*", F.row_number().over(window).alias("_rn"), *[
        _local(spec, window, window).alias(f"_l_{name}") for name, spec in specs.items()
    ])

    state = [F.count(F.lit(1)).alias("_n")]
    for name, (kind, col) in specs.items():
        base = kind.split("_")[0]
        if base in ("sum", "min", "max"):
            func = {"sum": F.sum, "min": F.min, "max": F.max}[base]
            state.append(func(F.col(col)).alias(f"_s_{name}"))
        elif kind == "lag":
            state.append(F.max_by(F.col(col), F.col("_rn")).alias(f"_s_{name}"))
    earlier = (Window.partitionBy(*keys).orderBy("_range")
               .rowsBetween(Window.unboundedPreceding, -1))
    carry_cols = []
    for name, (kind, _) in specs.items():
        if kind == "row_number":
            carry_cols.append(F.sum("_n").over(earlier).alias(f"_c_{name}"))
        elif kind == "lag":
            carry_cols.append(F.last(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
        else:
            func = {"sum": F.sum, "min": F.min, "max": F.max}[kind.split("_")[0]]
            carry_cols.append(func(f"_s_{name}").over(earlier).alias(f"_c_{name}"))
    grouped = local.groupBy(*keys, "_range").agg(*state)
    carry = grouped.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_range").alias("_k_range"),
        *carry_cols)
    on = reduce(lambda a, b: a & b,
                [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys],
                F.col("_range") == F.col("_k_range"))
    joined = local.join(carry, on)

    out = []
    for name, (kind, _) in specs.items():
        here, before = F.col(f"_l_{name}"), F.col(f"_c_{name}")
        if kind == "row_number":
            value = here + F.coalesce(before, F.lit(0))
        elif kind == "lag":
            value = F.when(F.col("_rn") == 1, before).otherwise(here)
        elif kind.startswith("sum"):
            value = F.when(here.isNull(), before).when(before.isNull(), here) \
                .otherwise(here + before)
        elif kind.startswith("min"):
            value = F.least(here, before)
        else:
            value = F.greatest(here, before)
        out.append(value.alias(name))
    return joined.select(*[F.col(c) for c in df.columns], *out)


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                name: str = "rank", max_group_rows: int = MAX_GROUP_ROWS,
                largest: int | None = None) -> DataFrame:
    """Exact 1-based position of every row inside its group."""
    return windowed(df, keys, order, {name: ("row_number", None)}, max_group_rows, largest)


def top_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], k: int,
               name: str = "rank") -> DataFrame:
    """First ``k`` rows per group.

    ``row_number <= k`` lets Catalyst cut every map task's share of a group to k rows before
    the shuffle (WindowGroupLimit), so a hot group never travels whole.
    """
    window = Window.partitionBy(*keys).orderBy(*_columns(order))
    return df.withColumn(name, F.row_number().over(window)).where(F.col(name) <= k)


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: dict[str, int],
                 max_group_rows: int = MAX_GROUP_ROWS) -> DataFrame:
    """Nearest-rank percentiles per group: the value at index ceil(p/100*n), 1-based.

    Works on the value histogram, so only distinct values are ordered.
    """
    keys = list(keys)
    hist = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n")), "hist")
    upto = windowed(hist, keys, [value], {"_upto": ("sum", "_n")}, max_group_rows)
    totals = hist.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    on = reduce(lambda a, b: a & b, [upto[k].eqNullSafe(totals[k]) for k in keys])
    both = upto.join(totals, on).select(
        *[upto[k] for k in keys], upto[value], "_upto", "_total")
    # integer ceil(p*n/100), at least 1
    return both.groupBy(*keys).agg(*[
        F.min(F.when(
            F.col("_upto") * 100 >= F.greatest(F.col("_total") * p, F.lit(100)),
            F.col(value))).alias(name)
        for name, p in percents.items()
    ])
