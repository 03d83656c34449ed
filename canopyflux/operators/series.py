"""Operators on series: one value a day, gaps, variograms, observations around a date, drops, medians, as-of dates."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from canopyflux.operators.kernel import smallest_mode


def _ordered(keys: Sequence[str], *by: str | Column) -> Window:
    return Window.partitionBy(*keys).orderBy(*by)


def daily_series(df: DataFrame, keys: Sequence[str], day: Column, **values: Column) -> DataFrame:
    """One row for each key and day: the mean of each value. Repeated observations of a day have no order otherwise."""
    return df.select(*keys, day.alias("day"), *(v.alias(k) for k, v in values.items())).groupBy(*keys, "day").agg(*(F.avg(k).alias(k) for k in values))


def with_gaps(df: DataFrame, keys: Sequence[str], day: str = "day", lag: int = 1) -> DataFrame:
    """Adds ``gap``: days since the observation ``lag`` places before; null for the first ones."""
    return df.withColumn("gap", F.col(day) - F.lag(day, lag).over(_ordered(keys, day)))


def median_gap(df: DataFrame, keys: Sequence[str], day: str = "day") -> DataFrame:
    return with_gaps(df, keys, day).groupBy(*keys).agg(F.median("gap").alias("median_gap"), F.count("*").alias("n_obs"))


def adjust_peek(df: DataFrame, keys: Sequence[str], day: str = "day", default: int = 6) -> DataFrame:
    """Observations to look ahead at: max(default, round half even(default * 16 / median gap)); the default for a gap of 0."""
    wide = F.bround(F.try_divide(F.lit(default * 16.0), F.col("median_gap"))).cast("int")
    return median_gap(df, keys, day).withColumn("peek", F.greatest(F.lit(default), F.coalesce(wide, F.lit(default)))).drop("n_obs")


def variogram(df: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day") -> DataFrame:
    """Median absolute first difference of each value."""
    w = _ordered(keys, day)
    steps = df.select(*keys, *(F.abs(F.col(v) - F.lag(v).over(w)).alias(v) for v in values))
    return steps.groupBy(*keys).agg(*(F.median(v).alias(f"{v}_variogram") for v in values))


def adjusted_variogram(df: DataFrame, keys: Sequence[str], values: Sequence[str], day: str = "day", apart: int = 30) -> DataFrame:
    """Median absolute differences at the first lag whose most frequent gap (the smaller of equals) is over ``apart`` days.

    Only gaps over ``apart`` days count at that lag. A key with no such lag, however long, has its plain variogram and no
    lag; one with a single observation has no row. One shuffle brings a key's series together; lags are tried in turn.
    """
    rows = df.select(*keys, F.col(day).cast("long").alias("day"), *(F.col(v).cast("double").alias(v) for v in values)).filter("day IS NOT NULL")
    names = [f"{v}_variogram" for v in values]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("lag", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("day")
        days = table.column("day").to_numpy()
        key = {k: table.column(k)[0].as_py() for k in keys}
        lag = next((k for k in range(1, len(days)) if smallest_mode(days[k:] - days[:-k]) > apart), None)
        step = lag or 1
        far = days[step:] - days[:-step] > (apart if lag else -1)
        found = {}
        for v, name in zip(values, names, strict=True):
            x = table.column(v).to_numpy()
            steps = np.abs(x[step:] - x[:-step])[far]
            steps = steps[~np.isnan(steps)]
            found[name] = float(np.median(steps)) if len(steps) else None
        return pa.Table.from_pylist([key | {"lag": lag} | found] if len(days) > 1 else [], schema=arrow)

    arrow = to_arrow_schema(schema)
    return rows.groupBy(*keys).applyInArrow(run, schema)


def observations_around(series: DataFrame, events: DataFrame, keys: Sequence[str], values: Sequence[str], n: int = 10, day: str = "day", at: str = "mid") -> DataFrame:
    """For each event its key's last ``n`` observations up to its day (a1 the latest) and first ``n`` after it (d1 the earliest).

    Each value is taken on its own: nulls are skipped. Columns are <value>_a1.. and <value>_d1.., and the days likewise.
    """
    long = series.select(*keys, F.col(day).alias("day_"), F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).cast("double").alias("x")) for v in values))).alias("o"))
    joined = events.select(*keys, at).distinct().join(long.select(*keys, "day_", "o.*").filter("x IS NOT NULL"), list(keys))
    side = F.when(F.col("day_") <= F.col(at), "a").otherwise("d")
    distance = F.abs(F.datediff("day_", at)) if dict(series.dtypes)[day] == "date" else F.abs(F.col("day_") - F.col(at))
    ranked = joined.withColumn("side", side).withColumn("rank", F.row_number().over(_ordered([*keys, at, "value", "side"], distance, "x")))
    near = ranked.filter(F.col("rank") <= n)
    cells = [
        F.max(F.when((F.col("value") == v) & (F.col("side") == s) & (F.col("rank") == i), F.col(c))).alias(f"{v}{kind}_{s}{i}")
        for v in values
        for kind, c in (("", "x"), ("_day", "day_"))
        for s in ("a", "d")
        for i in range(1, n + 1)
    ]
    return near.groupBy(*keys, at).agg(*cells)


def largest_drop(df: DataFrame, keys: Sequence[str], value: str, day: str = "day") -> DataFrame:
    """The lowest step from one observation to the next and the day it ends on (the earliest of equals)."""
    steps = df.select(*keys, day, (F.col(value) - F.lag(value).over(_ordered(keys, day))).alias("drop")).filter("drop IS NOT NULL")
    return steps.groupBy(*keys).agg(F.min(F.struct("drop", day)).alias("s")).select(*keys, F.col("s.drop").alias("drop"), F.col(f"s.{day}").alias("drop_day"))


def median_by_region_and_date(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    return df.groupBy(*keys).agg(F.median(value).alias("median"), F.count(value).alias("n"))


def closest_earlier(events: DataFrame, dates: DataFrame, keys: Sequence[str], at: str, date: str) -> DataFrame:
    """Adds ``closest``: the key's last date strictly before the event. Both tables go through one window; no pairs are made."""
    tagged = events.select(*keys, F.col(at).alias("when_"), F.lit(1).alias("event")).unionByName(dates.select(*keys, F.col(date).alias("when_"), F.lit(0).alias("event")).distinct())
    w = _ordered(keys, F.col("when_"), F.col("event").desc()).rowsBetween(Window.unboundedPreceding, -1)
    found = tagged.withColumn("closest", F.max(F.when(F.col("event") == 0, F.col("when_"))).over(w)).filter("event = 1")
    return found.select(*keys, F.col("when_").alias(at), "closest")
