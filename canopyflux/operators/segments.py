"""Operators on the segment table: exploding, break marks, probabilities, picking one break, boundary values, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflux.functions.columns import DAY_MS, harmonic_value, ms_to_yyyymmdd, zero_ms_to_null

KEYS = ("x_coord", "y_coord")


def explode_lists(df: DataFrame, lists: Sequence[str]) -> DataFrame:
    """Lists of equal length to rows, in step; a row with empty lists stays as one row of nulls."""
    others = [c for c in df.columns if c not in lists]
    return df.select(*others, F.inline_outer(F.arrays_zip(*lists)))


def parse_number_list(text: Column | str) -> Column:
    """``[1, 2.5]`` as an array of doubles; null for what is none."""
    return F.from_json(F.col(text) if isinstance(text, str) else text, "array<double>")


def mark_breaks(df: DataFrame, keys: Sequence[str] = KEYS, start: str = "tStart") -> DataFrame:
    """Adds ``is_break``: whether another segment of the location follows."""
    following = F.lead(start).over(Window.partitionBy(*keys).orderBy(start))
    return df.withColumn("is_break", F.when(following.isNotNull(), 1).otherwise(0))


def fix_change_prob(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Percent to a share; every segment but that with the location's latest break counts as a sure change."""
    w = Window.partitionBy(*keys)
    several = (F.count("tStart").over(w) > 1) & (F.max("tBreak").over(w) != F.col("tBreak"))
    return df.withColumn("changeProb", F.when(several, 1.0).otherwise(F.col("changeProb") / 100.0))


def select_break(df: DataFrame, start_ms: int, end_ms: int, keys: Sequence[str] = KEYS, order: Sequence[str] = ("tStart",)) -> DataFrame:
    """One row for each location: its only segment with a break in the range, or else that with the second latest break.

    Of equal breaks, that which comes later by ``order`` is the second.
    """
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(F.col("tBreak").desc(), *order))
    ranked = df.filter(F.col("tBreak").between(start_ms, end_ms)).withColumns({"rank_": rank, "many_": F.count("*").over(w)})
    return ranked.filter(F.col("rank_") == F.least(F.lit(2), F.col("many_"))).drop("rank_", "many_")


def boundary_values(segments: DataFrame, series: DataFrame, keys: Sequence[str], values: Sequence[str], start: str, end: str, day: str = "day") -> DataFrame:
    """Adds for each value its first two observations from the start on and the last two up to the end.

    The series becomes one sorted array for each key; its places come from array functions, so no range join is needed.
    """
    point = F.struct(F.col(day).alias("d"), *(F.col(v) for v in values))
    arrays = series.groupBy(*keys).agg(F.array_sort(F.collect_list(point)).alias("s_"))
    joined = segments.join(arrays, list(keys), "left")
    after = F.filter("s_", lambda p: p["d"] >= F.col(start))
    upto = F.reverse(F.filter("s_", lambda p: p["d"] <= F.col(end)))
    place = {"Start": (after, 0), "Start2": (after, 1), "End": (upto, 0), "End2": (upto, 1)}
    return joined.withColumns({f"{v}{name}": F.get(a, F.lit(i))[v] for v in values for name, (a, i) in place.items()}).drop("s_")


def predicted_curve(segments: DataFrame, keys: Sequence[str] = KEYS, step: int = 1) -> DataFrame:
    """One row for each segment and day (ordinal) between its start and its end, with the model's value."""
    day = lambda c: F.floor(F.col(c) / DAY_MS).cast("int") + 719163
    days = segments.filter("tStart IS NOT NULL").withColumn("day", F.explode(F.sequence(day("tStart"), day("tEnd"), F.lit(step))))
    return days.select(*keys, "tStart", "day", harmonic_value(F.col("day"), F.col("intercept_values"), F.col("coeficientes")).alias("predicted"))


def magnitude_between(segments: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``ndvi_magnitude``: the model's last value less the first one of the segment that follows."""
    day = lambda c: F.floor(F.col(c) / DAY_MS).cast("int") + 719163
    at = lambda c: harmonic_value(day(c), F.col("intercept_values"), F.col("coeficientes"))
    following = F.lead(at("tStart")).over(Window.partitionBy(*keys).orderBy("tStart"))
    return segments.withColumn("ndvi_magnitude", at("tEnd") - following)


def with_break_date(segments: DataFrame) -> DataFrame:
    """Adds ``break_yyyymmdd`` (null for none or 0)."""
    return segments.withColumn("break_yyyymmdd", ms_to_yyyymmdd(zero_ms_to_null("tBreak")))
