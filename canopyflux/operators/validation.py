"""Accuracy of detected breaks against the dates of analysts.

Steps: :func:`filter_period` reduces segments to those that count in the period, :func:`join_reference` brings them
together with the reference polygons, one row for each analyst, :func:`score` gives each row its true and false positives and
negatives, and :func:`accuracy` sums them up. All groups are locations, so that every window is small; rules that read what
earlier rules set are columns one after the other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflux.functions.columns import ms_to_date, yyyymmdd_to_date, zero_ms_to_null
from canopyflux.operators.spatial import near_boundary, points_in_polygons

#: Days between a break and an analyst's date that still count as the same event.
THETA = 60
PERIOD = ("2018-09-12", "2021-09-30")
BORDER_METRES = 10.0
#: Land types that are left out of the result.
LEFT_OUT = ("Agricultura", "Agua")


def filter_period(segments: DataFrame, keys: Sequence[str] = ("x_coord", "y_coord"), period: tuple[str, str] = PERIOD, largest: tuple[str, float] | None = None) -> DataFrame:
    """Segments that count, with startMin, numBreak and breaks_in_tmask; tBreak, tStart and tEnd become dates.

    changeProb is a share from 0 to 1. ``largest`` is a (column, limit): breaks of greater magnitude don't count.
    """
    w = Window.partitionBy(*keys)
    prob, broke = F.col("changeProb"), F.col("tBreak")
    lo, hi = (F.lit(p).cast("date") for p in period)
    df = segments.withColumns({c: ms_to_date(zero_ms_to_null(c)) for c in ("tBreak", "tEnd", "tStart")})
    if largest:
        df = df.withColumn("tBreak", F.when(~(F.col(largest[0]) > largest[1]) | F.col(largest[0]).isNull(), broke))
    df = df.withColumns({"startMin": F.min("tStart").over(w), "numBreak": F.ceil(F.round(F.sum(prob).over(w), 9)).cast("long")})
    partial = (prob > 0) & (prob < 1)
    df = df.withColumn("tBreak", F.when(~F.coalesce(partial, F.lit(False)), broke))
    within = broke.isNotNull() & (broke > lo) & (broke < hi)
    df = df.withColumn("breaks_in_tmask", within.cast("int")).withColumn("tBreak", F.when(F.col("breaks_in_tmask") == 1, broke))
    none = broke.isNull()
    df = df.withColumn("left_", ~((none & (F.col("numBreak") > 1)) | (none & (F.col("numBreak") == 1) & (F.col("breaks_in_tmask") == 0) & (F.col("tStart") == F.col("startMin")))))
    df = df.withColumn("many_", F.sum(F.col("left_").cast("int")).over(w)).withColumn("breaks_", F.count("tBreak").over(w))
    last_fit = (F.col("many_") == 2) & (prob == 0) & (F.col("numBreak") == 1)
    outside = none & (F.col("breaks_") == 0)
    # rows that are taken back in come once more where they are in already: a union of all three
    times = (F.col("left_") & ~last_fit).cast("int") + (partial & outside).cast("int") + ((prob == 0) & (F.col("numBreak") > 1) & outside).cast("int")
    df = df.withColumn("times_", F.coalesce(times, F.lit(0))).filter("times_ > 0")
    return df.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("times_")))).drop("left_", "many_", "breaks_", "times_", "copy_")


def with_analysts(joined: DataFrame, keys: Sequence[str] = ("x_coord", "y_coord")) -> DataFrame:
    """One row for each analyst: A with data_1, B with data_3 where there are both; else one row with the date there is.

    data_1 and data_3 are dates. Adds analistas, exists_event, nome, data1_z, Valid_breaks and delta_min (days).
    """
    first, second = F.col("data_1"), F.col("data_3")
    df = joined.withColumn("analistas", first.isNotNull().cast("int") + second.isNotNull().cast("int")).withColumn("exists_event", (F.col("analistas") > 0).cast("int"))
    a, b = F.struct(F.lit("A").alias("nome"), F.coalesce(first, second).alias("data1_z")), F.struct(F.lit("B").alias("nome"), second.alias("data1_z"))
    df = df.withColumn("who_", F.explode(F.when(F.col("analistas") == 2, F.array(a, b)).otherwise(F.array(a)))).select(*df.columns, "who_.*")
    df = df.withColumn("Valid_breaks", F.count("tBreak").over(Window.partitionBy(*keys, "nome")))
    return df.withColumn("delta_min", F.datediff("data1_z", "tBreak"))


def join_reference(segments: DataFrame, polygons: DataFrame, keys: Sequence[str] = ("x_coord", "y_coord"), x: str = "x_coord", y: str = "y_coord", border: float = BORDER_METRES, cell: float = 1000.0) -> DataFrame:
    """Segments in reference polygons (yyyymmdd dates; 0 and null mean none), marked where near a border, by analyst."""
    dated = polygons.withColumns({c: yyyymmdd_to_date(c) for c in ("data_0", "data_1", "data_2", "data_3") if c in polygons.columns})
    inner = near_boundary(points_in_polygons(segments, dated, x, y, cell=cell), x, y, border, name="bordadura")
    return with_analysts(inner.drop("ring"), keys)


def _flag(old: str, condition: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), 1).otherwise(F.col(old))


def score(df: DataFrame, theta: int = THETA, keys: Sequence[str] = ("x_coord", "y_coord"), segment: str = "tStart") -> DataFrame:
    """Adds Min_delta_min, VP, FP, FN and VN (1 or 0) and drops rows that get none, as well as :data:`LEFT_OUT` types.

    segment: what tells the segments of a location apart.
    """
    place, who = Window.partitionBy(*keys), Window.partitionBy(*keys, "nome")
    broke, analysts, valid = F.col("tBreak"), F.col("analistas"), F.col("Valid_breaks")
    no, yes = broke.isNull(), broke.isNotNull()
    delta, least = F.col("delta_min"), F.col("Min_delta_min")
    df = df.withColumn("delta_min", F.abs("delta_min")).withColumn("Min_delta_min", F.min("delta_min").over(who)).withColumn("Valid_breaks", F.count("tBreak").over(who))
    few = (analysts == 2) & (valid < analysts)
    df = df.withColumn("few_", F.min(F.when(few, delta)).over(place)).withColumn("Min_delta_min", F.when(few, F.col("few_")).otherwise(least)).drop("few_")
    df = df.withColumns({c: F.lit(0) for c in ("VP", "FP", "FN", "VN")})
    df = df.withColumn("VP", _flag("VP", (delta <= theta) & yes & (analysts > 0)))
    df = df.withColumn("FP", _flag("FP", ((analysts == 0) & yes) | ((delta > theta) & (delta == least)) | ((delta > theta) & (analysts == 1) & yes)))
    wrong = F.col("FP") == 1
    df = df.withColumn("FN", _flag("FN", ((analysts > 0) & no) | ((analysts == 1) & (valid == 1) & wrong) | ((analysts == 2) & (valid == 3) & wrong)))
    df = df.withColumn("VN", _flag("VN", (analysts == 0) & no))
    # breaks that no analyst's row has classified: the nearest counts as wrong
    same = Window.partitionBy(*keys, "tBreak")
    df = df.withColumn("total_", F.when(yes, F.sum(F.col("VP") + F.col("FP") + F.col("FN") + F.col("VN")).over(same)))
    open_ = (F.col("total_") == 0) & (analysts == 2) & (valid > analysts)
    df = df.withColumn("open_", F.coalesce(open_, F.lit(False))).withColumn("nearest_", F.min(F.when(F.col("open_"), delta)).over(place))
    df = df.withColumn("FP", _flag("FP", F.col("open_") & (delta == F.col("nearest_"))))
    df = df.withColumn(
        "FN",
        _flag(
            "FN",
            (wrong & (analysts == 1) & (delta == least) & valid.isin(2, 3)) | ((analysts == 2) & (valid == 1) & (F.col("VP") == 0)) | ((analysts == 2) & (valid == 2) & wrong),
        ),
    )
    clash = F.max(F.coalesce((F.col("total_") == 0) & (analysts == 2) & (valid == 2), F.lit(False)).cast("int")).over(place)
    df = df.withColumn("clash_", clash)
    clean = df.filter("clash_ = 0").drop("clash_", "total_", "open_", "nearest_")
    again = _closest_pairs(df.filter("clash_ = 1").drop("clash_", "total_", "open_", "nearest_"), [*keys, segment])
    again = again.withColumns({"VP": (delta <= theta).cast("int"), "FP": (delta > theta).cast("int"), "FN": (delta > theta).cast("int"), "VN": F.lit(0)})
    again = again.withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("VP", "FP", "FN")})
    out = clean.unionByName(again).filter((F.col("VP") > 0) | (F.col("FP") > 0) | (F.col("FN") > 0) | (F.col("VN") > 0))
    return out.filter(F.col("tipo").isNull() | ~F.col("tipo").isin(*LEFT_OUT)) if "tipo" in df.columns else out


def _closest_pairs(df: DataFrame, group: Sequence[str]) -> DataFrame:
    """Of each group keeps the pair of a break and a date that are closest, and drops other rows that share either.

    Groups of one row, and those without a date or a distance, stay as they are. Of equal pairs the first by date is the one.
    """
    w = Window.partitionBy(*group)
    least = F.min("Min_delta_min").over(w)
    df = df.withColumns({"least_": least, "rows_": F.count("*").over(w), "fewest_": F.min("analistas").over(w)})
    pair = F.min(F.when(F.col("delta_min") == F.col("least_"), F.struct("tBreak", "data1_z"))).over(w)
    df = df.withColumn("pair_", pair)
    shares = (F.col("tBreak") == F.col("pair_.tBreak")) | (F.col("data1_z") == F.col("pair_.data1_z"))
    drop = (F.col("rows_") > 1) & (F.col("fewest_") > 0) & F.col("pair_").isNotNull() & shares & (F.col("delta_min") != F.col("least_"))
    return df.filter(~F.coalesce(drop, F.lit(False))).drop("least_", "rows_", "fewest_", "pair_")


def accuracy(scored: DataFrame) -> DataFrame:
    """One row: the sums, commission and omission errors and F1 (null where nothing was found)."""
    sums = scored.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("VP", "FP", "FN", "VN")))
    cm, om = F.try_divide(F.col("FP"), F.col("FP") + F.col("VP")), F.try_divide(F.col("FN"), F.col("FN") + F.col("VP"))
    out = sums.withColumns({"commission": cm, "omission": om})
    cm, om = F.col("commission"), F.col("omission")
    return out.withColumn("f1", F.try_divide(2 * (1 - om) * (1 - cm), 2 - om - cm))
