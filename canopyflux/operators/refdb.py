"""Building a reference database from operation logs: pivots of dated activities, sessions, intervals, mixing of sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflux.functions.columns import days_around, digit_sum_even
from canopyflux.operators.spatial import points_in_polygons


def ordered_pairs(df: DataFrame, key: str, date: str, activity: str) -> DataFrame:
    """(key, pairs): each key's (date, activity) as an array in order of the date, then the activity."""
    return df.filter(F.col(date).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(date).alias("date"), F.col(activity).alias("activity")))).alias("pairs"))


def widen(df: DataFrame, array: str, fields: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` entries of an array of structs as numbered columns; null beyond its end."""
    others = [c for c in df.columns if c != array]
    return df.select(*others, *(F.get(F.col(array), F.lit(i))[f].alias(f"{f}_{i}") for i in range(n) for f in fields))


def pivot_ordered_pairs(df: DataFrame, key: str, date: str, activity: str, n: int) -> DataFrame:
    return widen(ordered_pairs(df, key, date, activity).withColumn("n_pairs", F.size("pairs")), "pairs", ("date", "activity"), n)


def sort_row_pairs(df: DataFrame, dates: Sequence[str], activities: Sequence[str]) -> DataFrame:
    """Sorts the (date, activity) columns of each row by date; missing dates come last."""
    pairs = F.filter(F.array(*(F.struct(F.col(d).alias("d"), F.col(a).alias("a")) for d, a in zip(dates, activities, strict=True))), lambda p: p["d"].isNotNull())
    held = df.withColumn("pairs_", F.array_sort(pairs))
    get = lambda i, f: F.get(F.col("pairs_"), F.lit(i))[f]
    return held.withColumns({d: get(i, "d") for i, d in enumerate(dates)} | {a: get(i, "a") for i, a in enumerate(activities)}).drop("pairs_")


def pivot_first(df: DataFrame, key: str, by: Column, values: Sequence, value: str, order: Sequence[str]) -> DataFrame:
    """The first value by ``order`` for each key and each of the given pivot values, which needn't be looked up."""
    return df.withColumn("by_", by).groupBy(key).pivot("by_", list(values)).agg(F.min_by(value, F.struct(*order)))


def count_starting(pairs: Column, prefix: str = "CORTE") -> Column:
    return F.size(F.filter(pairs, lambda p: F.startswith(p["activity"], F.lit(prefix))))


def cut_sessions(df: DataFrame, key: str, date: str, gap: int = 730, repeats: bool = True) -> DataFrame:
    """(key, session, first, last, n): runs of distinct dates no more than ``gap`` days after the one before.

    Without ``repeats``, a key with one date only that occurs three times or more has no session.
    """
    dates = df.select(key, F.col(date).cast("date").alias("d")).filter("d IS NOT NULL").groupBy(key, "d").agg(F.count("*").alias("times"))
    if not repeats:
        w = Window.partitionBy(key)
        dates = dates.withColumn("dates", F.count("*").over(w)).filter((F.col("dates") > 1) | (F.col("times") <= 2))
    w = Window.partitionBy(key).orderBy("d")
    new = F.coalesce(F.datediff("d", F.lag("d").over(w)) > gap, F.lit(False)).cast("int")
    return dates.withColumn("new", new).withColumn("session", F.sum("new").over(w)).groupBy(key, "session").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n"))


def cut_sessions_from_start(df: DataFrame, key: str, date: str, days: int = 730) -> DataFrame:
    """(key, session, first, last, n): a date more than ``days`` after the start of its session begins the next one.

    Where a session starts depends on the one before, so each key's sorted dates are folded; a key's dates are few.
    """
    dates = df.select(key, F.col(date).cast("date").alias("d")).filter("d IS NOT NULL").groupBy(key).agg(F.array_sort(F.collect_set("d")).alias("dates"))
    none = F.array().cast("array<struct<first:date,last:date,n:bigint>>")

    def fold(done: Column, d: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        stays = (F.size(done) > 0) & (F.datediff(d, last["first"]) <= days)
        joined = F.struct(last["first"].alias("first"), d.alias("last"), (last["n"] + 1).alias("n"))
        fresh = F.struct(d.alias("first"), d.alias("last"), F.lit(1).cast("bigint").alias("n"))
        return F.when(stays, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(fresh)))

    return dates.select(key, F.posexplode(F.aggregate("dates", none, fold)).alias("session", "s")).select(key, "session", "s.*")


def numbered(df: DataFrame, key: str, order: Sequence[str], width: int = 2) -> DataFrame:
    """Adds ``parcel``: the key and a number inside it, such as 1234_01."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("string")
    return df.withColumn("parcel", F.concat_ws("_", F.col(key).cast("string"), F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)))


def numbered_rows(df: DataFrame, order: Sequence[str], name: str = "number") -> DataFrame:
    """Adds a number from 1 on to all rows, by ``order``.

    Rows are counted by range partition, so that no task gets all rows; the number of partitions is given, so that both
    uses have the same ones.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part_", F.spark_partition_id())
    ranked = sorted_rows.withColumn("nth_", F.row_number().over(Window.partitionBy("part_").orderBy(*order)))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are partitions
    base = ranked.groupBy("part_").agg(F.count("*").alias("n_")).select("part_", F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    return ranked.join(F.broadcast(base), "part_").withColumn(name, F.col("base_") + F.col("nth_")).drop("part_", "nth_", "base_")


def first_part_of(df: DataFrame, order: Sequence[str], share: float = 0.5) -> DataFrame:
    """The first rows by ``order``, up to a share of all (rounded down)."""
    most = df.agg(F.floor(F.count("*") * share).alias("most_"))  # one row
    return numbered_rows(df, order, "place_").join(F.broadcast(most), F.col("place_") <= F.col("most_")).drop("place_", "most_")


def groups_with_any(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """The rows of all groups that have a value in one row at least."""
    some = df.groupBy(*keys).agg(F.count(value).alias("n_")).filter("n_ > 0").select(*keys)
    return df.join(some, list(keys), "left_semi")


def session_spans(sessions: DataFrame, key: str, days: int = 60) -> DataFrame:
    """(key, spans): each key's sessions in order, as structs of their start and end with so many days around."""
    low, high = days_around("first", "last", days)
    span = F.struct("session", low.alias("start"), high.alias("end"))
    return sessions.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(span)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def text_list(text: Column) -> Column:
    """``a, b`` or ``['a', 'b']`` as an array of texts; an empty one for null."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(text, r"[\[\]']", ""), ","), lambda p: F.trim(p)), lambda p: p != "")
    return F.coalesce(parts, F.array().cast("array<string>"))


def drops_per_location(locations: DataFrame, parcels: DataFrame, x: str, y: str, breaks: str, start: str = "start_date", end: str = "end_date", cell: float = 1000.0) -> DataFrame:
    """Locations of a tile with the parcels that they lie in, and the first of their break dates within the parcel's span.

    ``breaks`` is a text of dates. Locations in no parcel stay, with nulls.
    """
    joined = points_in_polygons(locations, parcels, x, y, cell=cell, how="left").drop("ring")
    dates = F.transform(text_list(F.col(breaks)), lambda t: F.try_to_date(t, "yyyy-MM-dd"))
    return joined.withColumn("drop_date", first_date_between(dates, F.col(start), F.col(end)))


def first_date_between(dates: Column, low: Column, high: Column) -> Column:
    """The earliest date of an array from low to high."""
    return F.array_min(F.filter(dates, lambda d: d.between(low, high)))


#: An estimate of this date means "before the first" or "after the last" date that was looked at.
OPEN_END = "1000-01-01"


def interval_columns(df: DataFrame, days: int = 5, drop: str = "drop_date", first: str = "ECCD1", last: str = "ECCD2", none: str = "NC", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Adds data0 and data1: the span in which a change happened.

    The two estimates as they are; an open one is the start or the end of the series; without one ``days`` around the drop,
    unless the parcel is marked as unchanged.
    """

    def bound(estimate: str, beyond: str, around: Column) -> Column:
        e = F.col(estimate)
        return F.when(e == F.lit(OPEN_END).cast("date"), F.col(beyond)).when(e.isNotNull(), e).when(F.col(none).isNull(), around)

    return df.withColumns({"data0": bound(first, start, F.date_sub(drop, days)), "data1": bound(last, end, F.date_add(drop, days))})


def date_difference(df: DataFrame, first: str, second: str, name: str = "date_diff") -> DataFrame:
    """Rows that have both dates, with the days from the first to the second."""
    return df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).withColumn(name, F.datediff(second, first))


def fill_estimated_date(drop: Column, start: Column, end: Column, estimated: Column) -> Column:
    """The estimated date; where there is a drop but no estimate, and the span is one day, that day."""
    return F.when(drop.isNotNull() & (start == end) & estimated.isNull(), start).otherwise(estimated)


def drop_distances(drop: Column, start: Column, end: Column, estimated: Column) -> tuple[Column, Column]:
    """Days from the drop to the first date (null behind it, or with an estimate), and from the last date to the drop (null before it)."""
    return F.when(estimated.isNull() & (drop <= start), F.datediff(start, drop)), F.when(drop >= end, F.datediff(drop, end))


def missed_by_clouds(n_dates: Column, n_empty: Column, n_filled: Column) -> Column:
    """Whether too many dates are empty: of an even number half, of an odd number two fifths."""
    return F.when(n_dates % 2 == 0, n_empty >= n_filled).otherwise(n_empty >= 0.4 * n_dates)


def first_of_each_date(df: DataFrame, keys: Sequence[str], date: str, order: Sequence[str]) -> DataFrame:
    """One observation of each key and date: the first by ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys, date).orderBy(*order))
    return df.withColumn("first_", first).filter("first_ = 1").drop("first_")


def mix_sources(first: DataFrame, second: DataFrame, id_col: str, area_col: str = "area_m2", low: float = 2500, high: float = 1_000_000) -> DataFrame:
    """Both sources in one table: of the second those whose id has an even digit sum; of both those of a fitting area."""
    both = first.withColumn("fonte", F.lit(1)).unionByName(second.filter(digit_sum_even(id_col)).withColumn("fonte", F.lit(2)), allowMissingColumns=True)
    return both.filter(F.col(area_col).between(low, high))


def merge_operations(base: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """The base rows with what the other tables have of their key, once each; rows without a match stay."""
    out = base
    for o in others:
        out = out.join(o.dropDuplicates([key]), key, "left")
    return out


def merge_parcels(operations: DataFrame, parcels: DataFrame, key: str) -> DataFrame:
    """Operations with their parcel's attributes; operations of no known parcel, and parcels without any, are left out."""
    return operations.join(parcels, key)


def class_shares(df: DataFrame, cls: str, area: str) -> DataFrame:
    """(class, n, area, percent): counts, areas and shares of the total area."""
    sums = df.groupBy(cls).agg(F.count("*").alias("n"), F.sum(area).alias("area"))
    return sums.withColumn("percent", F.try_divide(100 * F.col("area"), F.sum("area").over(Window.partitionBy())))


def null_counts(df: DataFrame, columns: Sequence[str]) -> Column:
    """How many of a row's columns are null."""
    return sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))


def mean_date(*dates: Column) -> Column:
    """The mean of the dates there are, rounded down to a day."""
    days = F.filter(F.array(*(F.unix_date(d) for d in dates)), lambda d: d.isNotNull())
    total = F.aggregate(days, F.lit(0).cast("bigint"), lambda s, d: s + d)
    return F.date_from_unix_date(F.floor(F.try_divide(total, F.size(days))).cast("int"))


def difference_histogram(df: DataFrame, first: str, second: str, width: int = 5) -> DataFrame:
    """(bin, n): whole multiples of ``width`` days below the difference of two dates."""
    bin_ = (F.floor(F.datediff(second, first) / width) * width).cast("int")
    return df.filter(F.col(first).isNotNull() & F.col(second).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))


def three_way(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: how often a is before, equal to and after b, and how often either is missing."""
    x, y = F.col(a), F.col(b)
    return df.agg(F.count_if(x < y).alias("before"), F.count_if(x == y).alias("equal"), F.count_if(x > y).alias("after"), F.count_if(x.isNull() | y.isNull()).alias("missing"))


def missing_ids(wanted: DataFrame, found: DataFrame, id_col: str) -> DataFrame:
    """Ids that are wanted but not found."""
    return wanted.select(id_col).distinct().join(found.select(id_col), id_col, "left_anti")
