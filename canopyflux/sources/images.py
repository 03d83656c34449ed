"""Image lists from file names, and names of runs."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.operators.spatial import grid_cells


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modified) of all files below a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "length", F.col("modificationTime").alias("modified"))


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_theia(files: DataFrame, tile: str, first_year: int, last: date | None = None) -> DataFrame:
    """(path, tile, acq_date) of names like Theia_<tile>_20180101..., from a year to the year of the last date."""
    day = F.try_to_date(F.regexp_extract(_name(F.col("path")), rf"Theia_{tile}_(\d{{8}})", 1), "yyyyMMdd")
    out = files.select("path", F.lit(tile).alias("tile"), day.alias("acq_date")).filter(F.year("acq_date") >= first_year)
    return out.filter(F.year("acq_date") <= last.year) if last else out


def list_epoch(files: DataFrame, tile: str, last: date | None = None) -> DataFrame:
    """(path, tile, acq_date) of names like S2SR_image_<epoch milliseconds>....tif, up to a date."""
    name = _name(F.col("path"))
    ms = F.regexp_extract(name, r"^S2SR_image_(\d{13}).*tif$", 1)
    day = F.date_from_unix_date(F.floor(F.nullif(ms, F.lit("")).cast("bigint") / 86_400_000).cast("int"))
    out = files.select("path", F.lit(tile).alias("tile"), day.alias("acq_date")).filter("acq_date IS NOT NULL")
    return out.filter(F.col("acq_date") <= F.lit(last)) if last else out


def dated_name(path: Column) -> Column:
    """The file name with its epoch milliseconds as a date."""
    ms = F.regexp_extract(path, r"(\d{13})", 1)
    day = F.date_format(F.date_from_unix_date(F.floor(F.nullif(ms, F.lit("")).cast("bigint") / 86_400_000).cast("int")), "yyyyMMdd")
    return F.coalesce(F.replace(path, ms, day), path)


def most_recent(files: DataFrame, without: str | None = None) -> DataFrame:
    """One row: the path that was modified last (of equals the last by name)."""
    some = files.filter(~F.contains(F.col("path"), F.lit(without))) if without else files
    return some.agg(F.max(F.struct("modified", "path")).alias("m")).select(F.col("m.path").alias("path"), F.col("m.modified").alias("modified"))


def largest(rasters: DataFrame) -> DataFrame:
    """One row: the path with the most pixels (of equals the first by name)."""
    return rasters.agg(F.max(F.col("width").cast("long") * F.col("height")).alias("pixels"), F.min_by("path", F.struct(-(F.col("width").cast("long") * F.col("height")), F.col("path"))).alias("path"))


def scenes(collection: DataFrame, start: str, end: str, tile: str | None = None, clouds: float | None = None) -> DataFrame:
    """Scenes of a metadata table (id, tile, acq_date, cloud_percent) from start to before end, in order."""
    out = collection.filter((F.col("acq_date") >= F.lit(start).cast("date")) & (F.col("acq_date") < F.lit(end).cast("date")))
    out = out.filter(F.col("tile") == tile) if tile else out
    return (out.filter(F.col("cloud_percent") <= clouds) if clouds is not None else out).orderBy("acq_date", "id")


def scenes_in_box(collection: DataFrame, bounds: tuple[float, float, float, float], start: str, end: str, clouds: float = 20) -> DataFrame:
    """Scenes (id, acq_date, cloud_percent, min_x, min_y, max_x, max_y) that meet a box and have fewer clouds."""
    x0, y0, x1, y1 = bounds
    meets = (F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0)
    return scenes(collection.filter(meets & (F.col("cloud_percent") < clouds)), start, end)


def first_and_last(listed: DataFrame, start: str, end: str) -> DataFrame:
    """One row: the first and the last acquisition date from start to end; nulls for none."""
    day = F.when(F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")), F.col("acq_date"))
    return listed.agg(F.min(day).alias("first"), F.max(day).alias("last"))


def first_match(scenes_df: DataFrame, other: DataFrame, key: str, order: str, how: str = "inner") -> DataFrame:
    """Scenes with the first row, by ``order``, of another collection that has the same index; with ``left`` the others stay."""
    first = other.groupBy(key).agg(*(F.min_by(c, F.struct(order, c)).alias(c) for c in other.columns if c != key))
    return scenes_df.join(first, key, how)


def first_overlapping(scenes_df: DataFrame, other: DataFrame, id_col: str, order: str, cell: float = 100_000.0) -> DataFrame:
    """Scenes with the first row, by ``order``, of another collection that has the same date and meets the scene's box.

    Both have acq_date, min_x, min_y, max_x and max_y. An equi join on date and grid cell; scenes without a partner are left out.
    """
    names = ("min_x", "min_y", "max_x", "max_y")
    spread = lambda df: F.explode(grid_cells(*(F.col(n) for n in names), cell))
    rest = [c for c in other.columns if c not in (*names, "acq_date")]
    left = scenes_df.select(id_col, "acq_date", *names).withColumn("cell_", spread(scenes_df))
    right = other.select("acq_date", *rest, *(F.col(n).alias(f"o_{n}") for n in names), spread(other).alias("cell_"))
    meets = (F.col("min_x") <= F.col("o_max_x")) & (F.col("max_x") >= F.col("o_min_x")) & (F.col("min_y") <= F.col("o_max_y")) & (F.col("max_y") >= F.col("o_min_y"))
    best = left.join(right, ["acq_date", "cell_"]).filter(meets).groupBy(id_col).agg(F.min(F.struct(order, *(c for c in rest if c != order))).alias("first_"))
    return scenes_df.join(best, id_col).select(*scenes_df.columns, *(F.col(f"first_.{c}").alias(c) for c in rest))


_RUN = re.compile(r"(?P<prefix>.+)_meow(?P<meow>\d+)_alpha(?P<alpha>[0-9.]+)_(?P<first>\d{8})_(?P<last>\d{8})_(?P<roi>[^_]+)$")


def format_run_name(prefix: str, meow: int, alpha: float, first: date, last: date, roi: str) -> str:
    """A name that holds a run's parameters, its first and its last date and its region."""
    return f"{prefix}_meow{meow}_alpha{alpha:g}_{first:%Y%m%d}_{last:%Y%m%d}_{roi}"


def parse_run_name(name: str) -> dict[str, str]:
    m = _RUN.match(name)
    if not m:
        raise ValueError(f"{name} is no run name")
    return m.groupdict()
