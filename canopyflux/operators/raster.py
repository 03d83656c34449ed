"""Rasters as tables of cells: masks, focal filters, shadows, mosaics, polygons to cells, breaks to a grid, colours."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from canopyflux.functions.columns import ms_to_date, ms_to_yyyymmdd, position_in_year, raster_index
from canopyflux.operators.spatial import box, grid_cells, inside, meets_box, points_in_polygons


def focal(cells: DataFrame, value: str, radius: int, how: str, keys: Sequence[str] = (), row: str = "row", col: str = "col") -> DataFrame:
    """Minimum or maximum over a square neighbourhood, for the cells there are.

    Each cell gives its value to its neighbours; partial aggregation combines them before the shuffle.
    """
    steps = range(-radius, radius + 1)
    around = F.array(*(F.struct((F.col(row) + i).alias(row), (F.col(col) + j).alias(col)) for i in steps for j in steps))
    given = cells.select(*keys, F.explode(around).alias("at"), value).select(*keys, f"at.{row}", f"at.{col}", value)
    out = given.groupBy(*keys, row, col).agg((F.min if how == "min" else F.max)(value).alias(value))
    return cells.drop(value).join(out, [*keys, row, col])


def shadow_cells(clouds: DataFrame, azimuth: float, steps: int = 10, keys: Sequence[str] = (), row: str = "row", col: str = "col") -> DataFrame:
    """Cells that the cloud cells are projected on, along the azimuth (degrees from north) for so many cells."""
    from math import cos, radians, sin

    dx, dy = sin(radians(azimuth)), cos(radians(azimuth))
    shifted = F.array(*(F.struct((F.col(row) - round(k * dy)).alias(row), (F.col(col) + round(k * dx)).alias(col)) for k in range(1, steps + 1)))
    return clouds.select(*keys, F.explode(shifted).alias("at")).select(*keys, f"at.{row}", f"at.{col}").distinct()


def cloud_shadow_mask(cells: DataFrame, cloud: str, dark: str, azimuth: float, keys: Sequence[str] = (), steps: int = 10, erode: int = 2, dilate: int = 5) -> DataFrame:
    """Adds ``masked`` (1 or 0): clouds and dark cells in their shadow, eroded, then dilated."""
    shade = shadow_cells(cells.filter(F.col(cloud) > 0), azimuth, steps, keys).withColumn("shade_", F.lit(1))
    on = [*keys, "row", "col"]
    raw = cells.join(shade, on, "left").withColumn("masked", ((F.col(cloud) > 0) | ((F.col(dark) > 0) & F.col("shade_").isNotNull())).cast("int")).drop("shade_")
    return focal(focal(raw, "masked", erode, "min", keys), "masked", dilate, "max", keys)


def apply_mask(cells: DataFrame, bands: Sequence[str], masked: Column) -> DataFrame:
    return cells.withColumns({b: F.when(~masked, F.col(b)) for b in bands})


def mosaic(parts: DataFrame, order: Sequence[str], keys: Sequence[str] = ("row", "col"), region: DataFrame | None = None) -> DataFrame:
    """One row for each cell: that of the first part by ``order`` that has it. With ``region`` (a table of cells), only its cells."""
    some = parts if region is None else parts.join(region.select(*keys).distinct(), list(keys), "left_semi")
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return some.withColumn("first_", first).filter("first_ = 1").drop("first_")


def rasterise(polygons: DataFrame, grid: DataFrame, x: str = "x", y: str = "y", ring: str = "ring", cell: float = 1000.0, touched: float | None = None) -> DataFrame:
    """Cells whose centre lies in any polygon; with ``touched``, the side of a cell, all cells that any polygon meets."""
    if touched is None:
        return points_in_polygons(grid, polygons.select(ring), x, y, ring, cell, "left_semi")
    half = touched / 2
    squares = grid.withColumns({"tx0_": F.col(x) - half, "ty0_": F.col(y) - half, "tx1_": F.col(x) + half, "ty1_": F.col(y) + half})
    low, high = ("tx0_", "ty0_"), ("tx1_", "ty1_")
    at = squares.withColumn("pcell_", F.explode(grid_cells(*(F.col(c) for c in (*low, *high)), cell)))
    corners = box(F.col(ring))
    dealt = polygons.select(ring).withColumn("cell_", F.explode(grid_cells(corners["min_x"], corners["min_y"], corners["max_x"], corners["max_y"], cell)))
    meets = inside(F.col(x), F.col(y), F.col(ring)) | meets_box(F.col(ring), *(F.col(c) for c in (*low, *high)))
    hit = at.join(dealt, (F.col("pcell_") == F.col("cell_")) & meets, "left_semi")
    return hit.drop("pcell_", *low, *high).dropDuplicates([x, y])


def select_pixels(pixels: DataFrame, region: DataFrame, keys: Sequence[str] = ("x", "y")) -> DataFrame:
    """The pixels whose cell is part of a region of interest."""
    return pixels.join(region.select(*keys).distinct(), list(keys), "left_semi")


def to_grid(points: DataFrame, value: Column, order: Sequence[str], x: str = "x_coord", y: str = "y_coord", cell: float = 10) -> DataFrame:
    """(row, col, value): the last value by ``order`` of each cell of the smallest grid that holds all points."""
    extent = points.agg(F.min(x).alias("min_x_"), F.max(y).alias("max_y_"))  # one row
    row, col = raster_index(x, y, F.col("min_x_"), F.col("max_y_"), cell)
    placed = points.join(F.broadcast(extent)).select(row.alias("row"), col.alias("col"), value.alias("value"), F.struct(*order).alias("order_"))
    return placed.groupBy("row", "col").agg(F.max_by("value", F.struct("order_", "value")).alias("value"))


class Grid(NamedTuple):
    """Place and size of a grid: its upper left corner, the side of a cell, and how many cells there are."""

    min_x: float
    max_y: float
    cell: float
    rows: int
    cols: int


def regrid(cells: DataFrame, source: Grid, target: Grid, back: Callable[[Column, Column], tuple[Column, Column]]) -> DataFrame:
    """(row, col, value) on another grid: the value of the source cell that holds the target cell's centre.

    ``back`` projects from the target's coordinates to the source's. Target cells without a source cell are left out.
    """
    number = F.col("id")
    centres = cells.sparkSession.range(target.rows * target.cols).select(F.floor(number / target.cols).cast("int").alias("row"), (number % target.cols).cast("int").alias("col"))
    x, y = back(target.min_x + (F.col("col") + 0.5) * target.cell, target.max_y - (F.col("row") + 0.5) * target.cell)
    at = centres.withColumns({"row_": F.floor((source.max_y - y) / source.cell).cast("int"), "col_": F.floor((x - source.min_x) / source.cell).cast("int")})
    known = cells.select(F.col("row").alias("row_"), F.col("col").alias("col_"), "value")
    return at.join(known, ["row_", "col_"]).select("row", "col", "value")


def break_grid(segments: DataFrame, cell: float = 10) -> DataFrame:
    """Breaks as yyyymmdd by cell; of several in a cell the latest."""
    return to_grid(segments.filter("tBreak IS NOT NULL"), ms_to_yyyymmdd("tBreak"), ["tBreak"], cell=cell)


#: Base colours of the years, red, green and blue.
YEAR_COLOURS = ((228, 26, 28), (55, 126, 184), (77, 175, 74), (152, 78, 163), (255, 127, 0), (166, 86, 40), (247, 129, 191), (153, 153, 153))


def palette(segments: DataFrame) -> DataFrame:
    """(value, label, red, green, blue): a colour for each distinct break date, the year's own, lighter later in the year."""
    dates = segments.filter("tBreak IS NOT NULL").select(ms_to_date("tBreak").alias("date"), ms_to_yyyymmdd("tBreak").alias("value")).distinct()
    place = F.pmod(F.year("date"), F.lit(len(YEAR_COLOURS)))
    share = 0.6 * position_in_year("date")
    base = lambda i: F.get(F.array(*(F.lit(c[i]) for c in YEAR_COLOURS)), place)
    tint = lambda i: F.bround(base(i) + (255 - base(i)) * share).cast("int")
    return dates.select("value", F.date_format("date", "yyyy-MM-dd").alias("label"), tint(0).alias("red"), tint(1).alias("green"), tint(2).alias("blue"))
