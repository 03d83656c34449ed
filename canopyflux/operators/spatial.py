"""Spatial predicates and joins. Polygons are rings (arrays of x, y); joins are equi joins on grid cells with exact checks after.

A row goes to the grid cells that its box touches, so that every join is a hash join on cells: no pair is made outside of a
cell. Cell sizes are parameters; a polygon's side should be of the order of a few cells.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _closed(ring: Column) -> Column:
    """Edges of a ring as structs (x1, y1, x2, y2); the last point is joined to the first."""
    moved = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, moved, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point is in a ring: parity of the crossed edges. Borders follow the half-open rule: left and lower ones are in."""

    def crossing(odd: Column, e: Column) -> Column:
        cut = F.when((e["y1"] > y) != (e["y2"] > y), x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]).otherwise(False)
        return odd != cut

    return F.aggregate(_closed(ring), F.lit(False), crossing)


def boundary_distance(x: Column, y: Column, ring: Column) -> Column:
    """Distance of a point to the nearest edge of a ring."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        share = F.coalesce(F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
        return F.sqrt(F.pow(x - e["x1"] - t * dx, 2) + F.pow(y - e["y1"] - t * dy, 2))

    return F.array_min(F.transform(_closed(ring), to_edge))


def ring_area(ring: Column) -> Column:
    """Area of a ring in square units of its coordinates (shoelace)."""
    total = F.aggregate(_closed(ring), F.lit(0.0), lambda s, e: s + e["x1"] * e["y2"] - e["x2"] * e["y1"])
    return F.abs(total) / 2


def area_hectares(ring: Column) -> Column:
    return ring_area(ring) / 10000


def box(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"min_x": F.array_min(xs), "min_y": F.array_min(ys), "max_x": F.array_max(xs), "max_y": F.array_max(ys)}


def ring_wkt(ring: Column) -> Column:
    points = F.transform(F.concat(ring, F.slice(ring, 1, 1)), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return F.concat(F.lit("POLYGON (("), F.array_join(points, ", "), F.lit("))"))


def _ring(body: Column) -> Column:
    """The points of a ring's text, without the repeated last one."""
    points = F.transform(F.split(body, r"\s*,\s*"), lambda p: F.split(F.trim(p), r"\s+"))
    ring = F.transform(points, lambda p: F.struct(F.get(p, F.lit(0)).cast("double").alias("x"), F.get(p, F.lit(1)).cast("double").alias("y")))
    closed = (F.size(ring) > 1) & (F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1))
    return F.when(closed, F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(1)))).otherwise(ring)


def parse_ring(wkt: Column) -> Column:
    """The outer ring of a polygon in WKT, without its repeated last point."""
    body = F.regexp_extract(wkt, r"\(\(([^)]*)\)", 1)
    return F.when(body != "", _ring(body))


def parse_parts(wkt: Column) -> Column:
    """The outer rings of a polygon or multipolygon in WKT; an empty array for other texts and null."""
    found = F.coalesce(F.regexp_extract_all(wkt, F.lit(r"\(\(([^()]+)\)"), F.lit(1)), F.array().cast("array<string>"))
    return F.transform(found, _ring)


def parts_wkt(parts: Column) -> Column:
    """Rings as a multipolygon in WKT."""
    texts = F.transform(parts, lambda r: F.substring(ring_wkt(r), F.lit(9), F.length(ring_wkt(r))))
    return F.concat(F.lit("MULTIPOLYGON ("), F.array_join(texts, ", "), F.lit(")"))


def inside_any(x: Column, y: Column, parts: Column) -> Column:
    """Whether a point is in the union of several rings."""
    return F.exists(parts, lambda r: inside(x, y, r))


def reproject_ring(ring: Column, project: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """The ring with each point through a projection, such as ``tm_forward``."""

    def point(p: Column) -> Column:
        x, y = project(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def clip_ring(ring: Column, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """The part of a ring in a box: the half plane of each side in turn. Empty if nothing is left."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def half_plane(axis: str, bound: float, sign: int) -> Callable[[Column], Column]:
        def kept(e: Column) -> Column:
            a, b = (sign * (e[f"{axis}{i}"] - bound) for i in (1, 2))
            t = F.coalesce(F.try_divide(a, a - b), F.lit(0.0))
            cut = F.struct((e["x1"] + t * (e["x2"] - e["x1"])).alias("x"), (e["y1"] + t * (e["y2"] - e["y1"])).alias("y"))
            end = F.struct(e["x2"].alias("x"), e["y2"].alias("y"))
            return F.concat(F.when((a >= 0) != (b >= 0), F.array(cut)).otherwise(none), F.when(b >= 0, F.array(end)).otherwise(none))

        return kept

    for axis, bound, sign in (("x", min_x, 1), ("x", max_x, -1), ("y", min_y, 1), ("y", max_y, -1)):
        ring = F.flatten(F.transform(_closed(ring), half_plane(axis, bound, sign)))
    return ring


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def grid_cells(low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float) -> Column:
    """All cells that a box touches."""
    return F.flatten(
        F.transform(
            F.sequence(_cell(low_x, size), _cell(high_x, size)), lambda i: F.transform(F.sequence(_cell(low_y, size), _cell(high_y, size)), lambda j: F.struct(i.alias("i"), j.alias("j")))
        )
    )


def meets_box(ring: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether an edge of the ring and a box have a point in common: the part of the edge that lies between both pairs of sides isn't empty."""

    def common(e: Column) -> Column:
        first, last, out = F.lit(0.0), F.lit(1.0), F.lit(False)
        for axis, low, high in (("x", min_x, max_x), ("y", min_y, max_y)):
            start, step = e[f"{axis}1"], e[f"{axis}2"] - e[f"{axis}1"]
            a, b = F.try_divide(low - start, step), F.try_divide(high - start, step)
            first, last = F.greatest(first, F.least(a, b)), F.least(last, F.greatest(a, b))  # an edge along the sides has no such bounds
            out = out | ((step == 0) & ((start < low) | (start > high)))
        return ~out & (first <= last)

    return F.exists(_closed(ring), common)


def _crossing(a: Column, b: Column) -> Column:
    """Whether two edges have a point in common, ends included."""
    turn = lambda e, x, y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"]))
    apart = lambda e, f: turn(e, f["x1"], f["y1"]) * turn(e, f["x2"], f["y2"])
    boxes = F.lit(True)
    for c in "xy":
        boxes &= (F.greatest(a[f"{c}1"], a[f"{c}2"]) >= F.least(b[f"{c}1"], b[f"{c}2"])) & (F.greatest(b[f"{c}1"], b[f"{c}2"]) >= F.least(a[f"{c}1"], a[f"{c}2"]))
    return boxes & (apart(a, b) <= 0) & (apart(b, a) <= 0)


def polygons_in_polygons(left: DataFrame, right: DataFrame, ring: str = "ring", other: str = "other", cell: float = 1000.0, predicate: str = "within", how: str = "inner", id_col: str = "id") -> DataFrame:
    """Pairs of a polygon and one it lies ``within`` (no edges cross or touch) or ``intersects``, with all columns of both.

    Column names must differ. With ``how="left"`` polygons without a partner stay, with nulls. A pair that shares several
    cells is found in the first of them only.
    """
    a, b = box(F.col(ring)), box(F.col(other))
    spread = lambda c: grid_cells(c["min_x"], c["min_y"], c["max_x"], c["max_y"], cell)
    l, r = left.withColumn("cells_", spread(a)).withColumn("cell_", F.explode("cells_")), right.withColumn("ocells_", spread(b)).withColumn("ocell_", F.explode("ocells_"))
    cross = F.exists(_closed(F.col(ring)), lambda e: F.exists(_closed(F.col(other)), lambda f: _crossing(e, f)))
    first = lambda p: (p[0]["x"], p[0]["y"])
    in_other = inside(*first(F.col(ring)), F.col(other))
    holds = in_other & ~cross if predicate == "within" else in_other | cross | inside(*first(F.col(other)), F.col(ring))
    once = F.col("cell_") == F.array_min(F.array_intersect("cells_", "ocells_"))
    found = l.join(r, (F.col("cell_") == F.col("ocell_")) & once & holds).drop("cells_", "cell_", "ocells_", "ocell_")
    if how == "inner":
        return found
    return found.unionByName(left.join(found.select(id_col).distinct(), id_col, "left_anti"), allowMissingColumns=True)


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str, y: str, ring: str = "ring", cell: float = 1000.0, how: str = "inner") -> DataFrame:
    """Pairs of a point and a polygon that holds it, with all columns of both; with ``left_semi`` the points in any polygon.

    Column names must differ. A point in several polygons has a row for each.
    """
    corners = box(F.col(ring))
    dealt = polygons.withColumn("cell_", F.explode(grid_cells(corners["min_x"], corners["min_y"], corners["max_x"], corners["max_y"], cell)))
    at = points.withColumn("pcell_", F.struct(_cell(F.col(x), cell).alias("i"), _cell(F.col(y), cell).alias("j")))
    condition = (F.col("pcell_") == F.col("cell_")) & inside(F.col(x), F.col(y), F.col(ring))
    return at.join(dealt, condition, how).drop("pcell_", "cell_")


def points_in_unions(points: DataFrame, polygons: DataFrame, keys: Sequence[str], id_col: str, x: str, y: str, ring: str = "ring", cell: float = 1000.0) -> DataFrame:
    """(id, keys) of points in the union of all polygons of a key, once each. Rings stay rows, so a union may have any number."""
    return points_in_polygons(points.select(id_col, x, y), polygons.select(*keys, ring), x, y, ring, cell).select(id_col, *keys).distinct()


def near_boundary(joined: DataFrame, x: str, y: str, distance: float, ring: str = "ring", name: str = "border") -> DataFrame:
    """Adds whether a point lies within ``distance`` of its polygon's boundary (1 or 0)."""
    return joined.withColumn(name, (boundary_distance(F.col(x), F.col(y), F.col(ring)) < distance).cast("int"))


def neighbour_pairs(points: DataFrame, distance: float, id_col: str = "id", x: str = "x", y: str = "y", carry: Sequence[str] = ()) -> DataFrame:
    """(a, b) with a < b of points at most ``distance`` apart, and the carried columns of both with suffixes _a and _b.

    Cells have the side ``distance``, so partners are in the cell or in one of its eight neighbours: an equi join on cells.
    Neither side is broadcast: sizes estimated from packed files can be a small part of the rows'.
    """
    own = points.select(F.col(id_col).alias("a"), F.col(x).alias("x_a"), F.col(y).alias("y_a"), *(F.col(c).alias(f"{c}_a") for c in carry))
    around = F.array(*(F.struct((_cell(F.col("x_a"), distance) + i).alias("i"), (_cell(F.col("y_a"), distance) + j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    left = own.withColumn("cell", F.explode(around))
    right = points.select(
        F.col(id_col).alias("b"), F.col(x).alias("x_b"), F.col(y).alias("y_b"), *(F.col(c).alias(f"{c}_b") for c in carry),
        F.struct(_cell(F.col(x), distance).alias("i"), _cell(F.col(y), distance).alias("j")).alias("cell"),
    )
    square = F.pow(F.col("x_a") - F.col("x_b"), 2) + F.pow(F.col("y_a") - F.col("y_b"), 2)
    return left.join(right.hint("merge"), "cell").filter((F.col("a") < F.col("b")) & (square <= distance * distance)).drop("cell")


def assign_tile(features: DataFrame, tiles: DataFrame, id_col: str, tile_col: str, cell: float = 100_000.0) -> DataFrame:
    """Each feature's tile: of those whose box holds the feature's, else of those it meets, the first by name; null for none.

    Both tables have min_x, min_y, max_x, max_y.
    """
    names = ("min_x", "min_y", "max_x", "max_y")
    spread = lambda df: F.explode(grid_cells(*(df[n] for n in names), cell))
    f = features.select(id_col, *names).withColumn("cell", spread(features))
    t = tiles.select(tile_col, *(F.col(n).alias(f"t_{n}") for n in names), *names).withColumn("cell", spread(tiles)).drop(*names)
    meets = (F.col("min_x") <= F.col("t_max_x")) & (F.col("max_x") >= F.col("t_min_x")) & (F.col("min_y") <= F.col("t_max_y")) & (F.col("max_y") >= F.col("t_min_y"))
    holds = (F.col("min_x") >= F.col("t_min_x")) & (F.col("max_x") <= F.col("t_max_x")) & (F.col("min_y") >= F.col("t_min_y")) & (F.col("max_y") <= F.col("t_max_y"))
    best = f.join(t, "cell").filter(meets).groupBy(id_col).agg(F.min(F.struct((~holds).alias("only_meets"), F.col(tile_col))).alias("best"))
    return features.join(best.select(id_col, F.col(f"best.{tile_col}").alias(tile_col)), id_col, "left")


def in_box(x: str, y: str, min_x: float, min_y: float, max_x: float, max_y: float) -> Column:
    """A box predicate that reaches the scan."""
    return F.col(x).between(min_x, max_x) & F.col(y).between(min_y, max_y)
