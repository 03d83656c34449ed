"""Registered queries of sources, sinks and small helpers: what is written to the shared folder and read again, equal to SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.functions import columns as C
from canopyflux.operators import raster, refdb, spatial
from canopyflux.operators.components import shared_dir
from canopyflux.plans import fixtures as fx
from canopyflux.plans.registry import query
from canopyflux.sources import images, tables, tiff


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/scan-{uuid.uuid4().hex}"


# --- tables ------------------------------------------------------------------------------------------------------------

_CUBE = f"{fx.OBSERVATIONS}, cube AS (SELECT 'T' || l_suppkey % 3 AS tile, (l_suppkey % 40 * 10)::INT AS x, (l_suppkey // 40 * 10)::INT AS y, date, green, red, nir, swir2 FROM obs)"


def _cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_suppkey")
    o = fx.observations(spark, sf_dir)
    return o.select(F.concat(F.lit("T"), (k % 3).cast("string")).alias("tile"), (k % 40 * 10).cast("int").alias("x"), (F.floor(k / 40) * 10).cast("int").alias("y"), "date", *fx.BANDS)


@query(f"WITH {_CUBE} SELECT * FROM cube WHERE tile = 'T1' AND date <= DATE '2000-06-30'")
def cube_scan(spark, sf_dir):
    """A cube written with its older images, the newer ones appended, and one tile of it read up to a date."""
    folder, o = _folder(spark), _cube(spark, sf_dir)
    tables.write_cube(o.filter("date < DATE '1999-01-01'"), folder)
    tables.write_cube(o.filter("date >= DATE '1999-01-01'"), folder, append=True)
    return tables.read_cube(spark, folder, "T1").filter("date <= DATE '2000-06-30'")


@query(f"WITH {_CUBE}, p AS (SELECT DISTINCT tile, x, y FROM cube) SELECT tile, count(*) AS pixels FROM p GROUP BY ALL")
def pixel_counts(spark, sf_dir):
    """How many pixels each tile of a cube has, from its key columns only."""
    folder = _folder(spark)
    tables.write_cube(_cube(spark, sf_dir), folder)
    return tables.read_cube(spark, folder).select("tile", "x", "y").distinct().groupBy("tile").agg(F.count("*").alias("pixels"))


@query(f"WITH {fx.SEGMENTS} SELECT x_coord, y_coord, tBreak, changeProb FROM seg WHERE tBreak > 880000000000")
def segment_files(spark, sf_dir):
    """Segment files: only some columns are read, and the filter reaches the scan."""
    folder = _folder(spark)
    tables.write_segments(fx.segments(spark, sf_dir), folder)
    return tables.read_segments(spark, folder, ["x_coord", "y_coord", "tBreak", "changeProb"]).filter("tBreak > 880000000000")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_orderdate::DATE AS d FROM orders")
def delimited_scan(spark, sf_dir):
    """A text table whose delimiter is found from its header."""
    folder = _folder(spark)
    tables.write_delimited(fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", F.to_date("o_orderdate").alias("d")), folder, sep=";")
    return tables.read_delimited(spark, folder, "o_orderkey long, o_custkey long, o_orderpriority string, d date")


@query(f"WITH {fx.SEGMENTS} SELECT c, tStart, tBreak, changeProb / 100.0 AS changeProb FROM seg")
def list_results_scan(spark, sf_dir):
    """Results of a text table with one row for each location and lists in its columns, as one row for each segment."""
    folder, names = _folder(spark), ("tStart", "tBreak", "changeProb")
    s = fx.segments(spark, sf_dir).withColumn("changeProb", F.col("changeProb") / 100.0)
    lists = s.groupBy("c").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("l"))
    texts = lists.select("c", *(F.concat(F.lit("["), F.array_join(F.col(f"l.{n}").cast("array<string>"), ", "), F.lit("]")).alias(n) for n in names))
    tables.write_delimited(texts, folder, sep="|")
    rows = tables.read_list_results(spark, folder, names, ("tStart", "tBreak"))
    return rows.select(F.col("c").cast("long").alias("c"), *names)


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY ALL")
def cached_table(spark, sf_dir):
    """A table that is built at its first use and read from its files from then on."""
    folder = _folder(spark)
    build = lambda: fx.table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"))
    tables.check_or_build(spark, folder, build)
    return tables.check_or_build(spark, folder, lambda: build().limit(0))


@query(f"WITH {fx.SEGMENTS} SELECT x_coord, y_coord, tBreak, strftime(make_timestamp(tBreak * 1000), '%Y-%m-%d') AS tBreak_date, 'POINT (' || x_coord || ' ' || y_coord || ')' AS geometry FROM seg")
def point_file(spark, sf_dir):
    """Breaks as points with the date of the break."""
    folder = _folder(spark)
    tables.write_points(fx.segments(spark, sf_dir).select("x_coord", "y_coord", "tBreak"), folder)
    return spark.read.parquet(folder)


@query("""WITH px AS (SELECT c_custkey AS v, c_custkey % 40 * 10 + 5.0 AS x, c_custkey // 40 * 10 + 5.0 AS y FROM customer), pt AS (SELECT s_suppkey AS p, s_suppkey % 17 * 23.5 AS x, s_suppkey // 17 * 4.25 AS y FROM supplier)
    SELECT p, v, px.x::DOUBLE AS x, px.y::DOUBLE AS y FROM px JOIN pt ON floor(px.x / 10) = floor(pt.x / 10) AND floor(px.y / 10) = floor(pt.y / 10)""")
def point_samples(spark, sf_dir):
    """The pixels that points lie in."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    px = fx.table(spark, sf_dir, "customer").select(c.alias("v"), (c % 40 * 10 + 5.0).alias("x"), (F.floor(c / 40) * 10 + 5.0).alias("y"))
    pt = fx.table(spark, sf_dir, "supplier").select(s.alias("p"), (s % 17 * 23.5).alias("x"), (F.floor(s / 17) * 4.25).alias("y"))
    return tables.sample_points(px, pt, 10).select("p", "v", "x", "y")


@query("SELECT 'S2SR_image_' || (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + 1000000000000)::VARCHAR || '.tif' AS path, 'S2SR_image_' || strftime(o_orderdate::DATE + 11574, '%Y%m%d') || '.tif' AS renamed FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT 'other_' || o_orderkey || '.tif', 'other_' || o_orderkey || '.tif' FROM orders WHERE o_orderkey % 2 = 1")
def renamed_files(spark, sf_dir):
    """File names with their epoch milliseconds as a date; names without any stay."""
    ms = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400000 + 1_000_000_000_000
    name = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("S2SR_image_"), ms.cast("string"))).otherwise(F.concat(F.lit("other_"), F.col("o_orderkey").cast("string")))
    return fx.table(spark, sf_dir, "orders").select(F.concat(name, F.lit(".tif")).alias("path")).withColumn("renamed", images.dated_name(F.col("path")))


@query("""SELECT o_orderkey AS id, o_orderdate::DATE AS acq_date FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1999-01-01' AND o_custkey % 40 * 10 <= 200 AND o_custkey % 40 * 10 + 15 >= 100
    AND o_custkey // 40 * 10 <= 30 AND o_custkey // 40 * 10 + 15 >= 10 AND o_orderkey % 60 < 20""")
def rectangle_scenes(spark, sf_dir):
    """Scenes of a rectangle and a period with fewer clouds than so many per cent."""
    c = F.col("o_custkey")
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("acq_date"), (F.col("o_orderkey") % 60).alias("cloud_percent"), (c % 40 * 10).alias("min_x"), (F.floor(c / 40) * 10).alias("min_y"))
    o = o.withColumns({"max_x": F.col("min_x") + 15, "max_y": F.col("min_y") + 15})
    return images.scenes_in_box(o, (100, 10, 200, 30), "1997-01-01", "1999-01-01").select("id", "acq_date")


@query("SELECT c_custkey, e FROM customer LEFT JOIN (SELECT user_id, min(event_id) AS e FROM events WHERE user_id % 3 = 0 GROUP BY ALL) f ON f.user_id = c_custkey")
def first_match_left(spark, sf_dir):
    """Rows with the first of several partners; those without any stay."""
    e = fx.table(spark, sf_dir, "events").filter("user_id % 3 = 0").select(F.col("user_id").alias("c_custkey"), F.col("event_id").alias("e"))
    return images.first_match(fx.table(spark, sf_dir, "customer").select("c_custkey"), e, "c_custkey", "e", how="left")


# --- rasters -----------------------------------------------------------------------------------------------------------

_CELLS = f"""{fx.SEGMENTS}, e AS (SELECT min(x_coord) AS mx, max(y_coord) AS my FROM seg),
    cells AS (SELECT round_even((my + 5 - y_coord) / 10.0 - 0.5, 0)::INT AS row, round_even((x_coord - (mx - 5)) / 10.0 - 0.5, 0)::INT AS col, strftime(make_timestamp(max(tBreak) * 1000), '%Y%m%d')::INT AS value FROM seg, e GROUP BY ALL)"""


@query(f"WITH {_CELLS} SELECT 1000 + (col + 0.5) * 10 AS x, 5000 - (row + 0.5) * 10 AS y, value::DOUBLE AS v FROM cells")
def raster_files(spark, sf_dir):
    """The latest breaks of a grid as packed raster files, one for each tile of 16 by 16 cells, and the pixels of all these files."""
    folder = _folder(spark)
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"
    files = tiff.tile_files(raster.break_grid(fx.segments(spark, sf_dir)), 16, 1000.0, 5000.0)
    tiff.write_files(files, folder).write.format("noop").mode("overwrite").save()
    return tiff.read_pixels(spark, folder, ["v"]).filter("v <> -9999").select("x", "y", "v")


@query(f"""WITH {_CELLS}, t AS (SELECT r.r::INT AS row, c.c::INT AS col, 3 + (c + 0.5) * 7 AS x, 250 - (r + 0.5) * 7 AS y FROM range(40) r(r), range(60) c(c))
    SELECT t.row, t.col, cells.value FROM t JOIN cells ON cells.row = floor((300 - (y * 0.8 + x * 0.6)) / 10) AND cells.col = floor((x * 0.8 - y * 0.6 + 50) / 10)""")
def regridded_cells(spark, sf_dir):
    """A grid on a turned one of other cells, by the nearest source cell."""
    source, target = raster.Grid(-50, 300, 10, 100, 100), raster.Grid(3, 250, 7, 40, 60)
    return raster.regrid(raster.break_grid(fx.segments(spark, sf_dir)), source, target, lambda x, y: (x * 0.8 - y * 0.6, y * 0.8 + x * 0.6))


@query(f"WITH {fx.OBSERVATIONS} SELECT l_suppkey, date, CASE WHEN green >= 300 THEN red END AS red, CASE WHEN green >= 300 THEN nir END AS nir, count(*) AS n FROM obs GROUP BY ALL")
def masked_bands(spark, sf_dir):
    """Bands without the observations whose score is too low."""
    o = raster.apply_mask(fx.observations(spark, sf_dir), ["red", "nir"], ~C.clear_score(F.col("green") / 500.0))
    return o.groupBy("l_suppkey", "date", "red", "nir").agg(F.count("*").alias("n"))


# --- geometries --------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.POLYGONS}, a AS (SELECT p, abs(sum(x1 * y2 - x2 * y1)) / 2 AS m2 FROM edge GROUP BY ALL) SELECT p % 7 AS k, count(*)::INT AS parts, round(sum(m2), 6) AS m2 FROM a GROUP BY ALL""")
def multipolygon_parts(spark, sf_dir):
    """Polygons of a key as a multipolygon's text, read again: its parts and their area."""
    many = fx.polygons(spark, sf_dir).groupBy((F.col("p") % 7).alias("k")).agg(spatial.parts_wkt(F.collect_list("ring")).alias("wkt"))
    parts = many.select("k", spatial.parse_parts(F.col("wkt")).alias("parts"))
    area = F.aggregate("parts", F.lit(0.0), lambda s, r: s + spatial.ring_area(r))
    return parts.select("k", F.size("parts").alias("parts"), F.round(area, 6).alias("m2"))


_INSIDE = "inn AS (SELECT id, p, x, y FROM pts, edge GROUP BY ALL HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1)"


@query(f"WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE} SELECT DISTINCT id, p % 7 AS k FROM inn")
def points_in_unions(spark, sf_dir):
    """Points in the union of a key's polygons, each point once for a key."""
    polygons = fx.polygons(spark, sf_dir).select((F.col("p") % 7).alias("k"), "ring")
    return spatial.points_in_unions(fx.locations(spark, sf_dir), polygons, ["k"], "id", "x", "y", cell=50)


@query(f"""WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE}, d AS (SELECT id, CASE WHEN id % 4 > 0 THEN [DATE '1996-01-10' + (id % 300)::INT, DATE '1998-01-10' + (id % 500)::INT] END AS b FROM pts)
    SELECT d.id, inn.p, list_min(list_filter(b, lambda t: t BETWEEN DATE '1996-05-01' + (inn.p % 30)::INT AND DATE '1998-12-31')) AS drop_date FROM d LEFT JOIN inn USING (id)""")
def tile_drops(spark, sf_dir):
    """Locations of a tile, the parcels they lie in, and their first break within the parcel's span."""
    k = F.col("id")
    day = lambda d, m: F.date_add(F.lit(d).cast("date"), (k % m).cast("int")).cast("string")
    pts = fx.locations(spark, sf_dir).withColumn("breaks", F.when(k % 4 > 0, F.concat(F.lit("['"), day("1996-01-10", 300), F.lit("', '"), day("1998-01-10", 500), F.lit("']"))))
    parcels = fx.polygons(spark, sf_dir).withColumns({"start_date": F.date_add(F.lit("1996-05-01").cast("date"), (F.col("p") % 30).cast("int")), "end_date": F.lit("1998-12-31").cast("date")})
    return refdb.drops_per_location(pts, parcels, "x", "y", "breaks", cell=50).select("id", "p", "drop_date")


# --- dates, rows and arrays --------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, d AS back, date_diff('day', DATE '1970-01-01', d) * 86400000 AS ms, CASE WHEN o_orderkey % 5 > 0 THEN d END AS whole, strftime(d, '%Y-%m-%d') AS day_first, d - 60 AS low, d + 70 AS high,
    nullif((o_orderkey % 3) * 1000, 0) AS no_zero FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def date_forms(spark, sf_dir):
    """Ordinals, milliseconds, whole numbers and day-first texts to dates, and spans of dates with 60 days around."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    number = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("d", "yyyyMMdd").cast("int")).otherwise(0)
    low, high = C.days_around("d", F.date_add("d", 10))
    return o.select(
        "o_orderkey", C.ordinal_to_date(C.date_to_ordinal("d")).alias("back"), C.ordinal_to_ms(C.date_to_ordinal("d")).alias("ms"), C.yyyymmdd_to_date(number).alias("whole"),
        C.parse_day_first(F.date_format("d", "ddMMyyyy")).alias("day_first"), low.alias("low"), high.alias("high"), C.zero_ms_to_null(F.col("o_orderkey") % 3 * 1000).alias("no_zero"),
    )


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS number FROM orders")
def numbered_rows(spark, sf_dir):
    """A number for each row of a table, in order."""
    return refdb.numbered_rows(fx.table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "number")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def groups_with_values(spark, sf_dir):
    """Rows of the groups in which not all values are missing."""
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice")).alias("v"))
    return refdb.groups_with_any(o, ["o_custkey"], "v").select("o_orderkey", "o_custkey")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS d FROM orders), g AS (SELECT k, d, coalesce(d - lag(d) OVER (PARTITION BY k ORDER BY d) > 730, false)::INT AS new FROM d), s AS (SELECT k, d, sum(new) OVER (PARTITION BY k ORDER BY d) AS session FROM g),
    p AS (SELECT k, session, min(d) - 60 AS a, max(d) + 60 AS b FROM s GROUP BY ALL) SELECT k, list(a ORDER BY session) AS starts, list(b ORDER BY session) AS ends FROM p GROUP BY ALL""")
def session_spans(spark, sf_dir):
    """Each parcel's sessions as lists of starts and ends, 60 days around."""
    log = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    spans = refdb.session_spans(refdb.cut_sessions(log, "k", "d"), "k")
    return spans.select("k", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))


@query(f"""WITH {fx.SERIES}, s AS (SELECT l_suppkey, list(day ORDER BY day) AS days FROM ser GROUP BY ALL), i AS (SELECT l_suppkey, days, len(days) AS n FROM s)
    SELECT l_suppkey, len(list_filter(days, lambda d: d = 10000))::INT AS hits, list_transform(days, lambda d: d = 10000) AS mask, sha1(array_to_string(days, ',')) AS key,
      CASE WHEN days[n] - days[1] >= 365 THEN coalesce(list_min(list_filter(range(15, greatest(15, n - 12)), lambda j: days[j + 1] - days[4] >= 365)), greatest(15, n - 12))::INT END AS later FROM i""")
def array_helpers(spark, sf_dir):
    """Masks, counts and digests of a series' days, and where a year has passed."""
    s = fx.series(spark, sf_dir).groupBy("l_suppkey").agg(F.array_sort(F.collect_list(F.col("day").cast("long"))).alias("days"))
    return s.select("l_suppkey", C.count_value("days", 10000).alias("hits"), C.value_mask("days", 10000).alias("mask"), C.array_key("days").alias("key"), C.year_later_index("days", 3).alias("later"))


@query("SELECT l_orderkey, l_linenumber, o_custkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL")
def parcel_merge(spark, sf_dir):
    """Operations with the attributes of their parcel; those of no known parcel are left out."""
    li, o = fx.table(spark, sf_dir, "lineitem"), fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return refdb.merge_parcels(li.select("l_orderkey", "l_linenumber"), o, "l_orderkey").groupBy("l_orderkey", "l_linenumber", "o_custkey").agg(F.count("*").alias("n"))
