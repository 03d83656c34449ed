"""Registered queries of the time-series operators, and the SQL that each must equal.

Where SQL can express only a part of an operator, that part is a query of its own; the rest is held by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.functions import columns as C
from canopyflux.functions.geodesy import tm_forward, tm_inverse
from canopyflux.operators import detect, graph, raster, refdb, segments, series, spatial, validation
from canopyflux.operators.components import components, cut
from canopyflux.plans import fixtures as fx
from canopyflux.plans import scans  # noqa: F401  (registers its queries)
from canopyflux.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from canopyflux.sources import images, tables

# --- detection ---------------------------------------------------------------------------------------------------------


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series to segments, break marks and the latest break of each location."""
    found = detect.detect_changes(fx.observations(spark, sf_dir), ["l_suppkey"])
    marked = segments.mark_breaks(found.filter("tBreak IS NOT NULL"), ["l_suppkey"])
    last = marked.groupBy("l_suppkey").agg(F.max(F.when(F.col("changeProb") == 100, F.col("tBreak"))).alias("tBreak"), F.count("*").alias("n_segments"), F.sum("is_break").alias("n_breaks"))
    return segments.with_break_date(last)


@query()
def ccd_last_break(spark, sf_dir):
    return flagship(spark, sf_dir)


@query()
def ccd_segments(spark, sf_dir):
    return detect.detect_changes(fx.observations(spark, sf_dir), ["l_suppkey"])


@query()
def ccd_detection_struct(spark, sf_dir):
    return detect.detection_struct(fx.observations(spark, sf_dir), ["l_suppkey"])


@query()
def tmask_outliers(spark, sf_dir):
    return detect.cloud_outlier_mask(fx.observations(spark, sf_dir), ["l_suppkey"])


@query(f"""WITH {fx.OBSERVATIONS} SELECT l_suppkey, count(*) AS n, sum(CASE WHEN nir + red > 0 THEN floor(10000.0 * (nir - red) / (nir + red)) END)::BIGINT AS ndvi_sum,
    sum(green) AS green_sum FROM obs WHERE green <> 500 AND red <> 500 AND nir <> 500 AND swir2 <> 500 GROUP BY ALL""")
def clean_observations(spark, sf_dir):
    """Observations without a missing band (500 stands for nodata here)."""
    rows = detect.clean_observations(fx.observations(spark, sf_dir), ["l_suppkey"], nodata=500)
    return rows.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.floor("ndvi")).alias("ndvi_sum"), F.sum(F.col("green").cast("long")).alias("green_sum"))


@query("SELECT DISTINCT l_suppkey, l_suppkey % 10 = 0 AS empty FROM lineitem")
def detected_locations(spark, sf_dir):
    """Every location is there once at least; those without any valid observation as a row of nulls."""
    o = fx.observations(spark, sf_dir).withColumn("green", F.when(F.col("l_suppkey") % 10 == 0, 65535).otherwise(F.col("green")))
    found = detect.detect_changes(o, ["l_suppkey"])
    return found.groupBy("l_suppkey").agg(F.bool_and(F.col("tStart").isNull() & F.col("error").isNull()).alias("empty"))


# --- columns -----------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.SERIES} SELECT l_suppkey, day, CASE WHEN nir + red > 0 THEN 10000 * (nir - red) / (nir + red) END AS ndvi, CASE WHEN nir + swir2 > 0 THEN 10000 * (nir - swir2) / (nir + swir2) END AS nbr, CASE WHEN nir + red > 0 THEN (nir - red) / (nir + red) END AS plain FROM ser")
def ndvi_scaled(spark, sf_dir):
    return fx.series(spark, sf_dir).select("l_suppkey", "day", C.ndvi("nir", "red").alias("ndvi"), C.nbr("nir", "swir2").alias("nbr"), C.normalized_difference("nir", "red").alias("plain"))


@query(f"WITH {fx.OBSERVATIONS} SELECT l_suppkey, count(*) FILTER (green = 500 OR red = 500 OR nir = 500 OR swir2 = 500) AS bad, count(*) FILTER (green = 500) AS bad_green, count(nullif(green, 500)) AS kept_green FROM obs GROUP BY ALL")
def nodata_filter(spark, sf_dir):
    o = fx.observations(spark, sf_dir).withColumn("bad", C.any_nodata(*fx.BANDS, nodata=500))
    return o.groupBy("l_suppkey").agg(F.count_if("bad").alias("bad"), F.count_if(F.col("green") == 500).alias("bad_green"), F.count(C.nodata_to_null("green", 500)).alias("kept_green"))


@query("SELECT event_id, (floor(value * 50)::BIGINT & 1024) = 0 AND (floor(value * 50)::BIGINT & 2048) = 0 AS clear, (floor(value * 50)::BIGINT >> 3) & 1 AS bit3, floor(value)::BIGINT > 50 AS cloudy, floor(value)::BIGINT <= 60 AS usable FROM events")
def qa_bitmask(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").withColumns({"qa": F.floor(F.col("value") * 50).cast("long"), "v": F.floor("value").cast("long")})
    return e.select("event_id", C.clear_qa60("qa").alias("clear"), C.bit("qa", 3).cast("long").alias("bit3"), C.cloud("v").alias("cloudy"), C.scene_usable("v").alias("usable"))


@query(f"WITH {fx.OBSERVATIONS} SELECT swir2 // 10 - 1000 AS v, greatest(0, least(5000, (swir2 // 10 - 1000)::INT)) AS clamped, count(*) AS n FROM obs GROUP BY ALL")
def ndvi_clamp(spark, sf_dir):
    v = (F.floor(F.col("swir2") / 10) - 1000).cast("long")
    return fx.observations(spark, sf_dir).select(v.alias("v"), C.clamp_ndvi(v).alias("clamped")).groupBy("v", "clamped").agg(F.count("*").alias("n"))


@query(f"WITH {fx.OBSERVATIONS} SELECT l_suppkey, date, green < 200 AND red <> 600 AS dark, CASE WHEN NOT (green = 10 AND red = 400) THEN swir2 END AS kept, count(*) AS n FROM obs GROUP BY ALL")
def dark_pixels(spark, sf_dir):
    o = fx.observations(spark, sf_dir)
    dark = C.dark_pixel("green", F.col("red") / 100, share=0.2, scale=1000)
    kept = C.all_zero_to_null("swir2", F.col("green") - 10, F.col("red") - 400)
    return o.select("l_suppkey", "date", dark.alias("dark"), kept.alias("kept")).groupBy("l_suppkey", "date", "dark", "kept").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, CASE WHEN year(d) BETWEEN 1996 AND 1999 THEN d END AS parsed, strftime(d, '%Y%m%d')::INT AS yyyymmdd, date_diff('day', DATE '1970-01-01', d) + 719163 AS ordinal,
    (dayofyear(d) - 1) / (dayofyear(make_date(year(d), 12, 31)) - 1)::DOUBLE AS place, (date_diff('day', DATE '1970-01-01', d) * 86400000) / 86400000.0::DOUBLE AS days
    FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)""")
def tolerant_dates(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("d", "yyyy-MM-dd")).otherwise(F.date_format("d", "yyyyMMdd"))
    ms = C.date_to_ms("d")
    return o.select(
        "o_orderkey", C.parse_date_tolerant(text, 1996, 1999).alias("parsed"), C.ms_to_yyyymmdd(ms).alias("yyyymmdd"), C.date_to_ordinal("d").cast("long").alias("ordinal"),
        C.position_in_year("d").alias("place"), C.ms_to_days(ms).alias("days"),
    )


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (o_orderkey % 61 - 20)::INT END AS b FROM orders)
    SELECT o_orderkey, CASE WHEN b IS NOT NULL AND b <> a THEN a + floor((b - a) / 2)::INT ELSE a END AS mid, (a - INTERVAL 2 MONTH)::DATE AS two_before, (a + INTERVAL 18 MONTH)::DATE AS later,
    CASE WHEN b IS NULL THEN 'Sem Alteracao' ELSE 'Com Alteracao' END AS altera FROM d""")
def midpoint_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    o = o.withColumn("b", F.when(k % 7 != 0, F.date_add("a", (k % 61 - 20).cast("int"))))
    return o.select("o_orderkey", C.midpoint_date("a", "b").alias("mid"), C.shift_months("a", -2).alias("two_before"), C.shift_months("a", 18).alias("later"), C.changed_label("b").alias("altera"))


@query("SELECT month(o_orderdate) AS m, CASE WHEN month(o_orderdate) IN (1, 2, 11, 12) THEN 'winter' WHEN month(o_orderdate) IN (3, 4, 9, 10) THEN 'between' ELSE 'summer' END AS g, count(*) AS n FROM orders GROUP BY ALL")
def month_groups(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").cast("long").alias("m"), C.month_group("o_orderdate").alias("g")).agg(F.count("*").alias("n"))


@query("""SELECT b, count(*) AS n, sum(floor(a * 100)::BIGINT) AS area FROM (SELECT floor(o_totalprice) / 5000 AS a, CASE WHEN a <= 0.5 THEN 0 WHEN a <= 5 THEN 1 WHEN a <= 10 THEN 2 WHEN a <= 20 THEN 3
    WHEN a <= 30 THEN 4 WHEN a <= 40 THEN 5 ELSE 6 END AS b FROM orders) GROUP BY ALL""")
def area_bins(spark, sf_dir):
    a = F.floor("o_totalprice") / 5000
    o = fx.table(spark, sf_dir, "orders").select(C.binned(a).alias("b"), F.floor(a * 100).alias("a"))
    return o.groupBy("b").agg(F.count("*").alias("n"), F.sum("a").alias("area"))


@query("SELECT c_custkey, c_name FROM customer WHERE (list_sum(list_transform(string_split(substr(lpad(c_custkey::VARCHAR, 5, '0'), 1, 5), ''), lambda x: x::INT))) % 2 = 0")
def digit_parity_sample(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return c.filter(C.digit_sum_even(F.lpad(F.col("c_custkey").cast("string"), 5, "0"))).select("c_custkey", "c_name")


@query("""SELECT o_orderkey, regexp_replace(o_orderpriority, '[^0-9A-Za-z]', '', 'g') AS letters, string_split(o_orderpriority, '-')[1] AS first, nullif(substr(o_orderpriority, length(string_split(o_orderpriority, '-')[1]) + 2), '') AS rest,
    starts_with(o_orderpriority, '1') AS starts FROM orders""")
def text_cleaning(spark, sf_dir):
    first, rest = C.split_once("o_orderpriority", "-")
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", C.alphanumeric("o_orderpriority").alias("letters"), first.alias("first"), rest.alias("rest"), F.startswith("o_orderpriority", F.lit("1")).alias("starts"))


@query(f"""WITH {fx.LOCATIONS} SELECT id, least(floor((x - 0) / (400.0 / 6)), 5)::INT * 6 + least(floor((y - 0) / (400.0 / 6)), 5)::INT + 1 AS part FROM pts WHERE x BETWEEN 0 AND 400 AND y BETWEEN 0 AND 400""")
def tile_parts(spark, sf_dir):
    return fx.locations(spark, sf_dir).filter(spatial.in_box("x", "y", 0, 0, 400, 400)).select("id", C.tile_part("x", "y", 0, 0, 400, 400).alias("part"))


@query()
def tm_round_trip(spark, sf_dir):
    """Points to the UTM zone and back: the differences in degrees, which must vanish."""
    p = fx.locations(spark, sf_dir).select("id", (F.col("x") / 200 - 10).alias("lon"), (F.col("y") / 500 + 38).alias("lat"))
    e, n = tm_forward(F.col("lon"), F.col("lat"))
    p = p.withColumns({"easting": e, "northing": n})
    lon, lat = tm_inverse(F.col("easting"), F.col("northing"))
    return p.select("id", F.round("easting", 3).alias("easting"), F.round("northing", 3).alias("northing"), (F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")) < 1e-9).alias("same"))


# --- sources -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'file:/x/S2SR_image_' || (date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400000 + 1000000000000)::VARCHAR || '_tile_' || o_orderkey || '.tif' AS path, 'T29TNE' AS tile,
    (o_orderdate::DATE + 11574)::DATE AS acq_date FROM orders WHERE o_orderdate::DATE + 11574 <= DATE '2030-01-01'""")
def image_listing(spark, sf_dir):
    ms = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400000 + 1_000_000_000_000
    files = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("file:/x/S2SR_image_"), ms.cast("string"), F.lit("_tile_"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"))
    import datetime

    return images.list_epoch(files, "T29TNE", datetime.date(2030, 1, 1))


@query("""SELECT '/d/Theia_T29TNE_' || strftime(o_orderdate, '%Y%m%d') || '-' || o_orderkey || '.tif' AS path, 'T29TNE' AS tile, o_orderdate::DATE AS acq_date FROM orders WHERE year(o_orderdate) BETWEEN 1997 AND 1999""")
def theia_listing(spark, sf_dir):
    import datetime

    name = F.concat(F.lit("/d/Theia_T29TNE_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("-"), F.col("o_orderkey").cast("string"), F.lit(".tif"))
    return images.list_theia(fx.table(spark, sf_dir, "orders").select(name.alias("path")), "T29TNE", 1997, datetime.date(1999, 3, 1))


@query("SELECT max(o_totalprice) AS pixels, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS path FROM (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS o_totalprice FROM orders)")
def largest_raster(spark, sf_dir):
    r = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), F.floor("o_totalprice").alias("width"), F.lit(1).alias("height"))
    return images.largest(r)


@query("""SELECT s.o_orderkey, s.o_custkey, f.e FROM (SELECT o_orderkey, o_custkey FROM orders) s JOIN (SELECT user_id, min(event_id) AS e FROM events GROUP BY ALL) f ON f.user_id = s.o_custkey""")
def first_match_join(spark, sf_dir):
    """Scenes with the first of several partners of the same index."""
    s = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    e = fx.table(spark, sf_dir, "events").select(F.col("user_id").alias("o_custkey"), F.col("event_id").alias("e"))
    return images.first_match(s, e, "o_custkey", "e")


@query("SELECT o_orderkey AS id, o_orderdate::DATE AS acq_date, o_totalprice AS cloud_percent FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND o_totalprice <= 100000")
def scene_collection(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("acq_date"), F.col("o_totalprice").alias("cloud_percent"))
    return images.scenes(o, "1997-01-01", "1998-01-01", clouds=100000)


@query("SELECT c_custkey AS k, c_name AS name, NULL::DOUBLE AS price FROM customer UNION ALL SELECT p_partkey, NULL, p_retailprice FROM part")
def union_sources(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    p = fx.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("price"))
    return tables.union_sources(c, p)


# --- series ------------------------------------------------------------------------------------------------------------

_GAPS = f"WITH {fx.SERIES}, g AS (SELECT *, day - lag(day) OVER (PARTITION BY l_suppkey ORDER BY day) AS gap FROM ser)"


@query(_GAPS + " SELECT l_suppkey, median(gap) AS median_gap, count(*) AS n_obs FROM g GROUP BY ALL")
def series_gap_median(spark, sf_dir):
    return series.median_gap(fx.series(spark, sf_dir), ["l_suppkey"])


@query(_GAPS + " SELECT l_suppkey, median(gap) AS median_gap, greatest(6, coalesce(round_even(96.0 / nullif(median(gap), 0), 0)::INT, 6)) AS peek FROM g GROUP BY ALL")
def adjust_peek(spark, sf_dir):
    return series.adjust_peek(fx.series(spark, sf_dir), ["l_suppkey"])


@query(f"""WITH {fx.SERIES}, s AS (SELECT l_suppkey, abs(green - lag(green) OVER w) AS g, abs(swir2 - lag(swir2) OVER w) AS s FROM ser WINDOW w AS (PARTITION BY l_suppkey ORDER BY day))
    SELECT l_suppkey, median(g) AS green_variogram, median(s) AS swir2_variogram FROM s GROUP BY ALL""")
def variogram_lag1(spark, sf_dir):
    return series.variogram(fx.series(spark, sf_dir), ["l_suppkey"], ["green", "swir2"])


@query(f"""WITH {fx.SERIES}, n AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY day) AS r FROM ser),
    p AS (SELECT a.l_suppkey, b.r - a.r AS lag, b.day - a.day AS gap, abs(b.green - a.green) AS green, abs(b.swir2 - a.swir2) AS swir2 FROM n a JOIN n b ON a.l_suppkey = b.l_suppkey AND b.r > a.r),
    c AS (SELECT l_suppkey, lag, gap, count(*) AS k FROM p GROUP BY ALL), m AS (SELECT l_suppkey, lag, arg_min(gap, (-k, gap)) AS usual FROM c GROUP BY ALL),
    f AS (SELECT l_suppkey, min(lag) AS lag FROM m WHERE usual > 30 GROUP BY ALL)
    SELECT k.l_suppkey, f.lag, median(green) FILTER (f.lag IS NULL OR gap > 30) AS green_variogram, median(swir2) FILTER (f.lag IS NULL OR gap > 30) AS swir2_variogram
    FROM (SELECT DISTINCT l_suppkey FROM p) k LEFT JOIN f USING (l_suppkey) JOIN p ON p.l_suppkey = k.l_suppkey AND p.lag = coalesce(f.lag, 1) GROUP BY ALL""")
def adjusted_variogram(spark, sf_dir):
    return series.adjusted_variogram(fx.series(spark, sf_dir), ["l_suppkey"], ["green", "swir2"])


def _around_sql(n: int) -> str:
    cells = ", ".join(
        f"max({c}) FILTER (side = '{s}' AND rank = {i} AND value = '{v}') AS {v}{k}_{s}{i}" for v in ("green", "red") for k, c in (("", "x"), ("_day", "day")) for s in "ad" for i in range(1, n + 1)
    )
    return f"""WITH {fx.SERIES}, ev AS (SELECT l_suppkey, (min(day) + max(day)) // 2 AS mid FROM ser GROUP BY ALL),
        l AS (SELECT l_suppkey, day, 'green' AS value, nullif(green, 500) AS x FROM ser UNION ALL SELECT l_suppkey, day, 'red', nullif(red, 500) FROM ser),
        j AS (SELECT l_suppkey, mid, day, value, x, CASE WHEN day <= mid THEN 'a' ELSE 'd' END AS side FROM ev JOIN l USING (l_suppkey) WHERE x IS NOT NULL),
        r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, mid, value, side ORDER BY abs(day - mid)) AS rank FROM j)
        SELECT l_suppkey, mid, {cells} FROM r WHERE rank <= {n} GROUP BY ALL"""


@query(_around_sql(3))
def obs_before_after_n(spark, sf_dir):
    s = fx.series(spark, sf_dir).withColumns({c: C.nodata_to_null(c, 500) for c in ("green", "red")})
    events = s.groupBy("l_suppkey").agg(F.floor((F.min("day") + F.max("day")) / 2).cast("int").alias("mid"))
    return series.observations_around(s, events, ["l_suppkey"], ["green", "red"], 3)


@query(f"""WITH {fx.SERIES}, s AS (SELECT l_suppkey, day, swir2 - lag(swir2) OVER (PARTITION BY l_suppkey ORDER BY day) AS drop FROM ser)
    SELECT l_suppkey, min(drop) AS drop, arg_min(day, (drop, day)) AS drop_day FROM s WHERE drop IS NOT NULL GROUP BY ALL""")
def largest_drop(spark, sf_dir):
    return series.largest_drop(fx.series(spark, sf_dir), ["l_suppkey"], "swir2")


@query(f"WITH {fx.OBSERVATIONS} SELECT l_suppkey, date, median(swir2) AS median, count(swir2) AS n FROM obs GROUP BY ALL")
def median_by_region_date(spark, sf_dir):
    return series.median_by_region_and_date(fx.observations(spark, sf_dir), ["l_suppkey", "date"], F.col("swir2"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS at FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT DISTINCT o_custkey AS k, o_orderdate::DATE AS date FROM orders WHERE o_orderstatus <> 'F')
    SELECT c.k, c.at, max(d.date) AS closest FROM c LEFT JOIN d ON c.k = d.k AND d.date < c.at GROUP BY ALL""")
def closest_earlier_date(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("at"), "o_orderstatus")
    return series.closest_earlier(o.filter("o_orderstatus = 'F'").select("k", "at").distinct(), o.filter("o_orderstatus <> 'F'").select("k", F.col("at").alias("date")), ["k"], "at", "date")


@query(f"WITH {fx.SERIES} SELECT l_suppkey, round(regr_slope(swir2, day), 6) AS slope, round(regr_r2(swir2, day), 6) AS r2 FROM ser GROUP BY ALL")
def ols_trend(spark, sf_dir):
    s = fx.series(spark, sf_dir)
    return s.groupBy("l_suppkey").agg(F.round(F.regr_slope("swir2", "day"), 6).alias("slope"), F.round(F.regr_r2("swir2", "day"), 6).alias("r2"))


# --- segments ----------------------------------------------------------------------------------------------------------


@query(f"WITH {fx.SEGMENTS} SELECT c, tStart, CASE WHEN lead(tStart) OVER (PARTITION BY c ORDER BY tStart) IS NOT NULL THEN 1 ELSE 0 END AS is_break FROM seg")
def is_break(spark, sf_dir):
    return segments.mark_breaks(fx.segments(spark, sf_dir), ["c"]).select("c", "tStart", "is_break")


@query(f"""WITH {fx.SEGMENTS} SELECT c, tStart, CASE WHEN count(tStart) OVER w > 1 AND max(tBreak) OVER w <> tBreak THEN 1.0::DOUBLE ELSE changeProb / 100.0::DOUBLE END AS changeProb FROM seg WINDOW w AS (PARTITION BY c)""")
def fix_change_prob(spark, sf_dir):
    return segments.fix_change_prob(fx.segments(spark, sf_dir), ["c"]).select("c", "tStart", "changeProb")


_RANGE = (820454400000, 978220800000)  # 1996 to 2000


@query(f"""WITH {fx.SEGMENTS}, r AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY tBreak DESC, tStart) AS r, count(*) OVER (PARTITION BY c) AS n FROM seg WHERE tBreak BETWEEN {_RANGE[0]} AND {_RANGE[1]})
    SELECT c, tStart, tBreak FROM r WHERE r = least(2, n)""")
def select_break_in_range(spark, sf_dir):
    return segments.select_break(fx.segments(spark, sf_dir), *_RANGE, keys=["c"]).select("c", "tStart", "tBreak")


def _boundary_sql() -> str:
    part = {"Start": ("day >= s0", "ASC", 1), "Start2": ("day >= s0", "ASC", 2), "End": ("day <= e0", "DESC", 1), "End2": ("day <= e0", "DESC", 2)}
    cells = ", ".join(f"(list({v} ORDER BY day {o}) FILTER ({c}))[{i}] AS {v}{n}" for v in ("green", "nir") for n, (c, o, i) in part.items())
    return f"WITH {fx.SERIES}, s AS (SELECT l_suppkey, min(day) + 100 AS s0, max(day) - 100 AS e0 FROM ser GROUP BY ALL) SELECT l_suppkey, s0, e0, {cells} FROM s JOIN ser USING (l_suppkey) GROUP BY ALL"


@query(_boundary_sql())
def boundary_values(spark, sf_dir):
    s = fx.series(spark, sf_dir)
    spans = s.groupBy("l_suppkey").agg((F.min("day") + 100).alias("s0"), (F.max("day") - 100).alias("e0"))
    return segments.boundary_values(spans, s, ["l_suppkey"], ["green", "nir"], "s0", "e0")


@query(f"""WITH {fx.SEGMENTS}, l AS (SELECT c, list(tStart ORDER BY tStart) AS tStart, list(price ORDER BY tStart) AS price FROM seg GROUP BY c) SELECT c, unnest(tStart) AS tStart, unnest(price) AS price FROM l
    UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey NOT IN (SELECT c FROM seg)""")
def explode_segments(spark, sf_dir):
    pairs = fx.segments(spark, sf_dir).groupBy("c").agg(F.array_sort(F.collect_list(F.struct("tStart", "price"))).alias("p"))
    lists = pairs.select("c", F.col("p.tStart").alias("tStart"), F.col("p.price").alias("price"))
    every = fx.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("c")).join(lists, "c", "left")
    empty = F.array().cast("array<bigint>")
    return segments.explode_lists(every.withColumns({x: F.coalesce(x, empty) for x in ("tStart", "price")}), ["tStart", "price"])


_CURVE = "(price / 100.0 + 0.001 * t + 50 * cos(w * t) - 20 * sin(w * t) + 5 * cos(2 * w * t) + 3 * sin(2 * w * t) + 2 * cos(3 * w * t) - 1 * sin(3 * w * t))"


def _modelled(spark, sf_dir):
    values = F.array(*(F.lit(v) for v in (0.001, 50.0, -20.0, 5.0, 3.0, 2.0, -1.0)))
    return fx.segments(spark, sf_dir).withColumns({"intercept_values": F.col("price") / 100.0, "coeficientes": values})


@query(f"""WITH {fx.SEGMENTS}, t AS (SELECT c, tStart, price, unnest(range(tStart // 86400000 + 719163, tEnd // 86400000 + 719164, 20)) AS t, 2 * pi() / 365.25 AS w FROM seg)
    SELECT c, count(*) AS n, round(sum({_CURVE}), 2) AS total FROM t GROUP BY ALL""")
def predicted_curve(spark, sf_dir):
    curve = segments.predicted_curve(_modelled(spark, sf_dir), ["c"], 20)
    return curve.groupBy("c").agg(F.count("*").alias("n"), F.round(F.sum("predicted"), 2).alias("total"))


@query(f"""WITH {fx.SEGMENTS}, t AS (SELECT *, 2 * pi() / 365.25 AS w, tEnd // 86400000 + 719163 AS te, tStart // 86400000 + 719163 AS ts FROM seg),
    v AS (SELECT c, tStart, {_CURVE.replace(' t', ' te')} AS e, {_CURVE.replace(' t', ' ts')} AS s FROM t)
    SELECT c, tStart, round(e - lead(s) OVER (PARTITION BY c ORDER BY tStart), 4) AS ndvi_magnitude FROM v""")
def magnitude_between(spark, sf_dir):
    return segments.magnitude_between(_modelled(spark, sf_dir), ["c"]).select("c", "tStart", F.round("ndvi_magnitude", 4).alias("ndvi_magnitude"))


# --- rasters -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {fx.SEGMENTS}, e AS (SELECT min(x_coord) AS mx, max(y_coord) AS my FROM seg),
    r AS (SELECT round_even((my + 5 - y_coord) / 10.0 - 0.5, 0)::INT AS row, round_even((x_coord - (mx - 5)) / 10.0 - 0.5, 0)::INT AS col, tBreak FROM seg, e)
    SELECT row, col, strftime(make_timestamp(max(tBreak) * 1000), '%Y%m%d')::INT AS value FROM r GROUP BY ALL""")
def raster_cells(spark, sf_dir):
    return raster.break_grid(fx.segments(spark, sf_dir))


@query(f"""WITH {fx.SEGMENTS}, d AS (SELECT DISTINCT make_timestamp(tBreak * 1000)::DATE AS d FROM seg),
    y AS (SELECT d, year(d) % 8 + 1 AS i, 0.6 * ((dayofyear(d) - 1) / (dayofyear(make_date(year(d), 12, 31)) - 1)::DOUBLE) AS s FROM d),
    c AS (SELECT d, s, {', '.join(f"{[c[k] for c in raster.YEAR_COLOURS]}[i] AS {n}" for k, n in enumerate('rgb'))} FROM y)
    SELECT strftime(d, '%Y%m%d')::INT AS value, strftime(d, '%Y-%m-%d') AS label, {', '.join(f"round_even({n[0]} + (255 - {n[0]}) * s, 0)::INT AS {n}" for n in ('red', 'green', 'blue'))} FROM c""")
def palette_dates(spark, sf_dir):
    return raster.palette(fx.segments(spark, sf_dir))


def _cells(spark, sf_dir):
    return fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") % fx.GRID).cast("int").alias("col"), F.floor(F.col("c_custkey") / fx.GRID).cast("int").alias("row"), (F.col("c_nationkey") < 2).cast("int").alias("v"))


_CELLS = f"cells AS (SELECT (c_custkey % {fx.GRID})::INT AS col, (c_custkey // {fx.GRID})::INT AS row, (c_nationkey < 2)::INT AS v FROM customer)"


@query(f"""WITH {_CELLS}, lo AS (SELECT a.row, a.col, min(b.v) AS v FROM cells a JOIN cells b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)
    SELECT a.row, a.col, max(b.v) AS v, (SELECT min(v) FROM lo l WHERE l.row = a.row AND l.col = a.col) AS low FROM cells a JOIN cells b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL""")
def focal_mask(spark, sf_dir):
    c = _cells(spark, sf_dir)
    return raster.focal(c, "v", 1, "max").join(raster.focal(c, "v", 1, "min").withColumnRenamed("v", "low"), ["row", "col"])


@query(f"""WITH {_CELLS}, k AS (SELECT unnest(range(1, 5)) AS k) SELECT DISTINCT (row - round_even(k * cos(radians(60)), 0)::INT)::INT AS row, (col + round_even(k * sin(radians(60)), 0)::INT)::INT AS col FROM cells, k WHERE v > 0""")
def cloud_shadow(spark, sf_dir):
    return raster.shadow_cells(_cells(spark, sf_dir).filter("v > 0"), 60, 4)


@query(f"""WITH {_CELLS}, k AS (SELECT unnest(range(1, 5)) AS k), sh AS (SELECT DISTINCT (row - round_even(k * cos(radians(60)), 0)::INT)::INT AS row, (col + round_even(k * sin(radians(60)), 0)::INT)::INT AS col, 1 AS s FROM cells, k WHERE v > 0),
    raw AS (SELECT row, col, v, (v > 0 OR s IS NOT NULL)::INT AS m FROM cells LEFT JOIN sh USING (row, col)),
    er AS (SELECT a.row, a.col, a.v, min(b.m) AS m FROM raw a JOIN raw b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY ALL)
    SELECT a.row, a.col, a.v, 1 AS dark, max(b.m) AS masked FROM er a JOIN er b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY ALL""")
def cloud_shadow_mask(spark, sf_dir):
    c = _cells(spark, sf_dir).withColumn("dark", F.lit(1))
    return raster.cloud_shadow_mask(c, "v", "dark", 60, steps=4, erode=1, dilate=2)


@query("""SELECT c_custkey % 100 AS row, c_nationkey AS col, min(c_custkey) AS part FROM customer GROUP BY ALL""")
def mosaic_first(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("row"), F.col("c_nationkey").alias("col"), F.col("c_custkey").alias("part"))
    return raster.mosaic(parts, ["part"])


@query("""SELECT c_custkey % 100 AS row, c_nationkey AS col, min(c_custkey) AS part FROM customer WHERE c_custkey % 100 IN (SELECT s_suppkey % 50 FROM supplier WHERE s_nationkey = c_nationkey) GROUP BY ALL""")
def mosaic_clipped(spark, sf_dir):
    parts = fx.table(spark, sf_dir, "customer").select((F.col("c_custkey") % 100).alias("row"), F.col("c_nationkey").alias("col"), F.col("c_custkey").alias("part"))
    region = fx.table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 50).alias("row"), F.col("s_nationkey").alias("col"))
    return raster.mosaic(parts, ["part"], region=region)


# --- space -------------------------------------------------------------------------------------------------------------

_INSIDE = "inn AS (SELECT id, p, x, y FROM pts, edge GROUP BY ALL HAVING count(*) FILTER ((y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / nullif(y2 - y1, 0) + x1) % 2 = 1)"


@query(f"WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE} SELECT id, p FROM inn")
def point_in_polygon(spark, sf_dir):
    return spatial.points_in_polygons(fx.locations(spark, sf_dir), fx.polygons(spark, sf_dir), "x", "y", cell=50).select("id", "p")


@query(f"WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE} SELECT DISTINCT id FROM inn")
def points_in_boundary(spark, sf_dir):
    return raster.rasterise(fx.polygons(spark, sf_dir), fx.locations(spark, sf_dir), cell=50).select("id")


@query(f"""WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE} SELECT id FROM inn UNION SELECT id FROM pts, edge
    WHERE greatest(0, least((x - 5 - x1) / (x2 - x1), (x + 5 - x1) / (x2 - x1)), least((y - 5 - y1) / (y2 - y1), (y + 5 - y1) / (y2 - y1)))
       <= least(1, greatest((x - 5 - x1) / (x2 - x1), (x + 5 - x1) / (x2 - x1)), greatest((y - 5 - y1) / (y2 - y1), (y + 5 - y1) / (y2 - y1)))""")
def cells_touched(spark, sf_dir):
    """Cells of a raster that any polygon meets, be it with its border only."""
    return raster.rasterise(fx.polygons(spark, sf_dir), fx.locations(spark, sf_dir), cell=50, touched=10).select("id")


@query(f"WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE}, w AS (SELECT DISTINCT x, y FROM inn) SELECT c, count(*) AS n FROM (SELECT o_custkey AS c, (o_custkey % {fx.GRID} * 10)::DOUBLE AS x, (o_custkey // {fx.GRID} * 10)::DOUBLE AS y FROM orders) SEMI JOIN w USING (x, y) GROUP BY ALL")
def roi_pixels(spark, sf_dir):
    """Observations of the pixels whose cell lies in a region of interest."""
    c = F.col("o_custkey")
    px = fx.table(spark, sf_dir, "orders").select(c.alias("c"), (c % fx.GRID * 10).cast("double").alias("x"), (F.floor(c / fx.GRID) * 10).cast("double").alias("y"))
    roi = raster.rasterise(fx.polygons(spark, sf_dir), fx.locations(spark, sf_dir), cell=50)
    return raster.select_pixels(px, roi).groupBy("c").agg(F.count("*").alias("n"))


@query(f"""WITH {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE}, t AS (SELECT i.id, i.p, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) AS t FROM inn i JOIN edge e ON e.p = i.p)
    SELECT id, p, (min(sqrt((x - x1 - t * dx) ^ 2 + (y - y1 - t * dy) ^ 2)) < 10)::INT AS border FROM t GROUP BY ALL""")
def border_flag(spark, sf_dir):
    j = spatial.points_in_polygons(fx.locations(spark, sf_dir), fx.polygons(spark, sf_dir), "x", "y", cell=50)
    return spatial.near_boundary(j, "x", "y", 10).select("id", "p", "border")


@query(f"""WITH {fx.POLYGONS}, a AS (SELECT p, round(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) AS m2 FROM edge GROUP BY ALL) SELECT p, m2, round(m2 / 10000, 10) AS ha FROM a WHERE m2 BETWEEN 2000 AND 1000000""")
def polygon_area(spark, sf_dir):
    p = fx.polygons(spark, sf_dir).select("p", F.round(spatial.ring_area(F.col("ring")), 6).alias("m2"), F.round(spatial.area_hectares(F.col("ring")), 10).alias("ha"))
    return p.filter(F.col("m2").between(2000, 1_000_000))


def _boxes(spark, sf_dir):
    p = fx.polygons(spark, sf_dir)
    return p.select("p", *(c.alias(n) for n, c in spatial.box(p.ring).items()))


@query(f"""WITH {fx.POLYGONS}, b AS (SELECT p, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM corner GROUP BY ALL), t AS (SELECT n_nationkey AS tile, n_nationkey % 5 * 90.0 AS x0, n_nationkey // 5 * 90.0 AS y0 FROM nation),
    m AS (SELECT p, tile, NOT (b.x0 >= t.x0 AND b.x1 <= t.x0 + 100 AND b.y0 >= t.y0 AND b.y1 <= t.y0 + 100) AS only_meets FROM b, t WHERE b.x0 <= t.x0 + 100 AND b.x1 >= t.x0 AND b.y0 <= t.y0 + 100 AND b.y1 >= t.y0)
    SELECT b.p, arg_min(tile, (only_meets, tile)) AS tile FROM b LEFT JOIN m USING (p) GROUP BY ALL""")
def tile_assignment(spark, sf_dir):
    n = F.col("n_nationkey")
    tiles = fx.table(spark, sf_dir, "nation").select(n.alias("tile"), (n % 5 * 90.0).alias("min_x"), (F.floor(n / 5) * 90.0).alias("min_y"))
    tiles = tiles.withColumns({"max_x": F.col("min_x") + 100, "max_y": F.col("min_y") + 100})
    return spatial.assign_tile(_boxes(spark, sf_dir), tiles, "p", "tile", cell=100).select("p", "tile")


_TILES = "t AS (SELECT n_nationkey AS tile, n_nationkey % 5 * 90.0 AS x0, n_nationkey // 5 * 90.0 AS y0 FROM nation)"


@query(f"""WITH {fx.POLYGONS}, {_TILES}, b AS (SELECT p, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM corner GROUP BY ALL),
    w AS (SELECT p, tile FROM b, t WHERE b.x0 > t.x0 AND b.x1 < t.x0 + 100 AND b.y0 > t.y0 AND b.y1 < t.y0 + 100) SELECT p, tile FROM b LEFT JOIN w USING (p)""")
def polygons_within_tiles(spark, sf_dir):
    """Polygons with the tiles, as rings, that they lie within; those in none stay."""
    n = F.col("n_nationkey")
    corner = lambda dx, dy: F.struct((n % 5 * 90.0 + dx).alias("x"), (F.floor(n / 5) * 90.0 + dy).alias("y"))
    tiles = fx.table(spark, sf_dir, "nation").select(n.alias("tile"), F.array(corner(0, 0), corner(100, 0), corner(100, 100), corner(0, 100)).alias("other"))
    return spatial.polygons_in_polygons(fx.polygons(spark, sf_dir), tiles, cell=50, how="left", id_col="p").select("p", "tile")


@query("""WITH s AS (SELECT c_custkey AS id, DATE '2020-01-01' + (c_custkey % 7)::INT AS d, c_custkey % 40 * 10.0 AS x, c_custkey // 40 * 10.0 AS y FROM customer),
    o AS (SELECT s_suppkey AS score, DATE '2020-01-01' + (s_suppkey % 7)::INT AS d, s_suppkey % 20 * 20.0 AS x, s_suppkey // 20 * 20.0 AS y FROM supplier)
    SELECT id, min(score) AS score FROM s JOIN o ON s.d = o.d AND s.x <= o.x + 25 AND s.x + 15 >= o.x AND s.y <= o.y + 25 AND s.y + 15 >= o.y GROUP BY ALL""")
def first_overlapping_scene(spark, sf_dir):
    """Scenes with the first row of another collection of the same day whose box meets theirs."""

    def boxes(name: str, key: str, new: str, per_row: int, side: float, size: float) -> DataFrame:
        k = F.col(key)
        t = fx.table(spark, sf_dir, name).select(k.alias(new), F.date_add(F.lit("2020-01-01").cast("date"), (k % 7).cast("int")).alias("acq_date"), (k % per_row * side).alias("min_x"), (F.floor(k / per_row) * side).alias("min_y"))
        return t.withColumns({"max_x": F.col("min_x") + size, "max_y": F.col("min_y") + size})

    return images.first_overlapping(boxes("customer", "c_custkey", "id", 40, 10.0, 15), boxes("supplier", "s_suppkey", "score", 20, 20.0, 25), "id", "score", cell=40).select("id", "score")


@query("SELECT max('/d/' || o_orderkey || '.tif') AS path, any_value(o_orderdate::DATE) AS modified FROM orders WHERE o_orderdate::DATE = (SELECT max(o_orderdate::DATE) FROM orders)")
def most_recent_file(spark, sf_dir):
    files = fx.table(spark, sf_dir, "orders").select(F.concat(F.lit("/d/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"), F.to_date("o_orderdate").alias("modified"))
    return images.most_recent(files)


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer) WHERE r <= floor(n * 0.5)")
def half_split(spark, sf_dir):
    return refdb.first_part_of(fx.table(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])


# --- graph -------------------------------------------------------------------------------------------------------------

_VERTICES = f"""{fx.SEGMENTS}, ver AS (SELECT c * 1000000 + tStart // 86400000 AS id, x_coord, y_coord, tBreak / 86400000.0 AS t, CASE WHEN lead(tStart) OVER (PARTITION BY c ORDER BY tStart) IS NOT NULL THEN 1 ELSE 0 END AS b FROM seg),
    near AS (SELECT l.id AS a, r.id AS b, l.b AS lb, r.b AS rb, abs(l.t - r.t) AS dt FROM ver l, (VALUES (0, 0), (10, 0), (-10, 0), (0, 10), (0, -10)) o(dx, dy), ver r
      WHERE r.x_coord = l.x_coord + dx AND r.y_coord = l.y_coord + dy AND l.id <> r.id)"""


def _vertices(spark, sf_dir):
    """Events of all customers; ids name the place and the day, so that SQL can name them, too."""
    s = segments.mark_breaks(fx.segments(spark, sf_dir), ["c"])
    return s.select((F.col("c") * 1_000_000 + F.floor(F.col("tStart") / C.DAY_MS)).alias("id"), "x_coord", "y_coord", C.ms_to_days("tBreak").alias("tBreak_days"), "is_break")


@query(f"WITH {_VERTICES} SELECT a AS src, b AS dst FROM near WHERE a < b AND ((lb <> rb) OR (lb = 1 AND rb = 1 AND dt < 30))")
def event_edges(spark, sf_dir):
    return graph.event_edges(_vertices(spark, sf_dir))


@query()
def event_components(spark, sf_dir):
    """All events, terminal ones and breaks up to the operator's days apart, by component; too much for recursive SQL."""
    named = components(graph.event_edges(_vertices(spark, sf_dir)).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    members = named.unionByName(named.select(F.col("root").alias("node"), "root").distinct())
    return members.groupBy("root").agg(F.count("*").alias("events"))


@query()
def louvain_communities(spark, sf_dir):
    v = _vertices(spark, sf_dir)
    return graph.communities(graph.event_edges(v))


@query()
def community_figures(spark, sf_dir):
    v = _vertices(spark, sf_dir)
    return graph.community_stats(v, graph.communities(graph.event_edges(v)), 10)


@query()
def community_hulls(spark, sf_dir):
    v = cut(_vertices(spark, sf_dir))
    return graph.hulls(v, graph.communities(graph.event_edges(v)), 10).select("community_id", "events", spatial.ring_wkt(F.col("ring")).alias("geometry"))


# --- validation --------------------------------------------------------------------------------------------------------

_FILTERED = f"""{fx.SEGMENTS}, f0 AS (SELECT c, price, changeProb / 100.0 AS changeProb, make_timestamp(tBreak * 1000)::DATE AS b0, make_timestamp(tStart * 1000)::DATE AS tStart FROM seg),
    f1 AS (SELECT *, min(tStart) OVER w AS startMin, ceil(sum(changeProb) OVER w)::BIGINT AS numBreak, (coalesce(NOT (changeProb > 0 AND changeProb < 1), true) AND b0 > DATE '{fx.PERIOD[0]}' AND b0 < DATE '{fx.PERIOD[1]}')::INT AS breaks_in_tmask FROM f0 WINDOW w AS (PARTITION BY c)),
    f2 AS (SELECT *, CASE WHEN breaks_in_tmask = 1 THEN b0 END AS tBreak FROM f1),
    f3 AS (SELECT *, NOT ((tBreak IS NULL AND numBreak > 1) OR (tBreak IS NULL AND numBreak = 1 AND breaks_in_tmask = 0 AND tStart = startMin)) AS kept, count(tBreak) OVER (PARTITION BY c) AS nb FROM f2),
    f4 AS (SELECT *, sum(kept::INT) OVER (PARTITION BY c) AS many FROM f3),
    fil AS (SELECT c, tStart, tBreak, changeProb::DOUBLE AS changeProb, startMin, numBreak, breaks_in_tmask FROM f4 WHERE kept AND NOT (many = 2 AND changeProb = 0 AND numBreak = 1)
      UNION ALL SELECT c, tStart, tBreak, changeProb::DOUBLE, startMin, numBreak, breaks_in_tmask FROM f4 WHERE changeProb > 0 AND changeProb < 1 AND tBreak IS NULL AND nb = 0
      UNION ALL SELECT c, tStart, tBreak, changeProb::DOUBLE, startMin, numBreak, breaks_in_tmask FROM f4 WHERE changeProb = 0 AND numBreak > 1 AND tBreak IS NULL AND nb = 0)"""


def _filtered(spark, sf_dir):
    s = fx.segments(spark, sf_dir).withColumn("changeProb", F.col("changeProb") / 100.0)
    return validation.filter_period(s, ["c"], fx.PERIOD)


@query(f"WITH {_FILTERED} SELECT * FROM fil")
def filter_validation_period(spark, sf_dir):
    return _filtered(spark, sf_dir).select("c", "tStart", "tBreak", "changeProb", "startMin", "numBreak", "breaks_in_tmask")


_SCORED = f"""{_FILTERED}, {fx.REFERENCE},
    j AS (SELECT fil.*, data_1, data_3, tipo, (data_1 IS NOT NULL)::INT + (data_3 IS NOT NULL)::INT AS analistas FROM fil JOIN ref USING (c)),
    a AS (SELECT *, 'A' AS nome, coalesce(data_1, data_3) AS data1_z FROM j UNION ALL SELECT *, 'B', data_3 FROM j WHERE analistas = 2),
    s0 AS (SELECT *, count(tBreak) OVER (PARTITION BY c, nome) AS valid, abs(data1_z - tBreak) AS delta FROM a),
    s1 AS (SELECT *, min(delta) OVER (PARTITION BY c, nome) AS l0 FROM s0),
    s2 AS (SELECT *, CASE WHEN analistas = 2 AND valid < analistas THEN min(CASE WHEN analistas = 2 AND valid < analistas THEN delta END) OVER (PARTITION BY c) ELSE l0 END AS least FROM s1),
    s3 AS (SELECT *, coalesce(delta <= 60 AND tBreak IS NOT NULL AND analistas > 0, false)::INT AS vp,
      coalesce((analistas = 0 AND tBreak IS NOT NULL) OR (delta > 60 AND delta = least) OR (delta > 60 AND analistas = 1 AND tBreak IS NOT NULL), false)::INT AS fp, (analistas = 0 AND tBreak IS NULL)::INT AS vn FROM s2),
    s4 AS (SELECT *, ((analistas > 0 AND tBreak IS NULL) OR (analistas = 1 AND valid = 1 AND fp = 1) OR (analistas = 2 AND valid = 3 AND fp = 1))::INT AS fn FROM s3),
    s5 AS (SELECT *, CASE WHEN tBreak IS NOT NULL THEN sum(vp + fp + fn + vn) OVER (PARTITION BY c, tBreak) END AS total FROM s4),
    s6 AS (SELECT *, coalesce(total = 0 AND analistas = 2 AND valid > analistas, false) AS open FROM s5),
    s7 AS (SELECT *, min(CASE WHEN open THEN delta END) OVER (PARTITION BY c) AS nearest FROM s6),
    s8 AS (SELECT * EXCLUDE (fp), CASE WHEN open AND delta = nearest THEN 1 ELSE fp END AS fp FROM s7),
    s9 AS (SELECT * EXCLUDE (fn), CASE WHEN (fp = 1 AND analistas = 1 AND delta = least AND valid IN (2, 3)) OR (analistas = 2 AND valid = 1 AND vp = 0) OR (analistas = 2 AND valid = 2 AND fp = 1) THEN 1 ELSE fn END AS fn FROM s8),
    sa AS (SELECT *, max(coalesce(total = 0 AND analistas = 2 AND valid = 2, false)::INT) OVER (PARTITION BY c) AS clash FROM s9),
    sb AS (SELECT *, min(least) OVER (PARTITION BY c, tStart) AS gl, count(*) OVER (PARTITION BY c, tStart) AS gn FROM sa WHERE clash = 1),
    sc AS (SELECT *, min(CASE WHEN delta = gl THEN {{'b': tBreak, 'd': data1_z}} END) OVER (PARTITION BY c, tStart) AS pair FROM sb),
    sd AS (SELECT * FROM sc WHERE NOT coalesce(gn > 1 AND analistas > 0 AND pair IS NOT NULL AND (tBreak = pair.b OR data1_z = pair.d) AND delta <> gl, false)),
    u AS (SELECT c, nome, tStart, tBreak, data1_z, analistas, valid, delta, least, vp, fp, fn, vn, tipo FROM sa WHERE clash = 0
      UNION ALL SELECT c, nome, tStart, tBreak, data1_z, analistas, valid, delta, least, coalesce((delta <= 60)::INT, 0), coalesce((delta > 60)::INT, 0), coalesce((delta > 60)::INT, 0), 0, tipo FROM sd),
    sco AS (SELECT c, nome, tStart, tBreak, data1_z, delta AS delta_min, least AS Min_delta_min, vp AS VP, fp AS FP, fn AS FN, vn AS VN FROM u WHERE (vp > 0 OR fp > 0 OR fn > 0 OR vn > 0) AND tipo NOT IN ('Agricultura', 'Agua'))"""


def _scored(spark, sf_dir):
    joined = _filtered(spark, sf_dir).join(fx.reference(spark, sf_dir), "c")
    return validation.score(validation.with_analysts(joined, ["c"]), keys=["c"])


@query(f"WITH {_SCORED} SELECT * FROM sco")
def confusion_matrix(spark, sf_dir):
    return _scored(spark, sf_dir).select("c", "nome", "tStart", "tBreak", "data1_z", "delta_min", "Min_delta_min", "VP", "FP", "FN", "VN")


@query(f"""WITH {_SCORED}, t AS (SELECT sum(VP)::BIGINT AS VP, sum(FP)::BIGINT AS FP, sum(FN)::BIGINT AS FN, sum(VN)::BIGINT AS VN FROM sco), r AS (SELECT *, FP / (FP + VP) AS cm, FN / (FN + VP) AS om FROM t)
    SELECT VP, FP, FN, VN, round(cm, 9) AS commission, round(om, 9) AS omission, round(2 * (1 - om) * (1 - cm) / (2 - om - cm), 9) AS f1 FROM r""")
def accuracy_metrics(spark, sf_dir):
    a = validation.accuracy(_scored(spark, sf_dir))
    return a.select("VP", "FP", "FN", "VN", *(F.round(c, 9).alias(c) for c in ("commission", "omission", "f1")))


@query(f"""WITH {_FILTERED}, {fx.LOCATIONS}, {fx.POLYGONS}, {_INSIDE},
    e AS (SELECT i.id, i.p, x, y, x1, y1, x2 - x1 AS dx, y2 - y1 AS dy, greatest(0, least(1, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) ^ 2 + (y2 - y1) ^ 2))) AS t FROM inn i JOIN edge e ON e.p = i.p),
    n AS (SELECT id, p, any_value(x) AS x, any_value(y) AS y, (min(sqrt((x - x1 - t * dx) ^ 2 + (y - y1 - t * dy) ^ 2)) < 10)::INT AS bordadura FROM e GROUP BY ALL),
    d AS (SELECT *, CASE WHEN p % 3 <> 0 THEN DATE '1997-03-05' END AS d1, CASE WHEN p % 4 = 0 THEN DATE '1999-07-11' END AS d3 FROM n),
    j AS (SELECT x AS x_coord, y AS y_coord, tStart, tBreak, p, bordadura, d1, d3 FROM fil JOIN d ON d.id = fil.c),
    a AS (SELECT *, 'A' AS nome, coalesce(d1, d3) AS data1_z FROM j UNION ALL SELECT *, 'B', d3 FROM j WHERE d1 IS NOT NULL AND d3 IS NOT NULL)
    SELECT x_coord, y_coord, tStart, p, bordadura, nome, data1_z, count(tBreak) OVER (PARTITION BY x_coord, y_coord, nome) AS Valid_breaks, data1_z - tBreak AS delta_min FROM a""")
def reference_join(spark, sf_dir):
    """Segments in reference polygons, by analyst."""
    s = _filtered(spark, sf_dir).withColumns({"x_coord": F.col("x_coord").cast("double"), "y_coord": F.col("y_coord").cast("double")})
    p = fx.polygons(spark, sf_dir).withColumns({"data_1": F.when(F.col("p") % 3 != 0, 19970305), "data_3": F.when(F.col("p") % 4 == 0, 19990711)})
    return validation.join_reference(s, p, cell=50).select("x_coord", "y_coord", "tStart", "p", "bordadura", "nome", "data1_z", "Valid_breaks", "delta_min")


# --- reference database ------------------------------------------------------------------------------------------------


def _log(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.concat(F.lit("CORTE "), "o_orderpriority").alias("act"))


_LOG = "log AS (SELECT o_custkey AS k, o_orderdate::DATE AS d, 'CORTE ' || o_orderpriority AS act FROM orders)"


@query(f"""WITH {_LOG}, p AS (SELECT k, list({{'d': d, 'a': act}} ORDER BY d, act) AS p FROM log GROUP BY ALL)
    SELECT k, len(p)::INT AS n_pairs, {', '.join(f'p[{i + 1}].d AS date_{i}, p[{i + 1}].a AS activity_{i}' for i in range(3))} FROM p""")
def collect_ordered_pairs(spark, sf_dir):
    return refdb.pivot_ordered_pairs(_log(spark, sf_dir), "k", "d", "act", 3)


@query(f"WITH {_LOG}, p AS (SELECT k, list(act ORDER BY d, act) AS p FROM log GROUP BY ALL) SELECT k, len(list_filter(p, lambda x: starts_with(x, 'CORTE 1')))::INT AS n FROM p")
def count_activities(spark, sf_dir):
    return refdb.ordered_pairs(_log(spark, sf_dir), "k", "d", "act").select("k", refdb.count_starting(F.col("pairs"), "CORTE 1").alias("n"))


@query("SELECT o_orderkey, least(a, coalesce(b, a)) AS d0, CASE WHEN b < a THEN 'second' ELSE 'first' END AS a0, CASE WHEN b IS NOT NULL THEN greatest(a, b) END AS d1, CASE WHEN b < a THEN 'first' WHEN b IS NOT NULL THEN 'second' END AS a1 FROM (SELECT o_orderkey, o_orderdate::DATE AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate::DATE + (o_orderkey % 41 - 20)::INT END AS b FROM orders)")
def sort_row_pairs(spark, sf_dir):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d0"), F.lit("first").alias("a0"))
    o = o.withColumn("d1", F.when(k % 3 > 0, F.date_add("d0", (k % 41 - 20).cast("int")))).withColumn("a1", F.when(F.col("d1").isNotNull(), "second"))
    return refdb.sort_row_pairs(o, ["d0", "d1"], ["a0", "a1"])


_YEARS = list(range(1995, 2002))


@query(f"SELECT o_custkey, {', '.join(f'arg_min(o_orderkey, (o_orderdate, o_orderkey)) FILTER (year(o_orderdate) = {y}) AS \"{y}\"' for y in _YEARS)} FROM orders GROUP BY ALL")
def pivot_dates(spark, sf_dir):
    return refdb.pivot_first(fx.table(spark, sf_dir, "orders"), "o_custkey", F.year("o_orderdate"), _YEARS, "o_orderkey", ["o_orderdate", "o_orderkey"])


@query(f"""WITH {_LOG}, d AS (SELECT DISTINCT k, d FROM log), g AS (SELECT k, d, coalesce(d - lag(d) OVER (PARTITION BY k ORDER BY d) > 200, false)::INT AS new FROM d), s AS (SELECT k, d, sum(new) OVER (PARTITION BY k ORDER BY d)::BIGINT AS session FROM g)
    SELECT k, session, min(d) AS first, max(d) AS last, count(*) AS n FROM s GROUP BY ALL""")
def cut_sessions_gap(spark, sf_dir):
    return refdb.cut_sessions(_log(spark, sf_dir), "k", "d", 200)


@query(f"""WITH RECURSIVE {_LOG}, d AS (SELECT DISTINCT k, d FROM log), r(k, session, first) AS (SELECT k, 0, min(d) FROM d GROUP BY k
      UNION ALL SELECT k, session, first FROM (SELECT r.k, r.session + 1 AS session, min(d.d) AS first FROM r JOIN d ON d.k = r.k AND d.d - r.first > 730 GROUP BY r.k, r.session, r.first))
    SELECT r.k, r.session::INT AS session, r.first, max(d.d) AS last, count(*) AS n FROM r JOIN d ON d.k = r.k AND d.d >= r.first AND d.d - r.first <= 730 GROUP BY ALL""")
def cut_sessions_start(spark, sf_dir):
    return refdb.cut_sessions_from_start(_log(spark, sf_dir), "k", "d", 730)


@query("SELECT o_orderkey, o_custkey::VARCHAR || '_' || CASE WHEN r < 10 THEN '0' || r ELSE r::VARCHAR END AS parcel FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders)")
def numbered_parcels(spark, sf_dir):
    return refdb.numbered(fx.table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "parcel")


def _parcels(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    open_end = F.lit(refdb.OPEN_END).cast("date")
    return fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(k % 4 > 0, d).alias("drop_date"), F.when(k % 3 == 0, open_end).when(k % 3 == 1, F.date_sub(d, 30)).alias("ECCD1"), F.when(k % 5 == 0, open_end).when(k % 5 < 3, F.date_add(d, 40)).alias("ECCD2"),
        F.when(k % 7 == 0, 1).alias("NC"), F.date_sub(d, (k % 90).cast("int")).alias("start_date"), F.date_add(d, (k % 80 - 20).cast("int")).alias("end_date"),
    )


_PARCELS = """par AS (SELECT o_orderkey, k % 7 = 0 AS nc, CASE WHEN k % 4 > 0 THEN d END AS drop_date, CASE WHEN k % 3 = 0 THEN DATE '1000-01-01' WHEN k % 3 = 1 THEN d - 30 END AS e1, CASE WHEN k % 5 = 0 THEN DATE '1000-01-01' WHEN k % 5 < 3 THEN d + 40 END AS e2,
    d - (k % 90)::INT AS s, d + (k % 80 - 20)::INT AS e FROM (SELECT o_orderkey, o_orderkey AS k, o_orderdate::DATE AS d FROM orders))"""


@query(f"""WITH {_PARCELS} SELECT o_orderkey, CASE WHEN e1 = DATE '1000-01-01' THEN s WHEN e1 IS NOT NULL THEN e1 WHEN NOT nc THEN drop_date - 5 END AS data0,
    CASE WHEN e2 = DATE '1000-01-01' THEN e WHEN e2 IS NOT NULL THEN e2 WHEN NOT nc THEN drop_date + 5 END AS data1 FROM par""")
def interval_columns(spark, sf_dir):
    return refdb.interval_columns(_parcels(spark, sf_dir)).select("o_orderkey", "data0", "data1")


@query(f"""WITH {_PARCELS} SELECT o_orderkey, CASE WHEN e1 IS NULL AND drop_date <= s THEN s - drop_date END AS before, CASE WHEN drop_date >= e THEN drop_date - e END AS after,
    CASE WHEN drop_date IS NOT NULL AND s = e AND e1 IS NULL THEN s ELSE e1 END AS estimated, CASE WHEN o_orderkey % 9 % 2 = 0 THEN o_orderkey % 5 >= o_orderkey % 9 - o_orderkey % 5 ELSE o_orderkey % 5 >= 0.4 * (o_orderkey % 9) END AS cloudy FROM par""")
def drop_distances(spark, sf_dir):
    drop, start, end, e1, k = (F.col(c) for c in ("drop_date", "start_date", "end_date", "ECCD1", "o_orderkey"))
    before, after = refdb.drop_distances(drop, start, end, e1)
    cloudy = refdb.missed_by_clouds(k % 9, k % 5, k % 9 - k % 5)
    return _parcels(spark, sf_dir).select("o_orderkey", before.alias("before"), after.alias("after"), refdb.fill_estimated_date(drop, start, end, e1).alias("estimated"), cloudy.alias("cloudy"))


@query(f"WITH {_PARCELS} SELECT o_orderkey, e - drop_date AS date_diff FROM par WHERE drop_date IS NOT NULL")
def date_difference(spark, sf_dir):
    return refdb.date_difference(_parcels(spark, sf_dir), "drop_date", "end_date").select("o_orderkey", "date_diff")


@query("SELECT o_custkey, o_orderdate::DATE AS d, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def first_of_each_date(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), "o_orderkey")
    return refdb.first_of_each_date(o, ["o_custkey"], "d", ["o_orderkey"])


@query("SELECT min(o_orderdate::DATE) AS first, max(o_orderdate::DATE) AS last FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1997-02-03' AND DATE '1998-04-05'")
def first_last_image(spark, sf_dir):
    listed = fx.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("acq_date"))
    return images.first_and_last(listed, "1997-02-03", "1998-04-05")


@query(f"""WITH {fx.POLYGONS}, b AS (SELECT p, px, py, greatest(px + 1, 20) AS x0 FROM poly) SELECT p, 4::INT AS points, (px + 1)::DOUBLE AS x, (py + 2)::DOUBLE AS y FROM b""")
def polygon_text(spark, sf_dir):
    """Rings to WKT and back."""
    ring = spatial.parse_ring(spatial.ring_wkt(F.col("ring")))
    return fx.polygons(spark, sf_dir).select("p", ring.alias("r")).select("p", F.size("r").alias("points"), F.col("r")[0]["x"].alias("x"), F.col("r")[0]["y"].alias("y"))


@query(f"WITH {_LOG}, l AS (SELECT k, list(DISTINCT d) AS ds FROM log GROUP BY ALL) SELECT k, list_min(list_filter(ds, lambda x: x BETWEEN DATE '1997-01-01' AND DATE '1998-06-30')) AS first FROM l")
def first_date_in_range(spark, sf_dir):
    ds = _log(spark, sf_dir).groupBy("k").agg(F.collect_set("d").alias("ds"))
    return ds.select("k", refdb.first_date_between(F.col("ds"), F.lit("1997-01-01").cast("date"), F.lit("1998-06-30").cast("date")).alias("first"))


@query("""SELECT 'a' AS src, c_custkey AS id, floor(c_acctbal * 100)::BIGINT AS area FROM customer WHERE floor(c_acctbal * 100) BETWEEN 2500 AND 1000000
    UNION ALL SELECT 'b', s_suppkey, floor(s_acctbal * 100)::BIGINT FROM supplier WHERE floor(s_acctbal * 100) BETWEEN 2500 AND 1000000 AND list_sum(list_transform(string_split(substr(s_suppkey::VARCHAR, 1, 5), ''), lambda x: x::INT)) % 2 = 0""")
def mix_sources(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.lit("a").alias("src"), F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") * 100).alias("area"))
    s = fx.table(spark, sf_dir, "supplier").select(F.lit("b").alias("src"), F.col("s_suppkey").alias("id"), F.floor(F.col("s_acctbal") * 100).alias("area"))
    return refdb.mix_sources(c, s, "id", "area").select("src", "id", "area")


@query("SELECT c_mktsegment AS cls, count(*) AS n, sum(c_nationkey)::BIGINT AS area, 100 * sum(c_nationkey) / (SELECT sum(c_nationkey) FROM customer) AS percent FROM customer GROUP BY ALL")
def class_shares(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("cls"), F.col("c_nationkey").cast("long").alias("area"))
    return refdb.class_shares(c, "cls", "area")


@query("SELECT n, count(*) AS rows FROM (SELECT (o_orderkey % 3 = 0)::INT + (o_custkey % 5 = 0)::INT + (o_orderstatus = 'F')::INT AS n FROM orders) GROUP BY ALL")
def null_cell_stats(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 3 != 0, 1).alias("a"), F.when(F.col("o_custkey") % 5 != 0, 1).alias("b"), F.when(F.col("o_orderstatus") != "F", 1).alias("c"))
    return o.groupBy(refdb.null_counts(o, ["a", "b", "c"]).alias("n")).agg(F.count("*").alias("rows"))


@query("WITH d AS (SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE) AS a, o_orderkey FROM orders) SELECT o_orderkey, (DATE '1970-01-01' + floor(CASE WHEN o_orderkey % 3 = 0 THEN a ELSE (2 * a + o_orderkey % 50) / 2 END)::INT) AS mean FROM d")
def mean_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("a"))
    b = F.when(k % 3 != 0, F.date_add("a", (k % 50).cast("int")))
    return o.select("o_orderkey", refdb.mean_date(F.col("a"), b).alias("mean"))


@query("SELECT (floor((l - o) / 5.0) * 5)::INT AS bin, count(*) AS n FROM (SELECT l_shipdate::DATE AS l, o_orderdate::DATE AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL")
def date_diff_hist(spark, sf_dir):
    j = fx.table(spark, sf_dir, "lineitem").join(fx.table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return refdb.difference_histogram(j.select(F.to_date("o_orderdate").alias("o"), F.to_date("l_shipdate").alias("l")), "o", "l")


@query("SELECT count(*) FILTER (a < b) AS before, count(*) FILTER (a = b) AS equal, count(*) FILTER (a > b) AS after, count(*) FILTER (a IS NULL OR b IS NULL) AS missing FROM (SELECT o_orderkey % 7 AS a, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 7 END AS b FROM orders)")
def three_way_compare(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("a"), F.when(F.col("o_custkey") % 5 > 0, F.col("o_custkey") % 7).alias("b"))
    return refdb.three_way(o, "a", "b")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def missing_ids(spark, sf_dir):
    """Customers without an order of one kind, which some have and some don't."""
    found = fx.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return refdb.missing_ids(fx.table(spark, sf_dir, "customer"), found, "c_custkey")


@query("SELECT c_custkey, a.o AS o_orderkey, b.e AS event_id FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS o FROM orders GROUP BY ALL) a ON a.o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS e FROM events GROUP BY ALL) b ON b.user_id = c_custkey")
def merge_operations(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer").select("c_custkey")
    o = fx.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o_orderkey"))
    e = fx.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count("*").alias("event_id"))
    return refdb.merge_operations(c, o, e, key="c_custkey")
