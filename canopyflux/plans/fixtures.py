"""The driver's tables in the shape that operators take, and the same as SQL.

A location is a supplier for series (its line items by day are observations) and a customer for segments (its orders are
breaks). Bands are whole numbers, so that sums and means are exact in any order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.functions.columns import date_to_ms
from canopyflux.operators.series import daily_series

BANDS = ("green", "red", "nir", "swir2")
GRID = 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, date, green, red, nir, swir2): one row for each line item."""
    li = table(spark, sf_dir, "lineitem")
    whole = lambda c, k: F.floor(F.col(c) * k + 0.5).cast("long")
    return li.select(
        "l_suppkey", F.to_date("l_shipdate").alias("date"),
        (whole("l_quantity", 1) * 10).alias("green"), (whole("l_discount", 100) * 100 + 400).alias("red"), (whole("l_tax", 100) * 200 + 2000).alias("nir"), F.floor("l_extendedprice").cast("long").alias("swir2"),
    )


OBSERVATIONS = """obs AS (SELECT l_suppkey, l_shipdate::DATE AS date, floor(l_quantity + 0.5)::BIGINT * 10 AS green, floor(l_discount * 100 + 0.5)::BIGINT * 100 + 400 AS red,
    floor(l_tax * 100 + 0.5)::BIGINT * 200 + 2000 AS nir, floor(l_extendedprice)::BIGINT AS swir2 FROM lineitem)"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_suppkey, day, bands): the mean of each day; days count from 1970."""
    return daily_series(observations(spark, sf_dir), ["l_suppkey"], F.unix_date("date"), **{b: F.col(b) for b in BANDS})


SERIES = OBSERVATIONS + ", " + "ser AS (SELECT l_suppkey, date_diff('day', DATE '1970-01-01', date) AS day, " + ", ".join(f"avg({b}) AS {b}" for b in BANDS) + " FROM obs GROUP BY ALL)"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, x_coord, y_coord, tStart, tEnd, tBreak, changeProb, price): one row for each customer and order date."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c"), F.to_date("o_orderdate").alias("d")).agg(F.min("o_orderkey").alias("k"), F.max(F.floor("o_totalprice")).cast("long").alias("price"))
    ms = date_to_ms("d")
    return days.select(
        "c", (F.col("c") % GRID * 10).alias("x_coord"), (F.floor(F.col("c") / GRID) * 10).alias("y_coord"), ms.alias("tStart"), (ms + 85 * 86400000).alias("tEnd"), (ms + 90 * 86400000).alias("tBreak"),
        F.when(F.col("k") % 4 == 0, 0).when(F.col("k") % 4 == 1, 50).otherwise(100).alias("changeProb"), "price",
    )


SEGMENTS = f"""days AS (SELECT o_custkey AS c, o_orderdate::DATE AS d, min(o_orderkey) AS k, max(floor(o_totalprice))::BIGINT AS price FROM orders GROUP BY ALL),
    seg AS (SELECT c, c % {GRID} * 10 AS x_coord, c // {GRID} * 10 AS y_coord, date_diff('day', DATE '1970-01-01', d) * 86400000 AS tStart,
      (date_diff('day', DATE '1970-01-01', d) + 85) * 86400000 AS tEnd, (date_diff('day', DATE '1970-01-01', d) + 90) * 86400000 AS tBreak,
      CASE WHEN k % 4 = 0 THEN 0 WHEN k % 4 = 1 THEN 50 ELSE 100 END AS changeProb, price FROM days)"""


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, ring): a four-sided, not rectangular ring for each supplier."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p"), (F.col("s_suppkey") % 10 * 37.0).alias("px"), (F.floor(F.col("s_suppkey") / 10) * 29.0).alias("py"))
    corner = lambda dx, dy: F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"))
    return s.select("p", F.array(corner(1, 2), corner(61, 7), corner(52, 55), corner(8, 47)).alias("ring"))


POLYGONS = """poly AS (SELECT s_suppkey AS p, s_suppkey % 10 * 37.0 AS px, s_suppkey // 10 * 29.0 AS py FROM supplier),
    corner AS (SELECT p, i, (px + [1, 61, 52, 8][i])::DOUBLE AS x, (py + [2, 7, 55, 47][i])::DOUBLE AS y FROM poly, (VALUES (1), (2), (3), (4)) v(i)),
    edge AS (SELECT a.p, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM corner a JOIN corner b ON a.p = b.p AND b.i = a.i % 4 + 1)"""


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, y): one point for each customer."""
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("id"), (c % GRID * 10).cast("double").alias("x"), (F.floor(c / GRID) * 10).cast("double").alias("y"))


LOCATIONS = f"pts AS (SELECT c_custkey AS id, (c_custkey % {GRID} * 10)::DOUBLE AS x, (c_custkey // {GRID} * 10)::DOUBLE AS y FROM customer)"


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(c, data_1, data_3, tipo): dates of two analysts for a customer, as found in its orders; some have one or none."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c")).agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    c = F.col("c")
    return o.select("c", F.when(c % 3 != 0, F.date_add("a", 120)).alias("data_1"), F.when(c % 5 < 2, F.date_add("b", 60)).alias("data_3"), F.when(c % 11 == 0, "Agua").otherwise("Floresta").alias("tipo"))


REFERENCE = """ref0 AS (SELECT o_custkey AS c, min(o_orderdate::DATE) AS a, max(o_orderdate::DATE) AS b FROM orders GROUP BY ALL),
    ref AS (SELECT c, CASE WHEN c % 3 <> 0 THEN a + 120 END AS data_1, CASE WHEN c % 5 < 2 THEN b + 60 END AS data_3, CASE WHEN c % 11 = 0 THEN 'Agua' ELSE 'Floresta' END AS tipo FROM ref0)"""

#: Period of the validation queries: it leaves early and late breaks out.
PERIOD = ("1996-06-30", "2000-12-31")
