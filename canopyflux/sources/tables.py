"""Reading and writing of tables: segments, cubes, delimited texts, grids, points, colour tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canopyflux.functions.columns import ms_to_date
from canopyflux.operators.segments import explode_lists, parse_number_list

VALIDATION_COLUMNS = ("tBreak", "tEnd", "tStart", "changeProb", "x_coord", "y_coord", "coeficientes")


def read_segments(spark: SparkSession, folder: str, columns: Sequence[str] = VALIDATION_COLUMNS, skip_broken: bool = True) -> DataFrame:
    """The segment files of a folder; only the columns asked for are read. Files that can't be read are skipped."""
    return spark.read.option("ignoreCorruptFiles", str(skip_broken).lower()).parquet(folder).select(*columns)


def write_segments(df: DataFrame, folder: str) -> None:
    df.write.mode("overwrite").parquet(folder)


def write_cube(df: DataFrame, folder: str, append: bool = False) -> None:
    """Observations by tile, sorted by location, so that row groups can be skipped by x and y."""
    df.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y", "date").write.mode("append" if append else "overwrite").partitionBy("tile").parquet(folder)


def read_cube(spark: SparkSession, folder: str, tile: str | None = None) -> DataFrame:
    df = spark.read.parquet(folder)
    return df.filter(F.col("tile") == tile) if tile else df


def check_or_build(spark: SparkSession, folder: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table in a folder; it is built and written first if it isn't there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def sniff_delimiter(line: str) -> str:
    """Of comma, semicolon, tab and bar the most frequent in a header."""
    return max(",;\t|", key=line.count)


def read_delimited(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A text table with a header; the delimiter is that of the first line. Without a schema all columns are strings."""
    first = spark.read.text(path).head()
    if first is None:
        raise ValueError(f"{path} is empty")
    reader = spark.read.option("header", "true").option("sep", sniff_delimiter(first[0]))
    return (reader.schema(schema) if schema else reader).csv(path)


def read_list_results(spark: SparkSession, path: str, lists: Sequence[str], whole: Sequence[str] = ()) -> DataFrame:
    """Results whose columns hold lists as texts, such as ``[1.5, 2]``: one row for each place of the lists; ``whole`` ones become whole numbers."""
    df = read_delimited(spark, path)
    rows = explode_lists(df.withColumns({c: parse_number_list(c) for c in lists}), lists)
    return rows.withColumns({c: F.col(c).cast("long") for c in whole})


def write_delimited(df: DataFrame, folder: str, sep: str = ",") -> None:
    df.write.mode("overwrite").option("header", "true").option("sep", sep).csv(folder)


def write_points(df: DataFrame, folder: str, x: str = "x_coord", y: str = "y_coord") -> None:
    """Points as a Parquet table with a WKT geometry; breaks have their date, too."""
    dated = df.withColumn("tBreak_date", F.date_format(ms_to_date("tBreak"), "yyyy-MM-dd")) if "tBreak" in df.columns else df
    dated.withColumn("geometry", F.concat(F.lit("POINT ("), F.col(x).cast("string"), F.lit(" "), F.col(y).cast("string"), F.lit(")"))).write.mode("overwrite").parquet(folder)


def grid_lines(grid: DataFrame, width: int, nodata: int = -9999) -> DataFrame:
    """(row, line): an ASCII grid's lines for a table (row, col, value), rows without any cell left out."""
    cells = grid.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at(F.col("m"), i.cast("int")), F.lit(nodata)).cast("string"))
    return cells.select("row", F.array_join(values, " ").alias("line"))


def colour_table(palette: DataFrame) -> DataFrame:
    """(value, line): entries of a colour table file."""
    entry = F.format_string('<paletteEntry value="%d" label="%s" color="#%02x%02x%02x" alpha="255"/>', "value", "label", "red", "green", "blue")
    return palette.select("value", entry.alias("line"))


def union_sources(*frames: DataFrame) -> DataFrame:
    """All rows, columns by name; missing ones are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def sample_points(pixels: DataFrame, points: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels at points: both on the same grid of cells, joined by cell."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    near = points.select(*points.columns, at(x).alias("i_"), at(y).alias("j_")).drop(x, y)
    return pixels.withColumns({"i_": at(x), "j_": at(y)}).join(near, ["i_", "j_"]).drop("i_", "j_")


def seeded_sample(df: DataFrame, n: int, key: Column, seed: int = 42) -> DataFrame:
    """A sample of n rows that depends on the key and the seed only."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
