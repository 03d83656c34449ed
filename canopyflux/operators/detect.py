"""Change detection over a table of observations: one group of the kernel for each location.

Everything before the group is column expressions, so that filters and column pruning reach the scan; one shuffle brings
the observations of a location together. A location's series is bounded by the number of acquisitions, and locations
are many, so that groups are even. The function gets a location's rows as one Arrow table.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canopyflux.functions.columns import ORDINAL_OF_EPOCH, any_nodata, date_to_ordinal, ndvi
from canopyflux.operators import kernel
from canopyflux.params import NODATA, CcdParams, named
from canopyflux.schemas import VALUE_BANDS, VALUE_COLUMNS

BAND_COLUMNS = ("green", "red", "nir", "swir2")
DAY_MS = 86_400_000


def clean_observations(df: DataFrame, keys: Sequence[str], date_col: str = "date", nodata: float = NODATA) -> DataFrame:
    """keys, day (ordinal), the four bands and ndvi; observations with a missing band or without an ndvi are dropped."""
    rows = df.filter(~any_nodata(*BAND_COLUMNS, nodata=nodata)).withColumn("ndvi", ndvi("nir", "red"))
    day = F.col(date_col) if dict(df.dtypes)[date_col] in ("int", "bigint") else date_to_ordinal(date_col)
    return rows.filter(F.col("ndvi").isNotNull()).select(*keys, day.cast("long").alias("day"), *[F.col(b).cast("double").alias(b) for b in BAND_COLUMNS], "ndvi")


def _boundary(values: np.ndarray, at: int, step: int) -> tuple[float | None, float | None]:
    """The value at a place and its neighbour; null out of the series."""
    other = at + step
    first = float(values[at]) if 0 <= at < len(values) else None
    return first, float(values[other]) if 0 <= other < len(values) else None


def segments_of(day: np.ndarray, bands: dict[str, np.ndarray], params: CcdParams, fitter: kernel.Fitter = kernel.fit_lasso) -> list[dict]:
    """The rows of the segment table for one series in the order of its days."""
    found, _ = kernel.detect(day, bands["ndvi"], bands["green"], bands["swir2"], params, fitter)
    out = []
    for s in found:
        row = {c: (d - ORDINAL_OF_EPOCH) * DAY_MS for c, d in (("tBreak", s.break_day), ("tEnd", s.end_day), ("tStart", s.start_day))}
        row |= {"changeProb": int(100 * s.change_probability), "coeficientes": s.coefficients[0].tolist(), "intercept_values": float(s.intercept[0])}
        first, last = int(np.searchsorted(day, s.start_day)), int(np.searchsorted(day, s.end_day))
        for b in VALUE_BANDS:
            row[f"{b}Start"], row[f"{b}Start2"] = _boundary(bands[b], first, 1)
            row[f"{b}End"], row[f"{b}End2"] = _boundary(bands[b], last, -1)
        out.append(row)
    return out


#: Locations, about, in a partition of series: their detection takes a task a minute or so.
LOCATIONS_PER_PARTITION = 500


def _by_location(df: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of cleaned observations with one row more for each location of ``df``, whose day is null.

    So a location without any valid observation is a group, too. Locations are spread over the cluster by their number:
    their series are small but costly, so partitions must not be merged by size.
    """
    spark = rows.sparkSession
    places = df.select(*keys).distinct()
    number = df.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, number // LOCATIONS_PER_PARTITION)
    return rows.unionByName(places, allowMissingColumns=True).repartition(n, *keys)


def _series(table: pa.Table) -> pa.Table:
    """The observations of a location in the order of their days."""
    return table.filter(pc.is_valid(table.column("day"))).sort_by([("day", "ascending"), *((b, "ascending") for b in BAND_COLUMNS)])


_OUT = (
    [T.StructField(c, T.LongType()) for c in ("tBreak", "tEnd", "tStart")]
    + [T.StructField("changeProb", T.IntegerType()), T.StructField("coeficientes", T.ArrayType(T.DoubleType())), T.StructField("intercept_values", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUE_COLUMNS]
)


def detect_changes(df: DataFrame, keys: Sequence[str], date_col: str = "date", params: CcdParams | None = None, nodata: float = NODATA, fitter: kernel.Fitter | str = kernel.fit_lasso) -> DataFrame:
    """One row for each segment of each location; a location without a model, or without a valid observation, is one row of nulls.

    A series whose detection fails is such a row too, with the reason in ``error``.
    """
    params, fitter = params or CcdParams(), named(fitter) if isinstance(fitter, str) else fitter
    rows = clean_observations(df, keys, date_col, nodata)
    schema = T.StructType([*(rows.schema[k] for k in keys), *_OUT, T.StructField("error", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        key = {k: table.column(k)[0].as_py() for k in keys}
        table, error = _series(table), None
        cols = {c: table.column(c).to_numpy() for c in ("day", "ndvi", *BAND_COLUMNS)}
        try:
            found = segments_of(cols.pop("day"), cols, params, fitter)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:  # one series must not end the job
            found, error = [], f"{type(e).__name__}: {e}"
        rows_out = [key | {"error": error} | x for x in found or [{}]]
        return pa.Table.from_pylist([{f: r.get(f) for f in schema.names} for r in rows_out], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    return _by_location(df, rows, keys).groupBy(*keys).applyInArrow(run, schema)


def detection_struct(df: DataFrame, keys: Sequence[str], date_col: str = "date", params: CcdParams | None = None, nodata: float = NODATA, fitter: kernel.Fitter | str = kernel.fit_lasso) -> DataFrame:
    """One row for each location with its nested result: algorithm, processing mask and change models.

    A location without a valid observation has an empty mask and no models. One whose detection fails has nulls instead,
    with the reason in ``error``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    from canopyflux.schemas import DETECTION

    params, fitter = params or CcdParams(), named(fitter) if isinstance(fitter, str) else fitter
    rows = clean_observations(df, keys, date_col, nodata)
    schema = T.StructType([*(rows.schema[k] for k in keys), *DETECTION.fields, T.StructField("error", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        key = {k: table.column(k)[0].as_py() for k in keys} | {"algorithm": "ccd"}
        table = _series(table)
        c = {x: table.column(x).to_numpy() for x in ("day", "ndvi", "green", "swir2")}
        try:
            found, mask = kernel.detect(c["day"], c["ndvi"], c["green"], c["swir2"], params, fitter)
        except (ValueError, ArithmeticError, np.linalg.LinAlgError) as e:  # one series must not end the job
            return pa.Table.from_pylist([key | {"error": f"{type(e).__name__}: {e}"}], schema=arrow)
        models = [
            {"start_day": s.start_day, "end_day": s.end_day, "break_day": s.break_day, "observation_count": s.observation_count, "change_probability": float(s.change_probability)}
            | {b: {"rmse": float(s.rmse[i]), "coefficients": s.coefficients[i].tolist(), "intercept": float(s.intercept[i]), "magnitude": float(s.magnitude[i])} for i, b in enumerate(kernel.BANDS)}
            for s in found
        ]
        return pa.Table.from_pylist([key | {"processing_mask": mask.tolist(), "change_models": models}], schema=arrow)

    return _by_location(df, rows, keys).groupBy(*keys).applyInArrow(run, schema)


def cloud_outlier_mask(df: DataFrame, keys: Sequence[str], date_col: str = "date", params: CcdParams | None = None, nodata: float = NODATA) -> DataFrame:
    """keys, day, outlier: robust seasonal outliers over each whole series."""
    params = params or CcdParams()
    rows = clean_observations(df, keys, date_col, nodata)
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("day", T.LongType()), T.StructField("outlier", T.BooleanType())])

    def run(table: pa.Table) -> pa.Table:
        table = _series(table)
        day = table.column("day").to_numpy()
        values = np.array([table.column(b).to_numpy() for b in kernel.BANDS])
        if len(day) <= params.meow_size:
            out = np.zeros(len(day), bool)
        else:
            out = kernel.cloud_outliers(day, values, kernel.adjusted_variogram(day, values), params)
        return pa.table([*(table.column(k) for k in keys), table.column("day"), pa.array(out)], names=schema.names)

    return _by_location(df, rows, keys).groupBy(*keys).applyInArrow(run, schema)
