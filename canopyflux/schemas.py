"""Schemas of the tables that pass between stages."""

from __future__ import annotations

from pyspark.sql import types as T

#: Start and end values of these bands are part of a segment.
VALUE_BANDS = ("green", "red", "nir", "swir2")
VALUE_COLUMNS = tuple(f"{b}{e}" for b in VALUE_BANDS for e in ("Start", "Start2", "End", "End2"))

IMAGES = T.StructType([T.StructField("path", T.StringType()), T.StructField("tile", T.StringType()), T.StructField("acq_date", T.DateType())])

#: The segment table; a location without a model is one row with nulls.
SEGMENTS = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("tBreak", "tEnd", "tStart")]
    + [T.StructField("changeProb", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in ("x_coord", "y_coord")]
    + [T.StructField("coeficientes", T.ArrayType(T.DoubleType())), T.StructField("intercept_values", T.DoubleType())]
    + [T.StructField(c, T.DoubleType()) for c in VALUE_COLUMNS]
)

_BAND = T.StructType(
    [T.StructField("rmse", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType())), T.StructField("intercept", T.DoubleType()), T.StructField("magnitude", T.DoubleType())]
)

#: One detection result with all its models.
DETECTION = T.StructType(
    [
        T.StructField("algorithm", T.StringType()),
        T.StructField("processing_mask", T.ArrayType(T.BooleanType())),
        T.StructField(
            "change_models",
            T.ArrayType(
                T.StructType(
                    [T.StructField(c, T.IntegerType()) for c in ("start_day", "end_day", "break_day", "observation_count")]
                    + [T.StructField("change_probability", T.DoubleType())]
                    + [T.StructField(b, _BAND) for b in ("ndvi", "green", "swir2")]
                )
            ),
        ),
    ]
)
