"""Scalar column functions: indices, masks, dates, classes and raster positions. All stay inside generated code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from canopyflux.params import NDVI_SCALE, NODATA

#: Proleptic ordinal of 1970-01-01.
ORDINAL_OF_EPOCH = 719163
DAY_MS = 86_400_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- reflectance -------------------------------------------------------------------------------------------------------


def nodata_to_null(value: Column | str, nodata: int = NODATA) -> Column:
    return F.nullif(_col(value), F.lit(nodata))


def any_nodata(*values: Column | str, nodata: int = NODATA) -> Column:
    """Whether an observation has to go: any of its bands is missing."""
    return reduce(Column.__or__, ((_col(v) == nodata) | _col(v).isNull() for v in values))


def normalized_difference(a: Column | str, b: Column | str) -> Column:
    """(a - b) / (a + b); null where the sum isn't positive."""
    a, b = _col(a), _col(b)
    return F.when(a + b > 0, F.try_divide(a - b, a + b))


def ndvi(nir: Column | str, red: Column | str, scale: float = NDVI_SCALE) -> Column:
    return F.when(_col(nir) + _col(red) > 0, F.try_divide(scale * (_col(nir) - _col(red)), _col(nir) + _col(red)))


def nbr(nir: Column | str, swir2: Column | str, scale: float = NDVI_SCALE) -> Column:
    return ndvi(nir, swir2, scale)


def clamp_ndvi(value: Column | str, low: int = 0, high: int = 5000) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), _col(value).cast("int")))


def clear_qa60(qa: Column | str) -> Column:
    """Neither the cloud bit (10) nor the cirrus bit (11) is set."""
    return (_col(qa).bitwiseAND(F.lit(1 << 10)) == 0) & (_col(qa).bitwiseAND(F.lit(1 << 11)) == 0)


def bit(qa: Column | str, place: int) -> Column:
    return F.getbit(_col(qa), F.lit(place))


def clear_score(score: Column | str, least: float = 0.60) -> Column:
    return _col(score) >= least


def scene_usable(cloud_percent: Column | str, most: float = 60) -> Column:
    return _col(cloud_percent) <= most


def cloud(probability: Column | str, above: float = 50) -> Column:
    return _col(probability) > above


def dark_pixel(nir: Column | str, scl: Column | str, share: float = 0.2, scale: float = 1e4) -> Column:
    """Dark in the near infrared, and not water (class 6)."""
    return (_col(nir) < share * scale) & (_col(scl) != 6)


def all_zero_to_null(value: Column | str, *bands: Column | str) -> Column:
    return F.when(~reduce(Column.__and__, (_col(b) == 0 for b in bands)), _col(value))


# --- dates -------------------------------------------------------------------------------------------------------------


def date_to_ordinal(date: Column | str) -> Column:
    return F.unix_date(F.to_date(_col(date))) + ORDINAL_OF_EPOCH


def ordinal_to_date(ordinal: Column | str) -> Column:
    return F.date_from_unix_date((_col(ordinal) - ORDINAL_OF_EPOCH).cast("int"))


def date_to_ms(date: Column | str) -> Column:
    """Epoch milliseconds of UTC midnight."""
    return F.unix_date(F.to_date(_col(date))).cast("long") * DAY_MS


def ordinal_to_ms(ordinal: Column | str) -> Column:
    return (_col(ordinal).cast("long") - ORDINAL_OF_EPOCH) * DAY_MS


def ms_to_date(ms: Column | str) -> Column:
    """The UTC date, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(_col(ms) / DAY_MS).cast("int"))


def ms_to_yyyymmdd(ms: Column | str) -> Column:
    return F.date_format(ms_to_date(ms), "yyyyMMdd").cast("int")


def ms_to_days(ms: Column | str) -> Column:
    return _col(ms) / float(DAY_MS)


def zero_ms_to_null(ms: Column | str) -> Column:
    return F.nullif(_col(ms), F.lit(0))


def yyyymmdd_to_date(value: Column | str) -> Column:
    """0 and null mean "no date"."""
    return F.try_to_date(F.nullif(_col(value).cast("string"), F.lit("0")), "yyyyMMdd")


def parse_date_tolerant(text: Column | str, first_year: int = 2017, last_year: int = 2024) -> Column:
    """yyyy-MM-dd, else yyyyMMdd; null outside of the years."""
    text = _col(text)
    found = F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))
    return F.when(F.year(found).between(first_year, last_year), found)


def parse_day_first(text: Column | str) -> Column:
    return F.date_format(F.try_to_date(_col(text), "ddMMyyyy"), "yyyy-MM-dd")


def midpoint_date(first: Column | str, second: Column | str) -> Column:
    """The day in the middle, rounded down; the first one where there is no second one."""
    first, second = _col(first), _col(second)
    return F.when(second.isNotNull() & (second != first), F.date_add(first, F.floor(F.datediff(second, first) / 2).cast("int"))).otherwise(first)


def shift_months(date: Column | str, months: int) -> Column:
    return F.add_months(_col(date), months)


def days_around(first: Column | str, last: Column | str, days: int = 60) -> tuple[Column, Column]:
    """So many days before the first and after the last date."""
    return F.date_sub(_col(first), days), F.date_add(_col(last), days)


def position_in_year(date: Column | str) -> Column:
    """0 on the first day of the year, 1 on the last one."""
    date = _col(date)
    return (F.dayofyear(date) - 1) / (F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31))) - 1).cast("double")


# --- classes and texts -------------------------------------------------------------------------------------------------


def month_group(date: Column | str) -> Column:
    m = F.month(_col(date))
    return F.when(m.isin(1, 2, 11, 12), "winter").when(m.isin(3, 4, 9, 10), "between").otherwise("summer")


def binned(value: Column | str, edges: tuple[float, ...] = (0.5, 5, 10, 20, 30, 40)) -> Column:
    """Right-closed classes: the number of the first edge that the value doesn't exceed; null for null."""
    value = _col(value)
    out = F.when(value.isNull(), None)
    for i, e in enumerate(edges):
        out = out.when(value <= e, i)
    return out.otherwise(len(edges))


def digit_sum_even(text: Column | str, chars: int = 5) -> Column:
    """Whether the digits among the first characters have an even sum."""
    digits = F.split(F.substring(_col(text), 1, chars), "")
    return F.aggregate(digits, F.lit(0), lambda total, c: total + F.coalesce(F.try_to_number(c, F.lit("9")).cast("int"), F.lit(0))) % 2 == 0


def changed_label(date: Column | str, yes: str = "Com Alteracao", no: str = "Sem Alteracao") -> Column:
    return F.when(_col(date).isNull(), no).otherwise(yes)


def alphanumeric(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), "[^0-9A-Za-z]", "")


def without_brackets(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"[\[\]]", "")


def split_once(text: Column | str, by: str = " - ") -> tuple[Column, Column]:
    parts = F.split(_col(text), by, 2)
    return F.get(parts, F.lit(0)), F.get(parts, F.lit(1))


# --- arrays ------------------------------------------------------------------------------------------------------------


def value_mask(values: Column | str, value: Column | float) -> Column:
    """For each entry of an array whether it has the value."""
    return F.transform(_col(values), lambda v: v == value)


def count_value(values: Column | str, value: Column | float) -> Column:
    return F.size(F.filter(_col(values), lambda v: v == value))


def array_key(values: Column | str) -> Column:
    """A digest that names an array by its entries."""
    return F.sha1(F.array_join(_col(values).cast("array<string>"), ","))


def year_later_index(days: Column | str, start: int, size: int = 12, delta: int = 365) -> Column:
    """Place of the first observation from ``start + size`` on that is ``delta`` days after that at ``start``.

    The last ``size`` places aren't looked at: if there is none before, the first of them. Null for series of less than
    ``delta`` days.
    """
    days = _col(days)
    end, first = F.size(days) - size, F.get(days, F.lit(start))
    fits = F.filter(F.sequence(F.lit(start + size), F.greatest(F.lit(start + size), end)), lambda i: (i < end) & (F.get(days, i) - first >= delta))
    spans = F.array_max(days) - F.array_min(days) >= delta
    return F.when(spans, F.coalesce(F.array_min(fits), F.greatest(F.lit(start + size), end)))


# --- rasters -----------------------------------------------------------------------------------------------------------


def raster_index(x: Column | str, y: Column | str, min_x: Column, max_y: Column, cell: float = 10) -> tuple[Column, Column]:
    """(row, col) of a cell centre in a grid whose corner lies half a cell out; halves round to even."""
    half = cell / 2
    col = F.bround((_col(x) - (min_x - half)) / cell - 0.5).cast("int")
    row = F.bround(((max_y + half) - _col(y)) / cell - 0.5).cast("int")
    return row, col


def tile_part(x: Column | str, y: Column | str, min_x: float, min_y: float, max_x: float, max_y: float, parts: int = 6) -> Column:
    """Label 1 to parts * parts of the part of a box that holds a point; the far edges belong to the last parts."""
    i = F.least(F.floor((_col(x) - min_x) / ((max_x - min_x) / parts)), F.lit(parts - 1))
    j = F.least(F.floor((_col(y) - min_y) / ((max_y - min_y) / parts)), F.lit(parts - 1))
    return (i * parts + j + 1).cast("int")


# --- models ------------------------------------------------------------------------------------------------------------


def harmonic_value(ordinal: Column, intercept: Column, coefficients: Column, days: float = 365.25) -> Column:
    """intercept + slope * t + three harmonics, as a segment's curve is drawn."""
    w = 2 * 3.141592653589793 / days
    t = ordinal.cast("double")
    out = intercept + F.get(coefficients, F.lit(0)) * t
    for k in (1, 2, 3):
        out = out + F.get(coefficients, F.lit(2 * k - 1)) * F.cos(k * w * t) + F.get(coefficients, F.lit(2 * k)) * F.sin(k * w * t)
    return out


def bisquare(residual: Column, c: float = 4.685) -> Column:
    return F.when(F.abs(residual) < c, F.pow(1 - F.pow(residual / c, 2), 2)).otherwise(0.0)
