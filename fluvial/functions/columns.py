"""Column expressions shared by the operators. Missing values are NULL; NaN and infinities count as missing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS64 = 2.220446049250313e-16
EPS32 = 1.1920928955078125e-07

# Unit factors.
CFS_TO_M3S = 0.028316846592
SECONDS_PER_HOUR = 3600.0
SECONDS_PER_DAY = 86400.0
#: Skill of the mean flow as a forecast, on the scale of the Kling-Gupta efficiency.
KGE_OF_MEAN = 1 - math.sqrt(2)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- missing values ----------------------------------------------------------------------------------------------------


def finite(c) -> Column:
    """NULL for NaN and infinities."""
    c = col(c).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def or_zero(c) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def number(c) -> Column:
    """A number read from text; anything else is missing."""
    return finite(F.expr(f"try_cast(`{c}` AS double)") if isinstance(c, str) else c.try_cast("double"))


def sentinel_to_null(c, *values: float) -> Column:
    """NULL where c is one of values, to a relative tolerance of 1e-5 and an absolute one of 1e-8."""
    c = finite(c)
    near = [F.abs(c - v) <= 1e-8 + 1e-5 * abs(v) for v in values]
    return F.when(~reduce(lambda a, b: a | b, near), c) if near else c


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a), col(b))


# -- numbers -----------------------------------------------------------------------------------------------------------


def clip(c, low=None, high=None) -> Column:
    """c within [low, high]; NULL stays NULL (greatest and least alone would skip it)."""
    c = col(c)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def log_flow(c) -> Column:
    """log(1 + c), negative values counting as 0."""
    return F.log1p(clip(c, 0.0))


def softplus(c) -> Column:
    c = col(c)
    return F.log1p(F.exp(-F.abs(c))) + F.greatest(c, F.lit(0.0))


def sigmoid(c) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def silu(c) -> Column:
    return col(c) * sigmoid(c)


def relu(c) -> Column:
    return clip(c, 0.0)


ACTIVATIONS = {"none": col, "identity": col, "linear": col, "relu": relu, "softplus": softplus, "sigmoid": sigmoid, "silu": silu}
TRANSFORMS = {"none": col, "log1p": log_flow}
INVERSE_TRANSFORMS = {"none": col, "log1p": lambda c: F.expm1(col(c))}


def kirpich_minutes(length_m, slope) -> Column:
    """Travel time in minutes; lengths of at least 1 m, slopes of at least 1e-6."""
    return 0.01947 * F.pow(F.greatest(col(length_m), F.lit(1.0)), F.lit(0.77)) * F.pow(F.greatest(col(slope), F.lit(1e-6)), F.lit(-0.385))


def kge_skill(kge) -> Column:
    """Skill against the mean flow: 0 for it, 1 for a perfect forecast."""
    return (col(kge) - KGE_OF_MEAN) / (1 - KGE_OF_MEAN)


def km_between(lon1, lat1, lon2, lat2) -> Column:
    """Distance on a local plane."""
    dx = (col(lon2) - col(lon1)) * F.cos(F.radians((col(lat1))))
    return 111.32 * F.sqrt(dx * dx + F.pow(col(lat2) - col(lat1), F.lit(2.0)))


# -- text --------------------------------------------------------------------------------------------------------------


def canonical_id(c) -> Column:
    """Ids of digits only lose leading zeros (but "0" stays); others are trimmed."""
    c = F.trim(col(c).cast("string"))
    return F.when(c.rlike("^[0-9]+$"), F.coalesce(F.nullif(F.ltrim(c, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(c)


def numeric_id(c) -> Column:
    """An id written as a number, without decimals: "12.0" becomes "12"; other text is missing."""
    return number(c).cast("bigint").cast("string")


def first_given(*columns) -> Column:
    """The first that is neither NULL nor blank."""
    return F.coalesce(*[F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in columns])


def safe_name(c) -> Column:
    """Runs of other characters than letters and digits become one _, none at the ends."""
    return F.btrim(F.regexp_replace(col(c), "[^A-Za-z0-9]+", "_"), F.lit("_"))


def number_label(c) -> Column:
    """A number as part of a channel name: 2.0 is 2, 1.5 is 1p5, -1.5 is -1p5."""
    c = col(c).cast("double")
    whole = F.when(c == F.floor(c), c.cast("bigint").cast("string")).otherwise(c.cast("string"))
    return F.replace(whole, F.lit("."), F.lit("p"))


def glob(c, *patterns: str) -> Column:
    """Whether c matches any of the shell patterns (* ? [...]); none matches nothing."""
    import fnmatch

    hits = [col(c).rlike(fnmatch.translate(p).replace(r"\z", r"\Z")) for p in patterns]
    return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)


def file_timestamp(name) -> Column:
    """The first run of 8, 10, 12 or 14 digits in a file name that is a date (and hour, minute, second)."""
    runs = F.regexp_extract_all(col(name), F.lit(r"(?<![0-9])([0-9]{8}(?:[0-9]{2}){0,3})(?![0-9])"), F.lit(1))
    padded = F.transform(runs, lambda r: F.try_to_timestamp(F.rpad(r, 14, "0"), F.lit("yyyyMMddHHmmss")))
    return F.get(F.filter(padded, lambda t: t.isNotNull()), F.lit(0)).cast("timestamp_ntz")


# -- time --------------------------------------------------------------------------------------------------------------


def water_year(date) -> Column:
    """Starts in October."""
    return F.year(col(date)) + (F.month(col(date)) >= 10).cast("int")


def cyclic_day(date) -> tuple[Column, Column]:
    angle = 2 * math.pi * (F.dayofyear(col(date)) - 1) / 366.0
    return F.sin(angle), F.cos(angle)


def cyclic_month(date) -> tuple[Column, Column]:
    angle = 2 * math.pi * (F.month(col(date)) - 1) / 12.0
    return F.sin(angle), F.cos(angle)


TIME_FEATURES = {
    "sin_doy": lambda d: cyclic_day(d)[0],
    "cos_doy": lambda d: cyclic_day(d)[1],
    "sin_month": lambda d: cyclic_month(d)[0],
    "cos_month": lambda d: cyclic_month(d)[1],
}

#: Overlapping seasons: a date can lie in several.
SEASONS = {"DJF": (12, 1, 2), "MAM": (3, 4, 5), "JJA": (6, 7, 8), "SON": (9, 10, 11), "Dec-May": (12, 1, 2, 3, 4, 5), "Jul-Sep": (7, 8, 9)}


def seasons_of(date) -> Column:
    """An array of all seasons that hold the date: one pass over the data instead of one for each season."""
    m = F.month(col(date))
    return F.array_compact(F.array(*[F.when(m.isin(*months), name) for name, months in SEASONS.items()]))


def half_year(date) -> Column:
    m = F.month(col(date))
    return F.when(m.isin(12, 1, 2, 3, 4, 5), "Dec-May").when(m.isin(6, 7, 8, 9), "Jun-Sep").otherwise("Other")


def month_name(date) -> Column:
    """Jan to Dec."""
    return F.date_format(col(date), "MMM")


def gauge_of_location(reference, uri, link) -> Column:
    """The gauge of a network location: what follows gages- in the URI of a reference to gages, else a link of digits only."""
    named = (col(reference) == "gages") & F.coalesce(col(uri), F.lit("")).startswith("gages-")
    return F.when(named, F.replace(col(uri), F.lit("gages-"), F.lit(""))).when(col(link).rlike("^[0-9]+$"), col(link))


def text_label(c) -> Column:
    """Text as part of a channel name."""
    return F.translate(col(c), " .", "_p")
