"""Attribute labels: activities, purposes, periods, trip-length bands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Vendor activity words and the activity each one stands for.
ACTIVITY_WORDS = {
    "home": "home",
    "casa": "home",
    "work_or_study": "work_or_study",
    "trabajo_estudio": "work_or_study",
    "frequent_activity": "frequent_activity",
    "frecuente": "frequent_activity",
    "infrequent_activity": "infrequent_activity",
    "no_frecuente": "infrequent_activity",
}
# Coarse purposes; any other activity is "other".
HOME_WORDS = ("home", "casa")
WORK_WORDS = ("work_or_study", "trabajo_estudio", "work", "lavoro")
# Hours of the named periods; any other hour is "interpeak".
PERIOD_HOURS = {
    "AM": (7, 8, 9),
    "PM": (16, 17, 18, 19),
    "night": (20, 21, 22, 23),
    "overnight": (0, 1, 2, 3, 4, 5, 6),
}
# Half-open trip-length bands in km.
LENGTH_BANDS = {
    "0.5-2": (0.5, 2.0),
    "2-10": (2.0, 10.0),
    "10-50": (10.0, 50.0),
    ">50": (50.0, None),
}
# Spellings of a set study flag.
FLAG_WORDS = ("1", "true", "t", "yes")


def activity(value: Column) -> Column:
    """Vendor activity in any spelling to its English name; unknown words pass through."""
    word = F.lower(F.trim(value.cast("string")))
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(ACTIVITY_WORDS.items())])
    return F.coalesce(F.try_element_at(known, word), word)


def coarse_purpose(value: Column) -> Column:
    word = F.lower(value.cast("string"))
    return (
        F.when(word.isin(*HOME_WORDS), "home").when(word.isin(*WORK_WORDS), "work").otherwise("other")
    )


def period(hour: Column, hours: Mapping[str, Sequence[int]] | None = None) -> Column:
    """First named period holding the hour, else ``interpeak``."""
    bins = hours or PERIOD_HOURS
    whole = hour.try_cast("int")
    return F.coalesce(
        *[F.when(whole.isin(*[int(h) for h in members]), F.lit(name)) for name, members in bins.items()],
        F.lit("interpeak"),
    )


def purpose_period(purpose: Column, part_of_day: Column) -> Column:
    return F.concat_ws("|", purpose, part_of_day)


def in_band(distance: Column, band: str) -> Column:
    """Whether a distance lies in the named band."""
    if band not in LENGTH_BANDS:
        raise ValueError(f"no such length band: {band}")
    low, high = LENGTH_BANDS[band]
    inside = distance >= low
    return inside if high is None else inside & (distance < high)


def length_band(distance: Column) -> Column:
    """Name of the band a distance lies in, NULL below the first one."""
    return F.coalesce(*[F.when(in_band(distance, name), F.lit(name)) for name in LENGTH_BANDS])


def is_flagged(value: Column) -> Column:
    """Study flag as boolean; NULL and unknown words are false."""
    worded = F.lower(value.cast("string")).isin(*FLAG_WORDS)
    numeric = value.cast("string").try_cast("double") == 1.0
    return F.coalesce(worded, F.lit(False)) | F.coalesce(numeric, F.lit(False))


def calendar_day(value: Column, dtype: T.DataType) -> Column:
    """Date from a date, timestamp, yyyymmdd number or text; NULL when unparseable."""
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return value.cast("date")
    text = value.cast("string")
    packed = F.try_to_timestamp(text, F.lit("yyyyMMdd"))
    if isinstance(dtype, T.StringType):
        return F.coalesce(packed.cast("date"), text.try_cast("date"))
    return packed.cast("date")


def is_weekday(day: Column) -> Column:
    """Monday to Friday; NULL days are not weekdays."""
    return F.coalesce(F.weekday(day) < 5, F.lit(False))


def hour_in(value: Column, dtype: T.DataType, hours: Sequence[int]) -> Column:
    """Hour membership; whole-number columns keep a predicate the file scan can push down."""
    if isinstance(dtype, T.IntegralType):
        return value.isin(*[int(h) for h in hours])
    return value.try_cast("double").isin(*[float(h) for h in hours])
