"""Partial, possibly BCE dates as Column expressions.

Two calendars live here and must not be mixed. The *feature* calendar has astronomical years and a
range that ends where its end date begins. The *viewer* calendar reads an end date as through its
last day, and shifts years up to 0 by one when it tests for leap years. Dates are structs
``(y, m, d)``; comparisons use ``date_key``, one BIGINT that keeps their order for all years.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The years that stand for no start and no end.
MIN_YEAR, MAX_YEAR = -(10**12), 10**12
#: The end that comparisons assume, and the bounds and default end of decades.
OPEN_END_YEAR = 2100
DECADE_FIRST, DECADE_LAST = -6000, 2030
DATE = "struct<y:bigint,m:int,d:int>"


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _null_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _date(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.cast("bigint").alias("y"), m.cast("int").alias("m"), d.cast("int").alias("d"))


# ------------------------------------------------------------- feature calendar
PARTIAL = r"^\s*(-?[0-9]+)(?:-([0-9]{1,2})(?:-([0-9]{1,2}))?)?\s*$"


def parse_date(s: Column) -> Column:
    """Text to struct(y, m, d), with null month and day where they are left out; null if it is no date.

    Months run to 12 and days to 31 whatever the month.
    """
    y, m, d = (_null_if_empty(F.regexp_extract(s, PARTIAL, i)) for i in (1, 2, 3))

    def checked(p: Column) -> Column:
        good = p["y"].isNotNull() & F.coalesce(p["m"].between(1, 12), F.lit(True)) & F.coalesce(p["d"].between(1, 31), F.lit(True))
        return F.when(good, p)

    return bind(_date(y.try_cast("bigint"), m, d), checked)


def start_of(date: Column) -> Column:
    """First day of a partial date."""
    return bind(date, lambda p: F.when(p.isNotNull(), _date(p["y"], F.coalesce(p["m"], F.lit(1)), F.coalesce(p["d"], F.lit(1)))))


def is_leap(y: Column) -> Column:
    """Leap years with astronomical numbering: year 0 is one."""
    return (F.pmod(y, F.lit(4)) == 0) & ((F.pmod(y, F.lit(100)) != 0) | (F.pmod(y, F.lit(400)) == 0))


def month_days(y: Column, m: Column) -> Column:
    return F.when(m == 2, F.when(is_leap(y), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def end_of(date: Column) -> Column:
    """Last day of a partial date."""

    def last(p: Column) -> Column:
        m = F.coalesce(p["m"], F.lit(12))
        return F.when(p.isNotNull(), _date(p["y"], m, F.coalesce(p["d"], month_days(p["y"], m))))

    return bind(date, last)


def date_key(date: Column) -> Column:
    """A BIGINT in the order of complete dates."""
    return bind(date, lambda p: p["y"] * 10000 + p["m"] * 100 + p["d"])


def never(year: int) -> Column:
    return _date(F.lit(year), F.lit(1), F.lit(1))


def date_range(start: Column, end: Column) -> Column:
    """struct(start, end), half open. Both bounds are the first days of their dates; unreadable ones are open."""
    return F.struct(
        F.coalesce(start_of(parse_date(start)), never(MIN_YEAR)).alias("start"),
        F.coalesce(start_of(parse_date(end)), never(MAX_YEAR)).alias("end"))


def fractional_year(date: Column) -> Column:
    return date["y"] + (date["m"] - 1) / F.lit(12.0) + (date["d"] - 1) / F.lit(365.0)


def duration_years(r: Column) -> Column:
    """Years of a range: infinite with an open bound, negative if it ends before it starts."""

    def years(x: Column) -> Column:
        is_open = (x["start"]["y"] == MIN_YEAR) | (x["end"]["y"] == MAX_YEAR)
        return F.when(is_open, F.lit(float("inf"))).otherwise(fractional_year(x["end"]) - fractional_year(x["start"]))

    return bind(r, years)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open ranges of date keys overlap; touching ones do not."""
    return (a_start < b_end) & (b_start < a_end)


def contains(start: Column, end: Column, key: Column) -> Column:
    return (start <= key) & (key < end)


def day_number(date: Column) -> Column:
    """Days since 1970-01-01 in the proleptic Gregorian calendar; null outside years 1 to 9999 or for no real day."""
    return bind(date, _day_number)


def _day_number(date: Column) -> Column:
    y, m, d = date["y"], date["m"], date["d"]
    real = y.between(1, 9999) & m.between(1, 12) & (d >= 1) & (d <= month_days(y, m))
    shifted = F.when(m <= 2, y - 1).otherwise(y)
    era = F.floor(shifted / 400)
    yoe = shifted - era * 400
    doy = F.floor((153 * (m + F.when(m > 2, -3).otherwise(9)) + 2) / 5) + d - 1
    doe = yoe * 365 + F.floor(yoe / 4) - F.floor(yoe / 100) + doy
    return F.when(real, (era * 146097 + doe - 719468).cast("bigint"))


def one_day_off(plain_lo: Column, plain_hi: Column, lo: Column, hi: Column) -> Column:
    """Whether a plain date misses an interval by exactly one day, on either side."""

    def missed(x: Column) -> Column:
        before = day_number(x["lo"]) - day_number(x["plain_hi"]) == 1
        after = day_number(x["plain_lo"]) - day_number(x["hi"]) == 1
        return F.coalesce(F.when(date_key(x["plain_hi"]) < date_key(x["lo"]), before).otherwise(after), F.lit(False))

    return bind(F.struct(plain_lo.alias("plain_lo"), plain_hi.alias("plain_hi"), lo.alias("lo"), hi.alias("hi")), missed)


def format_range(start: Column, end: Column) -> Column:
    """start-end; with spaces around the dash where either text has a hyphen of its own."""
    s, e = F.coalesce(start, F.lit("")), F.coalesce(end, F.lit(""))
    dash = F.when(F.contains(F.concat(s, e), F.lit("-")), F.when(e != "", " - ").otherwise(" -")).otherwise("-")
    return F.concat(s, dash, e)


def lenient_year(s: Column) -> Column:
    """Number before the first hyphen that is not a sign; null if there is none."""
    return F.regexp_extract(F.trim(s), r"^(-?[0-9]+)(?:-|$)", 1).try_cast("bigint")


def patched_start(year: Column, start: Column, end: Column) -> Column:
    """Features without a start whose end is 1871 or 1872 begin in 600."""
    return F.when(start.isNull() & end.isin(1871, 1872), F.lit(600)).otherwise(year)


def decades(lo: Column, hi: Column) -> Column:
    """Array of the multiples of ten from ``lo`` to ``hi``, both included; missing bounds are the limits."""
    first = F.ceil(F.coalesce(lo, F.lit(DECADE_FIRST)) / 10) * 10
    last = F.coalesce(hi, F.lit(DECADE_LAST)).cast("bigint")
    return F.when(first <= last, F.sequence(first, last, F.lit(10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def sort_key(s: Column) -> Column:
    """Sort key of a date text: missing parts are 0, unreadable texts come last."""
    y, m, d = (_null_if_empty(F.regexp_extract(s, r"^(-?[0-9]+)(?:-([0-9]+))?(?:-([0-9]+))?$", i)).try_cast("bigint") for i in (1, 2, 3))
    return F.when(y.isNull(), _date(F.lit(9999), F.lit(12), F.lit(31))).otherwise(_date(y, F.coalesce(m, F.lit(0)), F.coalesce(d, F.lit(0))))


def comparison_range(start: Column, end: Column) -> Column:
    """Range for comparisons of two sets: null without a start, to 2100 without a readable end."""
    return bind(start_of(parse_date(start)), lambda s: F.when(
        s.isNotNull(), F.struct(s.alias("start"), F.coalesce(start_of(parse_date(end)), never(OPEN_END_YEAR)).alias("end"))))


# ------------------------------------------------------------- viewer calendar
FULL = r"^(-?\+?[0-9]+)-([0-9]{2})-([0-9]{2})$"


def view_is_leap(y: Column) -> Column:
    """Leap years in a calendar without a year 0."""
    return is_leap(F.when(y <= 0, y + 1).otherwise(y))


def view_year_days(y: Column) -> Column:
    return F.when(view_is_leap(y), 366).otherwise(365)


def view_month_days(y: Column, m: Column) -> Column:
    return (F.when(m.isin(1, 3, 5, 7, 8, 10, 12), 31).when(m.isin(4, 6, 9, 11), 30)
            .when(m == 2, F.when(view_is_leap(y), 29).otherwise(28)).otherwise(0))


def view_is_valid(y: Column, m: Column, d: Column) -> Column:
    return m.between(1, 12) & (d > 0) & (d <= view_month_days(y, m))


def day_of_year(y: Column, m: Column, d: Column) -> Column:
    """1 for January 1; null for no real day."""
    before = F.element_at(F.array(*[F.lit(x) for x in (0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334)]), m)
    return F.when(view_is_valid(y, m, d), before + d + F.when((m > 2) & view_is_leap(y), 1).otherwise(0))


def split_full(s: Column) -> Column:
    """struct(y, m, d) of a complete ISO text, null for any other."""
    y = F.regexp_extract(s, FULL, 1)
    return F.when(s.rlike(FULL), _date(F.regexp_replace(y, r"\+", "").try_cast("bigint"), F.regexp_extract(s, FULL, 2).try_cast("int"), F.regexp_extract(s, FULL, 3).try_cast("int")))


def js_round(x: Column) -> Column:
    """Rounds halves up, also below zero."""
    return F.floor(x + F.lit(0.5))


def decimal_date(s: Column, repair: bool = False) -> Column:
    """A complete ISO date as a decimal year of five digits, at noon of its day; null if it is no date.

    repair: an unreal day becomes the first of its month, an unreal month gives the bare year.
    """

    def decimal(p: Column) -> Column:
        valid = view_is_valid(p["y"], p["m"], p["d"])
        d = F.when(valid, p["d"]).otherwise(1) if repair else p["d"]
        y = F.when(p["y"] <= 0, p["y"] - 1).otherwise(p["y"])
        part = (day_of_year(y, p["m"], d) - 0.5) / view_year_days(y)
        value = F.when(y < 0, y + 1 + part).otherwise(y + part)
        rounded = js_round(value * 100000) / 100000
        if not repair:
            return F.when(valid, rounded)
        return F.when(p["m"].between(1, 12), rounded).otherwise(p["y"].cast("double"))

    return bind(split_full(s), decimal)


def pad_date(s: Column, end: bool = False) -> Column:
    """A year or year and month as a complete date, its first or last day; '' for other texts, null for null."""

    def pad(t: Column) -> Column:
        y, m = F.regexp_extract(t, r"^(-?[0-9]+)-[0-9]{2}$", 1).try_cast("bigint"), F.regexp_extract(t, r"^-?[0-9]+-([0-9]{2})$", 1).try_cast("int")
        last = F.format_string("-%02d", view_month_days(y, m)) if end else F.lit("-01")
        return (F.when(t.rlike(r"^-?[0-9]+-[0-9]{2}-[0-9]{2}$") | (t == ""), t)
                .when(t.rlike(r"^-?[0-9]+$"), F.concat(t, F.lit("-12-31" if end else "-01-01")))
                .when(t.rlike(r"^-?[0-9]+-[0-9]{2}$"), F.concat(t, last)).when(t.isNotNull(), ""))

    return bind(F.regexp_replace(s, r"^\+", ""), pad)


def decimal_earliest(s: Column) -> Column:
    return decimal_date(pad_date(s))


def decimal_latest(s: Column) -> Column:
    return decimal_date(pad_date(s, end=True))


def decimal_exclusive_end(s: Column) -> Column:
    """Decimal year of the day after a date's last day."""

    def after(p: Column) -> Column:
        wraps = p["d"] + 1 > view_month_days(p["y"], p["m"])
        m = F.when(wraps, p["m"] + 1).otherwise(p["m"])
        y = F.when(m > 12, p["y"] + 1).otherwise(p["y"])
        return F.when(p.isNotNull(), F.concat(year_text(y), F.format_string("-%02d-%02d", F.when(m > 12, 1).otherwise(m), F.when(wraps, 1).otherwise(p["d"] + 1))))

    return decimal_date(bind(split_full(pad_date(s, end=True)), after))


def year_text(y: Column) -> Column:
    """Four digits at least, with a sign before Christ."""
    return F.when(y < 0, F.format_string("-%04d", -y.cast("bigint"))).otherwise(F.format_string("%04d", y.cast("bigint")))


def year_of(s: Column) -> Column:
    return F.regexp_extract(s, r"^(-?[0-9]+)", 1).try_cast("bigint")


def month_of(s: Column) -> Column:
    """Month of a date text, 0 for a bare year."""
    return F.coalesce(F.regexp_extract(s, r"^-?[0-9]+-([0-9]+)", 1).try_cast("int"), F.lit(0))


def to_months(s: Column) -> Column:
    """Year times twelve and months from January."""
    return year_of(s) * 12 + F.greatest(month_of(s) - 1, F.lit(0))


def from_months(n: Column) -> Column:
    return F.concat(year_text(F.floor(n / 12)), F.format_string("-%02d", (F.pmod(n, F.lit(12)) + 1).cast("int")))


def is_date_text(s: Column) -> Column:
    return s.rlike(r"^-?[0-9]{1,4}(-[0-9]{2}(-[0-9]{2})?)?$")


def atlas_year(name: Column) -> Column:
    """Year of an atlas file: WA and the year, or WB and the year before Christ."""
    n = F.regexp_extract(name, r"W[AB]([0-9]+)", 1).try_cast("bigint")
    return F.when(name.rlike(r"WA[0-9]+"), n).when(name.rlike(r"WB[0-9]+"), 1 - n)


# ------------------------------------------------------------- slider scale
#: Fixed values of the scale: years and positions where its segments meet.
SCALE = [(-6000, 0), (-3000, 1000), (-1000, 2000), (0, 3000)]
LAST_YEAR, LAST_POSITION, NEAR_UNITS, NEAR_PIXELS = 2026, 10000, 60, 6


def year_to_slider(y: Column) -> Column:
    """Position of a year: three straight segments, then a square-root scale to the last year."""
    t = F.least(y, F.lit(LAST_YEAR)) / F.lit(float(LAST_YEAR))
    out = js_round(3000 + (1 - F.sqrt(1 - t)) * 7000)
    for (y0, p0), (y1, p1) in reversed(list(zip(SCALE, SCALE[1:], strict=False))):
        out = F.when(y <= y1, js_round(p0 + (y - y0) / F.lit(float(y1 - y0)) * (p1 - p0))).otherwise(out)
    return out.cast("int")


def slider_to_year(p: Column) -> Column:
    s = (p - 3000) / F.lit(7000.0)
    out = js_round((1 - (1 - s) * (1 - s)) * LAST_YEAR)
    for (y0, p0), (y1, p1) in reversed(list(zip(SCALE, SCALE[1:], strict=False))):
        out = F.when(p <= p1, js_round(y0 + (p - p0) / F.lit(float(p1 - p0)) * (y1 - y0))).otherwise(out)
    return out.cast("int")


def _to_nearest(y: Column, n: int) -> Column:
    return js_round(y / F.lit(float(n))) * n


def _coarse(y: Column) -> Column:
    return F.when(y >= -1000, _to_nearest(y, 10)).when(y >= -3000, _to_nearest(y, 50)).otherwise(_to_nearest(y, 100))


def snap_year(position: Column, y: Column, near: int = NEAR_UNITS) -> Column:
    """A round year near a slider position, coarser the longer ago."""
    nearest = _to_nearest(y, 50)
    late = F.when(F.abs(position - year_to_slider(nearest)) <= near, F.least(nearest, F.lit(LAST_YEAR))).otherwise(y)
    return F.when(y >= 1900, late).otherwise(_coarse(y)).cast("int")


def snap_year_by_pixels(y: Column, width: Column, near: int = NEAR_PIXELS) -> Column:
    nearest = _to_nearest(y, 50)
    apart = F.abs(year_to_slider(y) - year_to_slider(nearest)) / F.lit(float(LAST_POSITION)) * width
    return F.when(y >= 1900, F.when(apart <= near, nearest).otherwise(y)).otherwise(_coarse(y)).cast("int")
