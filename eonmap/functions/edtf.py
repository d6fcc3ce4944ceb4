"""Extended date-time text as intervals of days.

Bounds are fuzzy: an approximate or uncertain date reaches one unit of its own precision further on
both sides, one that is both two units. Open ends are the first and last year there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eonmap.functions.dates import MAX_YEAR, MIN_YEAR

Day = tuple[int, int, int]
OPEN_LO, OPEN_HI = (MIN_YEAR, 1, 1), (MAX_YEAR, 1, 1)
#: First and last month of the season codes 21 to 41.
SEASONS = {
    21: (3, 5), 22: (6, 8), 23: (9, 11), 24: (12, 12), 25: (3, 5), 26: (6, 8), 27: (9, 11), 28: (12, 12), 29: (9, 11), 30: (12, 12),
    31: (3, 5), 32: (6, 8), 33: (1, 3), 34: (4, 6), 35: (7, 9), 36: (10, 12), 37: (1, 4), 38: (5, 8), 39: (9, 12), 40: (1, 6), 41: (7, 12),
}
_DATE = re.compile(r"(-?\d{4}|-?\d{3}X|-?\d{2}XX|-?\dXXX|Y-?\d{5,})(?:-(\d\d|XX)(?:-(\d\d|XX))?)?([~?%]?)$")
#: Misspelt ranges, 'a..b' without brackets.
DOT_DOT = re.compile(r"(-?\d{4}(?:-\d\d){0,2})?\.\.(-?\d{4}(?:-\d\d){0,2})?$")


def _last(y: int, m: int) -> int:
    leap = y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    return 29 if m == 2 and leap else (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]


def _shift(d: Day, unit: str, n: int) -> Day:
    y, m, day = d
    if unit == "year":
        return y + n, m, min(day, _last(y + n, m))
    if unit == "month":
        k = y * 12 + m - 1 + n
        return k // 12, k % 12 + 1, min(day, _last(k // 12, k % 12 + 1))
    for _ in range(abs(n)):
        day += 1 if n > 0 else -1
        if day < 1:
            m, y = (12, y - 1) if m == 1 else (m - 1, y)
            day = _last(y, m)
        elif day > _last(y, m):
            day, m, y = (1, 1, y + 1) if m == 12 else (1, m + 1, y)
    return y, m, day


def _date(s: str) -> tuple[Day, Day] | None:
    hit = _DATE.match(s)
    if not hit:
        return None
    year, month, day, mark = hit.groups()
    digits = year.lstrip("Y")
    lo_y, hi_y = int(digits.replace("X", "0")), int(digits.replace("X", "9"))
    if digits.startswith("-") and "X" in digits:
        lo_y, hi_y = hi_y, lo_y
    if "X" in digits and month not in (None, "XX"):
        return None
    unit, m0, m1 = "year", 1, 12
    if month not in (None, "XX"):
        code = int(month)
        if code in SEASONS and day is None:
            unit, (m0, m1) = "season", SEASONS[code]
        elif 1 <= code <= 12:
            unit, m0, m1 = "month", code, code
        else:
            return None
    lo, hi = (lo_y, m0, 1), (hi_y, m1, _last(hi_y, m1))
    if day not in (None, "XX"):
        if month == "XX" or not 1 <= int(day) <= _last(lo_y, m0):
            return None
        unit, lo, hi = "day", (lo_y, m0, int(day)), (lo_y, m0, int(day))
    n = {"": 0, "~": 1, "?": 1, "%": 2}[mark]
    if n:
        step, k = ("day", 84 * n) if unit == "season" else (unit, n)
        lo, hi = _shift(lo, step, -k), _shift(hi, step, k)
        if unit == "month":
            hi = (hi[0], hi[1], _last(hi[0], hi[1]))
    return lo, hi


def interval(s: str | None) -> tuple[Day, Day] | None:
    """First and last day of an extended date text, null if it is none."""
    s = (s or "").strip()
    if len(s) > 1 and s[0] + s[-1] in ("[]", "{}"):
        bounds = []
        for part in s[1:-1].split(","):
            a, dots, b = part.strip().partition("..")
            lo, hi = _date(a) if a else None, _date(b) if b else None
            if (a and not lo) or (b and not hi) or not (a or b):
                return None
            bounds.append((lo[0] if lo else OPEN_LO, hi[1] if hi else OPEN_HI if dots else lo[1]))
        return min(x for x, _ in bounds), max(y for _, y in bounds)
    if "/" in s:
        a, _, b = s.partition("/")
        lo, hi = (None if x in ("", "..") else _date(x) for x in (a, b))
        if (a not in ("", "..") and not lo) or (b not in ("", "..") and not hi) or s == "/":
            return None
        return lo[0] if lo else OPEN_LO, hi[1] if hi else OPEN_HI
    return _date(s)


DAY = "struct<y:bigint,m:int,d:int>"


def with_interval(rows: DataFrame, column: str, out: str) -> DataFrame:
    """Adds ``out``: struct(lo, hi), null where the text is none. Each distinct text is parsed once."""
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [interval(s) for s in b["s"]]
            day = lambda d: {"y": d[0], "m": d[1], "d": d[2]}
            yield pd.DataFrame({"s": b["s"], "v": [{"lo": day(x[0]), "hi": day(x[1])} if x else None for x in found]})

    texts = rows.select(F.col(column).alias("s")).where("s is not null").distinct()
    parsed = texts.mapInPandas(parse, f"s string, v struct<lo:{DAY},hi:{DAY}>").withColumnRenamed("v", out)
    return rows.join(parsed, rows[column] == parsed["s"], "left").drop("s")
