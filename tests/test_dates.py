"""Date algebra against values worked out by hand."""

from pyspark.sql import functions as F

from eonmap.functions import dates as D


def rows(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


def flat(d):
    return [d["y"], d["m"], d["d"]]


def test_parse(spark):
    good = {"2026": (2026, None, None), "2026-1": (2026, 1, None), " 2026-01-31 ": (2026, 1, 31), "-1234-5-6": (-1234, 5, 6), "2026-02-31": (2026, 2, 31)}
    bad = ["c. 1900", "1900?", "2026-13", "2026-00", "2026-01-32", "1900-1910", "", "  ", "1975..1985", None, "--1"]
    d = D.parse_date(F.col("s"))
    got = dict((r[0], r[1:]) for r in rows(spark, [(k,) for k in [*good, *bad]], "s string", "s", *flat(d)))
    assert {k: got[k] for k in good} == good
    assert all(got[k] == (None, None, None) for k in bad)


def test_ends(spark):
    cases = {"1972-02": 19720229, "1971-02": 19710228, "1900-02": 19000228, "2000-02": 20000229, "-500": -4998769, "1999": 19991231, "1999-04": 19990430}
    got = dict(rows(spark, [(k,) for k in cases], "s string", "s", D.date_key(D.end_of(D.parse_date(F.col("s"))))))
    assert got == cases


def test_range_and_duration(spark):
    r = D.date_range(F.col("a"), F.col("b"))
    got = rows(spark, [("2020-01", "2020-10"), (None, "1900"), ("x", None), ("1900", "1890")], "a string, b string", F.round(D.duration_years(r), 6))
    assert got == [(0.75,), (float("inf"),), (float("inf"),), (-10.0,)]


def test_overlap_is_half_open(spark):
    got = rows(spark, [(1, 5, 5, 9), (1, 6, 5, 9), (5, 9, 1, 5)], "a long, b long, c long, d long", D.overlaps(F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    assert got == [(False,), (True,), (False,)]


def test_one_day_off(spark):
    def d(k):
        return F.struct((F.floor(F.col(k) / 10000)).cast("bigint").alias("y"), (F.floor(F.col(k) / 100) % 100).cast("int").alias("m"), (F.col(k) % 100).cast("int").alias("d"))

    data = [(19480508, 19480508, 19480509, 19480509), (19480509, 19480509, 19480508, 19480508), (19480507, 19480507, 19480509, 19480509), (19480531, 19480531, 19480601, 19480630),
            (19481231, 19481231, 19490101, 19490101), (19480601, 19480630, 19480501, 19480531), (19480231, 19480231, 19480301, 19480301)]
    got = [r[0] for r in rows(spark, data, "a long, b long, c long, d long", D.one_day_off(d("a"), d("b"), d("c"), d("d")))]
    assert got == [True, True, False, True, True, True, False]


def test_day_number_is_unix_days(spark):
    got = rows(spark, [("1970-01-01",), ("2000-02-29",), ("1582-10-15",), ("0001-01-01",)], "s string", D.day_number(D.parse_date(F.col("s"))), F.unix_date(F.to_date("s")))
    assert all(a == b for a, b in got)


def test_labels(spark):
    got = rows(spark, [("1900", "1910"), ("1900-01", "1910"), (None, "1910"), ("1900-01", None), (None, None)], "a string, b string", D.format_range(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == ["1900-1910", "1900-01 - 1910", "-1910", "1900-01 -", "-"]


def test_lenient_year_and_decades(spark):
    got = rows(spark, [("-0500-01-01",), ("1871",), ("19x",), ("",), (None,)], "s string", D.lenient_year(F.col("s")))
    assert [g[0] for g in got] == [-500, 1871, None, None, None]
    got = rows(spark, [(-25, 1), (11, 19), (20, 20), (30, 10), (2025, None)], "a long, b long", D.decades(F.col("a"), F.col("b")))
    assert [list(g[0]) for g in got] == [[-20, -10, 0], [], [20], [], [2030]]


def test_viewer_decimal(spark):
    want = {"-0002-01-01": -1.99863, "-0002-07-02": -1.5, "-0001-12-31": -0.00137, "0000-01-01": 0.00137, "0000-07-02": 0.50137, "0001-07-02": 1.5, "0002-12-31": 2.99863, "1999-02-29": None, "x": None}
    got = dict(rows(spark, [(k,) for k in want], "s string", "s", D.decimal_date(F.col("s"))))
    assert got == want


def test_viewer_padding(spark):
    start = {"+2000": "2000-01-01", "-44-03": "-44-03-01", "": "", "never": "", "218-02-29": "218-02-29", None: None}
    end = {"2000-02": "2000-02-29", "-2001-02": "-2001-02-29", "+19900-02": "19900-02-28", "-2000": "-2000-12-31"}
    assert dict(rows(spark, [(k,) for k in start], "s string", "s", D.pad_date(F.col("s")))) == start
    assert dict(rows(spark, [(k,) for k in end], "s string", "s", D.pad_date(F.col("s"), end=True))) == end


def test_exclusive_end(spark):
    got = [r[0] for r in rows(spark, [("1999",), ("1999-12",), ("2000-02",), ("2000-02-28",), ("bad",)], "s string", D.decimal_exclusive_end(F.col("s")))]
    first_of = [r[0] for r in rows(spark, [("2000-01-01",), ("2000-01-01",), ("2000-03-01",), ("2000-02-29",)], "s string", D.decimal_date(F.col("s")))]
    assert got == [*first_of, None]


def test_months_and_text(spark):
    got = rows(spark, [("2024-03",), ("-44-03",), ("1999",)], "s string", D.to_months(F.col("s")), D.from_months(D.to_months(F.col("s"))))
    assert got == [(24290, "2024-03"), (-526, "-0044-03"), (23988, "1999-01")]
    assert rows(spark, [("WA1234",), ("WB0500",), ("X1",)], "s string", D.atlas_year(F.col("s"))) == [(1234,), (-499,), (None,)]


def test_slider(spark):
    years = [-6000, -3000, -1000, 0, 2026]
    got = rows(spark, [(y,) for y in years], "y int", D.year_to_slider(F.col("y")))
    assert [g[0] for g in got] == [0, 1000, 2000, 3000, 10000]
    back = rows(spark, [(p,) for p in (0, 1000, 2000, 3000, 10000)], "p int", D.slider_to_year(F.col("p")))
    assert [b[0] for b in back] == years
    assert [r[0] for r in rows(spark, [(-5949,), (-1026,), (1234,)], "y int", D.snap_year(F.lit(0), F.col("y")))] == [-5900, -1050, 1230]
