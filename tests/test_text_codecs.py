import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from eonmap.functions import codecs, text


@pytest.mark.parametrize(("title", "want"), [
    ("Kish, c2900 - 2350BCE.", ("Kish", "c2900 - 2350BCE", None, None, None)),
    ("East Turks.", ("East Turks", None, None, None, None)),
    ("Cyprus, Assyrian Vassal, 709 - 612BCE,.", ("Cyprus, Assyrian Vassal", "709 - 612BCE", None, None, None)),
    ("Ghazni, 977 - 1186, Ghaznevid Dynasty 977 - 1186.", ("Ghazni", "977 - 1186", None, "Ghaznevid Dynasty 977 - 1186", None)),
    ("Egypt, 972 - 1169, Al-Mustali Biallah, Emir 1094 - 1102, Fatimid Dynasty 969 - 1171", ("Egypt", "972 - 1169", "Al-Mustali Biallah, Emir 1094 - 1102", "Fatimid Dynasty 969 - 1171", None)),
    ("Calukyas, 973 - 1200, Tailapa Ahavamalla King 973 - 997, Calukya Dynasty 973 - 1200.", ("Calukyas", "973 - 1200", "Tailapa Ahavamalla King 973 - 997", "Calukya Dynasty 973 - 1200", None)),
    ("Awa, Satomi Family 1467 - 1590.", ("Awa", None, None, "Satomi Family 1467 - 1590", None)),
    ("Huns, c300 - c453, nomadic herders, Rugila, King 432 - 437", ("Huns", "c300 - c453", "Rugila, King 432 - 437", None, "nomadic herders")),
    ("Central Africa, French Colonies, gained 1626-1914, lost 1958-1962", ("Central Africa, French Colonies", None, None, None, "gained 1626-1914, lost 1958-1962")),
    ("Virginia, British Colony, 1607 - 1683, shown as part of America after 1683.", ("Virginia, British Colony", "1607 - 1683", None, None, "shown as part of America after 1683")),
    ("Denmark, 935 - Present.", ("Denmark", "935 - Present", None, None, None)),
    ("Kish., c2900 - 2350BCE.", ("Kish", "c2900 - 2350BCE", None, None, None)),
    ("A, 900 - 950, Snefru, The Pharaoh 900 - 950", ("A", "900 - 950", "Snefru, The Pharaoh 900 - 950", None, None)),
    ("A, 900 - 950, X, gained 910-920, King 900 - 950", ("A", "900 - 950", "X, King 900 - 950", None, "gained 910-920")),
    ("A, 900 - 950, One Dynasty 900 - 910, Two Dynasty 911 - 950, tail", ("A", "900 - 950", None, "One Dynasty 900 - 910", "tail")),
    ("A, 900 - 950, p, gained 1-2, q", ("A", "900 - 950", None, None, "gained 1-2, p, q")),
    ("900 - 950, King 900 - 950", ("", "900 - 950", "King 900 - 950", None, None)),
    ("Egypt, Old Kingdom, 2925 - c2150BCE + -50 years, Snefru, Pharaoh c2575 - c2551BCE, Fourth Dynasty of Egypt c2575 - c2465BCE.",
     ("Egypt, Old Kingdom", "2925 - c2150BCE + -50 years", "Snefru, Pharaoh c2575 - c2551BCE", "Fourth Dynasty of Egypt c2575 - c2465BCE", None)),
    ("Cordoba, 756 - 1070, Abd-ar-Rahman III, Emir (Caliph 929) 912 - 961, Ummayad Dynasty 756 - 1031.",
     ("Cordoba", "756 - 1070", "Abd-ar-Rahman III, Emir (Caliph 929) 912 - 961", "Ummayad Dynasty 756 - 1031", None)),
    ("", ("", None, None, None, None)),
    (None, (None,) * 5),
])
def test_titles(spark, title, want):
    got = spark.createDataFrame([(title,)], "t string").select(text.parse_title("t").alias("t")).first()["t"]
    assert tuple(got) == want if title is not None else got is None or tuple(got) == want


def test_parameters_of_a_view():
    assert text.map_view("4.5/10/-20.25") == (4.5, 10.0, -20.25) and text.map_view("1/2") is None and text.map_view("a/b/c") is None
    assert text.id_list("3,x,5") == [3.0, 5.0] and text.id_list("x") is None
    assert text.year_range("1500,1900") == (1500, 1900) and text.year_range("1900,1500") is None and text.year_range("-7000,0") is None
    assert text.level_set("2,4,x") == {"2", "4"} and text.level_set("x") is None


def test_varints_round_trip():
    rng = random.Random(5)
    rings = [np.array([rng.choice([-1, 1]) * rng.randint(1, 10 ** rng.randint(1, 11)) for _ in range(rng.randint(0, 40))], np.int64) for _ in range(300)]
    codes = codecs.encode_rings(rings)
    assert all(np.array_equal(a, b) for a, b in zip(rings, codecs.decode_rings(codes), strict=True))
    assert codecs.encode_rings([np.array([1, -1])]) == [bytes([4, 1])]
    near = np.arange(150_000_000, 150_000_020)
    assert len(codecs.encode_rings([near])[0]) < 4 * len(near)


def test_tag_dictionaries(spark):
    data = [(1, {"a": "x", "b": 'q"uo\\te'}), (2, {"a": "x", "c": "y"}), (3, {"d": "y", "e": "7"}), (4, {}), (5, None), (6, {"a": "z", "f": "-3"})]
    df = spark.createDataFrame(data, "id long, tags map<string,string>")
    tables = codecs.tag_tables(df, "id", "tags")
    flat = codecs.encode_tags(df, "id", "tags", tables)
    got = {r["id"]: json.loads(r["flat"]) for r in flat.collect()}
    assert got[1] == [-1, 1, 'q"uo\\te'] and got[2] == [-1, 2, got[2][2]] and got[3][:2] == [3, got[2][2]] and got[4] == []
    back = {r["id"]: r["tags"] for r in codecs.decode_tags(flat, tables).collect()}
    assert back == {i: t or {} for i, t in data}


def test_deltas(spark):
    df = spark.createDataFrame([([5, 7, 7, 1],), ([],)], "xs array<long>")
    got = df.select(codecs.deltas(F.col("xs")), codecs.running_sums(codecs.deltas(F.col("xs")))).collect()
    assert list(got[0][0]) == [5, 2, 0, -6] and list(got[0][1]) == [5, 7, 7, 1] and list(got[1][1]) == []
