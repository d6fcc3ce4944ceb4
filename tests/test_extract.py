"""Extract files: written once, read in both forms, drawn, and compared."""

import json

import numpy as np
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from eonmap.functions import geometry
from eonmap.plans import features as Q
from eonmap.sources import extract, tables


@pytest.fixture(scope="module")
def found(spark):
    """Two neighbours with a way in common, one with a hole and a label; a bow tie; one without a date."""
    xy = [(0, 0), (9, 0), (9, 9), (0, 9), (18, 0), (18, 9), (2, 2), (2, 4), (4, 4), (30, 0), (32, 2), (32, 0), (30, 2)]
    nodes = spark.createDataFrame([(i, float(x), float(y), {"name": 'a "b"\n], ,'} if i == 6 else {}) for i, (x, y) in enumerate(xy)], tables.NODES)
    refs = {1: [1, 2], 2: [2, 3, 0, 1], 3: [2, 5, 4, 1], 4: [6, 7, 8, 6], 5: [9, 10, 11, 12, 9]}
    pts = tables.way_points(spark.createDataFrame([(i, r, {}) for i, r in refs.items()], tables.WAYS), nodes)
    tags = lambda name, **k: {"boundary": "administrative", "admin_level": "2", "name": name, **k}
    w = lambda *ws: [("w", abs(i), "inner" if i < 0 else "outer") for i in ws]
    rel = [(1, tags('West "W"], {', start_date="1900", end_date="1950", whmid="7"), [*w(1, 2, -4), ("n", 6, "label")]), (2, tags("Ost ß", start_date="1900", end_date="1950"), w(1, 3)),
           (3, tags("Bow", start_date="1900"), w(5)), (4, tags("Undated", note="5"), w(5)), (5, tags("Nothing", start_date="1900"), [])]
    chron = [(20, {"type": "chronology", "name": "C"}, [("r", 1, ""), ("r", 2, "")])]
    relations = spark.createDataFrame(rel + chron, tables.RELATIONS)
    return Q.web_extract(relations, pts, "2", nodes, Q.chronology_entries(relations), None, 0.0, 0.0), relations, pts


@pytest.fixture(scope="module")
def folder(found, tmp_path_factory):
    place = tmp_path_factory.mktemp("extract")
    extract.write_extract(found[0], f"file://{place}", "2")
    return place


def test_files_hold_the_tables(found, folder):
    out = found[0]
    assert sorted(p.name for p in folder.iterdir() if not p.name.startswith(".")) == ["nodes2.json", "relations2.b64.json", "ways2.json"]
    ways = json.loads((folder / "ways2.json").read_text())
    assert ways == {str(r["id"]): list(r["deltas"]) for r in out["ways"].collect()} and len(ways) == 5
    assert json.loads((folder / "nodes2.json").read_text()) == {"6": {"loc": [2.0, 2.0], "tags": {"name": 'a "b"\n], ,'}}}
    whole = json.loads((folder / "relations2.b64.json").read_text())
    assert list(whole) == ["tagPairs", "tagKeys", "tagVals", "relations"]
    rows = out["relations"].collect()
    assert [r["id"] for r in whole["relations"]] == [r["id"] for r in rows]
    for got, want in zip(whole["relations"], rows, strict=True):
        assert got["tags"] == json.loads(want["flat"]) and got["ways"] == want["ways"] and got.get("nodes", []) == (want["nodes"] or [])
        assert [c["id"] for c in got.get("chronology", [])] == [c["id"] for c in (want["chronology"] or [])]


def test_both_forms_read_alike(spark, folder, tmp_path):
    coded = extract.read_relations(spark, f"file://{folder}/relations2.json")  # the sibling is there
    rows = {r["id"]: r for r in coded.collect()}
    assert rows[1]["tags"]["name"] == 'West "W"], {' and rows[4]["tags"]["note"] == "5" and rows[2]["tags"]["name"] == "Ost ß" and rows[5]["ways"] == []
    assert {frozenset(map(abs, ring)) for ring in rows[1]["ways"][0]} == {frozenset({1, 2}), frozenset({4})}
    plain = [{"id": i, "tags": r["tags"], "ways": r["ways"], **({"nodes": r["nodes"]} if r["nodes"] else {}), **({"chronology": [c.asDict() for c in r["chronology"]]} if r["chronology"] else {})} for i, r in rows.items()]
    (tmp_path / "relations2.json").write_text(json.dumps(plain, ensure_ascii=False))
    again = {r["id"]: r for r in extract.read_relations(spark, f"file://{tmp_path}/relations2.json").collect()}
    assert again == rows


def test_ways_are_read_from_any_place(spark, tmp_path):
    ways = {i: [i * 7, -i, 3, -4][: 4 if i % 5 else 0] for i in range(1, 3000)}
    (tmp_path / "ways.json").write_text(json.dumps({str(k): v for k, v in ways.items()}, separators=(",", ":")))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    try:
        rows = extract.read_ways(spark, f"file://{tmp_path}/ways.json")
        assert rows.rdd.getNumPartitions() > 5
        assert {r["id"]: list(r["deltas"]) for r in rows.collect()} == ways
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    (tmp_path / "none.json").write_text("{}")
    assert extract.read_ways(spark, f"file://{tmp_path}/none.json").count() == 0


def test_relations_are_read_from_any_place(spark, folder, tmp_path):
    """A file with a line for each member is read by many tasks; the same file without line ends, as one value, gives the same."""
    path = f"file://{folder}/relations2.b64.json"
    (tmp_path / "one.b64.json").write_text(json.dumps(json.loads((folder / "relations2.b64.json").read_text()), separators=(",", ":"), ensure_ascii=False))
    assert extract.has_lines(spark, path) and not extract.has_lines(spark, f"file://{tmp_path}/one.b64.json")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60")
    try:
        assert extract.coded_lines(spark, path)[0].rdd.getNumPartitions() > 3
        rows = {r["id"]: r for r in extract.read_relations(spark, path).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {r["id"]: r for r in extract.read_relations(spark, f"file://{tmp_path}/one.b64.json").collect()} and len(rows) == 5


def test_geometry_of_an_extract(spark):
    """A missing way is skipped; where it is the first of its ring, the next one still goes without its first point."""
    step = lambda *xy: np.diff(np.array(xy), axis=0, prepend=0).ravel().tolist()
    ways = spark.createDataFrame([(1, step((0, 0), (100, 0), (100, 100))), (2, step((100, 100), (0, 100), (0, 0))), (3, step((5, 5), (6, 5)))], "id long, deltas array<long>")
    rel = [(1, [[[1, 2]]]), (2, [[[9, 1, 2]]]), (3, [[[1, 9]]]), (4, [[[3]]]), (5, [[[1, 2], [3]]]), (6, [[[3], [1, 2]]]), (7, []), (8, [[[-2, -1]]])]
    got = {r["id"]: [[len(ring) for ring in polygon] for polygon in r["geom"]] for r in extract.drawn(spark.createDataFrame(rel, "id long, ways array<array<array<long>>>"), ways).collect()}
    assert got == {1: [[4]], 2: [[4]], 3: [[3]], 4: [], 5: [[4]], 6: [], 7: [], 8: [[4]]}


def test_from_extract_to_gap(spark, found, folder):
    skipped = Observation("skipped")
    relations, ways = extract.read_relations(spark, f"file://{folder}/relations2.b64.json"), extract.read_ways(spark, f"file://{folder}/ways2.json")
    ours = tables.materialise(extract.extract_features(relations, ways, "2", skipped))
    assert skipped.get == {"no_date": 1, "no_geometry": 1}
    rows = {r["id"]: r for r in ours.collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["whmid"] == "7" and (rows[1]["lo"], rows[1]["hi"]) == (1900.0, 1950.0) and rows[3]["hi"] == 2100.0
    square = [[np.array([(0, 0), (9, 0), (9, 9), (0, 9)], float), np.array([(2, 2), (2, 4), (4, 4)], float)]]
    assert abs(rows[1]["km2"] / geometry.area_km2(square) - 1) < 1e-3
    one_lobe = geometry.area_km2([[np.array([(30, 0), (31, 1), (30, 2)], float)]])
    assert abs(rows[3]["km2"] / one_lobe - 1) < 1e-3  # the bow tie is repaired
    theirs = ours.where("id = 1").withColumn("lo", F.lit(1925.0)).withColumn("id", F.lit(99).cast("long"))
    gap = {r["id"]: r for r in Q.coverage_gap(ours, theirs).collect()}
    assert abs(gap[1]["pct"] - 50) < 0.1 and gap[2]["pct"] == 100 and gap[3]["pct"] == 100


def test_features_as_the_viewer_draws_them(spark):
    relations = spark.createDataFrame([(1, {"name": "A"}, [[[1]]], [6]), (2, {"name": "@true"}, [], [6, 5]), (3, {}, [], None)], "id long, tags map<string,string>, ways array<array<array<long>>>, nodes array<long>")
    geom = spark.createDataFrame([(1, [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]]])], f"id long, geom {Q.GEOM}")
    nodes = spark.createDataFrame([(5, [1.5, 2.0]), (6, [3.0, 4.0])], "id long, loc array<double>")
    got = {f["id"]: f for f in (json.loads(r["value"]) for r in extract.shown(relations, geom, nodes).collect())}
    assert got[1]["geometry"] == {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]]]} and got[1]["properties"] == {"name": "A"}
    assert got[2]["geometry"] == {"type": "MultiPoint", "coordinates": [[3, 4], [1.5, 2]]} and got[2]["properties"]["_relation_node"] is True
    assert "points" not in got[3]


def test_gap_report_as_text(spark):
    from eonmap.sources import sinks

    rows = spark.createDataFrame([(1, "A", "7", "1900", None, 2.0, 0.5), (2, "B", "", "1900", "1910", 0.0, 0.0), (3, "C", "7", "1950", None, 1.0, 1.0)], "id long, name string, whmid string, start_date string, end_date string, earth_years double, uncovered double")
    got = [tuple(r) for r in sinks.gap_by_feature(rows).collect()]
    assert got == [("7", "C", "1950", None, "1.000000", "1.000000", "0.0"), ("7", "A", "1900", None, "2.000000", "0.500000", "75.0"), ("", "B", "1900", "1910", "0.000000", "0.000000", "0.0")]
    assert [tuple(r) for r in sinks.gap_by_chronology(Q.gap_by_chronology(rows)).collect()] == [("7", "A", 2, "3.000000", "1.500000", "50.0"), ("2", "B", 1, "0.000000", "0.000000", "0.0")]


def test_later_summaries_win(spark, tmp_path):
    from eonmap.sources import atlas

    for day in ("250101", "250102"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "a.summary.csv").write_text("type,count\nx,1\ny,2\n")
    (tmp_path / "250102" / "b.summary.csv").write_text("type,count\nx,5\nx,6\n")
    got = {(r["date"], r["type"]): (r["file"], r["count"]) for r in atlas.read_summaries(spark, f"file://{tmp_path}/*/*.summary.csv").collect()}
    assert got == {("250101", "x"): ("a.summary.csv", 1), ("250101", "y"): ("a.summary.csv", 2), ("250102", "x"): ("b.summary.csv", 6), ("250102", "y"): ("a.summary.csv", 2)}
