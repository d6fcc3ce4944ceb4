"""Queries over a small map: two square neighbours, a copy, an enclave and a chronology."""

import base64
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eonmap.functions import codecs, geometry
from eonmap.operators import graph, numbering, temporal
from eonmap.plans import features as Q
from eonmap.sources import sinks, tables


def boundary(name, start, end, level="2", **more):
    return {"boundary": "administrative", "admin_level": level, "name": name, **({"start_date": start} if start else {}), **({"end_date": end} if end else {}), **more}


@pytest.fixture(scope="module")
def world(spark):
    xy = {1: (0, 0), 2: (1, 0), 3: (1, 1), 4: (0, 1), 5: (2, 0), 6: (2, 1), 7: (0.2, 0.2), 8: (0.4, 0.2), 9: (0.4, 0.4)}
    nodes = spark.createDataFrame([(i, float(x), float(y), {}) for i, (x, y) in xy.items()], tables.NODES)
    ways = {10: [2, 3], 11: [3, 4, 1, 2], 12: [2, 5, 6, 3], 13: [7, 8, 9, 7], 14: [1, 2, 99]}
    ways = spark.createDataFrame([(i, r, {}) for i, r in ways.items()], tables.WAYS)
    m = lambda *ws, role="outer": [("w", w, role) for w in ws]
    rel = [
        (1, boundary("West", "1900", "1950"), m(10, 11)), (2, boundary("East", "1900", "2000"), m(10, 12)), (3, boundary("West", "1900", "1950", source="x"), m(11, 10)),
        (4, boundary("West", "1940", "1960"), m(10, 11)), (5, boundary("Open", "1800", None, "3"), m(11)), (6, boundary("Hole", "1900", "1910", "4"), [*m(10, 11), ("w", 13, "inner")]),
        (20, {"type": "chronology", "name": "Wests", "start_date": "1900", "end_date": "1955"}, [("r", 1, ""), ("r", 4, ""), ("r", 77, "")]),
    ]
    relations = spark.createDataFrame(rel, tables.RELATIONS)
    return {"nodes": nodes, "ways": ways, "relations": relations, "pts": tables.way_points(ways, nodes)}


def square_km2(x, y, w=1, h=1):
    return geometry.area_km2([[np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], float)]])


def test_counts_and_guard(spark, world):
    got = {r[0]: r[1] for r in Q.feature_counts(world["nodes"], world["ways"], world["relations"]).collect()}
    assert got == {"nodes": 9, "ways": 5, "relations": 7}
    with pytest.raises(ValueError, match="ways without nodes"):
        Q.feature_counts(world["nodes"], spark.createDataFrame([(1, [], {})], tables.WAYS), world["relations"])
    assert tables.snapshot_date("x/planet-260402.osm.pbf") == "2026-04-02"


def test_way_points_leave_out_missing_nodes(world):
    pts = {r["id"]: [p["node_id"] for p in r["pts"]] for r in world["pts"].collect()}
    assert pts[14] == [1, 2] and pts[11] == [3, 4, 1, 2]


def test_geometry_and_faults(world):
    rows = {r["id"]: r for r in Q.measured(Q.relation_geometry(world["relations"].where("id < 20"), world["pts"])).collect()}
    assert math.isclose(rows[1]["km2"], square_km2(0, 0), rel_tol=1e-9) and rows[1]["warnings"] == [] and rows[1]["fault"] is None
    assert [w["kind"] for w in rows[5]["warnings"]] == ["open_ring"] and rows[6]["km2"] < rows[1]["km2"]
    examples, counters = Q.bad_geometry(world["relations"].where("id < 20"), world["pts"], "2026-01-01")
    bad = examples.collect()
    assert [(b["type"], b["fid"]) for b in bad] == [("nonclosed-ring", 5)] and bad[0]["earth_years"] > 0
    assert bad[0]["text"].endswith("[3] Open OpenRingWarning(node_id_start=3, node_id_end=2)")
    assert {r[0]: r[1] for r in counters.collect()} == {"geom-valid": 5, "geom-invalid": 1}


def test_relations_without_shape(spark, world):
    """Missing ways, no ways at all and rings without area pass through every query."""
    m = lambda *ws: [("w", w, "outer") for w in ws]
    rel = [(1, boundary("A", "1900", "1950"), m(98, 99)), (2, boundary("B", "1900", None), []), (3, boundary("C", "1900", "1950"), m(97, 10, 11)), (4, boundary("D", None, None), None)]
    relations = spark.createDataFrame(rel, tables.RELATIONS)
    examples, counters = Q.bad_geometry(relations, world["pts"], "2026-01-01")
    got = {(r["type"], r["fid"]): r["text"] for r in examples.collect()}
    assert set(got) == {("invalid-way-reference", 1), ("no-shapely", 1), ("no-shapely", 2), ("invalid-way-reference", 3), ("no-shapely", 4)}
    assert got["invalid-way-reference", 1] == "(0.0000ey) [2] A MissingWayWarning(way_id=98), MissingWayWarning(way_id=99)" and got["no-shapely", 2] == "(0.0000ey) [2] B"
    assert {r[0]: r[1] for r in counters.collect()} == {"geom-valid": 0, "geom-invalid": 4}
    drawn = relations.join(Q.relation_geometry(relations, world["pts"]).select("id", "geom"), "id").select(F.lit("r").alias("ftype"), "id", "tags", "geom")
    rows = Q.coverage_rows(drawn, "2026-01-01")
    assert {r["id"] for r in rows.collect()} == {1, 2, 3} and Q.double_coverage(rows).count() == 0
    assert {r["level"] for r in Q.decade_coverage(drawn).collect()} == {"2"}
    out = Q.connectivity(relations, world["pts"])
    assert {r["node"] for r in out["nodes"].collect()} == {1, 2, 3, 4} and out["edges"].count() == 0
    assert Q.web_extract(relations, world["pts"], "2")["relations"].count() == 4


def test_a_way_and_a_relation_of_one_id(spark):
    square = [[[{"x": float(x), "y": float(y)} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))]]]
    rows = Q.coverage_rows(spark.createDataFrame([(t, 5, boundary("X", "1900", "1910"), square) for t in "rw"], f"ftype string, id long, tags map<string,string>, geom {Q.GEOM}"), "2026-01-01")
    pairs = Q.double_coverage(rows)
    assert [(r["a_type"], r["a"], r["b_type"], r["b"]) for r in pairs.collect()] == [("w", 5, "r", 5)]
    total = Q.double_coverage_totals(pairs).collect()
    assert [r["type"] for r in total] == ["double-covered-admin-2"] and abs(total[0]["count"] - 10 * square_km2(0, 0) / geometry.LAND_KM2) < 1e-6


def test_areas(spark, world):
    ways = world["ways"].withColumn("tags", F.create_map(F.lit("landuse"), F.lit("x")))
    typed = world["relations"].where("id in (1, 5, 6)").withColumn("tags", F.map_concat("tags", F.create_map(F.lit("type"), F.lit("boundary"))))
    got = {(r["ftype"], r["id"]): r for r in Q.measured(Q.areas(typed, world["pts"], ways)).collect()}
    assert set(got) == {("w", 13), ("r", 1), ("r", 6)}  # relation 5 does not close
    assert math.isclose(got["r", 1]["km2"] - got["r", 6]["km2"], got["w", 13]["km2"], rel_tol=1e-6)


def areas(world):
    g = Q.relation_geometry(world["relations"].where("id < 20"), world["pts"])
    return world["relations"].join(g.select("id", "geom"), "id").select(F.lit("r").alias("ftype"), "id", "tags", "geom")


def test_coverage(world):
    rows = tables.materialise(Q.coverage_rows(areas(world), "2026-01-01"))
    got = {r[0]: r[1] for r in Q.earth_years(rows).collect()}
    want = (50 * 2 + 20) * square_km2(0, 0) + 100 * square_km2(1, 0)
    assert abs(got["2"] - want / geometry.LAND_KM2) < 1e-6 and set(got) == {"2", "3", "4"}
    pairs = {(r["a"], r["b"]): r["earth_years"] for r in Q.double_coverage(rows, 1e-9).collect()}
    assert set(pairs) == {(3, 1), (4, 1), (4, 3)}
    assert math.isclose(pairs[4, 1], 10 * square_km2(0, 0) / geometry.LAND_KM2, rel_tol=1e-6)


def test_decades(world):
    got = {(r["level"], r["decade"]): r["km2"] for r in Q.decade_coverage(areas(world)).collect()}
    assert math.isclose(got["2", 1900], square_km2(0, 0, 2), rel_tol=1e-6) and math.isclose(got["2", 1990], square_km2(1, 0), rel_tol=1e-6)
    assert ("2", 1960) in got and ("2", 2010) not in got
    table = sinks.decade_table(Q.decade_coverage(areas(world))).collect()
    assert table[0]["year"] == 1900 and table[0]["admin2_km2"].isdigit()


def test_duplicates(world):
    got = Q.duplicate_relations(world["relations"].where("id < 20"), world["pts"]).collect()
    assert [(list(r["ids"]), r["extra"]) for r in got] == [([1, 3], 1)]


def test_chronology(spark, world):
    objects = world["relations"].select(F.lit("r").alias("ftype"), "id", "tags")
    got = {r["type"]: r["text"] for r in Q.chronology_quality(world["relations"], objects).collect()}
    assert got == {"chronology-overlapping-members": "Wests r/1 (1900-1950) + r/4 (1940-1960)",
                   "chronology-member-outside-range": "Wests r/4 (1940-1960) outside 1900-1955", "chronology-undated-member": "Wests r/77"}
    rel = [(30, {"type": "chronology"}, [("r", 77, ""), ("n", 8, ""), ("r", 1, ""), ("r", 31, "")]), (31, {"start_date": "19xx"}, []), (32, {"type": "chronology", "name": "Z"}, [])]
    more = world["relations"].unionByName(spark.createDataFrame(rel, tables.RELATIONS))
    got = {(r["type"], r["chrono_id"]): r["text"] for r in Q.chronology_quality(more, more.select(F.lit("r").alias("ftype"), "id", "tags")).collect() if r["chrono_id"] > 20}
    assert got == {("chronology-anonymous", 30): "", ("chronology-undated-member", 30): "r/77,n/8"}
    chron = {r["id"]: r["chronology"] for r in Q.chronology_entries(world["relations"]).collect()}
    assert [tuple(e) for e in chron[4]] == [(20, "Wests", 1, 77)]


def test_date_quality(spark):
    data = [("n", 1, {"start_date": "190x", "end_date": "bad", "name": "A"}), ("w", 2, {"start_date": "1950", "end_date": "1940"}), ("r", 3, {"end_date": "1948-05-08", "end_date:edtf": "1948-05-09", "name": "C"}),
            ("r", 4, {"start_date:edtf": "1900"}), ("n", 5, {"start_date": "1900", "start_date:edtf": "1890..1900"}), ("n", 6, {"name": "Rome (100-200)", "start_date": "100"}), ("n", 7, {"name": "no date"}),
            ("r", 8, {"start_date": "9999", "end_date": "9999"}), ("w", 9, {"end_date": "1900", "natural": "water"}), ("w", 10, {"start_date": "1900", "end_date": "1910", "natural": "water"}),
            ("n", 11, {"start_date": "1900", "start_date:edtf": "../19000"}), ("n", 12, {"start_date": "x", "start_date:edtf": "1..2"}), ("n", 13, {"end_date": "", "start_date": "5"})]
    examples, counters = Q.date_quality(spark.createDataFrame(data, "ftype string, id long, tags map<string,string>"))
    rows = [(r["type"], r["fid"], r["text"]) for r in examples.collect()]
    assert sorted(rows) == sorted([
        ("date-invalid", 1, "190x A"), ("date-start-after-end", 2, "1950 > 1940 "), ("date-end-no-start", 3, ""), ("date-edtf-mismatch", 3, "end_date=1948-05-08 vs end_date:edtf=1948-05-09 C"),
        ("date-edtf-without-plain", 4, "start_date:edtf=1900 "), ("date-edtf-invalid", 5, "start_date:edtf=1890..1900 "), ("date-in-name", 6, "Rome (100-200)"),
        ("date-far-future", 8, "9999 "), ("date-far-future", 8, "9999 "), ("date-edtf-invalid", 11, "start_date:edtf=../19000 "), ("date-invalid", 12, "x ")])
    n = {r[0]: r[1] for r in counters.collect()}
    assert n == {"dated-relations": 10, "dated-features": 11, "dated-timeless": 1, "date-edtf-features": 4, "date-edtf-invalid-dot-dot": 1, "date-edtf-mismatch-off-by-one-day": 1}
    lines = [r[0] for r in sinks.summary(counters, examples).select("type").collect()]
    assert lines == sorted(n) + sorted({t for t, _, _ in rows})
    assert {r[1] for r in Q.date_quality(spark.createDataFrame([], "ftype string, id long, tags map<string,string>"))[1].collect()} == {0}


def test_connectivity(world):
    out = Q.connectivity(world["relations"], world["pts"])
    nodes = {r["node"]: (r["members"], r["dropped"]) for r in out["nodes"].collect()}
    assert nodes == {20: ([4], [1, 3]), 2: ([2], [])}  # 1 lies in 4, 3 is a copy of 1
    assert [tuple(r) for r in out["edges"].collect()] == [(2, 20)]
    colours = {r["node"]: r["colour"] for r in out["colours"].collect()}
    assert colours[2] != colours[20] and graph.clashes(out["edges"], out["colours"]).count() == 0
    every = {r["id"]: (r["colour"], r["node"]) for r in Q.relation_colours(out["nodes"], out["colours"]).collect()}
    assert every == {i: (colours[n], n) for i, n in ((1, 20), (3, 20), (4, 20), (2, 2))}


def test_donations_follow_chains(spark):
    """A strip in a block, the block in a country: the country touches what the strip touched."""
    xy = [(0, 0), (4, 0), (4, 3), (0, 3), (4.4, 0), (4.4, 3), (4.5, 0), (4.5, 3), (8, 0), (8, 3)]
    nodes = spark.createDataFrame([(i, float(x), float(y), {}) for i, (x, y) in enumerate(xy)], tables.NODES)
    refs = {1: [1, 2], 2: [2, 3, 0, 1], 3: [1, 4], 4: [4, 5], 5: [5, 2], 6: [4, 6], 7: [6, 7], 8: [7, 5], 9: [6, 8, 9, 7], 10: [0, 1]}
    pts = tables.way_points(spark.createDataFrame([(i, r, {}) for i, r in refs.items()], tables.WAYS), nodes)
    m = lambda *ws: [("w", w, "outer") for w in ws]
    # 1: strip x 4.4-4.5; 2: block x 4-4.5, 3: country x 0-4.5, drawn with the same ways; 4: neighbour x 4.5-8
    rel = [(1, boundary("Strip", "1900", "1950"), m(4, 6, 7, 8)), (2, boundary("Block", "1900", "1950"), m(1, 3, 6, 7, 8, 5)), (3, boundary("Country", "1900", "1950"), m(2, 3, 6, 8, 5, 7)), (4, boundary("East", "1900", "1950"), m(7, 9))]
    out = Q.connectivity(spark.createDataFrame(rel, tables.RELATIONS), pts)
    assert {r["node"]: (r["members"], r["dropped"]) for r in out["nodes"].collect()} == {3: ([3], [1, 2]), 4: ([4], [])}
    assert [tuple(r) for r in out["edges"].collect()] == [(3, 4)]


def test_extract_and_view(spark, world):
    more = world["relations"].withColumn("members", F.when(F.col("id") == 2, F.concat("members", F.array(F.struct(F.lit("n").alias("type"), F.lit(6).cast("long").alias("ref"), F.lit("label").alias("role"))))).otherwise(F.col("members")))
    graph_of = Q.connectivity(more, world["pts"])
    out = Q.web_extract(more, world["pts"], "2", world["nodes"], Q.chronology_entries(more), Q.relation_colours(graph_of["nodes"], graph_of["colours"]), 0.0, 0.0)
    rows = {r["id"]: r for r in out["relations"].collect()}
    assert set(rows) == {1, 2, 3, 4} and out["pairs"].count() > 2 and [r["id"] for r in out["nodes"].collect()] == [6]
    assert rows[2]["nodes"] == [6] and rows[1]["chronology"][0]["next"] == 4 and rows[2]["chronology"] is None
    tags = {r["id"]: r["tags"] for r in codecs.decode_tags(out["relations"].select("id", "flat"), (out["pairs"], out["keys"], out["values"])).collect()}
    assert tags[3]["color:id"] == "20" and tags[2]["color"] != tags[3]["color"] == tags[1]["color"]
    ring = codecs.decode_rings([base64.b64decode(rows[1]["ways"][0][0])])[0]
    assert sorted(map(abs, ring)) == [10, 11]
    way = {r["id"]: r["deltas"] for r in out["ways"].collect()}
    assert way[10] == [11111, 0, 0, 11111]
    opened = Q.web_extract(world["relations"], world["pts"], "3")["relations"].first()
    assert [len(p) for p in opened["ways"]] == [1] and codecs.decode_rings([base64.b64decode(opened["ways"][0][0])])[0].tolist() in ([11], [-11])
    rel = spark.createDataFrame([(1, "1900", "1950", 2), (2, "1950", "1960", None), (3, None, None, None)], "id long, start_date string, end_date string, next long")
    at = lambda t: {r["id"] for r in Q.view_at(rel, t).collect()}
    assert at(1950.3) == {1, 3} and at(1950.7) == {2, 3} and at(1960.9) == {2, 3} and at(1961.1) == {3}


def test_gap_and_regions(spark, world):
    rows = Q.coverage_rows(areas(world), "2026-01-01").select("id", "name", F.lit("").alias("whmid"), "lo", "hi", "km2", "box", "geom", "level")
    rows = tables.materialise(rows.where("level = '2'"))
    gap = {r["id"]: r for r in Q.coverage_gap(rows.where("id = 2 or id = 4"), rows.where("id = 1")).collect()}
    assert math.isclose(gap[4]["uncovered"], 10 * square_km2(0, 0) / geometry.LAND_KM2, rel_tol=1e-6) and gap[4]["pct"] == 50.0
    assert math.isclose(gap[2]["uncovered"], gap[2]["earth_years"], rel_tol=1e-6)
    assert Q.gap_by_chronology(Q.coverage_gap(rows.where("id = 2"), rows.where("id = 1"))).first()["name"] == "East"
    regions = Q.measured(rows.where("id = 1").select(F.lit("R").alias("name"), "geom"))
    eras = spark.createDataFrame([(1900, 1945), (1945, 2000)], "start int, end int")
    got = {r["era"]: r["earth_years"] for r in Q.region_era(rows.where("id = 4"), regions, eras).collect()}
    assert math.isclose(got[1900], 5 * square_km2(0, 0) / geometry.LAND_KM2, rel_tol=1e-6) and math.isclose(got[1945], 3 * got[1900], rel_tol=1e-6)


def test_names_and_remap(spark):
    data = [("n", 1, {"name": "Alba", "name:en": "Alba"}), ("w", 2, {"name": "X", "name:en": "Albany"}), ("r", 3, {"name:en": "Alb"})]
    df = spark.createDataFrame(data, "ftype string, id long, tags map<string,string>")
    assert [tuple(r) for r in Q.find_by_name(df, "Alb|zz").orderBy("id").collect()] == [("n", 1, "Alba", None), ("w", 2, "X", "Albany")]
    got = Q.remap(spark.createDataFrame([(1, {"name": "A", "name_es": "B"}), (2, {"x": "y"})], "id long, tags map<string,string>"), {"k": "v"}).collect()
    assert len(got) == 1 and got[0]["tags"] == {"name": "A", "name:es": "B", "k": "v"}


def test_metrics(spark):
    day = lambda rows: spark.createDataFrame(rows, "type string, count double")
    wide = Q.collate(Q.collate(None, day([("b", 2.0), ("a", 4.0)]), "d1"), day([("a", 5.0), ("c", 1.0)]), "d2")
    assert wide.columns == ["date", "a", "b", "c"] and [tuple(r) for r in wide.collect()] == [("d1", 4.0, 2.0, None), ("d2", 5.0, None, 1.0)]
    long = spark.createDataFrame([("d1", "a", 4), ("d2", "a", 5), ("d1", "b", 9), ("d2", "b", 9)], "date string, type string, count long")
    assert [r[0] for r in sinks.difference(long, "date", "type", "count").collect()] == ["a: 4 -> 5 (+1, +25.0%)"]
    assert {(r["type"], r["date"]): (r["share"], r["order"]) for r in Q.series(long).collect()}["a", "d2"] == (1.25, 2)


def test_graph_algorithms():
    wheel = {0: {1, 2, 3, 4, 5}, **{i: {0, i % 5 + 1, (i - 2) % 5 + 1} for i in range(1, 6)}}
    for colours in (graph.welsh_powell(wheel), graph.dsatur(wheel)):
        assert len(set(colours.values())) == 4 and all(colours[a] != colours[b] for a in wheel for b in wheel[a])
    assert len(graph.largest_clique(wheel)) == 3 and graph.best_random(wheel) == 4
    assert graph.resolve_containment([(1, 2), (2, 3), (4, 1)]) == {1: 2, 2: 3} and graph.absorbed({1: 2, 2: 3}) == {3: [1, 2]}
    assert graph.analysis(wheel)["clique"] == 3


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a long, b long")
    got = {r[0]: r[1] for r in graph.components(edges).collect()}
    assert {got[i] for i in range(1, 41)} == {1} and got[101] == 100
    chron = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 6), (2, 1, 7), (2, 2, 8), (3, 0, 9)], "chrono_id long, pos int, member_id long")
    assert [tuple(r) for r in graph.merged_chronologies(chron).orderBy("chrono_id", "pos").collect()] == [(2, 0, 6), (2, 1, 7), (2, 2, 8), (2, 3, 5), (3, 0, 9)]


def test_containment_without_a_list(spark):
    rng = np.random.default_rng(5)
    for n in (8, 12):
        pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, n, (n, 2)) if a != b})
        got = graph.contained_into(spark.createDataFrame(pairs, "small long, large long")).collect()
        assert {r["id"]: r["into"] for r in got} == graph.resolve_containment(pairs)
        rng.shuffle(pairs)
        got = graph.contained_into(spark.createDataFrame([(int(a), int(b), i) for i, (a, b) in enumerate(pairs)], "small long, large long, rank int"))
        into = graph.resolve_containment([(int(a), int(b)) for a, b in pairs])
        assert {r["id"]: r["into"] for r in got.collect()} == into
        assert {r["id"]: r["into"] for r in graph.final_home(got).collect()} == {v: k for k, vs in graph.absorbed(into).items() for v in vs}
    assert graph.contained_into(spark.createDataFrame([], "small long, large long")).count() == 0


def test_a_whole_takes_its_parts_at_once(spark, monkeypatch):
    stored = []
    keep = graph.materialise
    monkeypatch.setattr(graph, "materialise", lambda df: (stored.append(1), keep(df))[1])
    pairs = spark.range(1000).select(F.col("id").alias("small"), F.lit(5000).cast("long").alias("large")).union(spark.createDataFrame([(5000, 6000)], "small long, large long"))
    ranked = pairs.withColumn("rank", F.col("small"))
    assert {r["into"] for r in graph.contained_into(ranked).collect()} == {5000, 6000} and len(stored) <= 5


def test_first_fit_is_one_pass_in_order(spark):
    rng = np.random.default_rng(1)
    for n, m in ((12, 20), (40, 200)):
        edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, n, (m, 2)) if a != b})
        nodes, links = spark.range(n + 2).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "a long, b long")
        got = {r["node"]: r["colour"] for r in graph.first_fit(links, graph.by_degree(nodes, links)).collect()}
        assert got == graph.welsh_powell(graph.collect_graph(nodes, links))
    none = spark.createDataFrame([], "a long, b long")
    assert [r["colour"] for r in graph.first_fit(none, graph.by_degree(spark.range(2).withColumnRenamed("id", "node"), none)).collect()] == [0, 0]


def test_geometries_as_arrays():
    import pyarrow as pa

    geoms = [[[np.array([(0, 0), (1, 0), (1, 1)], float), np.array([(0.2, 0.1), (0.3, 0.1), (0.3, 0.2)])]], [], [[np.array([(5, 5), (6, 5), (6, 6)], float)], [np.array([(8, 8), (9, 8), (9, 9)], float)]]]
    made = Q.geom_array(geoms)
    for start in range(3):
        back = Q.geoms_of(made.slice(start))
        assert [[[r.tolist() for r in p] for p in g] for g in back] == [[[r.tolist() for r in p] for p in g] for g in geoms[start:]]
    assert Q.geoms_of(pa.array([None, []], Q.ARROW_GEOM)) == [[], []] and Q.geom_array([]).type == Q.ARROW_GEOM


def test_skips_are_counted_in_the_job(spark):
    from pyspark.sql import Observation

    dated = lambda **k: {"boundary": "administrative", "admin_level": "2", **k}
    square = [[[{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]]]
    rows = spark.createDataFrame([("r", i, t, square) for i, t in enumerate([dated(start_date="1900"), dated(), dated(start_date="?", end_date="x"), dated(end_date="1950"), {"admin_level": "9"}])], f"ftype string, id long, tags map<string,string>, geom {Q.GEOM}")
    skipped = Observation("skipped")
    assert Q.coverage_rows(rows, "2026-01-01", skipped).count() == 1
    assert {r["type"]: r["count"] for r in Q.skip_counts(spark, skipped).collect()} == {"skipped-no-date": 2.0, "skipped-no-start": 1.0}


def test_numbers_and_pairs(spark):
    rows = spark.range(5000).select(F.xxhash64("id").alias("v"))
    got = [r["n"] for r in numbering.numbered(rows, [F.desc("v")], "n").orderBy(F.desc("v")).collect()]
    assert got == list(range(1, 5001))
    members = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (3, 1)) for i in range(n)] + [(1, 5)], "key int, node long")
    pairs = [tuple(r) for r in numbering.key_pairs(members, "key", "node", 7).collect()]
    assert sorted(pairs) == sorted((k, a, b) for k, n in ((1, 40), (2, 3)) for b in range(n) for a in range(b))
    degree = spark.createDataFrame([(i, d) for i, d in enumerate([0, 0, 1, 3, 3, 9])], "node long, degree long")
    assert tuple(graph.degree_stats(degree).first()) == (0, 3, 9, 2)
    with pytest.raises(ValueError, match="nodes"):
        graph.collect_graph(spark.range(5).withColumnRenamed("id", "node"), spark.createDataFrame([], "a long, b long"), 2)


def test_long_lists_of_ranges(spark, monkeypatch):
    rng = np.random.default_rng(8)
    draw = lambda n: [(i, float(a), float(a + d)) for i, (a, d) in enumerate(zip(rng.integers(0, 500, n), rng.integers(-1, 60, n), strict=True))]
    a, b = draw(120), draw(80)
    monkeypatch.setattr(temporal, "FEW", 10)
    got = temporal.range_join(spark.createDataFrame(a, "i int, s double, e double"), spark.createDataFrame(b, "j int, lo double, hi double"), "s", "e", "lo", "hi").collect()
    assert sorted((r["i"], r["j"], r["shared"]) for r in got) == sorted((i, j, min(e, hi) - max(s, lo)) for i, s, e in a for j, lo, hi in b if s < hi and lo < e and s < e and lo < hi)
