import numpy as np
from pyspark.sql import functions as F

from eonmap.functions import edtf, geometry
from eonmap.operators import topology
from eonmap.plans import atlas
from eonmap.sources import atlas as drawings
from eonmap.streaming import metrics


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


RINGS = "feature string, ring int, points array<struct<x:double,y:double>>"


def test_neighbours_share_a_way(spark):
    a, b = ring((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), ring((1, 0), (2, 0), (2, 1), (1, 1), (1, 0))
    lone, thin, repeat = ring((9, 9), (8, 9), (8, 8)), ring((0, 0), (0, 0), (1, 1)), ring((0, 0), (1, 0), (0, 0), (1, 1))
    df = spark.createDataFrame([("a", 0, a), ("b", 0, b), ("c", 0, lone), ("d", 0, thin), ("e", 0, repeat)], RINGS)
    out = topology.topology(df)
    nodes = {r["node"]: (round(r["lon"], 6), round(r["lat"], 6)) for r in out["nodes"].collect()}
    assert [nodes[i] for i in (1, 2, 3, 4)] == [(0, 0), (1, 0), (1, 1), (0, 1)] and len(nodes) == 9
    ways = {r["way"]: list(r["nodes"]) for r in out["ways"].collect()}
    refs = {}
    for r in out["refs"].orderBy("feature", "piece").collect():
        refs.setdefault(r["feature"], []).append((r["way"], r["forward"]))
    shared = {w for w, _ in refs["a"]} & {w for w, _ in refs["b"]}
    assert len(shared) == 1 and ways[shared.pop()] == [2, 3] and set(refs) == {"a", "b", "c"}
    assert ways[refs["c"][0][0]][0] == ways[refs["c"][0][0]][-1]
    assert {f for w, f in refs["a"] + refs["b"] if ways[w] == [2, 3]} == {True, False}


def test_spurs(spark):
    ways = spark.createDataFrame([(1, [1, 2, 3, 1]), (2, [4, 5]), (3, [5, 6]), (4, [6, 7]), (5, [7, 6])], "way long, nodes array<long>")
    assert sorted(r[0] for r in topology.prune_spurs(ways).collect()) == [1, 4, 5]


SVG = '<svg xmlns="http://www.w3.org/2000/svg"><g id="ctry"><path id="7-egypt" d="M{x},16000 l100,0 0,100z" fill="{fill}"/><path id="no" d="M0,0" fill="none"/><ellipse id="8-isle" cx="5" cy="5" rx="2" ry="1" fill="red"/></g><text id="7-egypt"><title>Egypt, 10 - 20, Abe, King 12 - 14.</title></text></svg>'


def test_history(spark, tmp_path):
    for year, fill, x in (("A0010", "red", 27000), ("A0020", "red", 27000), ("A0030", "blue", 27000)):
        (tmp_path / f"W{year}.svg").write_text(SVG.format(fill=fill, x=x))
    (tmp_path / "WA0040.svg").write_text(SVG.format(fill="blue", x=27000).replace("7-egypt", "9-other"))
    (tmp_path / "WB0005.svg").write_text(SVG.format(fill="blue", x=27000))
    rows = drawings.read_drawings(spark, f"file://{tmp_path}/*.svg")
    seg = atlas.history(rows)
    got = [(r["first"], r["last"], r["fill"]) for r in seg.where("id = '7-egypt'").orderBy("first").collect()]
    assert got == [(-4, -4, "blue"), (10, 20, "red"), (30, 30, "blue")]
    thin = atlas.changes(seg)
    assert thin.where("id = '7-egypt' and title is not null").count() == 1
    key = lambda df: sorted(map(str, df.select("id", "run", "fill", "d", "title").collect()))
    assert key(atlas.full_states(thin)) == key(seg)
    assert {r["id"] for r in atlas.state_in(seg, 15).collect()} == {"7-egypt", "8-isle"}
    made = atlas.features(seg.where("id like '%egypt'"))
    tags = made.orderBy("first").first()["tags"]
    assert tags["name"] == "Egypt" and tags["leader"] == "Abe, King 12 - 14" and tags["whmid"] == "7" and tags["start_date"] == "-0004" and tags["end_date"] == "-0003"
    chron = atlas.chronologies(made).collect()
    assert chron[0]["name"] == "Egypt" and len(chron[0]["members"]) == 3 and chron[0]["whmid"] == "7"
    assert atlas.import_topology(made)["ways"].count() == 1


def test_mesh(spark):
    control = spark.createDataFrame([(10.0, 10.0, 1.0, 0.5), (11.5, 10.0, 3.0, 0.5)], "lon double, lat double, dlon double, dlat double")
    rows = {(r["lon"], r["lat"]): (r["dlon"], r["dlat"]) for r in atlas.correction_mesh(control).collect()}
    assert rows[10.0, 10.0] == (1.0, 0.5)
    w1, w2 = 1 / 1.0, 1 / 0.25
    assert abs(rows[11.0, 10.0][0] - (w1 * 1 + w2 * 3) / (w1 + w2)) < 1e-9 and (20.0, 10.0) not in rows
    mesh = atlas.to_mesh(atlas.correction_mesh(control))
    d = mesh.at(np.array([10.0, 100.0]), np.array([10.0, 0.0]))
    assert d[0].tolist() == [1.0, 0.0]
    square = lambda x, y: [[ring((x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1))]]
    ours = spark.createDataFrame([("Britain", square(0, 0)), ("B", square(1.1, 0))], f"name string, geom {atlas.GEOM}")
    theirs = spark.createDataFrame([("United Kingdom", square(0.05, 0.0))], f"name string, geom {atlas.GEOM}")
    pts = atlas.control_points(ours, theirs).collect()
    assert {(r["lon"], r["lat"]) for r in pts} == {(1.0, 0.0), (1.0, 1.0)} and all(abs(r["dlon"] - 0.05) < 1e-9 for r in pts)
    assert atlas.offset_stats(atlas.control_points(ours, theirs)).first()["n"] == 2


def area2(geom):
    """Twice the area of a geometry column's value, holes taken off."""
    size = lambda r: geometry.signed_area2(np.array([(p["x"], p["y"]) for p in r]))
    return sum(abs(size(g[0])) - sum(abs(size(h)) for h in g[1:]) for g in geom)


def test_clip(spark):
    df = spark.createDataFrame([(1, [[ring((0, 0), (4, 0), (4, 4), (0, 4))]])], f"id long, geom {atlas.GEOM}")
    land = spark.createDataFrame([([[ring((1, 1), (2, 1), (2, 9), (1, 9))]],)], f"geom {atlas.GEOM}")
    assert area2(atlas.clip_to(df, land).first()["geom"]) == 6


def test_clip_to_many_windows(spark):
    df = spark.createDataFrame([(1, [[ring((0, 0), (4, 0), (4, 4), (0, 4))]]), (2, [[ring((50, 0), (54, 0), (54, 4), (50, 4))]]), (3, [])], f"id long, geom {atlas.GEOM}")
    n = 2_500
    corner = lambda x, y: f"struct({x} as x, {y} as y)"
    x0, x1 = f"id * 4.0D / {n}", f"(id + 1) * 4.0D / {n}"
    land = spark.range(n).selectExpr(f"array(array(array({corner(x0, '-1.0D')}, {corner(x1, '-1.0D')}, {corner(x1, '9.0D')}, {corner(x0, '9.0D')}))) as geom")
    got = {r["id"]: r["geom"] for r in atlas.clip_to(df, land).collect()}
    assert len(got[1]) == 1 and got[2] == got[3] == [] and abs(area2(got[1]) - 32) < 1e-6


def test_clip_to_a_concave_coast(spark):
    """A coast with a bay, an island in the bay and a lake, against points."""
    coast = [ring((0, 0), (10, 0), (10, 10), (7, 10), (5, 3), (3, 10), (0, 10)), ring((1, 1), (1, 2), (4, 2), (4, 1))]
    island = [ring((4.6, 8), (5.4, 8), (5, 9))]
    rng = np.random.default_rng(4)
    rows, shapes = [], {}
    for i in range(20):
        t = np.sort(rng.random(12)) * 2 * np.pi
        c, r = rng.random(2) * 10, 1 + 3 * rng.random(12)
        shapes[i] = np.stack([c[0] + r * np.cos(t), c[1] + r * np.sin(t)], 1)
        rows.append((i, [[ring(*map(tuple, shapes[i].tolist()))]]))
    out = {r["id"]: r["geom"] for r in atlas.clip_to(spark.createDataFrame(rows, f"id long, geom {atlas.GEOM}"), spark.createDataFrame([([coast],), ([island],)], f"geom {atlas.GEOM}")).collect()}
    points = rng.random((1500, 2)) * 12 - 1
    as_ring = lambda r: np.array([(p["x"], p["y"]) for p in r])
    inside = lambda p, polygons: any(sum(geometry.point_in_ring(p, as_ring(r)) for r in g) % 2 for g in polygons)
    plain = lambda g: [[{"x": x, "y": y} for x, y in (tuple(q) if not isinstance(q, dict) else q.values() for q in r)] for r in g]
    land = [plain(coast), plain(island)]
    for i, geom in out.items():
        for p in points[:300]:
            assert inside(p, geom) == (geometry.point_in_ring(p, shapes[i]) and inside(p, land))


def test_edtf():
    I = edtf.interval  # noqa: E741
    assert I("1948-05") == ((1948, 5, 1), (1948, 5, 31)) and I("1948~") == ((1947, 1, 1), (1949, 12, 31)) and I("1944/1950") == ((1944, 1, 1), (1950, 12, 31))
    assert I("1752/") == I("1752/..") == ((1752, 1, 1), edtf.OPEN_HI) and I("/1818") == (edtf.OPEN_LO, (1818, 12, 31)) and I("[..1800]") == (edtf.OPEN_LO, (1800, 12, 31))
    assert I("[1906..1908]") == ((1906, 1, 1), (1908, 12, 31)) and I("189X") == ((1890, 1, 1), (1899, 12, 31)) and I("14XX") == ((1400, 1, 1), (1499, 12, 31))
    assert I("1814-23") == ((1814, 9, 1), (1814, 11, 30)) and I("1887-39") == ((1887, 9, 1), (1887, 12, 31)) and I("1940-24") == ((1940, 12, 1), (1940, 12, 31))
    for bad in ("not a date", "c. 1900", "600 BC", "1900-1910", "1X00-1X-1X", "1960-05-01T13:00", "", None, "/", "1948-02-30", "1948-13"):
        assert I(bad) is None, bad


def test_config_and_stream(spark, tmp_path):
    got = drawings.read_config('{ // note\n "a": 0, "b": "x//y", /* z */ "c": [1,2,], }', {"a": 5, "d": 6})
    assert got == {"a": 5, "b": "x//y", "c": [1, 2], "d": 6}
    for day, n in (("2026-01-01", 3), ("2026-01-02", 4)):
        (tmp_path / "daily" / day).mkdir(parents=True)
        (tmp_path / "daily" / day / "x.summary.csv").write_text(f"type,count\nways,{n}\n")
    follow = lambda: metrics.follow(metrics.read_daily(spark, f"{tmp_path}/daily"), f"{tmp_path}/history", f"{tmp_path}/checkpoint").awaitTermination(120)
    for _ in range(2):
        follow()
    # a second file of a day that is stored already, in a later batch
    (tmp_path / "daily" / "2026-01-02" / "y.summary.csv").write_text("type,count\nnodes,9\n")
    follow()
    rows = spark.read.parquet(f"{tmp_path}/history").orderBy("date", "type").select(F.col("date").cast("string"), "type", "count").collect()
    assert [tuple(r) for r in rows] == [("2026-01-01", "ways", 3.0), ("2026-01-02", "nodes", 9.0), ("2026-01-02", "ways", 4.0)]
