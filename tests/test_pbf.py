from eonmap.sources import pbf, tables


def test_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 1.5, -2.25, {"name": "É", "start_date": "1900"}), (7, -179.9999999, 89.5, {}), (10**11, 0.0, 0.0, {"a": "b"})], tables.NODES)
    ways = spark.createDataFrame([(5, [1, 7, 10**11, 1], {"k": "v"}), (6, [], {})], tables.WAYS)
    relations = spark.createDataFrame([(9, {"type": "boundary"}, [("w", 5, "outer"), ("n", 7, "label"), ("r", 2, "")]), (10, {}, [])], tables.RELATIONS)
    path = f"{tmp_path}/x.osm.pbf"
    pbf.write_pbf(path, nodes, ways, relations, 1775088000)
    for kind, df in (("nodes", nodes), ("ways", ways), ("relations", relations)):
        assert sorted(pbf.read_pbf(spark, path, kind).collect(), key=lambda r: r[0]) == sorted(df.collect(), key=lambda r: r[0]), kind
    assert pbf.header_timestamp(path) == "2026-04-02T00:00:00Z"


def test_many_blobs(spark, tmp_path):
    path = f"{tmp_path}/y.osm.pbf"
    nodes = spark.range(40_000).selectExpr("id", "id / 1e3 as lon", "-id / 1e3 as lat", "cast(map() as map<string,string>) as tags")
    none = spark.createDataFrame([], tables.WAYS), spark.createDataFrame([], tables.RELATIONS)
    pbf.write_pbf(path, nodes, *none)
    got = pbf.read_pbf(spark, path, "nodes")
    assert got.count() == 40_000 and got.agg({"id": "sum"}).first()[0] == sum(range(40_000)) and pbf.read_pbf(spark, path, "ways").count() == 0
