import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from eonmap.llm import mixing, queries

COLS = "doc_id long, text string, source string, size string, target int"


def make(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], COLS)


def brute_targets(sizes):
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        out = {s: 2 * sizes[s] if s in full else left * weight[s] / w for s in names}
        over = {s for s in names if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_against_resharing(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 40])), rng.choice(["a", "b", "c", "d", "é", None] + ["hot"] * 5)) for i in range(3000)]
    got = mixing.mix(make(spark, rows)).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want, taken = brute_targets(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(got) == 3000 and all(abs(taken[s] - want[s]) <= 40 for s in want)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(make(spark, rows).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_word_counts(spark):
    texts = ["", " ", "a", " a ", "a b", "\ta\n\nb\r", "a\u00a0b", None, "a" * 100_000, "x " * 50_000]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(mixing.size_of(F.col("t"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 1, 2, 2, 1, 0, 1, 50_000]


def test_edges(spark):
    rows = [(None, "a b", None), (1, None, None), (2, "a", "s"), (2, "a", "s"), (3, "", "empty")]
    got = mixing.mix(make(spark, rows)).collect()
    assert len(got) == 5 and sum(r["size"] for r in got) == 4
    same = [r["taken"] for r in got if r["doc_id"] == 2]
    assert same[0] == same[1] and {r["target"] for r in got if r["source"] == "empty"} == {0.0}
    assert mixing.mix(make(spark, [])).count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = {r[0]: r[1:] for r in con.execute(queries.OP10_SQL).fetchall()}
    got = {r[0]: tuple(r[1:]) for r in queries.op10_mix_sources(spark, "/root/testdata/sf0.001").collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][3] == want[k][3] and abs(got[k][2] - want[k][2]) < 1e-6 for k in got)
