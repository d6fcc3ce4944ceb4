"""The stages over a small corpus with planted cases."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he"]) for _ in range(rng.randint(1, 4)))
    line = lambda n=12: " ".join(word() for _ in range(n))
    item, passage = line(30), "\n".join(line() for _ in range(6))
    rows = [(i, "\n".join(line() for _ in range(6)), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].replace(rows[1][1].split()[3], "xx", 1), "en", "s1", 1)]
    rows += [(200, f"{line()}\n{item}\n{line()}", "en", "s2", 1), (300, "12 34 !!", "en", "s0", 1), (301, None, None, None, None)]
    rows += [(400 + i, f"{line()}\n{passage}\n{line()}", "en", "s0", 1) for i in range(4)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "mix":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language_id"]) == {r[0] for r in rows} - {300, 301}
    assert sum(passage in r["text"] for r in seen["line_dedup"].values()) == 1
    # a copy goes as a whole, an edited one keeps the line of its own
    assert 100 not in seen["line_dedup"] and seen["line_dedup"][0]["text"] == rows[0][1]
    edited = next(s for s in rows[61][1].split("\n") if s not in rows[1][1])
    assert edited in seen["line_dedup"][101]["text"] and len(seen["line_dedup"][101]["text"]) < len(rows[61][1])
    assert set(range(60)) <= set(seen["line_dedup"]) | {0} and 200 in seen["near_dedup"] and 200 not in seen["decontaminate"]
    assert set(range(60)) <= set(seen["decontaminate"])
    assert set(seen["mix"]) <= set(seen["decontaminate"]) and all(r["copies"] in (1, 2) for r in seen["mix"].values())


def test_stages_on_an_empty_table(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "some words of an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
