import numpy as np
from pyspark.sql import functions as F

from eonmap.llm import langid

CORPUS = {"aa": "banana lalala mamama nana bala", "bb": "xixoxu zorzok kwix zzik rokko", "cc": "theend ending thing singer ring"}


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def model(spark):
    rows = [(i * 10 + j, " ".join(np.random.default_rng(i * 10 + j).permutation(CORPUS[k].split() * 4)), k) for i, k in enumerate(CORPUS) for j in range(8)]
    return langid.fit(frame(spark, [*rows, (99, None, "aa"), (98, "x", None)]))


def brute(texts, logp, rounds):
    """The same mixture one document and word at a time."""
    out = []
    for t in texts:
        w = langid.words_of([t])
        ends = [*w.starts[1:], len(w.grams)]
        rows = [[sum(float(logp[g, k]) for g in w.grams[a:b]) for k in range(logp.shape[1])] for a, b in zip(w.starts, ends, strict=True)]
        pi = [1 / logp.shape[1]] * logp.shape[1]
        for _ in range(rounds):
            new = [0.0] * len(pi)
            for r in rows:
                p = [np.exp(max(x - max(r), -60)) * q for x, q in zip(r, pi, strict=True)]
                new = [a + b / sum(p) for a, b in zip(new, p, strict=True)]
            pi = [max(x / len(rows), 1e-12) for x in new]
        out.append(pi)
    return np.array(out)


def test_mixture_against_brute_force(spark):
    m = model(spark)
    texts = ["banana nana xixoxu", "theend ring singer banana", "zorzok"]
    _, full, n = langid.infer(texts, m.logp)
    assert n.tolist() == [3, 4, 1]
    assert np.allclose(full, brute(texts, m.logp, langid.ROUNDS), atol=1e-4)


def test_mixture_finds_both_languages(spark):
    m = model(spark)
    chosen, _, _ = langid.infer([(CORPUS["aa"] + " ") * 10 + (CORPUS["bb"] + " ") * 5, CORPUS["cc"] * 6], m.logp)
    assert chosen[0, 0] > 0.5 > chosen[0, 1] > 0.2 and chosen[0, 2] == 0
    assert chosen[1].argmax() == 2 and (chosen[1] > 0).sum() == 1


def test_edge_cases(spark):
    docs = frame(spark, [(1, None, None), (2, "", "aa"), (3, "123 !?", "aa"), (None, CORPUS["bb"], None), (4, CORPUS["aa"] * 2000, None), (4, CORPUS["aa"] * 2000, None)])
    docs = docs.withColumn("score", F.lit("other")).withColumn("n_words", F.lit(7))
    got = langid.predict(docs, model(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 6 and [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and by[None]["lang_pred"] == "bb" and by[4]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got) and by[4]["n_words"] == 7
    assert langid.predict(docs.limit(0), model(spark)).count() == 0
    nothing = langid.fit(docs.limit(0).drop("score"))
    assert {r["lang_pred"] for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = langid.fit(docs.where(~langid.held_out()))
    out = langid.predict(docs.where(langid.held_out()), m)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.97
