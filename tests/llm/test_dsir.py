"""Importance resampling against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from eonmap.llm import dsir

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, target, buckets=10_000, low=1, high=1, percent=10, least=20):
    def features(text):
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        return len(words), [" ".join(words[i:i + n]) for n in range(low, high + 1) for i in range(len(words) - n + 1)]

    def bucket(f):
        return zlib.crc32(f.encode()) % buckets

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, features(text)[1]))
    for text in target:
        t.update(map(bucket, features(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in docs:
        n, found = features(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    eligible = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): i for i, r in enumerate(eligible[:percent * len(eligible) // 100], 1)}
    return sorted(((*r, rank.get(id(r))) for r in out), key=str)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["Straße", "été", "A1-B2", "X_Y"]
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(1, 80)))) for i in range(120)]
    return docs, [" ".join(rng.choice(vocabulary[:60], 30)) for _ in range(15)]


@pytest.mark.parametrize(("low", "high", "buckets"), [(1, 1, 10_000), (1, 2, 500), (2, 3, 65_536)])
def test_equals_brute_force(spark, texts, low, high, buckets):
    docs, target = texts
    docs = [*docs, (500, None), (501, ""), (502, "!!! ..."), (None, "w1 " * 30), (7, docs[7][1]), (503, "w2, W2; " * 40_000)]
    got = dsir.resample(spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, rank double"), spark.createDataFrame([(0, t) for t in target], "item_id long, text string"), low=low, high=high, n_buckets=buckets)
    assert rows(got) == brute(docs, target, buckets, low, high)


def test_empty_tables(spark, texts):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string")
    none = docs.limit(0)
    assert rows(dsir.resample(none, none)) == []
    assert rows(dsir.resample(docs, none)) == brute(texts[0], [])


def test_blocks_do_not_change_the_result(spark, texts, monkeypatch):
    docs = spark.createDataFrame(texts[0], "doc_id long, text string").coalesce(1)
    target = spark.createDataFrame([(t,) for t in texts[1]], "text string")
    once = rows(dsir.resample(docs, target))
    blocks = dsir.streams(docs.select("doc_id", "text"), 10_000, 1, 1, ["doc_id"])
    assert blocks.count() == 1
    counted = {r["bucket"]: r["n"] for r in dsir.bucket_counts(blocks).collect()}
    assert sum(counted.values()) == sum(r[2] for r in once)
    with pytest.raises(ValueError):
        dsir.resample(docs, target, n_buckets=70_000)


def test_memory_of_features_is_bounded(monkeypatch):
    monkeypatch.setattr(dsir, "REMEMBERED", 10)
    known = dsir.Buckets(100)
    assert [known[str(i).encode()] for i in range(50)] == [zlib.crc32(str(i).encode()) % 100 for i in range(50)]
    assert len(known) <= 10
