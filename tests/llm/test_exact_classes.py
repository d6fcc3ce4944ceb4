"""Links behind large buckets by first words, components by contraction, and op6's alignment."""

import random

import numpy as np

from eonmap.llm import decontam, omh


def classes_of(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {n: find(n) for n in nodes}


def test_all_links_in_large_buckets_are_found_without_rare_features(spark, monkeypatch):
    """All texts share 120 words; no feature joins any, and of the large buckets none takes part in rounds."""
    monkeypatch.setattr(omh, "FEW", 1)
    monkeypatch.setattr(omh, "THIN", 10**9)
    rng = random.Random(40)
    passage, texts = [f"p{rng.randrange(10**6)}" for _ in range(120)], []
    for _ in range(20):
        base = [f"v{rng.randrange(500)}" for _ in range(50)]
        texts += [base, [f"v{rng.randrange(500)}" if i % 2 else w for i, w in enumerate(base)]]
    whole = [" ".join(t[:20] + passage + t[20:]) for t in texts]
    links = [(i, j) for j in range(len(whole)) for i in range(j) if omh.alike(whole[i], whole[j])]
    got = omh.near_classes(spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")).collect()
    assert len(links) >= 20 and {r["doc_id"]: r["class_id"] for r in got} == classes_of(links, range(len(whole)))


def test_texts_alike_share_a_first_word():
    rng = random.Random(41)
    hasher = omh.Hasher()
    for _ in range(150):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(rng.randint(1, 300))]
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 5)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y", "z"]])
        if b and omh.alike(" ".join(a), " ".join(b)):
            known = np.sort(hasher(list({*a, *b})).view(np.int64))
            of, words = omh.first_words([hasher(a), hasher(b)], omh.SIMILARITY, (known, np.arange(len(known))))
            most = int(0.2 * max(len(a), len(b)) + 1e-9)
            assert set(words[of == 0][:most + 1].tolist()) & set(words[of == 1][:most + 1].tolist())


def test_components_and_further_links(spark, monkeypatch):
    """A chain, a star and a few loose edges; the rounds together join fewer rows than a chain's length times its edges."""
    rng = random.Random(42)
    edges = [*((i, i + 1) for i in range(200)), *((1000, 1001 + i) for i in range(100)), *((2000 + 2 * i, 2001 + 2 * i) for i in range(20))]
    joined = []
    keep = omh._meet
    monkeypatch.setattr(omh, "_meet", lambda rows, facts, key: (joined.append(rows.count()), keep(rows, facts, key))[1])
    rng.shuffle(edges)
    frame = lambda e: spark.createDataFrame(e, "a long, b long")
    read = lambda df: {r["node"]: r["label"] for r in df.collect()}
    nodes = {n for e in edges for n in e}
    found = omh.components(frame(edges))
    assert read(found) == classes_of(edges, nodes) and sum(joined) < 12 * len(edges)
    more = [(5, 1005), (2001, 2002), (9000, 9001), (7, 9)]
    assert read(omh.with_links(found, frame(more))) == classes_of(edges + more, nodes | {9000, 9001})
    assert omh.components(frame(edges).limit(0)).count() == 0


def test_rounds_of_few_edges_run_in_few_tasks(spark):
    """With 50 partitions for a shuffle, the rounds over 300 edges took 50 tasks a step before."""
    names = {"spark.sql.shuffle.partitions": "50", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    kept = {n: spark.conf.get(n) for n in names}
    sc, edges = spark.sparkContext, [(i, i + 1) for i in range(300)]
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        sc.setJobGroup("few tasks", "")
        found = {r["node"]: r["label"] for r in omh.components(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()}
        status = sc.statusTracker()
        tasks = sorted((i.numTasks for j in status.getJobIdsForGroup("few tasks") for k in status.getJobInfo(j).stageIds if (i := status.getStageInfo(k)) and i.numCompletedTasks), reverse=True)
    finally:
        sc._jsc.clearJobGroup()
        for n, v in kept.items():
            spark.conf.set(n, v)
    assert found == dict.fromkeys(range(301), 0)
    assert sum(n == 50 for n in tasks) <= 2, tasks


def test_alignment_against_plain_smith_waterman():
    rng = random.Random(43)
    for _ in range(60):
        item = [rng.randint(1, 6) for _ in range(rng.randint(3, 14))]
        texts = [[rng.randint(0, 6) for _ in range(rng.randint(1, 25))] for _ in range(5)]
        plain = []
        for text in texts:
            row, top = [0] * (len(item) + 1), (0, 0)
            for j, w in enumerate(text, 1):
                new = [0]
                for i, x in enumerate(item, 1):
                    new.append(max(0, row[i - 1] + (decontam.MATCH if x == w else decontam.MISMATCH), row[i] + decontam.GAP, new[-1] + decontam.GAP))
                row = new
                top = max(top, (max(row), -j))
            plain.append((top[0], -top[1]))
        score, end = decontam.align(np.array(item), [np.array(t) for t in texts])
        assert list(zip(score.tolist(), end.tolist(), strict=True)) == plain


def test_a_pair_that_shares_many_first_words_comes_about_once(spark):
    """Two texts whose rarest words differ share 200 of their first words: the join makes few rows, and each pair is there."""
    rng, rows = random.Random(45), []
    common = [rng.randrange(-2**63, 2**63) for _ in range(200)]
    for node, label in (("a", 1), ("b", 2), ("c", 3)):
        firsts = [rng.randrange(-2**63, 2**63) for _ in range(40)] + common
        least = sorted(firsts)[:omh.LEAST_WORDS]
        rows += [(bytearray(node, "utf8"), label, 1000, [0] * omh.WORD_BINS, w, [x for x in least if x < w]) for w in firsts]
    frame = spark.createDataFrame(rows, "node binary, label long, n long, bins array<tinyint>, word long, least array<long>")
    got = omh.unlike_first(frame, omh.SIMILARITY).collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in got) == [(b"a", b"b"), (b"a", b"c"), (b"b", b"c")]
    side = lambda p: frame.select("word", *[frame[c].alias(f"{c}_{p}") for c in ("node", "least")])
    rows = side("a").join(side("b"), "word").where("node_a < node_b and not arrays_overlap(least_a, least_b)").count()
    assert rows < 30


def test_word_bits_never_tell_texts_alike_apart(spark):
    rng = random.Random(44)
    hasher = omh.Hasher()
    rows = []
    for i in range(60):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 3) for _ in range(rng.randint(1, 300))]
        b = [w if rng.random() > 0.1 * (i % 4) else "new" for w in a][rng.randint(0, 1):] or ["x"]
        bits = [omh.word_bits([hasher(x)]).tolist() for x in (a, b)]
        rows.append((omh.alike(" ".join(a), " ".join(b)), len(a), len(b), *bits))
    got = spark.createDataFrame(rows, "alike boolean, n_a long, n_b long, bits_a array<long>, bits_b array<long>").withColumn("fit", omh.bits_fit(omh.SIMILARITY)).collect()
    assert all(r["fit"] for r in got if r["alike"]) and any(r["alike"] for r in got) and not all(r["fit"] for r in got)


def test_shuffle_files_go_when_a_query_ends(spark):
    """Of the setting within and behind; the classes do not change by it."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    seen = []
    before = spark.conf.get(name)
    keep = omh._near_classes
    try:
        omh._near_classes = lambda docs, *a: (seen.append(spark.conf.get(name)), keep(docs, *a))[1]
        out = omh.near_classes(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x y")], "doc_id long, text string"))
        assert sorted((r["doc_id"], r["class_id"]) for r in out.collect()) == [(1, 1), (2, 1), (3, 3)]
    finally:
        omh._near_classes = keep
    assert seen == ["true"] and spark.conf.get(name) == before


def test_only_passages_that_may_reach_the_threshold_are_aligned(monkeypatch):
    """A passage with a seed and nothing else of its item is left out; results are those of aligning every passage."""
    rng = random.Random(46)
    items = decontam.number([(i, " ".join(f"w{rng.randrange(900)}" for _ in range(30))) for i in range(20)])
    back = {n: w for w, n in items.vocabulary.items()}
    texts = []
    for i in range(60):
        item = [back[n] for n in items.words[i % 20].tolist()]
        copy = [w if rng.random() < 0.8 else "other" for w in item] if i % 3 == 0 else item[10:13]
        texts.append(" ".join(["before"] * 20 + copy + ["behind"] * 20))
    seeds = decontam.choose_seeds(items, np.ones(len(items.vocabulary) + 1, np.int64))
    aligned = []
    keep = decontam.align
    monkeypatch.setattr(decontam, "align", lambda item, passages: (aligned.extend(passages), keep(item, passages))[1])
    got = decontam.score_texts(texts, items, seeds, decontam.THRESHOLD)
    few = len(aligned)
    monkeypatch.setattr(decontam, "may_reach", lambda *a: True)
    assert got == decontam.score_texts(texts, items, seeds, decontam.THRESHOLD)
    assert len(got) >= 18 and few < (len(aligned) - few) / 2


def test_pairs_by_first_words_meet_in_blocks_once(spark, monkeypatch):
    """Families of texts just below the limit, and some alike, of 5 to 3,000 words, in many small blocks: all pairs alike are there, none twice, in few groups' rows."""
    monkeypatch.setattr(omh, "BLOCK_BYTES", 4_000)
    rng, texts = random.Random(47), []
    for size in (5, 12, 60, 61, 75, 90, 400, 700, 3000):
        base = [f"v{rng.randrange(5000)}" for _ in range(size)]
        for i in range(12):
            texts.append([f"n{rng.randrange(10**6)}" if rng.random() < (0.05 if i < 4 else 0.16) else w for w in base][rng.randint(0, size // 10):])
    words = [" ".join(t) for t in texts]
    labels = [i % 5 for i in range(len(words))]
    frame = spark.createDataFrame([(bytearray(str(i), "utf8"), k, len(t), w) for i, (k, t, w) in enumerate(zip(labels, texts, words, strict=True))], "node binary, label long, n long, text string")
    rows = omh.materialise(omh.with_firsts(frame, omh.SIMILARITY))
    assert len({len(r["bits"]) for r in rows.collect()}) > 2
    got = [tuple(sorted((int(bytes(r["a"])), int(bytes(r["b"]))))) for r in omh.unlike_in_blocks(rows, omh.SIMILARITY).collect()]
    want = {(i, j) for j in range(len(words)) for i in range(j) if labels[i] != labels[j] and omh.alike(words[i], words[j])}
    assert len(want) > 30 and want <= set(got) and len(got) == len(set(got)) and all(labels[i] != labels[j] for i, j in got)
    assert len(got) < 1.5 * len(want)  # what is left to align
    assert omh.unlike_in_blocks(rows.limit(0), omh.SIMILARITY).count() == 0


def test_a_family_is_marked_once_a_pair(monkeypatch):
    """200 texts that share 100 words: 19,900 pairs are marked and tried once each, where a join by words made 1,990,000 rows."""
    rng = np.random.default_rng(48)
    words, owners = np.sort(np.repeat(np.arange(100), 200)), np.tile(np.arange(200), 100)
    labels = np.arange(200)
    share = omh.sharing((words, words), (owners, owners), (labels, labels))
    assert share.sum() == 200 * 200
    bits = rng.integers(0, 2**62, (200, 64)).astype(np.uint64)
    bits[1::2] = bits[::2]
    n = np.full(200, 500)
    i, j = omh.fitting((bits, bits), share, (n, n), (labels, labels), omh.SIMILARITY, True)
    assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [(2 * k, 2 * k + 1) for k in range(100)]
    assert not omh.sharing((words, words), (owners, owners), (labels * 0, labels * 0)).any()
