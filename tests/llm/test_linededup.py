import random
import re
import struct

import xxhash
from pyspark.sql import functions as F

from eonmap.llm import linededup

COLS = "doc_id long, text string, n_removed string, other int"


def run(spark, rows, **kw):
    return [tuple(r) for r in linededup.dedup_lines(spark.createDataFrame([(i, t, "x", 5) for i, t in rows], COLS), **kw).select("doc_id", "text", "n_removed", "lines_removed", "other").collect()]


def lines(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    return df.select(linededup.lines_of(F.col("text")), linededup.joined(linededup.lines_of(F.col("text"))), linededup.cuts_of(F.col("text"))).first()


def line(rng, n=6):
    return " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))


def plain_lines(text):
    """The same lines by plain loops."""
    out = []
    for s in re.split(r"\n(?![\r\n])", text):
        some = [""]
        if linededup.MARK not in s:
            for sentence in re.split(r"(?:(?<=[.!?] )|(?<=[。！？]))", s):
                some[-1] += sentence
                if len(sentence) >= linededup.SENTENCE:
                    some.append("")
            if len(some) > 1 and not some[-1]:
                some.pop()
        else:
            some = [s]
        out += ["\n" + some[0], *some[1:]]
    return out


def plain_cuts(contents):
    """pos -> hash of the pair, by another implementation of the hash."""
    out = {}
    for i in range(1, len(contents)):
        if contents[i] and contents[i - 1]:
            h = [struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(s.encode(), seed=42)))[0] for s in contents[i - 1:i + 1]]
            seed = xxhash.xxh64_intdigest(struct.pack("<q", h[0]), seed=42)
            seed = xxhash.xxh64_intdigest(struct.pack("<i", linededup.ROLL), seed=seed)
            w = struct.unpack("<q", struct.pack("<Q", xxhash.xxh64_intdigest(struct.pack("<q", h[1]), seed=seed)))[0]
            if w % linededup.DIVISOR < linededup.CUTS:
                out[i] = w
    return out


def brute(rows):
    """Every cut held against the first of its kind, outwards, never beyond the next cuts."""
    first, out, docs = {}, {}, [(i, plain_lines(t)) for i, t in sorted(rows)]
    for i, raw in docs:
        own = [s.strip(" \t\r\n") for s in raw]
        cuts, gone = plain_cuts(own), set()
        at = [0, *sorted(cuts), len(own)]
        for lo, pos, hi in zip(at, at[1:], at[2:], strict=False):
            if cuts[pos] in first:
                its, p, l, h = first[cuts[pos]]
                up = down = 0
                while pos - up > lo and p - up > l and own[pos - up - 1] == its[p - up - 1]:
                    up += 1
                while pos + down < hi and p + down < h and own[pos + down] == its[p + down]:
                    down += 1
                if up and down:
                    gone |= set(range(pos - up, pos + down))
            else:
                first[cuts[pos]] = own, pos, lo, hi
        out[i] = "".join(s for n, s in enumerate(raw) if n not in gone)[1:], len(gone)
    # the line end at the start of the first line that is left is dropped, as that before the text is
    return out


def test_lines_and_cuts_against_plain_loops(spark):
    rng = random.Random(1)
    long = " ".join(line(rng, rng.randint(1, 12)).capitalize() + rng.choice([".", "!", "?"]) for _ in range(30))
    texts = ["", "\n", "\n\n", "B\nC\nB", "\nCx\nBy\n", "a\r\n\r\nb", long, f"{long}\n\n{long}\x01{long}\n", long[:-1] + " \n \n" + line(rng), "。".join([line(rng, 30)] * 3), " \t \n x \n y"]
    texts.append("\n".join(line(rng) for _ in range(60)))
    for t in texts:
        got, back, cuts = lines(spark, t)
        assert back == t and got == plain_lines(t)
        plain = plain_cuts([s.strip(" \t\r\n") for s in got])
        assert {c["pos"]: c["hash"] for c in cuts} == plain
        edges = [0, *sorted(plain), len(got)]
        assert [(c["lo"], c["hi"]) for c in cuts] == list(zip(edges, edges[2:], strict=False))
    a, b = ([(c["hash"]) for c in lines(spark, t)[2]] for t in (texts[-1], "new\nwords\n" + texts[-1]))
    assert set(a) <= set(b) and 30 < len(a) < 50


def test_against_brute_force(spark):
    rng = random.Random(2)
    passages = [[line(rng) for _ in range(rng.randint(2, 9))] for _ in range(8)]
    rows = []
    for i in range(60):
        own = [line(rng) for _ in range(rng.randint(0, 6))]
        for p in rng.sample(passages, 2):
            at, cut = rng.randint(0, len(own)), rng.randint(0, len(p) - 2)
            own[at:at] = rng.choice([p, p[cut:], p[:len(p) - cut]])
        rows.append((i, "\n".join(own)))
    got = {r[0]: (r[1], r[3]) for r in run(spark, rows)}
    assert got == brute(rows)
    assert sum(len(t) for t, _ in got.values()) < 0.8 * sum(len(t) for _, t in rows)


def test_share_of_planted_passages_removed(spark):
    """By the number of lines; also as single physical lines of several sentences, in differing surroundings."""
    rng = random.Random(6)
    shares = {}
    for n, least in ((2, 0.5), (3, 0.8), (5, 0.9), (8, 0.95), (12, 0.98)):
        for sep in ("\n", ". "):
            planted = [[line(rng, 12) for _ in range(n)] for _ in range(60)]
            rows = [(3 * i + c, sep.join([line(rng, 12), *p, line(rng, 12)])) for i, p in enumerate(planted) for c in range(3)]
            texts = {r[0]: r[1] for r in run(spark, rows)}
            left = sum(s in texts[3 * i + c] for i, p in enumerate(planted) for c in (1, 2) for s in p)
            assert all(s in texts[3 * i] for i, p in enumerate(planted) for s in p)
            assert all(rows[j][1].split(sep)[e] in t for j, t in texts.items() for e in (0, -1))  # what is around stays
            shares[n, sep] = 1 - left / (120 * n)
            assert shares[n, sep] >= least, shares


def test_single_lines_stay_at_every_length(spark):
    rng = random.Random(3)
    for n in (1, 20, 49, 50, 51, 200):
        p = line(rng, n)
        rows = [(i, f"{line(rng)}\n{p}\n{line(rng)}") for i in range(4)]
        assert {r[0]: r[1] for r in run(spark, rows)} == dict(rows)


def test_short_lines_stay(spark):
    rows = [(1, "hello"), (2, "hello"), (3, "a\nhello"), (4, "hello\n\n"), (5, "hello\n\n"), (6, "\nhello"), (7, "\nhello")]
    assert {r[0]: r[1] for r in run(spark, rows)} == dict(rows)


def test_edges(spark):
    rng = random.Random(4)
    big = "\n".join(line(rng) for _ in range(3000))
    rows = [(1, None), (None, big), (7, big), (7, big), (8, ""), (9, "x\ny\nx\ny\nx\ny\nx\ny"), (10, f"{line(rng)}\n{big[:3000]}")]
    got = run(spark, rows)
    assert len(got) == 7 and all(r[4] == 5 for r in got)
    by = {}
    for r in got:
        by.setdefault(r[0], []).append(r)
    assert by[1][0][1:4] == (None, 0, 0) and by[None][0][1] == big and by[8][0][1] == ""
    assert by[7][0] == by[7][1] and by[7][0][1] == "" and by[9][0][1] in ("x\ny", "x\ny\nx\ny\nx\ny\nx\ny")
    assert len(by[10][0][1]) < 200
    assert run(spark, []) == []


def test_hot_passage(spark):
    rng = random.Random(7)
    p = "\n".join(line(rng) for _ in range(8))
    rows = [(i, f"{line(rng)}\n{p}\n{line(rng)}") for i in range(2000)]
    got = {r[0]: r[1] for r in run(spark, rows)}
    assert p in got[0] and sum(len(t) for t in got.values()) < 0.45 * sum(len(t) for _, t in rows)


def test_filters_on_the_result_stay_linear(spark):
    rng = random.Random(5)
    big = "\n".join(line(rng) for _ in range(20_000))
    df = linededup.dedup_lines(spark.createDataFrame([(1, big), (2, big)], "doc_id long, text string"))
    assert [r["doc_id"] for r in df.where((F.col("n_removed") == 0) | (F.trim("text") != "")).collect()][:1] == [1]


def test_sentences_end_without_a_look_behind(spark):
    """A regular expression tried every character of a text before; the sentences are the same."""
    rng = random.Random(45)
    texts = ["".join(rng.choice(["a", "b" * 20, ". ", "! ", "? ", "。", "！", "？", " ", ".", "\n", "\r\n", "\u0001"][:12 if i % 9 else 13]) for _ in range(rng.randrange(80))) for i in range(500)]
    texts += ["", " ", ". ", "." * 50 + " ", ". . " * 30, "x" * 60 + "。。" + "y" * 60]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", linededup.lines_of(F.col("text")).alias("lines"))
    assert "?<=" not in got._jdf.queryExecution().toString()
    for row in got.collect():
        plain = []
        for line in re.split(r"\n(?![\r\n])", row["text"]):
            some = [line] if "\u0001" in line else "".join(s + "\u0001" * (len(s) >= linededup.SENTENCE) for s in re.split(r"(?<=[.!?] )|(?<=[。！？])", line)).rstrip("\u0001").split("\u0001")
            plain += ["\n" + some[0], *some[1:]]
        assert row["lines"] == plain
