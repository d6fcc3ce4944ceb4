"""Extraction, chat masks, media, token counts, decontamination and near copies against exact references."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from eonmap.llm import avi, chatmask, decontam, htmlcrf, omh, queries, tokencount

VOCABULARY = "piece_bpe_32k.model"


# ------------------------------------------------------------- tokens
@pytest.fixture(scope="module")
def model():
    return queries.tokenizer_file(VOCABULARY)


def odd_texts(n=1500):
    rng = random.Random(1)
    parts = list(" \n\tabcdehtion.,é½漢字🙂 ▁<s>/0123456789ABC ́") + ["the ", "<s>", "</s>", "  ", "    ", "<0x0A>", "ing", "aaaa", "==="]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(n)] + ["a" * 5000, "=-" * 3000, " " * 4000, "the" * 2000, "\n" * 900, "", "x" + " " * 37 + "y", "é" * 700]


def test_token_counts_equal_the_library(model):
    import sentencepiece

    texts = odd_texts()
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts, num_threads=1)]
    table = tokencount.PieceTable.from_model(model)
    assert tokencount.Counter(table).count(texts) == want
    assert tokencount.Counter(table, remembered=5).count(texts) == want


@pytest.mark.parametrize("bound", [1, 200])
def test_long_words_join_rank_by_rank(model, monkeypatch, bound):
    """Texts without a space, with the round of all pairs of a rank for all of them or for long ones."""
    import sentencepiece

    monkeypatch.setattr(tokencount, "LONG", bound)
    rng = random.Random(4)
    pools = ["abcdefghijklmnopqrstuvwxyz", "ab", "etaoin", "ABCabc0123+/é中文字的是", ["the", "ing", "ation", "aa", "aaa", "er"]]
    texts = ["".join(rng.choice(pools[i % 5]) for _ in range(rng.choice((3, 30, 700, 5000)))) for i in range(150)] + ["a" * 100_000]
    want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts, num_threads=1)]
    assert tokencount.Counter(tokencount.PieceTable.from_model(model)).count(texts) == want


def test_token_query_on_documents(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "a b " * 9000)], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in tokencount.count_tokens(docs, model).collect()}
    for r in docs.collect():
        t, g = r["text"] or "", got[r["doc_id"]]
        assert (g["n_bytes"], g["n_tokens"], g["over_limit"]) == (len(t.encode()), len(sp.encode(t)), len(sp.encode(t)) > 4096)
    assert tokencount.count_tokens(docs.limit(0), model).count() == 0


# ------------------------------------------------------------- media
def test_store_and_read_back():
    rng = np.random.default_rng(1)
    for n in (192, 384, 192 * 31, 192 * 997):
        for p in (rng.integers(0, 256, n, np.uint8).tobytes(), b"\xff" * n, b"\x00\xff" * (n // 2)):
            video = avi.read_avi(avi.store(p))
            frames = [avi.decode_jpeg(f) for f in video.frames]
            assert b"".join(f.tobytes() for f in frames)[:video.n_samples] == p and {f.shape for f in frames} == {(video.height, video.width)}


def test_lossless_frames_with_another_table():
    x = np.random.default_rng(2).integers(0, 256, (3, 5)).astype(np.uint8)
    own = avi.encode_lossless(x)
    # the same code with a table in which a tenth symbol stands last is read bit by bit
    head, tail = own.split(bytes([0xFF, 0xC4]), 1)
    lengths, symbols = avi.CODE_LENGTHS[:9] + b"\x01" + avi.CODE_LENGTHS[10:], avi.CODE_SYMBOLS + b"\x09"
    other = head + avi._segment(0xC4, b"\x00" + lengths + symbols) + tail[2 + 1 + 16 + 9:]
    assert np.array_equal(avi.decode_jpeg(own), x) and np.array_equal(avi.decode_jpeg(other), x)


def test_baseline_frame():
    """An 16 x 8 image of two flat blocks, coded by hand: DC 10 and -10 at a step of 8."""
    quant = avi._segment(0xDB, b"\x00" + bytes([8] * 64))
    frame = avi._segment(0xC0, bytes([8, 0, 8, 0, 16, 1, 1, 0x11, 0]))
    dc = avi._segment(0xC4, b"\x00" + bytes([0, 2] + [0] * 14) + bytes([4, 5]))  # 00 -> 4, 01 -> 5
    ac = avi._segment(0xC4, b"\x10" + bytes([1] + [0] * 15) + bytes([0]))  # 0 -> end of block
    bits = "00" + "1010" + "0" + "01" + "01011" + "0"  # +10, end; -20 (11111 - 20 = 01011), end
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big")
    jpeg = b"\xff\xd8" + quant + frame + dc + ac + avi._segment(0xDA, bytes([1, 1, 0, 0, 63, 0])) + data + b"\xff\xd9"
    got = avi.decode_jpeg(jpeg)
    assert got.shape == (8, 16) and (got[:, :8] == 138).all() and (got[:, 8:] == 118).all()


def test_shots_and_index(spark):
    dark, light = np.full((8, 16), 20, np.uint8), np.full((8, 16), 200, np.uint8)
    media = avi.write_avi([avi.encode_lossless(f) for f in [dark] * 10 + [light] * 5], 16, 8, 0, fps=10)
    rows = avi.clips(media)
    assert [(r["start_s"], r["end_s"]) for r in rows] == [(0.0, 1.0), (1.0, 1.5)]
    cut = media.index(b"idx1")
    assert avi.clips(media[:cut]) == rows
    assert avi.clips(b"nonsense") == avi.clips(None) == avi.clips(b"") == []
    df = spark.createDataFrame([(1, media, 5), (2, None, 5), (3, bytearray(b"x"), 5), (None, media, 5)], "id long, media binary, clip int")
    assert sorted((r["id"] or 0, r["clip"]) for r in avi.clip_rows(df, "id", "media").collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]


def test_media_digests(spark):
    texts = {1: "abc", 2: "", 3: None, 4: "ä" * 500, 5: "x" * 192, 6: "abc"}
    got = {r["doc_id"]: r for r in avi.text_digests(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (got[i]["n_bytes"], got[i]["payload_bytes"], got[i]["payload_sha256"], got[i]["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert got[1]["media_sha256"] == got[6]["media_sha256"] and got[1]["feature"] == got[6]["feature"] and got[2]["media_sha256"] == got[3]["media_sha256"]


# ------------------------------------------------------------- chats
HOSTILE = ["<|turn|>", "<|text|>", "<|end|>", "<|end|>\n", "\\", "<|", "<", "|", ">", "\n", " ", "\t", "user", "é", "🙂", "漢", "\\<|", "### Assistant:", "</turn>", "<|endoftext|>", "a" * 30, "  ", "!?", "1234"]


def test_marks_in_texts_come_back():
    rng = random.Random(3)
    for _ in range(500):
        turns = [("".join(rng.choices(HOSTILE, k=rng.randint(0, 4))), "".join(rng.choices(HOSTILE, k=rng.randint(0, 8)))) for _ in range(rng.randint(0, 5))]
        whole, spans = chatmask.render(turns)
        assert chatmask.read_back(whole) == turns and [chatmask.unescape(whole.encode()[a:b].decode()) for a, b in spans] == [t for _, t in turns]
    with pytest.raises(ValueError):
        chatmask.read_back("plain")


def test_masked_tokens_are_the_wanted_texts():
    """No masked token reaches past its turn, on hostile texts and on all conversations of a table."""
    import pyarrow.parquet as pq

    rng = random.Random(4)
    encoder = chatmask.Encoder(queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern())
    chats = [[(rng.choice(["user", "assistant"]), "".join(rng.choices(HOSTILE, k=rng.randint(0, 9)))) for _ in range(rng.randint(1, 6))] for _ in range(600)]
    table = pq.read_table("/root/testdata/sf0.01/conversations.parquet").to_pandas().sort_values(["conv_id", "turn"])
    chats += [[(r or "", t or "") for r, t in zip(g["role"], g["text"], strict=True)] for _, g in table.groupby("conv_id")]
    chats.append([("assistant", queries.PROBE), ("assistant", ""), ("assistant", " \n "), ("user", "x"), ("assistant", "word " * 20000)])
    for turns in chats:
        whole, spans = chatmask.render(turns)
        ids, edges = encoder(whole)
        raw = whole.encode()
        assert edges[-1] == len(raw) and encoder.encoding.decode(ids.tolist()) == whole
        mask = chatmask.loss_mask(edges, [s for s, (r, _) in zip(spans, turns, strict=True) if r == "assistant"])
        got = [chatmask.unescape(raw[a:b].decode()) for a, b in chatmask.masked_runs(edges, mask)]
        assert got == [t for r, t in turns if r == "assistant" and t]


def test_chat_digests(spark):
    rows = [(1, 1, "assistant", "  hi 🙂\n\n"), (1, 0, "user", "q"), (1, 2, "assistant", "<|endoftext|> \\ x"), (2, 0, "user", None), (None, None, None, "z"), (3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (4, 0, "assistant", "word " * 20000)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, mask int")
    model = queries.tokenizer_file("byte_bpe_50k.tiktoken"), queries.split_pattern()
    chats = chatmask.format_chats(df, *model)
    got = {r["conv_id"]: r for r in chatmask.digests(chats).collect()}
    loss = "  hi 🙂\n\n<|endoftext|> \\ x"
    turns = "user\nq\nassistant\n  hi 🙂\n\n\nassistant\n<|endoftext|> \\ x\n"
    assert got[1]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and got[1]["loss_chars"] == len(loss)
    assert got[1]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest() and got[1]["n_turns"] == 3
    assert got[2]["loss_chars"] == 0 and got[None]["n_turns"] == 1 and got[3]["n_turns"] == 2 and got[4]["loss_chars"] == 100000
    one = {r["conv_id"]: r for r in chats.collect()}[1]
    assert len(one["mask"]) == len(one["token_ids"]) and 0 < sum(one["mask"]) < len(one["mask"]) and len(one["loss_spans"]) == 2
    assert chatmask.digests(chatmask.format_chats(df.limit(0), *model)).count() == 0


# ------------------------------------------------------------- pages
def test_crf_on_unseen_layouts():
    m = htmlcrf.default_model()
    pages = htmlcrf.labelled_pages(200, seed=99)
    assert sum(htmlcrf.viterbi(f, m) == y for f, y in pages) / len(pages) > 0.95


def test_viterbi_against_all_paths():
    import itertools

    m, rng = htmlcrf.default_model(), random.Random(5)
    names = list(m.index)
    for _ in range(30):
        fs = [rng.sample(names, 4) for _ in range(6)]

        def score(path, fs=fs):
            s = m.start[path[0]] + sum(m.weights[m.index[f], y] for x, y in zip(fs, path, strict=True) for f in x)
            return s + sum(m.steps[a, b] for a, b in zip(path, path[1:], strict=False))

        assert tuple(htmlcrf.viterbi(fs, m)) == max(itertools.product((0, 1), repeat=6), key=score)


def test_pages(spark):
    page = ('<html><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article><h1>Title &amp; so</h1><p>One\n  two<br>three &#233;<p>Four <b>five</b></p><div class="ad-box">Buy</div>'
            '<script>var t="<p>x</p>";</script></article><section id="comments"><p>I think so too, well said.</p></section><aside><p>Some other story here.</p></aside><footer>&copy; me</footer>')
    rows = [(1, "u", page), (2, None, None), (None, "v", ""), (4, "w", "<main><p>just words here and there.</p><!-- no"), (5, "x", "<article><p>" + "long words " * 20000)]
    got = {r["page_id"]: r for r in htmlcrf.extract(spark.createDataFrame([(*r, 9) for r in rows], "page_id long, url string, html string, text int")).collect()}
    assert got[1]["text"] == "Title & so\n\nOne two three é\n\nFour five"
    assert got[2]["text"] == got[None]["text"] == "" and got[4]["text"] == "just words here and there." and got[5]["n_chars"] == 11 * 20000 - 1


# ------------------------------------------------------------- decontamination
def test_alignment_against_full_table():
    rng = np.random.default_rng(4)
    for _ in range(60):
        item, text = rng.integers(1, 6, rng.integers(3, 12)), rng.integers(0, 6, rng.integers(1, 25))
        h = np.zeros((len(text) + 1, len(item) + 1))
        for i, a in enumerate(text, 1):
            for j, b in enumerate(item, 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (decontam.MATCH if a == b else decontam.MISMATCH), h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
        assert decontam.align(item, [text, text[:1]])[0][0] == h.max()


def test_items_shorter_than_a_seed():
    items = decontam.number([(1, "zebra"), (2, "Blue whale"), (3, ""), (4, "one two three four five six")])
    seeds = decontam.choose_seeds(items, np.zeros(len(items.vocabulary) + 1, np.int64))
    texts = ["a zebra, a ZEBRA", "the blue whale", "whale blue", "blue", None, "", "zebra", "x one two three four five six zebra"]
    got = {(t, i) for t, i, score, _, _ in decontam.score_texts(texts, items, seeds, 0.5)}
    assert got == {(0, 0), (1, 1), (6, 0), (7, 0), (7, 3)}


def test_leaks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(12)] + [(90, "too short"), (91, None)]
    docs, want = [], set()
    for d in range(150):
        body = [word() for _ in range(rng.randint(0, 300))]
        if d % 3 == 0:
            i, text = items[d % 12]
            w = text.split()
            for _ in range(d % 5):  # up to four edits
                w[rng.randrange(len(w))] = word()
            body[len(body) // 2:len(body) // 2] = [x.upper() if d % 2 else x + "," for x in w]
            want.add((d, i))
        docs.append((d, " ".join(body), "x"))
    docs += [(1000, None, "x"), (None, items[3][1], "x")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench).collect()}
    assert got == want | {(None, 3)}
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find_leaks(df, bench, block_bytes=800).collect()} == got
    assert decontam.find_leaks(df, bench.limit(0)).count() == 0 and decontam.find_leaks(df.limit(0), bench).count() == 0


# ------------------------------------------------------------- near copies
def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance_against_full_table():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = [x for x in a if rng.random() > 0.1] if rng.random() < 0.7 else [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        d, most = plain_distance(a, b), rng.randint(0, 14)
        assert omh.distance(a, b, most) == (d if d <= most else most + 1)


def sketches(texts):
    each, found = omh.sketch(texts)
    return np.split(found, np.cumsum(each)[:-1])


def test_sketch_against_plain_sampling():
    rng = random.Random(8)
    texts = [np.array([rng.randint(1, 9) for _ in range(n)], np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (1, 4, 5, 6, 40, 300)]
    got, m = sketches(texts), 2**64
    assert all(np.array_equal(got[i], sketches([t])[0]) for i, t in enumerate(texts))
    mix = lambda x: int(omh._mix(np.array([x % m], np.uint64))[0])
    for t, samples in zip(texts, got, strict=True):
        grams, _, _ = omh.grams_of([t], omh.K)
        plain = []
        for i in range(omh.ROUNDS):
            bins = {}
            for place, g in enumerate(map(int, grams)):
                v = mix(g + 0x632BE59BD9B4E019 * (i + 1))
                bins.setdefault((v >> 40) * omh.BINS >> 24, []).append((v % 2**omh.HASH_BITS, place, g))
            for _, members in sorted(bins.items()):
                if len(members) > 1:
                    (_, _, first), (_, _, second) = sorted(sorted(members)[:2], key=lambda x: x[1])
                    plain.append(mix(mix(first + i + 1) + second))
        assert plain == samples.view(np.uint64).tolist()
    swapped = sketches([np.concatenate([texts[5][150:], texts[5][:150]])])[0]
    assert len(np.setdiff1d(swapped, got[5])) / len(swapped) > 0.2  # the order of samples counts


def test_recall_of_samples_by_similarity():
    rng = np.random.default_rng(14)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    for n in (60, 150, 400):
        for similarity, least in ((0.8, 0.9), (0.85, 0.97), (0.9, 0.99)):
            edits, texts = round(n * (1 - similarity)), []
            for trial in range(200):
                a = draw(n)
                b = a.copy()
                at = np.arange(edits) * n // edits if trial % 2 else rng.choice(n, edits, replace=False)
                b[at] = draw(edits)
                texts += [a, b]
            got = sketches(texts)
            assert np.mean([len(np.intersect1d(got[i], got[i + 1])) > 0 for i in range(0, 400, 2)]) >= least


def test_near_classes_against_all_pairs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=4))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        for c in range(rng.choice([1, 1, 2, 4])):
            w = list(base)
            for _ in range(0 if c == 1 else len(w) * c // 100 + (c > 2)):
                w[rng.randrange(len(w))] = word()
            texts.append(" ".join(w))
    ids = list(range(100, 100 + len(texts)))
    rows = [*zip(ids, texts, strict=True), (1, None), (2, ""), (3, "!?"), (None, texts[0]), (100, texts[0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, class_id int")
    got = omh.near_classes(df).collect()
    assert len(got) == len(rows)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in zip(ids, texts, strict=True):
        for j, b in zip(ids, texts, strict=True):
            x, y = a.split(), b.split()
            if i < j and plain_distance(x, y) <= 0.2 * max(len(x), len(y)):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    classes = {r["doc_id"]: r["class_id"] for r in got if r["doc_id"] is not None}
    assert {i: classes[i] for i in ids} == {i: find(i) for i in ids} and [classes[i] for i in (1, 2, 3)] == [1, 2, 3]
    kept = omh.one_of_each(df)
    assert kept.columns == df.columns and kept.count() == len(set(classes.values()))
    assert omh.near_classes(df.limit(0)).count() == 0


def test_hot_group_is_one_class(spark):
    rng = random.Random(10)
    base = [f"w{rng.randint(0, 999)}" for _ in range(80)]
    rows = [(i, " ".join(base[:i % 80] + [f"x{i}"] + base[i % 80 + 1:])) for i in range(400)]
    got = omh.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).select(F.col("class_id")).distinct().collect()
    assert len(got) == 1


def test_near_copies_behind_a_shared_passage(spark):
    """Of pairs whose documents all share a passage of 60 words, hardly one is missed, whatever the share of their own words."""
    rng = random.Random(30)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=4))
    passage, texts = [word() for _ in range(60)], []
    for own in (30, 60, 120):
        for _ in range(60):
            base = [word() for _ in range(own)]
            copy = list(base)
            for i in rng.sample(range(own), own // 5):
                copy[i] = word()
            texts += [passage + base, passage + copy]
    got = omh.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    found = {r["doc_id"]: r["class_id"] for r in got.collect()}
    assert all(found[i] in (i, i - 1) for i in found)
    assert all(sum(found[i] == i - 1 for i in range(at + 1, at + 120, 2)) >= 58 for at in (0, 120, 240))


@pytest.mark.parametrize(("size", "vocabulary"), [(16, 30_000), (100, 30_000), (1000, 2_000)])
def test_evenly_edited_copies_behind_a_long_passage(spark, size, vocabulary):
    """All texts share 200 words; of a copy's other 55 every second is another, so that no 3-gram of its own is left."""
    rng = random.Random(size)
    passage, texts, pairs = [f"p{rng.randrange(10**6)}" for _ in range(200)], [], min(60, size // 2)
    word = lambda: f"v{int(vocabulary * rng.random() ** 2)}"
    for _ in range(pairs):
        base = [word() for _ in range(55)]
        texts += [base, [word() if i % 2 else w for i, w in enumerate(base)]]
    texts += [[word() for _ in range(55)] for _ in range(size - 2 * pairs)]
    whole = [" ".join(t[:20] + passage + t[20:]) for t in texts]
    found = {r["doc_id"]: r["class_id"] for r in omh.near_classes(spark.createDataFrame(list(enumerate(whole)), "doc_id long, text string")).collect()}
    alike = [i for i in range(0, 2 * pairs, 2) if omh.alike(whole[i], whole[i + 1])]
    assert len(alike) > 0.8 * pairs and sum(found[i] == found[i + 1] for i in alike) >= 0.95 * len(alike)
    assert all(found[i] in (i, i - 1) for i in found)


def test_short_texts_of_one_template_are_not_held_against_each_other(spark, monkeypatch):
    """38 words of a template and 12 of their own: no two are alike, and the template's words join no pairs."""
    joined = []
    keep = omh.unlike_short
    monkeypatch.setattr(omh, "unlike_short", lambda *a: (lambda made: (joined.append(made.count()), made)[1])(keep(*a)))
    for n in (100, 300):
        rng = random.Random(n)
        template = [f"t{i}" for i in range(38)]
        texts = [" ".join(template + [f"w{rng.randrange(10**7)}" for _ in range(12)]) for _ in range(n)]
        got = omh.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
        assert got.select("class_id").distinct().count() == n
    assert joined == [0, 0]


def test_own_words_and_features():
    hasher = omh.Hasher()
    passage = [f"p{i}" for i in range(120)]
    a, b = (hasher([f"{x}{i}" for i in range(20)] + passage + [f"{x}e{i}" for i in range(20)]) for x in "ab")
    each, found, places = omh.sketch_places([a, b])
    first, second = found[:each[0]], found[each[0]:]
    own = omh.own_words(len(a), places[:each[0]], np.isin(first, second))
    assert own[:15].all() and own[-15:].all() and own[20:140].mean() < 0.5
    features = omh.own_features(a, own)
    assert 0 < len(features) <= omh.OWN and len(set(features.tolist())) == len(features)
    assert len(omh.own_features(a, np.zeros(len(a), bool))) == 0


def test_texts_alike_share_a_rare_word():
    rng = random.Random(12)
    hasher = omh.Hasher()
    for n in [*range(1, 40), 90, 150]:
        for _ in range(12):
            a = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(n)]
            b = list(a)
            for _ in range(n // 4):
                at = rng.randrange(len(b) + 1)
                b[at:at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y", "z"]])
            if b and omh.alike(" ".join(a), " ".join(b)):
                counts = np.sort(hasher(list({*a, *b})).view(np.int64))
                text, key, longer = omh.rare_words([hasher(a), hasher(b)], omh.SIMILARITY, (counts, np.ones(len(counts), np.int64)))
                least = 0 if len(a) >= len(b) else 1
                assert set(key[(text == least) & longer]) & set(key[text == 1 - least])


def test_bins_bound_the_edits():
    rng = random.Random(15)
    hasher = omh.Hasher()
    for _ in range(300):
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") * 2 for _ in range(rng.randint(1, 400))]
        b = list(a)
        for _ in range(rng.randint(0, 40)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["y"]])
        if b:
            x, y = omh.word_bins([hasher(a), hasher(b)]).reshape(2, -1).astype(int)
            assert max(np.maximum(x - y, 0).sum(), np.maximum(y - x, 0).sum()) <= omh.distance(a, b, 1000)


def test_short_and_evenly_edited_copies(spark):
    rng = random.Random(13)
    word = lambda: "".join(rng.choices("abcdefghijklm", k=4))
    texts = []
    for n, step in [(10, 0), (12, 0), (150, 6), (60, 6)] * 12:
        base = [word() for _ in range(n)]
        edited = [word() if (i % step == step - 1 if step else i == n // 2) else w for i, w in enumerate(base)]
        texts += [base, edited]
    got = omh.near_classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: i - i % 2 for i in range(len(texts))}


@pytest.mark.parametrize("m", [5, 6, 8, 12, 13, 20, 40])
@pytest.mark.parametrize("edits", ["every third", "random", "moved"])
def test_edited_items_that_the_alignment_passes_are_found(m, edits):
    """Of edited copies whose own alignment reaches the threshold, at least 0.97 are found in a text."""
    rng = random.Random(m)
    vocabulary = [f"w{i}" for i in range(3000)]
    weights = [1 / (i + 1) for i in range(3000)]
    items = decontam.number([(i, " ".join(rng.choices(vocabulary, weights, k=m))) for i in range(100)])
    counts = np.zeros(len(items.vocabulary) + 1, np.int64)
    np.add.at(counts, decontam.numbers(" ".join(rng.choices(vocabulary, weights, k=20_000)), items.vocabulary), 1)
    seeds = decontam.choose_seeds(items, counts)
    names = {i: w for w, i in items.vocabulary.items()}
    texts, wanted = [], []
    for i, words in enumerate(items.words):
        copy = [names[w] for w in words.tolist()]
        at = range(2, m, 3) if edits == "every third" else sorted(rng.sample(range(m), round(0.3 * m)), reverse=True)
        for k in at:
            new = ["qq"] if edits != "moved" else rng.choice([[], ["qq"], [copy[k], "qq"]])
            copy[k:k + 1] = new
        score, _ = decontam.align(words, [decontam.numbers(" ".join(copy), items.vocabulary)])
        if score[0] >= decontam.THRESHOLD * decontam.MATCH * m:
            wanted.append((len(texts), i))
            texts.append("filler qq " * 20 + " ".join(copy) + " qq filler" * 20)
    found = {(t, i) for t, i, *_ in decontam.score_texts(texts, items, seeds, decontam.THRESHOLD)}
    assert len(wanted) > 40 and len(found.intersection(wanted)) >= 0.97 * len(wanted)


def test_two_words_of_a_very_short_item_are_no_leak():
    items = decontam.number([(1, "what is the capital"), (2, "name of it")])
    seeds = decontam.choose_seeds(items, np.zeros(len(items.vocabulary) + 1, np.int64))
    assert decontam.score_texts(["this is the end of it all", "what is capital"], items, seeds, decontam.THRESHOLD) == [(1, 0, 0.625, 0, 3)]
