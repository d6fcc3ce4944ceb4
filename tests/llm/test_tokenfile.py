"""Token files: ids equal the library's, files read back as written."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eonmap.llm import tokenfile

NAME = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def vocabulary():
    with open(public_tokenizers.path(NAME)) as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(NAME))


TEXTS = ["", " ", "Hello, world! it's I'LL 'sup don't", "STRASSE straße Größe ÀÉÎ ñandú ÿ×÷", "a<|endoftext|>b <|STARTOFTEXT|> <|", "12 3a4 x86_64 ... ?!", "é ́x ﬁ İ ΣΑΣ.", "漢字かな 한국어 ไทย", "tab\tand\x0bv nb ls\r\n", "fooµ ªº…. «q».",
         "x" * 5000, "word. " * 3000, "\x00 \x1c\x1d \x85", "👍🏽 ok", "l'été d'où"]


def test_ids_equal_the_library(vocabulary, library):
    encoder = tokenfile.Encoder(vocabulary, np.dtype("<u2"))
    assert encoder.by_word
    for texts in (TEXTS, TEXTS[::-1], [" ".join(TEXTS)]):
        assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \n.,'-ABCabcßéÿ<|>019stre")), max_size=60), max_size=4))
def test_ids_equal_the_library_on_any_text(texts):
    encoder = test_ids_equal_the_library_on_any_text.__dict__.setdefault("encoder", None) or tokenfile.Encoder(open(public_tokenizers.path(NAME)).read(), np.dtype("<u2"))
    test_ids_equal_the_library_on_any_text.encoder = encoder
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(texts)] == [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]


def test_round_trip_in_order(spark, vocabulary, library, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    docs = [(int(i), t) for i, t in zip(rng.permutation(60), TEXTS * 4, strict=True)] + [(None, "no id"), (None, None), (5, None), (3, "again"), (3, "again"), (-4, "very " * 30_000)]
    table = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, start int").repartition(5)
    path = f"file://{tmp_path}/ids"
    tokenfile.write_ids(table, path, vocabulary, 2)
    got = tokenfile.read_ids(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in docs), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, tuple(library.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t in docs)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, tuple(r["ids"])) for r in got) == want
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]))
        at += len(r["ids"])
    digests = {r["start"]: r for r in tokenfile.digests(spark, path).collect()}
    assert all(digests[r["start"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in got)


def test_one_document_is_read_alone(spark, vocabulary, library, tmp_path):
    docs = spark.createDataFrame([(i, f"Text {i} of many, number {i * i}.") for i in range(300)], "doc_id long, text string").coalesce(1)
    path = f"file://{tmp_path}/ids"
    tokenfile.write_ids(docs, path, vocabulary, 2)
    files, folder = pa.fs.FileSystem.from_uri(f"{path}/shards")
    dictionary = bytes(spark.read.parquet(f"{path}/dictionary").first()["dictionary"])
    assert dictionary
    seen = 0
    for row in spark.read.parquet(f"{path}/manifest").collect():
        shard = tokenfile.Shard(files, f"{folder}/{row['name']}", dictionary)
        assert shard.told["dictionary"] == hashlib.sha256(dictionary).hexdigest() and shard.told["width"] == "<u2"
        for i, doc_id in enumerate(shard.index["doc_id"].to_pylist()):
            assert shard.ids(i).tolist() == [*library.encode(f"Text {doc_id} of many, number {doc_id * doc_id}.", add_special_tokens=False).ids, 2]
            seen += 1
        assert tokenfile.read_one(spark, path, row["name"], 0).tolist() == shard.ids(0).tolist()
        with pytest.raises(ValueError, match="another dictionary"):
            tokenfile.Shard(files, f"{folder}/{row['name']}", b"other")
    assert seen == 300


def test_shards_of_lost_tasks_are_no_output(spark, vocabulary, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    path = f"file://{tmp_path}/ids"
    (tmp_path / "ids" / "shards").mkdir(parents=True)
    (tmp_path / "ids" / "shards" / "000000-0000-lost.ids").write_bytes(b"half")
    tokenfile.write_ids(docs, path, vocabulary, 2)
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in tokenfile.digests(spark, path).orderBy("doc_id").collect()] == [(1, 0, 3), (2, 3, 2)]
    assert not (tmp_path / "ids" / "shards" / "000000-0000-lost.ids").exists()


def test_full_shards_are_closed(vocabulary, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "SHARD_IDS", 10)
    writer = tokenfile.ShardWriter(f"file://{tmp_path}", tokenfile.Plan(vocabulary, 2, "<u4", b""), pa.string(), 3)
    rows = [r for i in range(7) for r in writer.add(pa.scalar(f"d{i}"), np.arange(4, dtype="<u4").tobytes())] + list(writer.close()) + list(writer.close())
    assert [(r["seq"], r["n_docs"], r["n_ids"]) for r in rows] == [(0, 3, 12), (1, 3, 12), (2, 1, 4)]
    files, folder = pa.fs.FileSystem.from_uri(f"file://{tmp_path}")
    parts = [p for r in rows for p in tokenfile.Shard(files, f"{folder}/{r['name']}", b"").all(rows=2)]
    assert [i for t, _ in parts for i in t["doc_id"].to_pylist()] == [f"d{i}" for i in range(7)]
    assert all(x.tolist() == [0, 1, 2, 3] for _, ids in parts for x in ids)


def test_empty_table_and_other_vocabularies(spark, vocabulary, tmp_path):
    tokenfile.write_ids(spark.createDataFrame([], "doc_id long, text string"), f"file://{tmp_path}/none", vocabulary, 2)
    assert tokenfile.digests(spark, f"file://{tmp_path}/none").collect() == []
    with open(public_tokenizers.path("byte_bpe_50k.json")) as f:
        other = f.read()
    encoder = tokenfile.Encoder(other, np.dtype(tokenfile.id_width(other, 2)))
    assert not encoder.by_word
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder.encode(TEXTS)] == [e.ids for e in encoder.library.encode_batch(TEXTS, add_special_tokens=False)]


def test_parts_of_the_older_generation_are_not_encoded_again(monkeypatch):
    """What comes again after a worker's memory was full was all encoded again before."""
    vocabulary = open(public_tokenizers.path(NAME), encoding="utf-8").read()
    encoder = tokenfile.Encoder(vocabulary, np.dtype("<u2"))
    monkeypatch.setattr(tokenfile, "REMEMBERED", 20)
    texts = [" ".join(f"{'abcdefghij'[i]}{w}" for w in ("tree", "house", "stone")) for i in range(10)]
    first = encoder.encode(texts)
    seen, library = [], encoder.library
    encoder.library = type("Counted", (), {"encode_batch_fast": lambda self, t, **o: (seen.extend(t), library.encode_batch_fast(t, **o))[1],
                                           "encode": lambda self, t, **o: (seen.append(t), library.encode(t, **o))[1]})()
    assert encoder.encode(texts) == first and not seen
    assert len(encoder.parts) + len(encoder.older) == 60
