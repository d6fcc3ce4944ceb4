"""Files in several parts, frames that can't be decoded, and the clips of stored texts."""

import struct

import numpy as np

from eonmap.llm import avi


def frames(*levels):
    return [avi.encode_lossless(np.full((4, avi.WIDTH), v, np.uint8)) for v in levels]


def test_a_bad_frame_costs_one_frame():
    whole = avi.clips(avi.write_avi(frames(10, 10, 10, 200, 200, 200), avi.WIDTH, 4, 1))
    for bad in (b"\xff\xd8broken", b"", b"no picture"):
        made = frames(10, 10, 10, 200, 200, 200)
        made[1] = bad
        got = avi.clips(avi.write_avi(made, avi.WIDTH, 4, 1))
        assert [(c["first_frame"], c["n_frames"], c["mean"]) for c in got] == [(c["first_frame"], c["n_frames"], c["mean"]) for c in whole] == [(0, 3, 10.0), (3, 3, 200.0)]
    assert avi.clips(avi.write_avi([b"x", b"y"], avi.WIDTH, 4, 1)) == [] == avi.clips(b"RIFF")


def test_parts_after_the_first_are_read():
    first = avi.write_avi(frames(1, 2, 3, 4), avi.WIDTH, 4, 1)
    listed = b"".join(avi._chunk(b"00dc", f) for f in frames(5, 6))
    group = avi._chunk(b"LIST", b"rec " + b"".join(avi._chunk(b"00dc", f) for f in frames(7, 8)))
    second = avi._chunk(b"RIFF", b"AVIX" + avi._chunk(b"LIST", b"movi" + listed + group))
    video = avi.read_avi(first + second)
    assert [int(avi.decode_jpeg(f)[0, 0]) for f in video.frames] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert sum(c["n_frames"] for c in avi.clips(first + second)) == 8
    cut = first.replace(b"idx1", b"JUNK")  # no index
    assert len(avi.read_avi(cut + second).frames) == 8
    assert struct.unpack("<I", first[4:8])[0] + 8 == len(first)


def test_clips_of_texts_are_a_column(spark):
    text = "a" * 60_000 + "ÿ" * 30_000
    rows = spark.createDataFrame([(1, text), (2, None), (None, ""), (3, text)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in avi.text_digests(rows).collect()}
    assert got[1]["clips"] == got[3]["clips"] and len(got[1]["clips"]) >= 2 and len(got[2]["clips"]) == len(got[None]["clips"]) == 1
    for r in got.values():
        assert [c["start_s"] for c in r["clips"]] == [float(x) for x in r["feature"].split("clips=")[1].split(" ")[0].split(",")]
        assert all(a["end_s"] == b["start_s"] for a, b in zip(r["clips"], r["clips"][1:], strict=False))
    assert avi.text_digests(rows.limit(0)).count() == 0
