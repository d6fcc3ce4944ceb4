"""AVI motion-JPEG: RIFF index, intra frames, and timed clips between shot changes.

Reading: the RIFF chunks are walked and the idx1 index (or the movi list itself, where there is no
index) gives the frames; each frame is one JPEG. Lossless frames (SOF3) and baseline frames (SOF0)
are decoded here, since no imaging library is assumed. A cut is a histogram difference above an
adaptive threshold, taken from the differences around it.

Writing: bytes are stored as 8-bit samples of lossless JPEG frames. The Huffman code gives every
difference category s the length 9 - s, so each sample takes nine bits and both directions are
array operations; any JPEG reader with lossless support can read it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, ROWS, FPS = 64, 48, 25
#: Zigzag order of an 8 x 8 block, by the rule of the standard: along diagonals, turning each time.
ZIGZAG = np.array([r * 8 + c for d in range(15) for r, c in sorted(((r, d - r) for r in range(8) if 0 <= d - r < 8), key=lambda x: x[d % 2])])
#: An index entry flag: key frame.
KEYFRAME = 0x10


# ---------------------------------------------------------------- JPEG
def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Category s in 0..8 has a code of 9 - s bits: lengths 1 to 9 belong to 8 down to 0.
CODE_LENGTHS = bytes([1] * 9 + [0] * 7)
CODE_SYMBOLS = bytes(range(8, -1, -1))


def _code_table() -> np.ndarray:
    """Nine bits for each difference from -255 to 255: the category's code, then its value bits."""
    out = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        s = abs(diff).bit_length()
        code = (1 << (9 - s)) - 2  # 0, 10, 110, ...
        out[diff + 255] = code << s | (diff if diff >= 0 else diff + (1 << s) - 1)
    return out


CODES = _code_table()
DIFF_OF = np.zeros(512, np.int16)
DIFF_OF[CODES] = np.arange(-255, 256)


def encode_lossless(frame: np.ndarray) -> bytes:
    """A grey 8-bit image as a lossless JPEG with the left neighbour as predictor."""
    h, w = frame.shape
    x = frame.astype(np.int16)
    diff = np.empty_like(x)
    diff[:, 1:] = x[:, 1:] - x[:, :-1]
    diff[1:, 0] = x[1:, 0] - x[:-1, 0]
    diff[0, 0] = x[0, 0] - 128
    bits = np.unpackbits(CODES[diff.ravel() + 255].astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)[:, 7:].ravel()
    if extra := -len(bits) % 8:
        bits = np.r_[bits, np.ones(extra, np.uint8)]
    data = np.packbits(bits).tobytes().replace(b"\xff", b"\xff\x00")
    head = b"\xff\xd8" + _segment(0xC3, struct.pack(">BHHB3B", 8, h, w, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + CODE_LENGTHS + CODE_SYMBOLS)
    return head + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0])) + data + b"\xff\xd9"


def _decode_tree(lengths: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.value, self.left = int.from_bytes(data, "big"), len(data) * 8
        self.data = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0

    def take(self, n: int) -> int:
        part = self.data[self.at:self.at + n]
        if len(part) < n:
            part = np.r_[part, np.ones(n - len(part), np.uint8)]
        self.at += n
        v = 0
        for b in part.tolist():
            v = v << 1 | b
        return v

    def symbol(self, tree: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in tree:
                return tree[n, code]
        raise ValueError("bad Huffman code")

    def signed(self, s: int) -> int:
        if not s:
            return 0
        v = self.take(s)
        return v if v >> (s - 1) else v - (1 << s) + 1


@dataclass
class _Header:
    kind: int
    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # id, horizontal and vertical sampling, quantisation table


def decode_jpeg(data: bytes) -> np.ndarray:
    """The samples of a JPEG frame: its first component (grey or luma) as a height x width array."""
    at, head, quant, trees, restart = 2, None, {}, {}, 0
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    while at + 4 <= len(data):
        marker, size = data[at + 1], int.from_bytes(data[at + 2:at + 4], "big")
        body, at = data[at + 4:at + 2 + size], at + 2 + size
        if marker in (0xC0, 0xC1, 0xC3):
            _, h, w, n = struct.unpack(">BHHB", body[:6])
            head = _Header(marker, h, w, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)])
        elif 0xC0 < marker < 0xD0 and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError(f"JPEG process {marker:#x} is not supported")
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 64 * (1 + wide)
                quant[body[0] & 15] = np.frombuffer(body[1:1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                trees[body[0]] = (body[1:17], body[17:17 + n])
                body = body[17 + n:]
        elif marker == 0xDD:
            restart = int.from_bytes(body, "big")
        elif marker == 0xDA:
            break
    if head is None:
        raise ValueError("no frame header")
    end = data.rfind(b"\xff\xd9")
    coded = data[at:end if end >= at else len(data)]
    if head.kind == 0xC3:
        return _decode_lossless(head, coded.replace(b"\xff\x00", b"\xff"), trees[body[2] >> 4], body[-3])
    return _decode_baseline(head, coded, body, trees, quant, restart)


def _decode_lossless(head: _Header, coded: bytes, table: tuple[bytes, bytes], predictor: int) -> np.ndarray:
    h, w = head.height, head.width
    if len(head.parts) != 1 or predictor != 1:
        raise ValueError("only one component with the left predictor is supported")
    n = h * w
    if table == (CODE_LENGTHS, CODE_SYMBOLS):  # each sample has nine bits
        bits = np.unpackbits(np.frombuffer(coded, np.uint8), count=9 * n).reshape(n, 9)
        code = np.packbits(bits, axis=1).view(">u2").ravel() >> 7
        diff = DIFF_OF[code].astype(np.int64)
    else:
        tree, read = _decode_tree(*table), _Bits(coded)
        diff = np.array([read.signed(read.symbol(tree)) for _ in range(n)], np.int64)
    diff = diff.reshape(h, w)
    diff[0, 0] += 128
    diff[:, 0] = np.cumsum(diff[:, 0])
    return (np.cumsum(diff, axis=1) & 255).astype(np.uint8)


def _basis() -> np.ndarray:
    k = np.arange(8)
    c = np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    return c


def _decode_baseline(head: _Header, coded: bytes, scan: bytes, trees: dict, quant: dict, restart: int) -> np.ndarray:
    own = {scan[1 + 2 * i]: (scan[2 + 2 * i] >> 4, scan[2 + 2 * i] & 15) for i in range(scan[0])}
    built = {k: _decode_tree(*v) for k, v in trees.items()}
    hmax, vmax = max(p[1] for p in head.parts), max(p[2] for p in head.parts)
    if len(head.parts) == 1:
        head.parts = [(head.parts[0][0], 1, 1, head.parts[0][3])]
        hmax = vmax = 1
    across, down = -(-head.width // (8 * hmax)), -(-head.height // (8 * vmax))
    first = head.parts[0]
    out = np.zeros((down * vmax * 8, across * hmax * 8))
    basis = _basis()
    runs = [coded]
    if restart:
        runs, at = [], 0
        for i in range(len(coded) - 1):
            if coded[i] == 0xFF and 0xD0 <= coded[i + 1] <= 0xD7:
                runs.append(coded[at:i])
                at = i + 2
        runs.append(coded[at:])
    unit = 0
    for run in runs:
        read, dc = _Bits(run.replace(b"\xff\x00", b"\xff")), {p[0]: 0 for p in head.parts}
        for _ in range(restart or across * down):
            if unit >= across * down:
                break
            my, mx = divmod(unit, across)
            unit += 1
            for name, hs, vs, q in head.parts:
                td, ta = own[name]
                for by in range(vs):
                    for bx in range(hs):
                        block = np.zeros(64, np.int64)
                        dc[name] += read.signed(read.symbol(built[td]))
                        block[0], k = dc[name], 1
                        while k < 64:
                            rs = read.symbol(built[16 + ta])
                            if rs == 0:
                                break
                            k += rs >> 4
                            if rs & 15 and k < 64:
                                block[k] = read.signed(rs & 15)
                            k += 1
                        if name == first[0]:
                            plain = np.zeros(64)
                            plain[ZIGZAG] = block * quant[q]
                            y, x = (my * vs + by) * 8, (mx * hs + bx) * 8
                            out[y:y + 8, x:x + 8] = basis @ plain.reshape(8, 8) @ basis.T + 128
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)[:head.height, :head.width]


# ---------------------------------------------------------------- AVI
def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\x00" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int, height: int, n_samples: int, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames with an index. ``n_samples``: samples that count, kept in INFO."""
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, KEYFRAME, len(frames), 0, 1, most, width, height, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, fps, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, width, height)
    bitmap = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    head = b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", bitmap))
    info = b"INFO" + _chunk(b"ISBJ", b"samples=%d" % n_samples)
    parts, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        parts.append(c)
        index.append(struct.pack("<4sIII", b"00dc", KEYFRAME, at, len(f)))
        at += len(c)
    body = b"AVI " + _chunk(b"LIST", head) + _chunk(b"LIST", info) + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", b"".join(index))
    return _chunk(b"RIFF", body)


@dataclass
class Video:
    fps: float
    width: int
    height: int
    n_samples: int | None
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4:at + 8], "little")
        yield data[at:at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def read_avi(data: bytes) -> Video:
    """Frames in order by the idx1 index; without one, by the movi list. Unknown chunks are passed over.

    Parts that follow the first (AVIX), which its index does not cover, are read by their own lists.
    """
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    fps, width, height, n, movi, index = float(FPS), 0, 0, None, None, None
    more: list[bytes] = []
    for name, a, b in _chunks(data, 12, len(data)):
        kind = data[a:a + 4] if name == b"LIST" else b""
        if kind == b"hdrl":
            for sub, x, y in _chunks(data, a + 4, b):
                if sub == b"avih":
                    width, height = struct.unpack("<II", data[x + 32:x + 40])
                elif sub == b"LIST" and data[x:x + 4] == b"strl":
                    for own, p, _ in _chunks(data, x + 4, y):
                        if own == b"strh" and data[p:p + 4] == b"vids":
                            scale, rate = struct.unpack("<II", data[p + 20:p + 28])
                            fps = rate / scale if scale else fps
        elif kind == b"INFO":
            for sub, x, y in _chunks(data, a + 4, b):
                if sub == b"ISBJ" and data[x:x + 8] == b"samples=":
                    n = int(data[x + 8:y])
        elif kind == b"movi":
            movi = (a, b)
        elif name == b"RIFF" and data[a:a + 4] == b"AVIX":
            for sub, x, y in _chunks(data, a + 4, b):
                if sub == b"LIST" and data[x:x + 4] == b"movi":
                    more += _listed(data, x + 4, y)
        elif name == b"idx1":
            index = data[a:b]
    if movi is None:
        raise ValueError("no movi list")
    if index is not None:
        found = [struct.unpack("<4sIII", index[i:i + 16]) for i in range(0, len(index) - 15, 16)]
        # offsets count from the list's name, or in some files from the start of the file
        base = 0 if found and found[0][2] >= movi[0] and data[found[0][2]:found[0][2] + 4] == found[0][0] else movi[0]
        frames = [data[base + at + 8:base + at + 8 + size] for name, _, at, size in found if name[2:] in (b"dc", b"db")]
    else:
        frames = _listed(data, movi[0] + 4, movi[1])
    return Video(fps, width, height, n, frames + more)


def _listed(data: bytes, start: int, end: int) -> list[bytes]:
    """Frames of a movi list in order, those in groups (rec) too."""
    out: list[bytes] = []
    for name, a, b in _chunks(data, start, end):
        if name == b"LIST" and data[a:a + 4] == b"rec ":
            out += _listed(data, a + 4, b)
        elif name[2:] in (b"dc", b"db"):
            out.append(data[a:b])
    return out


# ---------------------------------------------------------------- samples and shots
def store(payload: bytes) -> bytes:
    """Bytes (a positive multiple of WIDTH) as samples of an AVI file; frames are equally high."""
    rows = len(payload) // WIDTH
    n = -(-rows // ROWS)
    height = -(-rows // n)
    x = np.full(n * height * WIDTH, 32, np.uint8)
    x[:len(payload)] = np.frombuffer(payload, np.uint8)
    return write_avi([encode_lossless(f) for f in x.reshape(n, height, WIDTH)], WIDTH, height, len(payload))


def histograms(frames: list[np.ndarray], bins: int = 32) -> np.ndarray:
    """Share of the samples in each bin, a row a frame."""
    return np.array([np.bincount(f.ravel() * bins // 256 if f.dtype != np.uint8 else (f.ravel() >> (8 - bins.bit_length() + 1)), minlength=bins) / f.size for f in frames])


def cuts(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.25) -> list[int]:
    """Frames that begin a shot, 0 first: their difference from the frame before (half the sum of
    absolute bin differences) is ``least`` or more and above mean plus ``factor`` deviations of the
    other differences within ``window`` frames."""
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    out = [0]
    for i in np.flatnonzero(d >= least).tolist():
        near = np.r_[d[max(0, i - window):i], d[i + 1:i + 1 + window]]
        if not len(near) or d[i] > near.mean() + factor * near.std():
            out.append(i + 1)
    return out


CLIP = "struct<clip:bigint,first_frame:bigint,n_frames:bigint,start_s:double,end_s:double,mean:double>"


def timed(frames: list[np.ndarray | None], fps: float) -> list[dict]:
    """Clips of frames, of which those that could not be decoded are null.

    A null frame keeps its place in time and belongs to the clip that it falls in; shots are told by the others.
    """
    good = [i for i, f in enumerate(frames) if f is not None]
    if not good:
        return []
    at = [0, *(good[i] for i in cuts(histograms([frames[i] for i in good]))[1:])]
    means = np.array([np.nan if f is None else f.mean() for f in frames])
    return [{"clip": i, "first_frame": a, "n_frames": b - a, "start_s": a / fps, "end_s": b / fps, "mean": float(np.nanmean(means[a:b]))}
            for i, (a, b) in enumerate(zip(at, [*at[1:], len(frames)], strict=True))]


def clips(data: bytes | None) -> list[dict]:
    """Timed clips of an AVI file; none for null or for a file of another format, or of which no frame can be decoded."""
    if not data:
        return []
    try:
        video = read_avi(data)
    except (ValueError, KeyError, struct.error, IndexError):
        return []
    frames: list[np.ndarray | None] = []
    for f in video.frames:
        try:
            frames.append(decode_jpeg(f) if f else None)
        except (ValueError, KeyError, struct.error, IndexError):
            frames.append(None)
    return timed(frames, video.fps)


def clip_rows(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per clip of each AVI file: id, clip, first_frame, n_frames, start_s, end_s, mean.

    Null or unreadable media and files without frames give no rows. Repeated rows repeat their
    clips; an empty table gives no rows; other columns are not read.
    """
    some = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{media_col}`").alias("media"))
    kind = some.schema["id"].dataType.simpleString()
    names = ["clip", "first_frame", "n_frames", "start_s", "end_s", "mean"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = clips(batch.column(1)[i].as_py())
                if rows:
                    own = pa.array([batch.column(0)[i].as_py()] * len(rows), batch.column(0).type)
                    yield pa.RecordBatch.from_arrays([own, *[pa.array([r[n] for r in rows]) for n in names]], names=["id", *names])

    return some.mapInArrow(work, f"id {kind}, clip long, first_frame long, n_frames long, start_s double, end_s double, mean double")


#: A payload is a positive multiple of so many bytes.
UNIT = 192


def text_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as an AVI file, reads the file back and describes it, a row a document; ``clips`` are its timed clips.

    A null text is empty; ids may be null; repeated rows give repeated results and equal texts equal
    values; an empty table gives no rows. A long text is many frames, held one document at a time.
    """
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<{CLIP}>"
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
    clip = pa.struct([*((n, pa.int64()) for n in ("clip", "first_frame", "n_frames")), *((n, pa.float64()) for n in ("start_s", "end_s", "mean"))])

    def digest(text: str | None) -> tuple:
        raw = (text or "").encode()
        media = store(raw + b" " * (-len(raw) % UNIT if raw else UNIT))
        video = read_avi(media)
        frames = [decode_jpeg(f) for f in video.frames]
        back = b"".join(f.tobytes() for f in frames)[:video.n_samples]
        found = timed(frames, video.fps)
        feature = f"frames={len(frames)} size={video.width}x{video.height} clips={','.join(f'{c['start_s']:g}' for c in found)} end={len(frames) / video.fps:g}"
        return len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, found

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(batch.column(1)[i].as_py()) for i in range(batch.num_rows)]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(clip)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return some.mapInArrow(work, schema)
