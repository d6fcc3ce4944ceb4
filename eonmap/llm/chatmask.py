"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once. The bytes of the tokens give their offsets, which
tile the text. The spans of the turns that count for the loss and the spans of the tokens are both
sorted, so a binary search finds the tokens of each turn.

The marks of the template are special tokens of the encoding, so that no token joins a mark with
text: every token of a turn's text ends where the text ends. Text that looks like a mark is escaped,
and comes back exactly.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import slices

OPEN, SAY, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
_PART = r"((?:[^\\<]++|\\.|<(?!\|))*+)"
_TURN = re.compile(re.escape(OPEN) + _PART + re.escape(SAY) + _PART + re.escape(CLOSE) + "\n", re.S)
#: Characters encoded at once.
CHARS = 1_000_000


def escape(s: str) -> str:
    """A backslash goes before each backslash and inside ``<|``; no mark is left in the result."""
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S) if "\\" in s else s


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and where each turn's (escaped) text stands in it, in UTF-8 bytes."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{SAY}", escape(text)
        start = at + len(head.encode())
        spans.append((start, start + len(body.encode())))
        at = spans[-1][1] + len(CLOSE) + 1
        parts += [head, body, CLOSE, "\n"]
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; an error if anything else stands in it."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


class Encoder:
    """A byte-pair encoding whose special tokens are the template's marks.

    vocabulary: lines of a token in base64 and its rank. pattern: how text is split before merging.
    """

    def __init__(self, vocabulary: bytes, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        first = max(ranks.values()) + 1
        self.marks = {m: first + i for i, m in enumerate((OPEN, SAY, CLOSE))}
        self.sizes = np.zeros(first + len(self.marks), np.int64)
        self.sizes[list(ranks.values())] = [len(t) for t in ranks]
        self.sizes[first:] = [len(m) for m in self.marks]
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.marks)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and offsets of their edges in bytes: one more than ids, from 0 to the text's size."""
        ids = np.asarray(self.encoding.encode(text, allowed_special="all"), np.int64)
        return ids, np.r_[0, np.cumsum(self.sizes[ids])]


def loss_mask(edges: np.ndarray, wanted: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens overlap a wanted span, by binary search."""
    mask = np.zeros(len(edges) - 1, bool)
    for a, b in wanted:
        if a < b:
            mask[np.searchsorted(edges[1:], a, "right"):np.searchsorted(edges[:-1], b, "left")] = True
    return mask


def masked_runs(edges: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Bytes from the first token's start to the last one's end of each run of masked tokens."""
    turns = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8)))
    return list(zip(edges[turns[::2]].tolist(), edges[turns[1::2]].tolist(), strict=True))


def format_chats(rows: DataFrame, vocabulary: bytes, pattern: str, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, token_ids, mask, loss_spans (start and end in UTF-8 bytes, of the runs of masked tokens): a row a conversation.

    Rows stand in order of turn (null first), ties by role and text. Null texts and roles are empty;
    rows without a conversation id are one conversation, with a null id. A repeated row is a turn of
    its own. An empty table gives no rows; other columns are not read. One conversation is held by
    one task, since it is rendered and encoded whole. ``vocabulary`` and ``pattern``: see ``Encoder``.
    """
    model = rows.sparkSession.sparkContext.broadcast((vocabulary, pattern))
    some = rows.select(F.col(f"`{conv}`").alias("conv_id"), F.struct(
        F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).alias("t"))
    turns = some.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = turns.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    kind = turns.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*model.value)
        for batch in batches:
            roles, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in slices((sum(map(len, t)) for t in texts), CHARS):
                made = [render(list(zip(r, t, strict=True))) for r, t in zip(roles[a:b], texts[a:b], strict=True)]
                ids, masks, runs = [], [], []
                for (whole, spans), own in zip(made, roles[a:b], strict=True):
                    one, edges = encoder(whole)
                    mask = loss_mask(edges, [s for s, r in zip(spans, own, strict=True) if r in loss_roles])
                    ids.append(one)
                    masks.append(mask)
                    runs.append(masked_runs(edges, mask))
                ends = lambda xs: pa.array(np.r_[0, np.cumsum([len(x) for x in xs])].astype(np.int32))
                flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 2)
                span = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["start", "end"])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array([len(x[1]) for x in made], pa.int64()), pa.array([x[0] for x in made], pa.string()),
                    pa.ListArray.from_arrays(ends(ids), pa.array(np.concatenate(ids).astype(np.int32))),
                    pa.ListArray.from_arrays(ends(masks), pa.array(np.concatenate(masks))), pa.ListArray.from_arrays(ends(runs), span),
                ], names=["conv_id", "n_turns", "formatted", "token_ids", "mask", "loss_spans"])

    return turns.mapInArrow(work, f"conv_id {kind}, n_turns long, formatted string, token_ids array<int>, mask array<boolean>, loss_spans array<struct<start:long,end:long>>")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from formatted conversations and from the bytes of their masked tokens, as digests."""
    kind = chats.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def sha(s: str) -> str:
        return hashlib.sha256(s.encode()).hexdigest()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns, raw = read_back(whole), whole.encode()
                loss = "".join(unescape(raw[s["start"]:s["end"]].decode()) for s in spans)
                rows.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    return chats.select("conv_id", "formatted", "loss_spans").mapInArrow(
        work, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
