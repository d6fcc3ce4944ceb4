"""Token counts of a BPE piece vocabulary by rank-synchronous array merging.

Pre-tokens that no piece can span are counted one by one and remembered. The new ones of a batch
stand in ragged numpy arrays, and in each round every sequence joins its lowest-rank pair (the
leftmost of equals), all sequences at once; the symbols that survive are the tokens. This is the
order in which the library joins pairs, so counts are the same.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import slices

SPACE = "▁"
NONE = np.int32(2**31 - 1)
#: Pre-tokens remembered by a worker, and characters of text that it takes at once.
REMEMBERED, CHARS = 600_000, 2_000_000
#: In sequences of more symbols a round joins all pairs of the lowest rank, and not one of each sequence.
LONG = 200


class PieceTable:
    """Which pairs of symbols join to a piece, and at what rank."""

    def __init__(self, pieces: Iterable[tuple[str, float]]):
        """pieces: the ordinary pieces and their scores; a higher score joins earlier."""
        score = dict(pieces)
        self.ids = {p: i for i, p in enumerate(score)}
        for p in score:
            for ch in p:
                self.ids.setdefault(ch, len(self.ids))
        _, level = np.unique(-np.fromiter(score.values(), float, len(score)), return_inverse=True)
        rank = dict(zip(score, level.tolist(), strict=True))
        self.n = len(self.ids) + 1  # the last id stands for any character that no piece has
        pairs = [(self.ids[p[:i]] * self.n + self.ids[p[i:]], rank[p], self.ids[p])
                 for p in score for i in range(1, len(p)) if p[:i] in self.ids and p[i:] in self.ids]
        pairs.sort()
        self.keys = np.array([x[0] for x in pairs], np.int64)
        self.ranks = np.array([x[1] for x in pairs] + [NONE], np.int32)
        self.made = np.array([x[2] for x in pairs] + [-1], np.int32)
        self.char_ids = np.full(0x110000, self.n - 1, np.int32)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.within = {p[i:i + 2] for p in score for i in range(len(p) - 1)}
        self.known = frozenset(score)
        #: Whether a line end or a space inside a text always ends a piece.
        self.plain = not any("\n" in p or " " in p or SPACE in p.lstrip(SPACE) for p in score)

    @classmethod
    def from_model(cls, model: bytes) -> PieceTable:
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(model)
        n = m.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not m.trainer_spec.byte_fallback:
            raise ValueError("only vocabularies with byte fallback and without normalisation are supported")
        if any(p.type == p.USER_DEFINED for p in m.pieces):
            raise ValueError("user-defined pieces are not supported")
        return cls((p.piece, p.score) for p in m.pieces if p.type == p.NORMAL)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair in ranks and made; the last place if the pair joins to nothing."""
        key = left.astype(np.int64) * self.n + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys)) if len(self.keys) else np.zeros(len(key), int)

    def parts(self, token: str) -> list[str]:
        """The token cut between characters that no piece has side by side."""
        cuts = [i for i in range(1, len(token)) if token[i - 1:i + 1] not in self.within]
        return [token[a:b] for a, b in zip([0, *cuts], [*cuts, len(token)], strict=True)]

    def bytes_of(self, ch: str) -> int:
        return 1 if ch in self.known else len(ch.encode())

    def count(self, tokens: list[str]) -> list[int]:
        """Number of symbols that survive in each token."""
        if max(map(len, tokens), default=0) <= LONG:
            return self.count_batch(tokens).tolist()
        out = np.zeros(len(tokens), np.int64)
        owner: tuple[list[int], list[int]] = ([], [])
        seqs: tuple[list[str], list[str]] = ([], [])
        for i, t in enumerate(tokens):
            for p in self.parts(t) if len(t) > LONG else [t]:
                which = 1 if len(p) > LONG else 0
                owner[which].append(i)
                seqs[which].append(p)
        np.add.at(out, np.array(owner[0], int), self.count_batch(seqs[0]))
        np.add.at(out, np.array(owner[1], int), self.count_long(seqs[1]))
        return out.tolist()

    def count_batch(self, seqs: list[str]) -> np.ndarray:
        size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        whole = "".join(seqs)
        sym = self.char_ids[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        seq = np.repeat(np.arange(len(seqs)), size)
        out = np.zeros(len(seqs), np.int64)
        for i in np.flatnonzero(sym >= len(self.known)).tolist():  # no piece: one token a byte
            out[seq[i]] += len(whole[i].encode()) - 1
        place = np.full(len(sym), len(self.keys))
        inner = np.flatnonzero(seq[1:] == seq[:-1])
        place[inner] = self.lookup(sym[inner], sym[inner + 1])
        rank = self.ranks[place]
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            lens = np.diff(np.r_[starts, len(seq)])
            low = np.minimum.reduceat(rank, starts)
            done = low == NONE
            if done.any():
                out[seq[starts[done]]] += lens[done]
                stay = np.repeat(~done, lens)
                sym, seq, rank, place, low, lens = sym[stay], seq[stay], rank[stay], place[stay], low[~done], lens[~done]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, lens))
            hit = hit[np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]]  # the leftmost of each sequence
            sym[hit] = self.made[place[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            at = np.cumsum(keep)[hit] - 1
            sym, seq, rank, place = sym[keep], seq[keep], rank[keep], place[keep]
            for left in (at - 1, at):
                left = left[left >= 0]
                right = np.minimum(left + 1, len(sym) - 1)
                found = self.lookup(sym[left], sym[right])
                found[(seq[left] != seq[right]) | (left == right)] = len(self.keys)
                place[left], rank[left] = found, self.ranks[found]
        return out

    def count_long(self, seqs: list[str]) -> np.ndarray:
        """The same for long sequences: rank after rank, the pairs of a rank in all sequences at once.

        Pairs wait in arrays by rank, so that a round costs what it joins, however long the sequences
        are. Of pairs of one rank that overlap the leftmost go first; where a join makes a pair of the same
        or a lower rank, what stands behind it in its sequence waits for the next round.
        """
        size = np.fromiter(map(len, seqs), np.int64, len(seqs))
        whole = "".join(seqs)
        total, none = len(whole), len(self.keys)
        sym = np.append(self.char_ids[np.frombuffer(whole.encode("utf-32-le"), np.uint32)], -1)
        seq = np.append(np.repeat(np.arange(len(seqs)), size), -1)
        out = size.copy()
        for i in np.flatnonzero(sym[:total] >= len(self.known)).tolist():  # no piece: one token a byte
            out[seq[i]] += len(whole[i].encode()) - 1
        # places ``total`` and -1 are the end mark, whose sequence is no other's
        after, before = np.arange(1, total + 2), np.arange(-1, total)
        after[total] = total
        alive = np.ones(total + 1, bool)
        place = np.full(total + 1, none)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def wait(at: np.ndarray) -> None:
            rank = self.ranks[place[at]]
            at, rank = at[rank != NONE], rank[rank != NONE]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            edges = np.flatnonzero(np.r_[True, rank[1:] != rank[:-1]]).tolist()
            for x, y in zip(edges, [*edges[1:], len(at)], strict=True):
                r = int(rank[x])
                if r not in waiting:
                    waiting[r] = []
                    heapq.heappush(ranks, r)
                waiting[r].append(at[x:y])

        def pairs(left: np.ndarray, right: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return np.where(seq[left] == seq[right], self.lookup(a, b), none)

        every = np.arange(total)
        place[:total] = pairs(every, every + 1, sym[:total], sym[1:])
        wait(every)
        while ranks:
            r = heapq.heappop(ranks)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[alive[at] & (self.ranks[place[at]] == r)]
            if not len(at):
                continue
            # every second one of a run of overlapping pairs
            heads = np.r_[True, at[1:] != after[at[:-1]]]
            hit = at[(np.arange(len(at)) - np.flatnonzero(heads)[np.cumsum(heads) - 1]) % 2 == 0]
            made, right = self.made[place[hit]], after[hit]
            joined = np.r_[False, before[hit[1:]] == right[:-1]]  # the pair before has just been joined
            left = np.where(joined, np.r_[-1, hit[:-1]], before[hit])
            left_sym = np.where(joined, np.r_[-1, made[:-1]], sym[left])
            behind = after[right]
            low = np.minimum(self.ranks[pairs(left, hit, left_sym, made)], self.ranks[pairs(hit, behind, made, sym[behind])]) <= r
            passed = np.cumsum(low) - low
            first = np.r_[True, seq[hit[1:]] != seq[hit[:-1]]]
            now = passed == passed[np.flatnonzero(first)[np.cumsum(first) - 1]]
            if not now.all():
                wait(at[~np.isin(at, hit[now])])
                hit, made, right, behind = hit[now], made[now], right[now], behind[now]
            sym[hit] = made
            alive[right] = False
            place[right] = none
            after[hit] = behind
            before[behind] = hit
            np.subtract.at(out, seq[hit], 1)
            near = np.unique(np.r_[hit, before[hit]])
            near = near[(near >= 0) & alive[near]]
            place[near] = pairs(near, after[near], sym[near], sym[after[near]])
            wait(near)
        return out


#: A run of space marks with the word behind it.
RUNS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Counter:
    """Counts whole texts; remembers the counts of pre-tokens up to a bound."""

    def __init__(self, table: PieceTable, remembered: int = REMEMBERED):
        self.table, self.remembered = table, remembered
        self.after_space: dict[str, int] = {}
        self.bare: dict[str, int] = {}
        self.line_end = table.bytes_of("\n")

    def _split(self, text: str) -> tuple[list[str], list[str], int]:
        """Words behind one space, other pre-tokens, and line ends."""
        if not self.table.plain:
            return [], RUNS.findall(SPACE + text.replace(" ", SPACE)), 0
        spaced: list[str] = []
        bare: list[str] = []
        lines = (" " + text).split("\n")
        for line in lines:
            if "  " in line or line.endswith(" ") or SPACE in line:
                bare += RUNS.findall(line.replace(" ", SPACE))
            elif line:
                words = line.split(" ")
                if words[0]:
                    bare.append(words[0])
                spaced += words[1:]
        return spaced, bare, len(lines) - 1

    def _learn(self, known: dict[str, int], new: set[str], prefix: str) -> None:
        todo = list(new)
        for a, b in slices(map(len, todo), 200_000):
            known.update(zip(todo[a:b], self.table.count([prefix + w for w in todo[a:b]]), strict=True))

    def count(self, texts: list[str | None]) -> list[int]:
        split = [self._split(t) if t else ([], [], 0) for t in texts]
        for known in (self.after_space, self.bare):
            if len(known) > self.remembered:
                known.clear()
        for known, k, prefix in ((self.after_space, 0, SPACE), (self.bare, 1, "")):
            new: set[str] = set()
            for s in split:
                new.update(s[k])
            self._learn(known, new.difference(known), prefix)
        one, two = self.after_space.__getitem__, self.bare.__getitem__
        return [sum(map(one, a)) + sum(map(two, b)) + n * self.line_end for a, b, n in split]


def count_tokens(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs``, whole texts.

    Nulls: a null text counts as empty (0 bytes, 0 tokens), a null id stays null. Repeated rows give
    repeated results, an empty table an empty one; other columns are not read. Very long texts and
    words are exact. ``model``: the bytes of the vocabulary file,
    whose tables (a few MB, fixed by the vocabulary) go to the executors.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(PieceTable.from_model(model))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a worker that is used again keeps what it has counted
        counter = table.value.__dict__.setdefault("counter", Counter(table.value))
        for batch in batches:
            texts = batch.column(1)
            sizes = np.nan_to_num(pa.compute.binary_length(texts).to_numpy(zero_copy_only=False)).astype(np.int64)
            n: list[int] = []
            for a, b in slices(sizes.tolist(), CHARS):
                n += counter.count(texts.slice(a, b - a).to_pylist())
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), tokens, pa.compute.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()
    return some.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
