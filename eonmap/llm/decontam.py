"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the test items that are rare under the corpus's own word frequencies are seeds. They
are three words that stand together or with one other between, so that an item of which every third word is
edited keeps some, also where a word was put in or left out; short items have seeds of two words as well. A
document that holds a seed is aligned, around it, with the item: the local alignment score over the
score of a perfect copy says how much of the item stands there, copied, edited or paraphrased. The
frequencies are counted over all documents, and come from single words, so that an item which leaked
into very many documents does not make its own n-grams common. An item too short for an n-gram is
found where its words stand in order.

The items stand in the memory of every worker, a block of bounded size at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import slices

WORD = re.compile(r"\w+")
#: Words in a seed; bits of surprise from which an n-gram is rare; seeds that an item keeps at least.
N, BITS, LEAST_SEEDS = 3, 22.0, 8
#: Offsets of the words of a seed. Seeds of equal words are equal, whatever the offsets.
SPACED = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
#: Items of up to so many words have pairs of words as seeds too, at these offsets, unless they have so
#: few that two words alone would reach the threshold.
SHORT_ITEM, PAIRS, PAIRS_FROM = 12, ((0, 1), (0, 2), (0, 3)), 5
#: Scores of the alignment.
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of the best possible score from which a document counts as contaminated.
THRESHOLD = 0.5
#: Bytes of test items in a block.
BLOCK_BYTES = 8_000_000
#: Bytes of texts whose leaks are found at once, and whose words are counted at once.
CHARS, COUNTED = 2_000_000, 10_000_000


@dataclass
class Items:
    """A block of test items: ids, their words as numbers from 1, and the number of each word."""

    ids: list
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    has_short: bool = False
    has_pairs: bool = False


@dataclass
class Seeds:
    """Sorted codes of seeds, and for each the items and places that have it (as in a sparse matrix)."""

    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray


def numbers(text: str | None, vocabulary: dict[str, int]) -> np.ndarray:
    """The words of a text as numbers, 0 for those outside the vocabulary."""
    return np.fromiter(map(vocabulary.get, WORD.findall(text.lower()), repeat(0)), np.int64) if text else np.zeros(0, np.int64)


def number(items: list[tuple]) -> Items:
    vocabulary: dict[str, int] = {}
    words = [np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in WORD.findall((t or "").lower())], np.int64) for _, t in items]
    return Items([i for i, _ in items], words, vocabulary, any(0 < len(w) < N for w in words),
                 any(PAIRS_FROM <= len(w) <= SHORT_ITEM for w in words))


def codes_of(words: np.ndarray, v: int, offsets: tuple[int, ...] = SPACED[0]) -> np.ndarray:
    """A number for the words at ``offsets`` from each place; -1 where one is not in the vocabulary."""
    n = len(words) - offsets[-1]
    if n < 1:
        return np.zeros(0, np.int64)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for k in offsets:
        part = words[k:n + k]
        out = out * v + part
        known &= part > 0
    return np.where(known, out, -1)


def all_codes(words: np.ndarray, v: int, pairs: bool) -> tuple[np.ndarray, np.ndarray]:
    """(code, place) of all seeds that the words may hold, as they are or spaced; words outside the vocabulary make none."""
    code, place = [], []
    for offsets in (*SPACED, *PAIRS) if pairs else SPACED:
        c = codes_of(words, v, offsets)
        at = np.flatnonzero(c >= 0)
        code.append(c[at])
        place.append(at)
    return np.concatenate(code), np.concatenate(place)


def choose_seeds(items: Items, counts: np.ndarray, bits: float = BITS, least: int = LEAST_SEEDS) -> Seeds:
    """The rare n-grams of every item; of an item with few, its rarest. Short items keep all, pairs included.

    counts: occurrences in the corpus of each word, at 0 of all words outside the vocabulary.
    """
    v = len(items.vocabulary) + 1
    surprise = -np.log2((counts + 1) / (counts.sum() + v))
    code, item, place = [], [], []
    for i, w in enumerate(items.words):
        if len(w) < N:
            continue
        c, at = all_codes(w, v, PAIRS_FROM <= len(w) <= SHORT_ITEM)
        if len(w) > SHORT_ITEM:
            s = sum(surprise[c // v ** k % v] for k in range(N))
            # the rarest are counted among words that stand together
            keep = s >= min(bits, np.sort(s[:len(w) - N + 1])[::-1][min(least, len(w) - N + 1) - 1])
            c, at = c[keep], at[keep]
        code.append(c)
        item.append(np.full(len(c), i))
        place.append(at)
    if not code:
        return Seeds(*[np.zeros(0, np.int64)] * 4)
    code, item, place = np.concatenate(code), np.concatenate(item), np.concatenate(place)
    order = np.argsort(code, kind="stable")
    codes, first = np.unique(code[order], return_index=True)
    return Seeds(codes, np.r_[first, len(order)], item[order], place[order])


def short_places(words: np.ndarray, items: Items) -> list[tuple[int, int, int]]:
    """(item, start, end): where the words of each item of fewer than ``N`` words first stand."""
    out = []
    for i, w in enumerate(items.words):
        if 0 < len(w) < N <= len(words) + N - len(w):
            hit = np.all([words[k:len(words) - len(w) + 1 + k] == x for k, x in enumerate(w)], axis=0)
            if hit.any():
                out.append((i, int(hit.argmax()), int(hit.argmax()) + len(w)))
    return out


def windows(words: np.ndarray, seeds: Seeds, items: Items) -> list[tuple[int, int, int]]:
    """(item, start, end): where seeds of an item stand, with room for its other words."""
    if items.has_short:
        return short_places(words, items) + seed_windows(words, seeds, items)
    return seed_windows(words, seeds, items)


def seed_windows(words: np.ndarray, seeds: Seeds, items: Items) -> list[tuple[int, int, int]]:
    code, at = all_codes(words, len(items.vocabulary) + 1, items.has_pairs)
    if not len(at) or not len(seeds.codes):
        return []
    k = np.searchsorted(seeds.codes, code)
    k[k == len(seeds.codes)] = 0
    hit = seeds.codes[k] == code
    at, k = at[hit], k[hit]
    n = seeds.first[k + 1] - seeds.first[k]
    flat = np.repeat(seeds.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
    item, begin = seeds.item[flat], np.repeat(at, n) - seeds.place[flat]
    order = np.lexsort((begin, item))
    out: list[tuple[int, int, int]] = []
    for i, b in zip(item[order].tolist(), begin[order].tolist(), strict=True):
        m = len(items.words[i])
        room = max(3, m // 3)
        lo, hi = max(0, b - room), min(len(words), b + m + room)
        if out and out[-1][0] == i and lo <= out[-1][2] and hi - out[-1][1] <= 6 * m + 6 * room:
            out[-1] = (i, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((i, lo, hi))
    return out


def align(item: np.ndarray, passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each passage with the item, and the passage word where it ends."""
    m, c = len(item), len(passages)
    longest = max(map(len, passages))
    text = np.full((longest, c, 1), -1, np.int32)
    for i, p in enumerate(passages):
        text[:len(p), i, 0] = p
    text[text == 0] = -1  # words outside the vocabulary match nothing
    item = item.astype(np.int32)
    row, best, end = np.zeros((c, m + 1), np.int32), np.zeros(c, np.int32), np.zeros(c, int)
    new, up = np.zeros_like(row), np.empty((c, m), np.int32)
    slope = -GAP * np.arange(m + 1, dtype=np.int32)
    for j in range(longest):
        step = (item == text[j]).astype(np.int32)
        step *= MATCH - MISMATCH
        step += row[:, :-1]
        step += MISMATCH
        np.add(row[:, 1:], GAP, out=up)
        np.maximum(step, up, out=up)
        np.maximum(up, 0, out=new[:, 1:])
        np.add(new, slope, out=row)
        np.maximum.accumulate(row, axis=1, out=row)  # gaps along the item
        row -= slope
        top = row.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], j + 1
    return best, end


def may_reach(item: np.ndarray, passage: np.ndarray, there: np.ndarray, threshold: float) -> bool:
    """Whether the passage holds so many of the item's words that an alignment can score ``threshold``: no word of the item counts twice.

    there: for each word of the vocabulary False, as it is again afterwards.
    """
    there[passage] = True
    there[0] = False  # words outside the vocabulary match nothing
    held = np.count_nonzero(there[item])
    there[passage] = False
    return held / len(item) >= threshold


def score_texts(texts: list[str | None], items: Items, seeds: Seeds, threshold: float) -> list[tuple[int, int, float, int, int]]:
    """(text, item, score, window start, passage end) of the best passage for each text and item."""
    numbered, todo = [], {}
    there = np.zeros(len(items.vocabulary) + 1, bool)
    for t, text in enumerate(texts):
        words = numbers(text, items.vocabulary)
        numbered.append(words)
        for i, a, b in windows(words, seeds, items):
            if may_reach(items.words[i], words[a:b], there, threshold):
                todo.setdefault(i, []).append((t, a, b))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for i, spots in todo.items():
        spots.sort(key=lambda s: s[2] - s[1])
        for x in range(0, len(spots), 256):
            part = spots[x:x + 256]
            score, end = align(items.words[i], [numbered[t][a:b] for t, a, b in part])
            for (t, a, _), s, e in zip(part, (score / (MATCH * len(items.words[i]))).tolist(), end.tolist(), strict=True):
                if s >= threshold and s > best.get((t, i), (0.0,))[0]:
                    best[t, i] = (s, a, a + e)
    return [(t, i, *v) for (t, i), v in sorted(best.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, score, start_word, end_word: a row for each document and item that it holds.

    score: the best local alignment over that of a perfect copy, from ``threshold`` to 1. Null texts
    have no words; null ids are passed on; items of fewer than three words are found word for word,
    items without a word never. Repeated items count once, repeated documents give repeated results. An empty table on
    either side gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null").distinct()
    kinds = [some.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start_word long, end_word long"
    n_blocks = 1 + int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes
    out = None
    for block in range(n_blocks):
        # a block is a bounded share of the items: its size has been counted
        own = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == block).orderBy("item_id", "text").collect()
        found = _one_block(spark, some, number([tuple(r) for r in own]), schema, threshold)
        out = found if out is None else out.unionByName(found)
    return out


def _one_block(spark, docs: DataFrame, items: Items, schema: str, threshold: float) -> DataFrame:
    shared = spark.sparkContext.broadcast(items)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        total = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for a, b in slices(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), COUNTED):
                words = [numbers(t, vocabulary) for t in batch.column(0).slice(a, b - a).to_pylist()]
                total += np.bincount(np.concatenate(words), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["word", "n"])

    got = docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.vocabulary) + 1, np.int64)
    counts[got["word"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    chosen = spark.sparkContext.broadcast(choose_seeds(items, counts))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seeds = shared.value, chosen.value
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHARS):
                rows = score_texts(texts.slice(a, b - a).to_pylist(), own, seeds, threshold)
                if rows:
                    t, i, s, x, y = zip(*rows, strict=True)
                    ids = batch.column(0).slice(a, b - a).take(pa.array(t, pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, pa.array([own.ids[k] for k in i]), pa.array(s, pa.float64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                                                     names=["doc_id", "item_id", "score", "start_word", "end_word"])

    return docs.mapInArrow(work, schema)
