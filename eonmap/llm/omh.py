"""Near-duplicate classes by Order MinHash and banded alignment.

A document's word 3-grams are labelled with their occurrence number and hashed, in each of several
rounds, into bins. A sample is the two least k-mers of a bin, kept in the order of the text;
documents with an equal sample are candidates. This is sensitive to edit similarity, since a copy
with moved parts has other orders. Candidates are verified by a banded alignment of their words:
similarity is 1 less edits over the words of the longer text, and a link needs 0.8 or more.

Three words a k-mer, since edits spread evenly at similarity 0.8 leave no five words in a row; texts
whose five-word shingles are alike share far more of their 3-grams.

Texts of equal words are one node from the start. In a bucket every node is first held against the
bucket's least and greatest node; of these pairs the likeliest of each node is verified first. Further
rounds hold all nodes of a bucket against one more of its nodes, as long as that finds links. Then
all pairs of a small bucket whose nodes still lie in different classes follow.

In a large bucket (a passage that many documents share) comparing all pairs would grow with the square
of its size. All nodes of large buckets that lie apart after the rounds are candidates by their first words: ordered by rarity, two texts
alike have one of those in common, so that none is missed. Who shares one is marked in blocks of texts of like length,
where a pair costs little however many words it shares, and bits of words tell most of the marked ones apart.
Short texts, of which samples miss some, are candidates by their rare words as well, without samples:
by the number of edits that a link allows, texts that are alike share one of those, so that none is
missed.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import hot_join, materialise, materialise_by, release, row_key, shuffles_freed, slices

WORD = re.compile(r"\w+")
#: Words in a k-mer; rounds of hashing and bins in each, of which every one gives a sample; similarity of a link.
K, ROUNDS, BINS, SIMILARITY = 3, 4, 12, 0.8
#: Words remembered by a worker; characters taken at once.
REMEMBERED, CHARS = 1_000_000, 1_000_000
#: Words of a text up to which all that are alike are found, whatever their samples.
SHORT = 50
#: Rounds at most in which a bucket's nodes are held against one more of them.
PIVOTS = 1
#: Bins of a text's words, by which pairs that can't be alike are found before their texts are fetched.
WORD_BINS = 128
#: Numbers of 64 bits for a text's words, by which more such pairs are found, once a pair; the least for a text, and words to each.
WORD_LONGS, LONG_WORDS = 64, 8
#: Bytes of such bits in a block of texts, of which two meet in a task; pairs that are held at once.
BLOCK_BYTES, BLOCK_PAIRS = 4_000_000, 2_000_000
#: Nodes in a bucket up to which all pairs are compared; of larger ones, whose nodes share many, every so many-th takes part in rounds.
SMALL, THIN = 16, 4
#: Features of a text outside shared passages, and classes that share one of them up to which they may join nodes.
OWN, FEW = 40, 20
#: First words of a text, those of least hash, by which a pair that comes by several words is known; more would only spare repetitions.
LEAST_WORDS = 16
#: Rows up to which a join needs no care for hot keys, and tasks that such rows are dealt to: their rounds are many, and
#: a task has costs of its own (files, log, what the driver keeps of it).
FEW_ROWS, FEW_TASKS = 100_000, 4
#: Nodes by which words are ordered, and words known as frequent; the order changes costs, not results.
ORDER_NODES, FREQUENT = 20_000, 200_000
#: Bits of a k-mer's hash by which the least are found (ties go to the first in the text), and of its bin.
HASH_BITS, BIN_BITS = 26, 4


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class _Known(dict[str, int]):
    def __missing__(self, word: str) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


class Hasher:
    """64-bit hashes of words, remembered up to a bound (and what one call adds)."""

    def __init__(self, remembered: int = REMEMBERED):
        self.known = _Known()
        self.remembered = remembered

    def __call__(self, words: list[str]) -> np.ndarray:
        if len(self.known) > self.remembered:
            self.known = _Known()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams_of(hashes: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k-mers of texts of one word or more, labelled with their occurrence number; starts and sizes."""
    n = np.array([len(h) for h in hashes])
    size = np.maximum(n - k + 1, 1)
    starts = np.cumsum(size) - size
    grams = np.empty(int(size.sum()), np.uint64)
    power = np.uint64(0xD6E8FEB86659FD93)
    for h, s, m in zip(hashes, starts.tolist(), size.tolist(), strict=True):
        g = np.zeros(m, np.uint64)
        for j in range(min(k, len(h))):
            g = g * power + h[j:j + m]
        grams[s:s + m] = g
    grams = _mix(grams)
    doc = np.repeat(np.arange(len(hashes), dtype=np.uint64), size)
    # the occurrence number of each k-mer in its text
    own = _mix(grams + doc * np.uint64(0xA0761D6478BD642F))
    order = np.argsort(own, kind="stable")
    run = np.r_[True, own[order][1:] != own[order][:-1]]
    number = np.arange(len(own)) - np.maximum.accumulate(np.where(run, np.arange(len(own)), 0))
    if number.any():
        labelled = grams.copy()
        labelled[order] += number.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)
        grams = labelled
    return grams, starts, size


def sketch(hashes: list[np.ndarray], rounds: int = ROUNDS, k: int = K, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """Order MinHash of texts of one word or more: the number of samples of each text, and all samples."""
    return sketch_places(hashes, rounds, k, bins)[:2]


def sketch_places(hashes: list[np.ndarray], rounds: int = ROUNDS, k: int = K, bins: int = BINS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``sketch``, with the places in the text of both k-mers of each sample.

    A bin of fewer than two k-mers gives no sample. One sort a round serves all bins of all texts.
    """
    grams, starts, size = grams_of(hashes, k)
    place_bits = len(grams).bit_length()
    if len(hashes).bit_length() + BIN_BITS + HASH_BITS + place_bits > 64:
        half = len(hashes) // 2
        parts = sketch_places(hashes[:half], rounds, k, bins), sketch_places(hashes[half:], rounds, k, bins)
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    u = np.uint64
    doc = np.repeat(np.arange(len(hashes), dtype=u), size) << u(BIN_BITS + HASH_BITS + place_bits) | np.arange(len(grams), dtype=u)
    texts, found, places = [], [], []
    for i in range(rounds):
        v = _mix(grams + u(0x632BE59BD9B4E019 * (i + 1) % 2**64))
        own_bin = (v >> u(40)) * u(bins) >> u(24)
        ranked = doc | own_bin << u(HASH_BITS + place_bits) | (v & u((1 << HASH_BITS) - 1)) << u(place_bits)
        ranked.sort()
        of = ranked >> u(HASH_BITS + place_bits)
        same = np.r_[of[1:] == of[:-1], False]
        first = np.flatnonzero(same & np.r_[True, ~same[:-1]])
        a, b = (ranked[x] & u((1 << place_bits) - 1) for x in (first, first + 1))
        found.append(_mix(_mix(grams[np.minimum(a, b)] + u(i + 1)) + grams[np.maximum(a, b)]).view(np.int64))
        texts.append((of[first] >> u(BIN_BITS)).astype(np.int64))
        places.append(np.stack([a, b], axis=1).astype(np.int64) - starts[texts[-1]][:, None])
    text = np.concatenate(texts)
    order = np.argsort(text, kind="stable")
    return np.bincount(text, minlength=len(hashes)), np.concatenate(found)[order], np.concatenate(places)[order]


def own_words(n: int, places: np.ndarray, shared: np.ndarray, k: int = K) -> np.ndarray:
    """Which of a text's ``n`` words lie outside the stretches that its shared samples mark.

    A stretch runs from one k-mer of shared samples to the next, where no k-mer of another sample lies between.
    """
    own = np.ones(n, bool)
    hot, cold = np.unique(places[shared]), np.unique(places[~shared])
    for at in range(k):
        own[np.minimum(hot + at, n - 1)] = False
    begin, end = hot[:-1], hot[1:]
    for a, b in zip(begin, end, strict=True):
        if np.searchsorted(cold, a, "right") == np.searchsorted(cold, b, "left"):
            own[a:b] = False
    return own


def own_features(h: np.ndarray, own: np.ndarray, most: int = OWN) -> np.ndarray:
    """The least of the hashes of a text's own words, and of neighbours and next but one among them."""
    u = np.uint64
    one = _mix(h[own] + u(0x2545F4914F6CDD1D))
    pairs = [_mix(_mix(h[:-d] * u(2 * d + 1) + u(d)) + h[d:])[own[:-d] & own[d:]] for d in (1, 2) if len(h) > d]
    return np.unique(np.concatenate([one, *pairs]))[:most].view(np.int64)


def word_bins(hashes: list[np.ndarray], bins: int = WORD_BINS) -> np.ndarray:
    """How many words of each text fall in each of ``bins`` bins, up to 127; an edit changes one count by one, or two."""
    of = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
    at = (np.concatenate(hashes) >> np.uint64(40)).astype(np.int64) % bins if len(of) else of
    return np.minimum(np.bincount(of * bins + at, minlength=len(hashes) * bins), 127).astype(np.int8)


def word_bits(hashes: list[np.ndarray], longs: int = WORD_LONGS) -> np.ndarray:
    """A bit for each word of a text, labelled with its occurrence number, as ``longs`` numbers a text; an edit changes one word for one."""
    words, _, size = grams_of(hashes, 1)
    of, at = np.repeat(np.arange(len(hashes)), size), words >> np.uint64(40)
    out = np.zeros(len(hashes) * longs, np.uint64)
    np.bitwise_or.at(out, of * longs + (at // np.uint64(64) % np.uint64(longs)).astype(np.int64), np.uint64(1) << at % np.uint64(64))
    return out.view(np.int64)


def bands_of(n: np.ndarray, similarity: float) -> np.ndarray:
    """Bands of lengths: texts alike lie in one band or in neighbours."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(1.01 / similarity)).astype(np.int32)


def longs_of(band: np.ndarray, similarity: float) -> np.ndarray:
    """Numbers of 64 bits for the words of a text of a band: a power of two, ``LONG_WORDS`` words a number or fewer."""
    most = (1.01 / similarity) ** (np.asarray(band) + 1.0)
    return WORD_LONGS * 2 ** np.maximum(np.ceil(np.log2(most / (WORD_LONGS * LONG_WORDS))), 0).astype(np.int64)


def sharing(words: Sequence[np.ndarray], owners: Sequence[np.ndarray], labels: Sequence[np.ndarray]) -> np.ndarray:
    """A row for each text of one block, a column for each of another: whether they share a word. Sorted words, and whose each is.

    Words that only one class has may be left out.
    """
    unique = [np.unique(w, return_index=True, return_counts=True) for w in words]
    _, *at = np.intersect1d(unique[0][0], unique[1][0], assume_unique=True, return_indices=True)
    (sx, kx), (sy, ky) = ((u[1][i], u[2][i]) for u, i in zip(unique, at, strict=True))
    share = np.zeros((len(labels[0]), len(labels[1])), bool)
    few = np.flatnonzero(kx * ky <= 64)
    for s in range(0, len(few), BLOCK_PAIRS // 64):
        part = few[s:s + BLOCK_PAIRS // 64]
        size = kx[part] * ky[part]
        each = np.repeat(part, size)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
        share[owners[0][sx[each] + nth // ky[each]], owners[1][sy[each] + nth % ky[each]]] = True
    for w in np.flatnonzero(kx * ky > 64).tolist():
        x, y = owners[0][sx[w]:sx[w] + kx[w]], owners[1][sy[w]:sy[w] + ky[w]]
        if (labels[0][x] != labels[1][y[0]]).any() or (labels[1][y] != labels[0][x[0]]).any():
            share[np.ix_(x, y)] = True
    return share


def fitting(bits: Sequence[np.ndarray], share: np.ndarray, n: Sequence[np.ndarray], labels: Sequence[np.ndarray], similarity: float, one: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs that share a word, of two blocks (or twice the same ``one``), in different classes, that may be alike by lengths and ``word_bits``.

    Rows of bits may be longer in one block by powers of two: they are folded.
    """
    longs = min(b.shape[1] for b in bits)
    x, y = (np.bitwise_or.reduce(b.reshape(len(b), -1, longs), axis=1) for b in bits)
    step, at_once = max(1, BLOCK_PAIRS // max(1, share.shape[1])), max(1, BLOCK_PAIRS // longs)
    found = []
    for r in range(0, len(share), step):
        i, j = np.nonzero(share[r:r + step])
        i += r
        most = np.floor((1 - similarity) * np.maximum(n[0][i], n[1][j]) + 1e-9)
        fit = (labels[0][i] != labels[1][j]) & (np.abs(n[0][i] - n[1][j]) <= most)
        if one:
            fit &= i < j
        i, j, most = i[fit], j[fit], most[fit]
        for s in range(0, len(i), at_once):
            a, b = i[s:s + at_once], j[s:s + at_once]
            u, v = x[a], y[b]
            good = np.maximum(np.bitwise_count(u & ~v).sum(1, dtype=np.int64), np.bitwise_count(v & ~u).sum(1, dtype=np.int64)) <= most[s:s + at_once]
            found.append((a[good], b[good]))
    return tuple(np.concatenate(p) for p in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def most_edits(n: np.ndarray, similarity: float) -> np.ndarray:
    """Edits between a text of ``n`` words and any text alike, which may be the longer one."""
    return np.floor(n * (1 - similarity) / similarity + 1e-9).astype(np.int64)


def rare_words(hashes: list[np.ndarray], similarity: float, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, longer): for each text, and each length of the longer of two texts alike, its rarest words.

    Words are labelled with their occurrence number, so that an edit changes one of them at most.
    Of the words that two texts alike have in common, the first in an order common to all texts has
    no more words before it, in either text, than edits are allowed, which the longer text decides. So the
    key is a word with that length; longer: whether the text has it. Only then is it held against
    the others of the key, which are as long or shorter. known: sorted words and their counts.
    """
    words, of, rank, order = _by_rarity(hashes, known)
    size = np.maximum([len(h) for h in hashes], 1)
    own = size[of]
    found = []
    for more in range(int(most_edits(size, similarity).max(initial=0)) + 1):
        length = own + more
        kept = (more <= most_edits(own, similarity)) & (rank <= np.floor((1 - similarity) * length + 1e-9))
        key = _mix(words[order[kept]].view(np.uint64) + length[kept].astype(np.uint64) * np.uint64(0xA24BAED4963EE407)).view(np.int64)
        found.append((of[kept], key, np.full(int(kept.sum()), more == 0)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def first_words(hashes: list[np.ndarray], similarity: float, known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word): the rarest words of each text, rarest first, one more than edits that its longest text alike allows.

    Words and their order are those of ``rare_words``: the first word that two texts alike have in common comes, in
    both, after no more words than the longer one's length allows edits.
    """
    words, of, rank, order = _by_rarity(hashes, known)
    kept = rank <= most_edits(np.array([len(h) for h in hashes]), similarity)[of]
    return of[kept], words[order[kept]]


def _by_rarity(hashes: list[np.ndarray], known: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words labelled with their occurrence number, and by text, rarest first: text, rank in it, and place among the words."""
    words, starts, size = grams_of(hashes, 1)
    words, of = words.view(np.int64), np.repeat(np.arange(len(hashes)), size)
    at = np.minimum(np.searchsorted(known[0], words), max(len(known[0]) - 1, 0))
    count = np.where(known[0][at] == words, known[1][at], 0) if len(known[0]) else np.zeros(len(words), np.int64)
    return words, of, np.arange(len(words)) - np.repeat(starts, size), np.lexsort((words, count, of))


def _lists_of(f: Callable[[list[np.ndarray]], list[tuple[np.ndarray, np.ndarray]]], names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of node and text to node and lists of what ``f`` makes, (text, value) in the order of values."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(1)).to_pylist(), CHARS):
                words = [words_of(t) for t in batch.column(1).slice(a, b - a).to_pylist()]
                hashes = np.split(hasher([w for ws in words for w in ws]), np.cumsum([len(w) for w in words])[:-1])
                lists = []
                for of, values in f(hashes):
                    values, of = values[np.argsort(of, kind="stable")], np.sort(of)
                    ends = np.r_[0, np.cumsum(np.bincount(of, minlength=len(hashes)))].astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["node", *names])

    return work


def _every_word(hashes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    words, _, size = grams_of(hashes, 1)
    return np.repeat(np.arange(len(hashes)), size), words.view(np.int64)


def _known_words(texts: DataFrame) -> Broadcast:
    """Sorted words and counts of the frequent ones among (node, text), by some of the nodes."""
    part = min(1.0, ORDER_NODES / max(texts.count(), 1))
    some = texts.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(part * 1_000_000)).select("node", "text")
    seen = some.mapInArrow(_lists_of(lambda hashes: [_every_word(hashes)], ["words"]), "node binary, words array<long>").select(F.explode("words").alias("word"))
    often = seen.groupBy("word").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "word").limit(FREQUENT)
    known = sorted(tuple(r) for r in often.collect())
    return texts.sparkSession.sparkContext.broadcast((np.array([r[0] for r in known], np.int64), np.array([r[1] for r in known], np.int64)))


def shared_rare(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, text) -> node, words (hashes of all of them), rare and longer: those keys of ``rare_words`` of which texts alike share one."""
    sent = _known_words(texts)

    def both(hashes: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        of, words = _every_word(hashes)
        text, key, longer = rare_words(hashes, similarity, sent.value)
        return [(of, words.astype(np.int32)), (text, key), (text, longer)]

    return texts.select("node", "text").mapInArrow(_lists_of(both, ["words", "rare", "longer"]), "node binary, words array<int>, rare array<long>, longer array<boolean>")


def with_firsts(texts: DataFrame, similarity: float) -> DataFrame:
    """(node, label, n, text) -> node, label, n, band (of lengths), firsts: 32 bits of each of ``first_words``, and bits: ``word_bits``, of a size by the band."""
    sent = _known_words(texts)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(3)).to_pylist(), CHARS):
                words = [words_of(t) for t in batch.column(3).slice(a, b - a).to_pylist()]
                hashes = np.split(hasher([w for ws in words for w in ws]), np.cumsum([len(w) for w in words])[:-1])
                of, first = first_words(hashes, similarity, sent.value)
                firsts = np.split(first.astype(np.int32), np.cumsum(np.bincount(of, minlength=len(words)))[:-1])
                band = bands_of(np.array([len(w) for w in words]), similarity)
                longs, bits = longs_of(band, similarity), [b""] * len(words)
                for size in np.unique(longs).tolist():
                    own = np.flatnonzero(longs == size)
                    for i, row in zip(own, word_bits([hashes[i] for i in own], size).reshape(len(own), -1), strict=True):
                        bits[i] = row.tobytes()
                made = pa.array(band), pa.array([f.tobytes() for f in firsts], pa.binary()), pa.array(bits, pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in range(3)), *made], names=["node", "label", "n", "band", "firsts", "bits"])

    return texts.select("node", "label", "n", "text").mapInArrow(work, "node binary, label long, n long, band int, firsts binary, bits binary")


# ---------------------------------------------------------------- alignment
def banded(masks: dict, m: int, text: Sequence, k: int) -> int:
    """Edit distance within a band of ``k`` diagonals on both sides, exact if it is ``k`` or less.

    masks: for each symbol of the pattern of length ``m`` the bits of its places. Columns are bit
    vectors that slide with the band. The lengths may differ by ``k`` at most.
    """
    width = 2 * k + 1
    full = (1 << width) - 1
    vp, vn = ((1 << (k + 1)) - 1) << k, 0
    bottom = 1 << (2 * k)
    score = min(k, m)
    for i, c in enumerate(text, 1):
        x = masks.get(c, 0)
        if x:
            x = (x >> (i - k - 1) if i > k else x << (k + 1 - i)) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp, hn = (vn | ~(d0 | vp)) & full, d0 & vp
        if i + k <= m:
            score += not d0 & bottom
        else:
            at = 1 << (m - i + k)
            score += bool(hp & at) - bool(hn & at)
        half = d0 >> 1
        vp, vn = (hn | ~(half | hp)) & full, half & hp
    return score


def distance(a: Sequence, b: Sequence, most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 if it is more."""
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo:len(a) - hi], b[lo:len(b) - hi]
    gap = abs(len(a) - len(b))
    if gap > most:
        return most + 1
    if not a or not b:
        return len(a) + len(b)
    ca, cb = Counter(a), Counter(b)
    if max(len(a), len(b)) - (ca & cb).total() > most:  # more symbols differ than edits are left
        return most + 1
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    k = max(8, gap)
    while True:
        k = min(k, most)
        d = banded(masks, len(a), b, k)
        if d <= k:
            return d
        if k >= most:
            return most + 1
        k *= 3


def alike(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    x, y = words_of(a), words_of(b)
    longer = max(len(x), len(y))
    most = int((1 - similarity) * longer + 1e-9)
    return distance(x, y, most) <= most


# ---------------------------------------------------------------- classes
def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the least node of each connected component.

    In each round every node goes to the least of its neighbours and itself, in an order that changes with
    the round; edges between the nodes that are left go on. So edges become fewer by a share each
    round, and all rounds together move a few times as many as there are.
    """
    left = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    steps: list[DataFrame] = []
    while rows := left.count():
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(len(steps))).alias("h"), F.col(c).alias("to"))
        to = materialise(_dealt(left.groupBy("a").agg(F.least(rank("a"), F.min(rank("b")))["to"].alias("to")).withColumnRenamed("a", "node"), rows))
        half = _dealt(_meet(left, to.select(F.col("node").alias("a"), F.col("to").alias("c")), "a").select("c", "b"), rows).distinct()
        half = materialise(half) if rows > FEW_ROWS else _dealt(half, rows)
        whole = _meet(half, to.select(F.col("node").alias("b"), F.col("to").alias("d")), "b").where("c <> d").select(F.col("c").alias("a"), F.col("d").alias("b"))
        fewer = materialise(_dealt(_dealt(whole, rows).distinct(), rows))
        release(left, half)
        left = fewer
        steps.append(to)
    if not steps:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    done, found = [left], steps.pop()
    while steps:
        done.append(found)
        found = _moved(steps.pop(), "to", found)
    if "stored_at" not in vars(found):
        done.append(found := materialise(found))
    rows = found.count()
    out = materialise(_dealt(_meet(found, _dealt(found.groupBy("to").agg(F.min("node").alias("label")), rows), "to").select("node", "label"), rows))
    release(*done, found)
    return out


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df``, made from so many rows, in few tasks where they are few."""
    return df.coalesce(FEW_TASKS) if rows <= FEW_ROWS else df


def _meet(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """``hot_join`` of stored rows; a plain join of few rows, stored or not, where no key can be much work."""
    return hot_join(rows, facts, key) if "stored_at" in vars(rows) and rows.count() > FEW_ROWS else rows.join(facts, key)


def _moved(rows: DataFrame, column: str, to: DataFrame) -> DataFrame:
    """Stored ``rows`` (node, ``column``) with values of ``column`` replaced by where (node, ``column``) of ``to`` leads from them, if anywhere."""
    further = to.select(F.col("node").alias(column), F.col(column).alias("further"))
    n = rows.count()
    if n > FEW_ROWS:
        joined = hot_join(rows, rows.select(column).distinct().join(further, column, "left"), column)
    else:
        joined = rows.join(further, column, "left")
    out = _dealt(joined.select("node", F.coalesce("further", column).alias(column)), n)
    return materialise(out) if n > FEW_ROWS else out


def with_links(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(node, label) of ``components``, after further links (a, b): only the classes that they join are worked through."""
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    between = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b").distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("node"))
    if links.isEmpty():
        return labels
    rows = labels.count() + links.count()
    every = materialise(_dealt(labels.union(ends.select("node", F.col("node").alias("label"))).groupBy("node").agg(F.min("label").alias("label")), rows))
    between = materialise(_dealt(between, rows))
    top = components(between)
    out = _moved(every, "label", top)
    if "stored_at" not in vars(out):
        out = materialise(out)
    release(labels, every, between, top)
    return out


def lengths_fit(a: Column, b: Column, similarity: float) -> Column:
    """Whether texts of ``a`` and ``b`` words can be alike."""
    return F.abs(a - b) <= F.floor((1 - similarity) * F.greatest(a, b) + 1e-9)


def bins_fit(similarity: float) -> Column:
    """Whether texts of n_a and n_b words, whose ``word_bins`` are bins_a and bins_b, can be alike."""
    more = "aggregate(zip_with(bins_{0}, bins_{1}, (x, y) -> greatest(int(x) - int(y), 0)), 0, (s, x) -> s + x)"
    most = F.floor((1 - similarity) * F.greatest("n_a", "n_b") + 1e-9)
    return (F.expr(more.format("a", "b")) <= most) & (F.expr(more.format("b", "a")) <= most)


def bits_fit(similarity: float) -> Column:
    """Whether texts of n_a and n_b words, whose ``word_bits`` are bits_a and bits_b, can be alike."""
    only = "aggregate(zip_with(bits_{0}, bits_{1}, (x, y) -> bit_count(x & ~y)), 0, (s, x) -> s + x)"
    most = F.floor((1 - similarity) * F.greatest("n_a", "n_b") + 1e-9)
    return (F.expr(only.format("a", "b")) <= most) & (F.expr(only.format("b", "a")) <= most)


def unlike(rows: DataFrame, by: str, similarity: float, also: str = "true") -> DataFrame:
    """a, b: pairs of nodes in one group that lie in different classes, of lengths that may be alike.

    rows: ``by``, node, label, n, and what ``also``, a condition on pairs, needs. Members of a group's largest class are only held against the others.
    """
    classes = rows.groupBy(by, "label").agg(F.count("*").alias("m"))
    main = classes.groupBy(by).agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    some = materialise(rows.join(main, by))
    side = lambda df, p: df.select(by, *[F.col(c).alias(f"{c}_{p}") for c in rows.columns if c != by])
    pairs = side(some.where("label <> main"), "a").join(side(some, "b"), by).where(
        (F.col("label_a") != F.col("label_b")) & lengths_fit(F.col("n_a"), F.col("n_b"), similarity) & F.expr(also))
    return pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def unlike_short(rows: DataFrame, similarity: float, also: str) -> DataFrame:
    """a, b: pairs of nodes that share a key, the longer text as such, and lie in different classes (see ``rare_words``).

    rows: rare, longer, node, label, n, and what ``also`` needs. Members of a key's largest class are not held against each other.
    """
    classes = rows.groupBy("rare", "label").agg(F.count("*").alias("m"), F.max("longer").alias("longer"))
    main = classes.groupBy("rare").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count("*").alias("classes"), F.max("longer").alias("any")).where("classes > 1 and any").select("rare", "main")
    some = materialise(rows.join(main, "rare"))
    side = lambda df, p: df.select("rare", *[F.col(c).alias(f"{c}_{p}") for c in rows.columns if c != "rare"])
    fits = (F.col("label_a") != F.col("label_b")) & lengths_fit(F.col("n_a"), F.col("n_b"), similarity) & F.expr(also)
    long_ones = some.where("longer")
    pairs = [side(long_ones.where("label <> main"), "a").join(side(some, "b"), "rare").where(fits), side(long_ones.where("label = main"), "a").join(side(some.where("label <> main"), "b"), "rare").where(fits)]
    return pairs[0].unionByName(pairs[1]).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()


def unlike_first(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: pairs of nodes that share one of their first words, and lie in different classes (see ``first_words``).

    rows: word, least (of the ``LEAST_WORDS`` least hashes of the text's first words those that are less than ``word``), node, label, n, bins.
    A pair comes by the least word that it shares, as far as ``least`` tells: by rarity, by which first words are chosen, texts share
    the last ones of many. Members of a word's largest class are not held against each other.
    """
    classes = rows.groupBy("word", "label").agg(F.count("*").alias("m"))
    main = classes.groupBy("word").agg(F.max(F.struct("m", "label"))["label"].alias("main"), F.count("*").alias("classes")).where("classes > 1").drop("classes")
    some = materialise(rows.join(main, "word"))
    side = lambda df, p: df.select("word", *[F.col(c).alias(f"{c}_{p}") for c in ("node", "label", "n", "bins", "least")], (F.col("label") == F.col("main")).alias(f"main_{p}"))
    # of two rows of other classes than the largest one, either comes once
    once = F.col("main_b") | (F.col("node_a") < F.col("node_b"))
    fits = once & lengths_fit(F.col("n_a"), F.col("n_b"), similarity) & ~F.arrays_overlap("least_a", "least_b") & bins_fit(similarity)
    pairs = side(some.where("label <> main"), "a").join(side(some, "b"), "word").where((F.col("label_a") != F.col("label_b")) & fits)
    out = materialise(pairs.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct())
    release(some)
    return out


def unlike_in_blocks(rows: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of nodes in different classes that share a first word and may be alike by lengths and words, each once (see ``with_firsts``).

    rows: stored; node, label, n, band, firsts, bits. Each band is dealt into blocks of a size in bytes, of which all pairs, within a band and
    with the next, meet in a group of two blocks. So no group grows with the input, a pair that shares many words is marked and tried once,
    and a row is copied once for each block that its own one meets.
    """
    sizes = dict(rows.groupBy("band").agg(F.count("*").alias("rows")).collect())  # a row for each fourth of a length
    each = {b: -(-m * int(longs_of(b, similarity)) * 8 // BLOCK_BYTES) for b, m in sizes.items()}
    if not each:
        return rows.sparkSession.createDataFrame([], "a binary, b binary")
    blocks = lambda band: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in each.items() for x in kv]), band), F.lit(0))
    up_to = lambda m: F.when(m > 0, F.sequence(F.lit(0), m - 1)).otherwise(F.array().cast("array<int>"))
    meet = lambda lo, p, hi, q, side: F.struct(lo.alias("lo"), p.alias("p"), hi.alias("hi"), q.alias("q"), side.alias("side"))
    band, part = F.col("band"), F.col("part")
    pairs = F.concat(F.transform(up_to(blocks(band)), lambda q: meet(band, F.least(part, q), band, F.greatest(part, q), (q < part).cast("int"))),
                     F.transform(up_to(blocks(band + 1)), lambda q: meet(band, part, band + 1, q, F.lit(0))), F.transform(up_to(blocks(band - 1)), lambda q: meet(band - 1, q, band, part, F.lit(1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("node"), blocks(band)).cast("int")).select("node", "label", "n", "firsts", "bits", F.explode(pairs).alias("m")).select("node", "label", "n", "firsts", "bits", "m.*")
    groups = sum(k * (k + 1) // 2 + k * each.get(b + 1, 0) for b, k in each.items())

    def fits(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        side = group.column("side").to_numpy()
        one = group.column("lo")[0] == group.column("hi")[0] and group.column("p")[0] == group.column("q")[0]
        halves = [group.filter(pa.array(side == k)) for k in ((0, 0) if one else (0, 1))]
        if not all(h.num_rows for h in halves):
            return group.slice(0, 0).select(["node", "node"]).rename_columns(["a", "b"])
        joined = lambda h, c, kind: np.frombuffer(b"".join(h.column(c).to_pylist()), kind)
        bits, words, owners = [joined(h, "bits", np.uint64).reshape(h.num_rows, -1) for h in halves], [], []
        for h in halves:
            first = joined(h, "firsts", np.int32)
            order = np.argsort(first, kind="stable")
            words.append(first[order])
            owners.append(np.repeat(np.arange(h.num_rows), pc.binary_length(h.column("firsts")).to_numpy() // 4)[order])
        n, labels = ([h.column(c).to_numpy() for h in halves] for c in ("n", "label"))
        i, j = fitting(bits, sharing(words, owners, labels), n, labels, similarity, one)
        ends = [h.column("node").take(pa.array(at)) for h, at in zip(halves, (i, j), strict=True)]
        return pa.table(ends, names=["a", "b"])

    keys = ["lo", "p", "hi", "q"]
    found = dealt.repartition(max(1, min(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))), *keys).groupBy(*keys).applyInArrow(fits, "a binary, b binary")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: float) -> DataFrame:
    """``docs`` with one row of each class: the row with the least id (then hash of id and text)."""
    classes = near_classes(docs, id_col, text_col, **options)
    first = classes.groupBy("label").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("__key"))
    keyed = docs.withColumn("__key", row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    return keyed.join(first, "__key", "left_semi").dropDuplicates(["__key"]).drop("__key")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, class_id, class_size, n_words, and key (a hash of id and text): a row a document.

    class_id: the least id in the class, null if all are null. Null texts and texts without a word
    are in classes of their own. Repeated rows count in class_size. An empty table gives no rows;
    other columns are not read.
    """
    with shuffles_freed(docs.sparkSession):
        return _near_classes(docs, id_col, text_col, similarity, rounds)


def _near_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float, rounds: int) -> DataFrame:
    key = row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`"))
    some = docs.select(F.col(f"`{id_col}`").alias("doc_id"), key.alias("key"), F.col(f"`{text_col}`").alias("text"))
    kind = some.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            texts, keys = batch.column(2), batch.column(1).to_pylist()
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHARS):
                words = [words_of(t) for t in texts.slice(a, b - a).to_pylist()]
                n = np.array([len(w) for w in words], np.int64)
                flat = hasher([w for ws in words for w in ws])
                hashes = np.split(flat, np.cumsum(n)[:-1])
                node = [hashlib.blake2b(h.tobytes() if len(h) else b"row" + k.to_bytes(8, "big", signed=True), digest_size=16).digest() for h, k in zip(hashes, keys[a:b], strict=True)]
                some = np.flatnonzero(n)
                each, found = sketch([hashes[i] for i in some], rounds) if len(some) else (some, np.zeros(0, np.int64))
                offsets = np.zeros(len(n) + 1, np.int32)
                offsets[some + 1] = each
                offsets = np.cumsum(offsets, dtype=np.int32)
                counts = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * WORD_BINS), pa.array(word_bins(hashes)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(node, pa.binary()), pa.array(n),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(found)), counts], names=["doc_id", "key", "node", "n_words", "samples", "bins"])

    rows = materialise(some.mapInArrow(work, f"doc_id {kind}, key long, node binary, n_words long, samples array<long>, bins array<tinyint>"))
    nodes = materialise(rows.where("n_words > 0").groupBy("node").agg(F.min("key").alias("key"), F.first("n_words").alias("n"), F.first("samples").alias("samples"), F.first("bins").alias("bins")))
    sampled, rows = rows, materialise(rows.drop("samples", "bins"))
    release(sampled)
    # one exchange serves the count of each bucket and its nodes; a node is in a bucket once
    keys = nodes.select("node", "n", F.explode("samples").alias("sample")).repartition("sample")
    sizes = keys.groupBy("sample").agg(F.count("*").alias("size")).where("size > 1")
    held = materialise(keys.join(sizes, "sample"))
    sampled, nodes = nodes, materialise(nodes.drop("samples"))
    release(sampled)
    whole = F.struct("node", "n")
    ends = held.groupBy("sample").agg(F.min(whole).alias("lo"), F.max(whole).alias("hi"))
    pairs = held.join(ends, "sample").select("node", "n", F.explode(F.array("lo", "hi")).alias("lead")).where("node <> lead.node")
    pairs = pairs.where(lengths_fit(F.col("n"), F.col("lead.n"), similarity)).select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b"))
    pairs = materialise(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))
    # texts that may be compared: those in buckets, and short ones
    short = nodes.where(F.col("n") <= int(SHORT / similarity + 1e-9)).select("node", "n")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(held.where("size > 2").select("node")).union(short.select("node")).distinct()
    wanted = nodes.select("node", "key", "n", "bins").join(wanted, "node")
    # grouped by key too, by which the rows are dealt already: repeated rows have one key
    texts = materialise_by(some.select("key", "text").join(wanted.hint("merge"), "key").groupBy("key", "node").agg(*[F.first(c).alias(c) for c in ("text", "n", "bins")]).drop("key"), "node")

    def verified(few: DataFrame, texts: DataFrame = texts) -> DataFrame:
        """The pairs that are alike."""
        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, y = batch.column(2), batch.column(3)
                good = [alike(x[i].as_py(), y[i].as_py(), similarity) for i in range(batch.num_rows)]
                part = batch.select([0, 1]).filter(pa.array(good, pa.bool_()))
                if part.num_rows:
                    yield part

        # texts alike have nearly equal counts of words in each bin; the others are not aligned, nor are their texts moved
        side = lambda c, *of: texts.select(F.col("node").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in of])
        near = few.select("a", "b").join(side("a", "n", "bins"), "a").join(side("b", "n", "bins"), "b").where(bins_fit(similarity)).select("a", "b")
        near = near.join(side("a", "text"), "a").join(side("b", "text"), "b")
        return materialise(near.select("a", "b", "text_a", "text_b").mapInArrow(check, "a binary, b binary"))

    # first the likeliest pair of each node, then all pairs of a bucket that still lie in different classes
    best = pairs.groupBy("b").agg(F.max(F.struct("n", "a")).alias("m")).select(F.col("m.a").alias("a"), "b")
    labels = components(verified(best))
    at = labels.select(F.col("node").alias("a"), F.col("label").alias("la")), labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    apart = pairs.join(best.withColumn("done", F.lit(True)), ["a", "b"], "left").where("done is null").select("a", "b")
    apart = materialise(apart.join(at[0], "a", "left").join(at[1], "b", "left").where("la is null or lb is null or la <> lb"))
    def still_apart(before: DataFrame) -> DataFrame:
        """sample, node, n, size, label of those buckets of ``before`` whose nodes lie in different classes."""
        members = before.select("sample", "node", "n", "size").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = members.groupBy("sample").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        return materialise(members.join(mixed.select("sample"), "sample", "left_semi"))

    def behind_large(labels: DataFrame) -> DataFrame:
        """``labels`` with the links of all nodes in large buckets of different classes, by their first words: none is missed."""
        at = held.where(F.col("size") > SMALL).join(labels, "node", "left").select("sample", "node", "n", F.coalesce("label", "node").alias("label"))
        mixed = at.groupBy("sample").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
        open_nodes = materialise(at.join(mixed.select("sample"), "sample", "left_semi").select("node", "n", F.xxhash64("label").alias("label")).distinct())
        if open_nodes.isEmpty():
            return labels
        # their texts are read from among all of them once
        own = materialise_by(texts.drop("n").join(open_nodes, "node"), "node")
        firsts = materialise(with_firsts(own, similarity))
        todo = materialise(unlike_in_blocks(firsts, similarity))
        # again one pair of each node comes first
        lead = materialise(todo.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        labels = with_links(labels, verified(lead, own))
        now = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
        rest = todo.join(lead, ["a", "b"], "left_anti").join(now("a"), "a", "left").join(now("b"), "b", "left")
        labels = with_links(labels, verified(rest.where("la is null or lb is null or la <> lb").select("a", "b"), own))
        release(open_nodes, own, firsts, todo, lead)
        return labels

    some_large = (F.col("size") <= SMALL) | (F.pmod(F.xxhash64("sample"), F.lit(THIN)) == 0)
    members = still_apart(held.where((F.col("size") > 2) & some_large))
    for turn in range(PIVOTS):
        if members.isEmpty():
            break
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "label")
        one = members.groupBy("sample").agg(F.min(own).alias("one"))
        few = members.join(one, "sample").where((F.col("label") != F.col("one.label")) & lengths_fit(F.col("n"), F.col("one.n"), similarity))
        found = verified(materialise(few.select(F.least("node", "one.node").alias("a"), F.greatest("node", "one.node").alias("b")).distinct()))
        if found.isEmpty():
            break
        labels = with_links(labels, found)
        before, members = members, still_apart(members)  # classes only grow: a bucket of one class stays so
        release(before)
    left = unlike(members.where(F.col("size") <= SMALL).select("sample", "node", "label", "n"), "sample", similarity)
    brief = materialise(short.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    if brief.limit(1).count():
        # read from among all texts once
        brief_texts = materialise(texts.select("node", "text").join(brief.select("node"), "node"))
        rare = shared_rare(brief_texts, similarity).select("node", "words", F.explode(F.arrays_zip("rare", "longer")).alias("key")).select("node", "words", "key.rare", "key.longer")
        few = " and ".join(f"size(array_except(words_{x}, words_{y})) <= floor({1 - similarity} * greatest(n_a, n_b) + 1e-9)" for x, y in ("ab", "ba"))
        left = left.union(unlike_short(brief.join(rare, "node"), similarity, few))
    left = materialise(left.join(best, ["a", "b"], "left_anti").union(apart.select("a", "b")).distinct())
    labels = with_links(labels, verified(left))
    labels = behind_large(labels)

    named = materialise(rows.join(labels, "node", "left").select("doc_id", "key", "n_words", F.coalesce("label", "node").alias("label")))
    release(rows, nodes, held, pairs, texts, left, brief, members, labels)
    classes = named.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return hot_join(named, classes, "label").select("doc_id", "class_id", "class_size", "n_words", "key", "label")
