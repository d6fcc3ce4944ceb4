"""Language ID by multilingual mixture inference.

Each word of a document is drawn from one of the languages, with the likelihood of its character
trigrams. Expectation-maximisation estimates the document's language proportions; the set of
languages that explains it is chosen by penalised likelihood, half the log of the number of words
for each language after the first (as BIC has it), going back from all languages.

Documents of an array batch are treated together: words are ragged numpy arrays, and every step of
the iteration is a few array operations over all words of the batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eonmap.llm.common import slices

BUCKETS = 1 << 15
#: At most about so many labelled documents of each language are read to fit the model.
TRAIN_DOCS = 2000
#: Added to the count of each trigram.
SMOOTH = 0.05
#: Rounds of expectation-maximisation; characters of text that a worker takes at once.
ROUNDS, CHARS = 12, 400_000
UNKNOWN = "und"
#: Multipliers of the trigram hash: odd, with well-spread bits.
MULT = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def _letters() -> np.ndarray:
    """Whether a code point is a letter, for all code points."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Alphabet:
    """The table of letters, made once in a worker."""

    table: np.ndarray | None = None

    @classmethod
    def letters(cls) -> np.ndarray:
        if cls.table is None:
            cls.table = _letters()
        return cls.table


@dataclass
class Words:
    """Words of a batch: trigram buckets, the start of each word in them, and the document of each word."""

    grams: np.ndarray
    starts: np.ndarray
    doc: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    """Runs of letters, lower case, with an edge mark on both sides; each gives as many trigrams as letters."""
    whole = "\n".join(t or "" for t in texts)
    low = whole.lower()
    code = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    breaks = np.cumsum([len((t or "").lower()) + 1 for t in texts]) - 1 if texts else np.zeros(0, int)
    letter = Alphabet.letters()[code]
    if len(breaks) > 1:
        letter[breaks[:-1]] = False
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    marked = np.where(letter, code, 0).astype(np.uint32)
    padded = np.r_[np.uint32(0), marked, np.uint32(0)]
    h = padded[:-2] * MULT[0] + padded[1:-1] * MULT[1] + padded[2:] * MULT[2]
    h ^= h >> np.uint32(15)
    grams = ((h * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)[letter]
    size = last - first
    starts = np.cumsum(size) - size
    return Words(grams, starts, np.searchsorted(breaks, first, "left"))


def word_scores(words: Words, logp: np.ndarray) -> np.ndarray:
    """Log likelihood of each word (a row) in each language (a column)."""
    if not len(words.starts):
        return np.zeros((0, logp.shape[1]))
    return np.add.reduceat(logp[words.grams], words.starts, axis=0, dtype=np.float64)


def _mixture(p: np.ndarray, top: np.ndarray, starts: np.ndarray, doc: np.ndarray, n: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log likelihood of each document, over its allowed languages."""
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        r = p * pi[doc]
        r /= r.sum(axis=1, keepdims=True)
        pi = np.add.reduceat(r, starts, axis=0) / n[:, None]
        pi = np.where(allowed, np.maximum(pi, 1e-12), 0)
    ll = np.add.reduceat(np.log((p * pi[doc]).sum(axis=1)) + top, starts)
    return pi, ll


def infer(texts: list[str | None], logp: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of each document after the choice of its set, the same before it, and its words."""
    k = logp.shape[1]
    words = words_of(texts)
    scores = word_scores(words, logp)
    n_all = np.bincount(words.doc, minlength=len(texts))
    chosen, full = np.zeros((len(texts), k)), np.zeros((len(texts), k))
    ids = np.flatnonzero(n_all)
    if not len(ids):
        return chosen, full, n_all
    top = scores.max(axis=1)
    p = np.exp(np.maximum(scores - top[:, None], -60)).astype(np.float32)
    doc = np.repeat(np.arange(len(ids)), n_all[ids])
    n = n_all[ids]
    starts = np.cumsum(n) - n
    pi, ll = _mixture(p, top, starts, doc, n, np.ones((len(ids), k), bool), rounds)
    full[ids] = pi
    # one language alone; a set of more can't beat it by more than all languages do
    single = np.add.reduceat(scores, starts, axis=0)
    best_set = np.zeros((len(ids), k), bool)
    best_set[np.arange(len(ids)), single.argmax(axis=1)] = True
    best = single.max(axis=1)
    best_pi = best_set.astype(float)
    penalty = 0.5 * np.log(np.maximum(n, 2))
    open_ = np.flatnonzero(ll - penalty > best)
    allowed = np.ones((len(ids), k), bool)
    size = k
    while len(open_) and size > 1:
        value = ll[open_] - penalty[open_] * (size - 1)
        better = open_[value > best[open_]]
        best[better] = (ll - penalty * (size - 1))[better]
        best_set[better], best_pi[better] = allowed[better], pi[better]
        size -= 1
        if size == 1:
            break
        # the least of the allowed languages goes
        weakest = np.where(allowed[open_], pi[open_], np.inf).argmin(axis=1)
        allowed[open_, weakest] = False
        mask = np.isin(doc, open_)
        sub = np.searchsorted(open_, doc[mask])
        m = n[open_]
        sub_pi, sub_ll = _mixture(p[mask], top[mask], np.cumsum(m) - m, sub, m, allowed[open_], rounds)
        pi[open_], ll[open_] = sub_pi, sub_ll
    chosen[ids] = best_pi
    return chosen, full, n_all


@dataclass
class Model:
    """Languages in order of name, and log probabilities of trigram buckets; the last column is a
    background language in which all trigrams are equally likely."""

    langs: list[str]
    logp: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        train_docs: int = TRAIN_DOCS, buckets: int = BUCKETS, smooth: float = SMOOTH) -> Model:
    """Trigram counts by language from labelled rows.

    A language with more than ``train_docs`` labelled rows gives about that many: those whose hash
    of id and text is under a threshold. What comes to the driver is a count for each language and
    bucket, however large the input. Rows without a label or text are not read.
    """
    rows = docs.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"), F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("h"))
    rows = rows.where("lang is not null and text is not null")
    per = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row a language
    share = F.lit(0.0)
    for name, n in per:
        share = F.when(F.col("lang") == name, min(1.0, train_docs / n)).otherwise(share)
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(pc.binary_length(texts).to_pylist(), CHARS):
                w = words_of(texts.slice(a, b - a).to_pylist())
                lang_of_word = np.array(langs[a:b], object)[w.doc]
                size = np.diff(np.r_[w.starts, len(w.grams)])
                of_gram = np.repeat(lang_of_word, size)
                for name in set(langs[a:b]):
                    total.setdefault(name, np.zeros(buckets, np.int64))
                    total[name] += np.bincount(w.grams[of_gram == name], minlength=buckets)
        for name, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(c[at])], names=["lang", "bucket", "n"])

    got = some.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    logp = np.full((buckets, len(langs) + 1), -math.log(buckets))
    for i, name in enumerate(langs):
        own = got[got["lang"] == name]
        c = np.full(buckets, smooth)
        c[own["bucket"].to_numpy()] += own["n"].to_numpy()
        logp[:, i] = np.log(c / c.sum())
    return Model(langs, logp.astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all, if not given) and lang_pred, score, background, mixture (language and share, the largest first).

    lang_pred is the language with the largest share; ``und`` if the text is null or has no letter,
    or no language was learned (score 0). score is its share of the words before the choice of the
    set, background the share that the background takes in the chosen set. Ties go to the language
    first by name. Repeated rows get equal results, an empty table gives no rows. Columns of these
    names in ``docs`` are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = ["lang_pred", "score", "background", "mixture"]
    kept = [c for c in (docs.columns if keep is None else keep) if c not in new]
    some = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in some.schema.fields[:-1])
    mixture = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        k = len(m.langs)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(pc.fill_null(pc.binary_length(texts), 0).to_pylist(), CHARS):
                chosen, full, n = infer(texts.slice(a, b - a).to_pylist(), m.logp)
                pred, score, back, mix = [], [], [], []
                lead = full[:, :k].argmax(axis=1) if k else None
                for i in range(b - a):
                    if not n[i] or not k:
                        pred.append(UNKNOWN), score.append(0.0), back.append(0.0), mix.append([])
                        continue
                    own = chosen[i, :k]
                    j = int(own.argmax()) if own.any() else int(lead[i])
                    known = full[i, :k].sum()
                    pred.append(m.langs[j])
                    score.append(float(min(1.0, full[i, j] / known if known > 0 else 0.0)))
                    back.append(float(chosen[i, k]))
                    mix.append([{"lang": m.langs[x], "share": float(own[x])} for x in np.argsort(-own, kind="stable") if own[x] > 0])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(back, pa.float64()), pa.array(mix, mixture)],
                    names=[*kept, *new])

    return some.mapInArrow(work, f"{schema}, lang_pred string, score double, background double, mixture array<struct<lang:string,share:double>>")


def held_out(id_col: str = "doc_id", folds: int = 5) -> Column:
    """Whether crc32 of the id as text leaves 0 modulo ``folds``; a null id is held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds == 0, F.lit(True))
