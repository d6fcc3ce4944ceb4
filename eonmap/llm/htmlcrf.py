"""Main-text extraction by a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks (runs of text without a block element inside). Each block has binary
features of its ancestors' tags and class names and of its text. The field has two labels, main text
and other; it is fitted to labelled pages by gradient ascent on the exact log likelihood (forward
and backward sums) and decoded by Viterbi.

The labelled pages are made here from page layouts with known labels, so that fitting needs no
corpus; ``fit`` takes any other labelled pages in the same form.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's elements by kind, and class-name parts that tell what a container is for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
ROLES = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip toolbar",
    "edge": "header masthead topbar footer foot copyright colophon site-info credits legal",
    "side": "sidebar aside side rail widget widgets related recommended trending popular more teaser",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay disclaimer warning message paywall",
    "talk": "comment comments reply replies discussion disqus respond thread feedback",
    "form": "form search login signup subscribe newsletter subscription share social sharing buttons follow",
    "main": "article content post entry story main body text page-content article-body post-content entry-content",
}
ROLE_OF = {name: role for role, names in ROLES.items() for name in names.split()}
STEMS = [(name, role) for name, role in ROLE_OF.items() if len(name) > 5 and role != "main"]
TAGS = frozenset("nav header footer aside article main form section table ul ol li dl h1 h2 h3 p pre blockquote td th title head button select option textarea figure figcaption address dialog menu label legend fieldset".split())

TOKEN = re.compile(r"<!--(?:.*?(?:-->|--!>)|.*)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


@dataclass
class Block:
    text: str
    features: list[str] = field(default_factory=list)


def _marks(name: str, attrs: str) -> tuple[str, ...]:
    """Features that an element gives to all blocks below it."""
    out = ["in:" + name] if name in TAGS else []
    if attrs:
        for m in NAMED.finditer(attrs):
            value = (m[1] or m[2] or m[3] or "").lower()
            for word in value.split():
                for part in {word, *re.split(r"[-_]", word)}:
                    role = ROLE_OF.get(part) or next((r for stem, r in STEMS if part.startswith(stem)), None)
                    if role:
                        out.append("is:" + role)
        if "hidden" in attrs and re.search(r"(?<![\w-])hidden\b|display\s*:\s*none", attrs):
            out.append("is:hidden")
    return tuple(dict.fromkeys(out))


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, with decoded, trimmed text of single spaces."""
    if not page:
        return []
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, links = 0, 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(text, _text_features(text, linked / max(1, len(raw)), stack)))
            parts = []
        linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            parts.append(piece)
            linked += len(piece) if links else 0
            at = lt
            continue
        m = TOKEN.match(page, at)
        if not m:
            parts.append("<")
            at += 1
            continue
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        if name in RAW and not closing:
            if not m[0].endswith("/>"):
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else links + 1
            elif name == "label" and not closing:
                flush()
            if not closing and (marks := _marks(name, m[3] or "")):
                if any(x.startswith("is:") for x in marks):
                    flush()
                    stack.append((name, marks))
            elif closing and any(x[0] == name for x in stack):
                flush()
                while stack and stack.pop()[0] != name:
                    pass
            continue
        flush()
        links = 0
        if closing:
            if any(x[0] == name for x in stack):
                while stack.pop()[0] != name:
                    pass
            continue
        if name in CLOSES_P:
            _close(stack, "p", ("div", "article", "section", "td", "li", "body", "main"))
        if name in ("li", "td", "th", "tr", "dt", "dd", "option"):
            _close(stack, name, ("ul", "ol", "table", "dl", "select"))
        if name not in VOID and not m[0].endswith("/>"):
            stack.append((name, _marks(name, m[3] or "")))
    flush()
    return out


def _close(stack: list[tuple[str, tuple[str, ...]]], name: str, fences: Sequence[str]) -> None:
    """Closes an open element whose end tag may be left out."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] in fences:
            return


def _text_features(text: str, linked: float, stack: list[tuple[str, tuple[str, ...]]]) -> list[str]:
    out = dict.fromkeys(x for _, marks in stack for x in marks)
    out[f"leaf:{stack[-1][0]}" if stack and stack[-1][0] in TAGS else "leaf:other"] = None
    n = len(text)
    out["len:" + ("1" if n < 25 else "2" if n < 80 else "3" if n < 250 else "4")] = None
    out["links:" + ("none" if linked < 0.05 else "some" if linked < 0.6 else "most")] = None
    if text[-1] in ".!?…:;\"”»":
        out["ends"] = None
    if "©" in text or "(c)" in text[:20]:
        out["rights"] = None
    return list(out)


# ---------------------------------------------------------------- the field
@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray  # feature x label
    steps: np.ndarray  # label x label
    start: np.ndarray


def fit(pages: Sequence[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.02) -> Model:
    """Weights that maximise the log likelihood of the labels, less a quadratic penalty.

    pages: for each page the features of its blocks and their labels, 1 for main text.
    """
    pages = [p for p in pages if p[0]]
    index = {f: i for i, f in enumerate(sorted({f for fs, _ in pages for x in fs for f in x}))}
    b, t, k = len(pages), max(len(fs) for fs, _ in pages), len(index)
    x = np.zeros((b, t, k), np.float32)
    y, live = np.zeros((b, t), int), np.zeros((b, t), bool)
    for i, (fs, ys) in enumerate(pages):
        for j, f in enumerate(fs):
            x[i, j, [index[n] for n in f]] = 1
        y[i, :len(ys)], live[i, :len(ys)] = ys, True
    theta = [np.zeros((k, 2)), np.zeros((2, 2)), np.zeros(2)]
    first = [np.zeros_like(p) for p in theta]
    second = [np.zeros_like(p) for p in theta]
    flat = x.reshape(-1, k)
    gold = np.eye(2)[y] * live[..., None]
    pair_gold = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:])
    for r in range(1, rounds + 1):
        w, a, s = theta
        e = (flat @ w).reshape(b, t, 2)
        alpha, beta = np.zeros((b, t, 2)), np.zeros((b, t, 2))
        alpha[:, 0] = e[:, 0] + s
        for j in range(1, t):
            z = alpha[:, j - 1, :, None] + a[None]
            alpha[:, j] = np.where(live[:, j, None], np.logaddexp(z[:, 0], z[:, 1]) + e[:, j], alpha[:, j - 1])
        for j in range(t - 2, -1, -1):
            z = a[None] + (e[:, j + 1] + beta[:, j + 1])[:, None, :]
            beta[:, j] = np.where(live[:, j + 1, None], np.logaddexp(z[..., 0], z[..., 1]), 0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        marginal = np.exp(alpha + beta - total[:, None, None]) * live[..., None]
        pair = alpha[:, :-1, :, None] + a[None, None] + (e + beta)[:, 1:, None, :] - total[:, None, None, None]
        pair = np.where(live[:, 1:, None, None], np.exp(np.minimum(pair, 0)), 0)
        grads = [flat.T @ (gold - marginal).reshape(-1, 2), pair_gold - pair.sum((0, 1)), (gold - marginal)[:, 0].sum(0)]
        for i, g in enumerate(grads):
            g = g / b - decay * theta[i] / 10
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            theta[i] = theta[i] + rate * (first[i] / (1 - 0.9**r)) / (np.sqrt(second[i] / (1 - 0.99**r)) + 1e-8)
    return Model(index, *theta)


def viterbi(features: list[list[str]], model: Model) -> list[int]:
    """The likeliest labels of a page's blocks."""
    if not features:
        return []
    index, w, a = model.index, model.weights.tolist(), model.steps.tolist()
    s0, s1 = model.start.tolist()
    back: list[tuple[int, int]] = []
    for i, fs in enumerate(features):
        e0 = e1 = 0.0
        for f in fs:
            j = index.get(f)
            if j is not None:
                e0 += w[j][0]
                e1 += w[j][1]
        if i:
            p0, p1 = int(s1 + a[1][0] > s0 + a[0][0]), int(s1 + a[1][1] > s0 + a[0][1])
            back.append((p0, p1))
            s0, s1 = (s1 + a[1][0] if p0 else s0 + a[0][0]) + e0, (s1 + a[1][1] if p1 else s0 + a[0][1]) + e1
        else:
            s0, s1 = s0 + e0, s1 + e1
    path = [int(s1 > s0)]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]


# ---------------------------------------------------------------- labelled pages
def labelled_pages(n: int = 700, seed: int = 7) -> list[tuple[list[list[str]], list[int]]]:
    """Pages of many layouts: every block's text starts with a mark that tells its label."""
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"

    def words(lo: int, hi: int, label: int, stop: bool = True) -> str:
        body = " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(lo, hi)))
        return f"\x01{label}{body}{'.' if stop else ''}"

    def menu() -> str:
        items = "".join(f'<li><a href="/x">{words(1, 2, 0, False)}</a></li>' for _ in range(rng.randint(2, 6)))
        return f"<ul>{items}</ul>"

    def named(tag: str, role: str) -> str:
        name = rng.choice(ROLES[role].split())
        return f'<{tag} {rng.choice(["class", "id"])}="{name}">'

    def junk() -> str:
        kind = rng.choice(["nav", "menu", "header", "footer", "aside", "side", "advert", "notice", "form", "formdiv", "talk", "talk", "edge"])
        short = rng.choice([(2, 8), (5, 20), (15, 50)])
        if kind in ("nav", "header", "footer", "aside"):
            body = menu() if kind == "nav" or rng.random() < 0.3 else rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(words(*short, 0))
            if kind == "footer" and rng.random() < 0.5:
                body = "\x010&copy; " + words(2, 8, 0)[2:]
            return f"<{kind}>{body}</{kind}>"
        if kind == "form":
            return f'<form action="/s"><label>{words(1, 3, 0, False)}</label><input name="q"><button>{words(1, 2, 0, False)}</button>{"<p>" + words(4, 15, 0) + "</p>" if rng.random() < 0.5 else ""}</form>'
        role = {"menu": "menu", "side": "side", "advert": "advert", "notice": "notice", "formdiv": "form", "talk": "talk", "edge": "edge"}[kind]
        tag = rng.choice(["div", "div", "section"])
        if kind == "menu":
            body = menu()
        elif kind in ("talk", "side") and rng.random() < 0.7:
            head = f"<h2>{words(1, 3, 0, False)}</h2>" if rng.random() < 0.6 else ""
            body = head + "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<ul><li>{}</li></ul>"]).format(words(4, 40, 0)) for _ in range(rng.randint(1, 4)))
        else:
            body = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>"]).format(words(*short, 0))
        return f"{named(tag, role)}{body}</{tag}>"

    def story() -> str:
        out = [f"<h1>{words(1, 10, 1, rng.random() < 0.5)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.choice([0, 1, 1, 2, 3, 5, 8])):
            kind = rng.random()
            text = words(*rng.choice([(1, 4), (8, 30), (30, 80)]), 1, rng.random() < 0.85)
            if kind < 0.72:
                out.append(rng.choice(["<p>{}</p>", "<p>{}", "<p><b>{}</b></p>", "<p><b>{}<br>"]).format(text))
            elif kind < 0.8:
                out.append(f"<h2>{words(1, 6, 1, False)}</h2><p>{text}</p>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{words(2, 12, 1, rng.random() < 0.5)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.92:
                out.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.96:
                out.append(f'<p>{text[:-1]} <a href="/y">link</a> more.</p>')
            else:
                out.append(f"<table><tr><td>{text}</td></tr></table>")
            if rng.random() < 0.12:
                out.append(junk())
        whole = "".join(out)
        if rng.random() < 0.2:
            whole = f"<section>{whole}</section>" if rng.random() < 0.5 else f"<div>{whole}</div>"
        return whole

    made = []
    for _ in range(n):
        before, after = [junk() for _ in range(rng.randint(0, 4))], [junk() for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.12:
            body = ""
        else:
            frame = rng.choice(["<article>{}</article>"] * 5 + ["<main>{}</main>", "<main><article>{}</article></main>", "MAIN", "MAIN", "<div>{}</div>"])
            if frame == "MAIN":
                frame = named("div", "main") + "{}</div>"
            body = frame.replace("{}", story())
        head = f"<head><title>{words(1, 9, 0, False)}</title><style>p{{}}</style></head>" if rng.random() < 0.8 else ""
        page = f"<html>{head}<body>{''.join(before)}{body}{''.join(after)}</body></html>"
        found = blocks_of(page)
        labels = [int("\x011" in x.text) for x in found]
        made.append(([x.features for x in found], labels))
    return made


@functools.lru_cache(maxsize=1)
def default_model() -> Model:
    """The field fitted to the labelled pages above; it takes a few seconds, once a process."""
    return fit(labelled_pages())


def main_text(page: str | None, model: Model) -> str:
    blocks = blocks_of(page)
    return "\n\n".join(x.text for x, label in zip(blocks, viterbi([x.features for x in blocks], model), strict=True) if label)


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars for every page.

    Null html, and pages without main text, give an empty text with 0 characters. Ids and urls may be
    null and are passed on. Repeated rows give repeated results, an empty table no rows; broken
    markup is read as far as it goes; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())
    some = pages.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{url_col}`").alias(url_col), F.col(f"`{html_col}`").alias("html"))
    kinds = [some.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = [main_text(batch.column(2)[i].as_py(), m) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return some.mapInArrow(work, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
