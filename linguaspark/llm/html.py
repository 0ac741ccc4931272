"""Main-text extraction with a recurrent block labeller.

A page becomes the sequence of its leaf blocks (runs of text between block
tags). Each block is a vector: hashed tokens of its tag path (tags, classes
and ids of all open elements), hashed words of its text, and a few shape
values. A bidirectional LSTM in numpy reads the sequence and labels every
block as article or not, so the decision on a block uses the whole page.

The labeller is trained on the driver from a bounded sample of pages. Their
blocks get weak labels from the meaning of tag and class names, and their
texts are set into varied page layouts (different containers, menus, notices,
sidebars, forms, comments) whose labels are known by construction. Sample
bounds are parameters. Labelling runs over all pages and whole pages.

Defined cases: null or empty html gives the empty text; script, style and
comments are dropped (an unclosed one to the end of the page); unclosed and
stray tags are tolerated; equal pages give equal texts; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linguaspark.llm.common import hash_sample, pick, returning, word_hashes

# HTML element classes.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s "
                   "samp small span strike strong sub sup time tt u var br wbr img input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noembed noframes".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}

# Words in tags, classes and ids that tell what a block is.
OUTSIDE = frozenset("nav menu navbar footer aside sidebar ad ads advert advertisement adverts banner sponsor sponsored promo "
                    "cookie cookies consent notice alert popup modal form search login signup newsletter subscribe comment "
                    "comments reply replies discussion disqus related share social breadcrumb breadcrumbs pagination "
                    "widget toolbar masthead header head button select option label fieldset textarea tags "
                    "copyright topbar recommended feedback".split())
INSIDE = frozenset("article main content post entry story body-text articlebody text".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[/a-zA-Z!?][^>]*>?""")
_ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

PATH, LEAF, WORDS, SHAPE = 96, 32, 32, 7
SIZE = PATH + LEAF + WORDS + SHAPE


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tokens of the open elements, outermost first
    leaf: str              # the innermost element
    linked: int            # characters inside links


def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    out = [tag]
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            out += ["." + w.lower() for w in _PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(out)


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded, white space single, none empty."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, tuple(t for _, ts in stack for t in ts), stack[-1][0] if stack else "", linked))
            parts.clear()
        linked = 0

    n = len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            parts.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        m = _TAG.match(page, lt)
        if m is None:  # a bare "<" is text
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:  # doctype and the like
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
        if tag in RAW and not closing:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = n if end is None else end.end()
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            if stack and stack[-1][0] == "p":
                stack.pop()
            ends = CLOSES.get(tag)
            while ends and stack and stack[-1][0] in ends:
                stack.pop()
            stack.append((tag, _tokens(tag, m[3])))
    flush()
    return out


@lru_cache(maxsize=100_000)
def _cell(token: str, cells: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % cells


def vectors(bs: list[Block]) -> np.ndarray:
    """One row per block: hashed path, innermost element, hashed words, shape."""
    x = np.zeros((len(bs), SIZE), np.float32)
    for row, b in zip(x, bs, strict=True):
        for t in b.path:
            row[_cell(t, PATH)] = 1
        row[PATH + _cell(b.leaf, LEAF)] = 1
        words, _, _ = word_hashes(b.text)
        row[PATH + LEAF:PATH + LEAF + WORDS] = np.bincount((words >> np.uint64(59)).astype(np.int64), minlength=WORDS) \
            / max(1.0, np.sqrt(len(words)) * 2)
        n = len(b.text)
        row[-SHAPE:] = (np.log1p(n) / 8, np.log1p(len(words)) / 6, min(1.0, b.linked / n), b.text[-1] in ".!?…。",
                        min(1.0, 10 * b.text.count(",") / n), len(b.path) / 16, 1)
    return x


class Labeller:
    """A bidirectional LSTM over block vectors with a logistic output for each block."""

    def __init__(self, hidden: int = 16, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in "fb":
            self.p["x" + d] = rng.normal(0, 1 / np.sqrt(SIZE / 8), (SIZE, 4 * hidden)).astype(np.float32)
            self.p["h" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden:2 * hidden] = 1  # remember at first
        self.p["o"] = rng.normal(0, 0.3, 2 * hidden).astype(np.float32)
        self.p["q"] = np.zeros(1, np.float32)

    def _pass(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: steps x pages x SIZE, already in reading direction; padded steps leave the state as it is."""
        steps, pages, _ = x.shape
        h, c, k = np.zeros((pages, self.h), np.float32), np.zeros((pages, self.h), np.float32), self.h
        z_in = x.reshape(-1, SIZE) @ self.p["x" + d] + self.p["c" + d]
        z_in = z_in.reshape(steps, pages, -1)
        out, tape = np.empty((steps, pages, k), np.float32), []
        for t in range(steps):
            z = z_in[t] + h @ self.p["h" + d]
            gates = 1 / (1 + np.exp(-z[:, :3 * k]))
            i, f, o = gates[:, :k], gates[:, k:2 * k], gates[:, 2 * k:]
            g = np.tanh(z[:, 3 * k:])
            m = mask[t, :, None]
            c_new = f * c + i * g
            tc = np.tanh(c_new)
            if keep:
                tape.append((h, c, i, f, o, g, tc, m))
            h, c = m * (o * tc) + (1 - m) * h, m * c_new + (1 - m) * c
            out[t] = h
        return out, tape

    def _back(self, x, tape, d_out, d, grad):
        k, steps = self.h, len(tape)
        dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
        dz_all = np.empty((steps, x.shape[1], 4 * k), np.float32)
        for t in range(steps - 1, -1, -1):
            h, c, i, f, o, g, tc, m = tape[t]
            dh = dh + d_out[t]
            a = dh * m
            dcn = dc * m + a * o * (1 - tc * tc)
            dz = np.concatenate((dcn * g * i * (1 - i), dcn * c * f * (1 - f), a * tc * o * (1 - o), dcn * i * (1 - g * g)), 1)
            dz_all[t] = dz
            grad["h" + d] += h.T @ dz
            dh = dh * (1 - m) + dz @ self.p["h" + d].T
            dc = dc * (1 - m) + dcn * f
        flat = dz_all.reshape(-1, 4 * k)
        grad["x" + d] += x.reshape(-1, SIZE).T @ flat
        grad["c" + d] += flat.sum(0)

    @staticmethod
    def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        steps = max(len(x) for x in pages)
        x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), np.float32)
        for j, v in enumerate(pages):
            x[:len(v), j], mask[:len(v), j] = v, 1
        return x, mask

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Article probability of every block; pages of like length are run together."""
        out: list[np.ndarray] = [np.empty(0, np.float32)] * len(pages)
        order = sorted((i for i, x in enumerate(pages) if len(x)), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            size = max(1, min(64, 16_384 // len(pages[order[min(at + 63, len(order) - 1)]])))
            part = order[at:at + size]
            at += len(part)
            x, mask = self._batch([pages[i] for i in part])
            both = self._both(x, mask, False)[0]
            p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["q"])))
            for j, i in enumerate(part):
                out[i] = p[:len(pages[i]), j]
        return out

    def _both(self, x, mask, keep):
        f, tape_f = self._pass(x, mask, "f", keep)
        b, tape_b = self._pass(x[::-1], mask[::-1], "b", keep)
        return np.concatenate((f, b[::-1]), 2), tape_f, tape_b

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = 14, rate: float = 0.01, seed: int = 3) -> None:
        """Adam on the log loss; a label of -1 is unknown and does not count."""
        rng = np.random.default_rng(seed)
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, k = 0, self.h
        for epoch in range(epochs):
            order = np.array(sorted(range(len(pages)), key=lambda i: (len(pages[i]) + rng.integers(0, 6), rng.random())))
            batches = [order[i:i + 24] for i in range(0, len(order), 24)]
            for part in rng.permutation(len(batches)):
                ids = batches[part]
                x, mask = self._batch([pages[i] for i in ids])
                y = np.full(mask.shape, -1.0, np.float32)
                for j, i in enumerate(ids):
                    y[:len(labels[i]), j] = labels[i]
                both, tape_f, tape_b = self._both(x, mask, True)
                p = 1 / (1 + np.exp(-(both @ self.p["o"] + self.p["q"])))
                known = (y >= 0) & (mask > 0)
                err = np.where(known, p - y, 0) / max(1, known.sum())
                grad = {n: np.zeros_like(v) for n, v in self.p.items()}
                grad["o"] = np.einsum("tp,tpk->k", err, both).astype(np.float32)
                grad["q"] = err.sum(keepdims=True).reshape(-1)[:1].astype(np.float32)
                d = (err[..., None] * self.p["o"]).astype(np.float32)
                self._back(x, tape_f, d[..., :k], "f", grad)
                self._back(x[::-1], tape_b, d[::-1][..., k:], "b", grad)
                step += 1
                lr = rate * (1 - 0.8 * epoch / epochs)
                for n, g in grad.items():
                    g = np.clip(g, -1, 1)
                    m1[n] = 0.9 * m1[n] + 0.1 * g
                    m2[n] = 0.99 * m2[n] + 0.01 * g * g
                    self.p[n] -= (lr * m1[n] / (1 - 0.9 ** step) / (np.sqrt(m2[n] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)


def weak_label(b: Block) -> int:
    """1 article, 0 not, -1 unknown, from the meaning of the names on the path."""
    names = {t.lstrip(".") for t in b.path}
    if names & OUTSIDE:
        return 0
    if names & INSIDE:
        return 1
    if b.linked > 0.5 * len(b.text):
        return 0
    return -1


@dataclass
class Layouts:
    """Random page layouts filled with given article and other texts; labels are known by construction."""

    rng: np.random.Generator
    article: list[list[str]]
    other: list[str] = field(default_factory=list)

    def _some(self, lo: int, hi: int) -> list[str]:
        return [self.other[i] for i in self.rng.integers(0, len(self.other), self.rng.integers(lo, hi + 1))]

    def _outside(self, kind: str) -> str:
        e, r = entities.escape, self.rng
        name = lambda *xs: xs[r.integers(0, len(xs))]
        if kind == "menu":
            body = "".join(f'<li><a href="/x">{e(w)}</a></li>' for t in self._some(2, 4) for w in t.split()[:3])
            return name("<nav><ul>%s</ul></nav>", '<div class="menu"><ul>%s</ul></div>', '<ul class="nav navbar">%s</ul>',
                        '<nav class="breadcrumb"><ul>%s</ul></nav>', '<div id="menu"><ul>%s</ul></div>') % body
        if kind == "header":
            return name("<header><h1>%s</h1></header>", '<div class="header"><p>%s</p></div>', '<div id="masthead">%s</div>',
                        '<header class="site-header"><div>%s</div></header>') % e(self._some(1, 1)[0])
        if kind == "footer":
            return name("<footer>%s</footer>", '<div class="footer"><p>%s</p></div>', '<footer><p>%s</p></footer>',
                        '<div id="footer">%s</div>') % ("&copy; " + e(self._some(1, 1)[0]))
        if kind == "comments":
            ps = [self.article[r.integers(0, len(self.article))] for _ in range(r.integers(1, 5))]
            body = "".join(f'<div class="comment"><p>{e(p[r.integers(0, len(p))])}</p></div>' for p in ps)
            return name('<section class="comments"><h2>Comments</h2>%s</section>', '<div id="comments">%s</div>',
                        '<ol class="comment-list">%s</ol>', '<div class="user-comments">%s</div>') % body
        if kind == "form":
            return name('<form><label>%s</label><input name="q"><button>Go</button></form>', "<form><p>%s</p></form>",
                        '<div class="newsletter"><form><p>%s</p><button>OK</button></form></div>') % e(self._some(1, 1)[0])
        if kind == "aside":
            body = "".join(f"<p>{e(t)}</p>" for t in self._some(1, 4))
            return name("<aside>%s</aside>", '<div class="sidebar">%s</div>', '<div id="sidebar"><div class="widget">%s</div></div>',
                        '<div class="related">%s</div>', '<aside class="related"><ul>%s</ul></aside>') % body
        if kind == "notice":
            return name('<div class="cookie-notice"><p>%s</p></div>', '<div id="cookie-banner">%s</div>', '<div class="notice">%s</div>',
                        '<div class="consent" role="alert"><p>%s</p></div>') % e(self._some(1, 1)[0])
        return name('<div class="ad">%s</div>', '<div class="ads"><p>%s</p></div>', '<div id="advert">%s</div>',
                    '<div class="sponsored">%s</div>', '<section class="promo"><p>%s</p></section>') % e(self._some(1, 1)[0])

    def page(self) -> tuple[str, list[str]]:
        """A page and the texts of its article blocks."""
        e, r = entities.escape, self.rng
        texts = self.article[r.integers(0, len(self.article))]
        kinds = ["menu", "header", "footer", "comments", "form", "aside", "notice", "ad"]
        body = [f"<h{r.integers(1, 3)}>{e(texts[0])}</h1>" if r.random() < 0.5 else f"<h1>{e(texts[0])}</h1>"]
        body += [f"<{t}>{e(x)}</{t}>" for x in texts[1:]
                 for t in [("p", "p", "p", "p", "blockquote", "h2", "li")[r.integers(0, 7)] if r.random() < 0.3 else "p"]]
        inner = [(k, self._outside(k)) for k in kinds[3:] if r.random() < 0.15]
        for _, x in inner:
            body.insert(r.integers(1, len(body) + 1), x)
        wrap = ("<article>%s</article>", "<main>%s</main>", '<div class="content">%s</div>', '<div class="post">%s</div>',
                "<main><article>%s</article></main>", '<div id="content"><div class="entry">%s</div></div>',
                '<section class="story">%s</section>', '<div class="wrap"><div class="text">%s</div></div>',
                "<div>%s</div>")[r.integers(0, 9)]
        before = [self._outside(k) for k in kinds if k not in ("footer", "comments") and r.random() < 0.4]
        after = [self._outside(k) for k in kinds if k != "header" and r.random() < 0.4]
        page = f"<html><head><title>{e(texts[0])}</title></head><body>{''.join(before)}{wrap % ''.join(body)}{''.join(after)}</body></html>"
        return page, texts


def train(pages: list[str], layouts: int = 700, longest: int = 80, article_blocks: int = 24, article_chars: int = 600,
          other_blocks: int = 20, other_chars: int = 200, seed: int = 9) -> Labeller:
    """Fit a labeller from sample pages: as they are with weak labels, and in generated layouts.

    All bounds concern the training material alone. A page gives its first
    ``longest`` blocks as a training sequence, and to the generated layouts
    its first ``article_blocks`` article blocks of ``article_chars``
    characters and ``other_blocks`` others of ``other_chars``.
    """
    rng = np.random.default_rng(seed)
    xs, ys, article, other = [], [], [], []
    for page in pages:
        bs = blocks(page)
        y = [weak_label(b) for b in bs]
        inside = [b.text[:article_chars] for b, v in zip(bs, y, strict=True) if v == 1][:article_blocks]
        if inside:
            article.append(inside)
        other += [b.text[:other_chars] for b, v in zip(bs, y, strict=True) if v == 0][:other_blocks]
        if 0 < len(bs):
            xs.append(vectors(bs[:longest]))
            ys.append(np.array(y[:longest], np.float32))
    if article and other:
        make = Layouts(rng, article, other)
        for _ in range(layouts):
            page, _texts = make.page()
            bs = blocks(page)[:longest]
            y = [_known(b) for b in bs]
            xs.append(vectors(bs))
            ys.append(np.array(y, np.float32))
    model = Labeller()
    if xs:
        model.fit(xs, ys)
    return model


def _known(b: Block) -> int:
    """Labels of generated layouts: what their outside parts are is in the names; the rest is the article."""
    return 0 if {t.lstrip(".") for t in b.path} & OUTSIDE else 1


def main_text(bs: list[Block], p: np.ndarray) -> str:
    return "\n\n".join(b.text for b, x in zip(bs, p, strict=True) if x >= 0.5)


def extract(df: DataFrame, html: str = "html", keep: dict[str, str] | None = None, sample_pages: int = 150,
            sample_bytes: int = 100_000, training: dict[str, int] | None = None) -> DataFrame:
    """The ``keep`` columns, ``text`` and ``n_chars`` of every row.

    The labeller is fitted on the ``sample_pages`` pages of least hash among
    those of at most ``sample_bytes`` (15 MB at most reach the driver), under
    the bounds in ``training`` (see ``train``).
    """
    keep = keep if keep is not None else {"page_id": "page_id", "url": "url"}
    d = pick(df, **{f"k_{c}": src for c, src in keep.items()}, html=html)
    fit = d.where((F.octet_length("html") <= sample_bytes) & (F.octet_length("html") > 0)).select("html")
    sample = hash_sample(fit, ["html"], sample_pages).toPandas()["html"]
    shared = df.sparkSession.sparkContext.broadcast(train(sample.tolist(), **(training or {})))  # 0.1 MB

    @F.pandas_udf("text string, n_chars long")
    @returning
    def extracted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            texts: list[str] = []
            for at in range(0, len(pages), 128):
                bs = [blocks(x) for x in pages.iloc[at:at + 128]]
                ps = shared.value.label([vectors(b) for b in bs])
                texts += [main_text(b, p) for b, p in zip(bs, ps, strict=True)]
            yield pd.DataFrame({"text": texts, "n_chars": [len(t) for t in texts]})

    d = d.withColumn("r", extracted("html"))
    return d.select(*[F.col(f"k_{c}").alias(c) for c in keep], "r.*")
