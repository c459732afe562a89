"""Main text of HTML pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between the borders
of block elements.  Each block becomes a vector of its hashed tag path (tags,
class and id words of all open elements), its hashed words and a few figures.
A bidirectional LSTM, in numpy, reads all blocks of the page and labels each
one with the whole page as context.  It is trained on pages made up from
layouts with known blocks, filled with lines of the pages at hand.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PATH_DIMS, WORD_DIMS, FIGURES = 160, 32, 6
DIMS = PATH_DIMS + WORD_DIMS + FIGURES
HIDDEN = 20
#: Pages whose lines fill the training pages, and how many of those are made.
SAMPLE_PAGES, TRAINING_PAGES, EPOCHS = 200, 480, 24

#: Sets main text apart in training pages; it is taken out before a block is read.
MARK = "\u2060"

#: Fixed values of HTML: elements whose content is no text, those of them that run to the end of the page without an end tag,
#: those that "/>" closes, and elements without an end tag.
RAW = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "select", "object", "canvas", "math", "title")
TO_END = frozenset(("script", "style", "textarea", "title"))
FOREIGN = frozenset(("svg", "math"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary "
    "table tbody td tfoot th thead tr ul".split())
#: What a start tag closes, up to an element that holds it.
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
          "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*)"
    r"|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?>\"[^\"]*\"|'[^']*'|[^\"'>]+)*+>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?>\"[^\"]*\"|'[^']*'|[^\"'>]+)*+)>"
    r"|<[/!?][^>]*>|<[a-zA-Z][^<>]*>", re.S | re.I)
_CLOSE = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_ATTR = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
_WORDISH = re.compile(r"[^\W\d_]+")


def _bucket(token: str, dims: int) -> int:
    return zlib.crc32(token.encode()) % dims


_path_of: dict[tuple[str, str], tuple[int, ...]] = {}


def _path(tag: str, attrs: str) -> tuple[int, ...]:
    """Places of an element's tokens in the path vector; those of long attributes are not kept."""
    key = (tag, attrs)
    got = _path_of.get(key)
    if got is None:
        tokens = {"t:" + tag}
        for name, *vals in _ATTR.findall(attrs):
            value = next((v for v in vals if v), "")
            name = name.lower()
            if name in ("hidden", "aria-hidden"):
                if value.lower() != "false":
                    tokens.add("hidden")
                continue
            for w in _PART.findall(value):
                w = w.lower()
                tokens.add("c:" + (w[:-1] if len(w) > 3 and w.endswith("s") else w))
        got = tuple(_bucket(t, PATH_DIMS) for t in sorted(tokens))
        if len(attrs) < 300:
            if len(_path_of) > 50_000:
                _path_of.clear()
            _path_of[key] = got
    return got


def blocks(page: str | None) -> list[tuple[str, list[tuple[int, ...]], int]]:
    """(text, path, characters inside links) of each leaf block in page order; text with its references decoded and trimmed."""
    page = page or ""
    stack: list[tuple[str, tuple[int, ...]]] = []
    out, run, path, linked, links_open = [], [], None, 0, 0

    def flush():
        nonlocal run, path, linked
        if run:
            text = " ".join(html.unescape("".join(run)).split())
            if text:
                out.append((text, path, linked))
        run, path, linked = [], None, 0

    def text(a, b):
        nonlocal path, linked
        s = page[a:b]
        if s:
            if path is None and not s.isspace():
                path = [p for _, p in stack]
            run.append(s)
            if links_open:
                linked += len(s)

    at, unclosed = 0, set()
    while m := _TOKEN.search(page, at):
        text(at, m.start())
        at = m.end()
        if m["raw"]:
            tag = m["raw"].lower()
            if tag in unclosed or (tag in FOREIGN and page[at - 2] == "/"):
                continue
            if shut := _CLOSE[tag].search(page, at):
                at = shut.end()
            elif tag in TO_END:
                at = len(page)
            else:  # only the start tag is left out; no later one of its kind is closed either
                unclosed.add(tag)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
        if m["end"]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    links_open -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    break
            continue
        shut, within = CLOSES.get(tag, ("p", ()) if tag in BLOCK else ("", ()))
        if tag in BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p" or stack[k][0] in shut.split():
                    links_open -= sum(x[0] == "a" for x in stack[k:])
                    del stack[k:]
                    if tag not in CLOSES:
                        break
                elif stack[k][0] in within or (not within and stack[k][0] in BLOCK):
                    break
        links_open += tag == "a"
        stack.append((tag, _path(tag, m["attrs"] or "")))
    text(at, len(page))
    flush()
    return out


def vectors(found: list[tuple[str, list, int]]) -> np.ndarray:
    """One row per block: path, words, figures."""
    x = np.zeros((len(found), DIMS), np.float32)
    for r, (text, path, linked) in enumerate(found):
        for depth, places in enumerate(reversed(path)):
            for p in places:
                x[r, p] = max(x[r, p], 1.0 / (1.0 + 0.1 * depth))
        words = text.lower().split()
        h = np.bincount([zlib.crc32(w.encode("utf-8", "replace")) % WORD_DIMS for w in words], minlength=WORD_DIMS)
        x[r, PATH_DIMS:PATH_DIMS + WORD_DIMS] = h / max(1, len(words))
        ends = text.count(".") + text.count(",") + text.count("?") + text.count("!")
        x[r, -FIGURES:] = (np.log1p(len(words)) / 6, min(1.0, linked / max(1, len(text))), min(1.0, 5 * ends / max(1, len(words))),
                           len(path) / 12, (r + 0.5) / len(found), 1.0 if text.endswith((".", "!", "?")) else 0.0)
    return x


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


class BlockLabeller:
    """Bidirectional LSTM over block vectors, then one output per block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p["W" + d] = rng.normal(0, 0.15, (DIMS, 4 * hidden)).astype(np.float32)
            self.p["U" + d] = rng.normal(0, 0.15, (hidden, 4 * hidden)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden:2 * hidden] = 1.0
        self.p["V"] = rng.normal(0, 0.2, (2 * hidden, 1)).astype(np.float32)
        self.p["o"] = np.zeros(1, np.float32)

    def _run(self, d: str, x: np.ndarray, live: np.ndarray, keep: bool):
        """Hidden states of one direction; ``x`` is (time, page, dims), ``live`` marks blocks that exist."""
        T, B, _ = x.shape
        H, U = self.h, self.p["U" + d]
        z = x.reshape(T * B, -1) @ self.p["W" + d] + self.p["c" + d]
        z = z.reshape(T, B, 4 * H)
        h, c = np.zeros((B, H), np.float32), np.zeros((B, H), np.float32)
        hs, past = np.zeros((T, B, H), np.float32), []
        for t in range(T) if d == "f" else range(T - 1, -1, -1):
            a = z[t] + h @ U
            i, f, o = _sigmoid(a[:, :H]), _sigmoid(a[:, H:2 * H]), _sigmoid(a[:, 2 * H:3 * H])
            g = np.tanh(a[:, 3 * H:])
            c2 = f * c + i * g
            k = live[t][:, None]
            tc = np.tanh(c2)
            if keep:
                past.append((t, h, c, i, f, o, g, tc))
            h, c = np.where(k, o * tc, h), np.where(k, c2, c)
            hs[t] = h
        return hs, past

    def scores(self, x: np.ndarray, live: np.ndarray, keep: bool = False):
        f, pf = self._run("f", x, live, keep)
        b, pb = self._run("b", x, live, keep)
        hs = np.concatenate((f, b), axis=2)
        return _sigmoid(hs @ self.p["V"] + self.p["o"])[:, :, 0], (hs, pf, pb)

    def gradients(self, x, live, y):
        """Loss and gradients by backpropagation through time."""
        s, (hs, pf, pb) = self.scores(x, live, True)
        H, n = self.h, live.sum()
        ds = np.where(live, s - y, 0.0).astype(np.float32) / n
        g = {"V": np.einsum("tbh,tb->h", hs, ds)[:, None], "o": np.array([ds.sum()], np.float32)}
        dhs = ds[:, :, None] * self.p["V"][:, 0]
        for d, past, dh_out in (("f", pf, dhs[:, :, :H]), ("b", pb, dhs[:, :, H:])):
            U = self.p["U" + d]
            da_all = np.zeros(x.shape[:2] + (4 * H,), np.float32)
            dU = np.zeros_like(U)
            dh, dc = np.zeros((x.shape[1], H), np.float32), np.zeros((x.shape[1], H), np.float32)
            for t, h0, c0, i, f, o, gg, tc in reversed(past):
                k = live[t][:, None]
                dh = dh + dh_out[t]
                dht, dct = np.where(k, dh, 0), np.where(k, dc, 0)
                dct = dct + dht * o * (1 - tc * tc)
                da = np.concatenate((dct * gg * i * (1 - i), dct * c0 * f * (1 - f), dht * tc * o * (1 - o), dct * i * (1 - gg * gg)), axis=1)
                da_all[t] = da
                dU += h0.T @ da
                dh = np.where(k, da @ U.T, dh)
                dc = np.where(k, dct * f, dc)
            flat = da_all.reshape(-1, 4 * H)
            g["W" + d] = x.reshape(-1, x.shape[2]).T @ flat
            g["U" + d], g["c" + d] = dU, flat.sum(0)
        loss = -np.where(live, y * np.log(s + 1e-7) + (1 - y) * np.log(1 - s + 1e-7), 0).sum() / n
        return loss, g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = EPOCHS, batch: int = 48, rate: float = 0.01, seed: int = 3) -> float:
        """Adam over batches of pages of similar length; returns the last mean loss."""
        rng = random.Random(seed)
        pages = sorted(pages, key=lambda p: len(p[0]))
        groups = [pages[k:k + batch] for k in range(0, len(pages), batch)]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step, last = 0, 0.0
        for e in range(epochs):
            rng.shuffle(groups)
            total = 0.0
            for group in groups:
                x, live = padded([p[0] for p in group])
                y = np.zeros(live.shape, np.float32)
                for b, p in enumerate(group):
                    y[:len(p[1]), b] = p[1]
                loss, g = self.gradients(x, live, y)
                total += loss
                step += 1
                r = rate * (1 - e / epochs) + 1e-4
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = self.p[k] - r * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            last = total / len(groups)
        return last

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Whether each block is main text, page by page; pages of similar length go together."""
        out: list = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if len(pages[k])), key=lambda k: len(pages[k]))
        at = 0
        while at < len(order):
            to = at + 1
            while to < len(order) and (to - at + 1) * len(pages[order[to]]) <= 12_000:
                to += 1
            group = order[at:to]
            x, live = padded([pages[k] for k in group])
            s, _ = self.scores(x, live)
            for b, k in enumerate(group):
                out[k] = s[:len(pages[k]), b] >= 0.5
            at = to
        return out


def padded(xs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    T = max(len(x) for x in xs)
    out, live = np.zeros((T, len(xs), DIMS), np.float32), np.zeros((T, len(xs)), bool)
    for b, x in enumerate(xs):
        out[:len(x), b] = x
        live[:len(x), b] = True
    return out, live


# ---- training pages -------------------------------------------------------------------------------------------------

_NAMES = {
    "header": "header masthead banner site-header top-bar page-header branding logo", "nav": "nav menu navbar navigation breadcrumb breadcrumbs main-menu tabs pagination toc skip-links",
    "footer": "footer site-footer bottom copyright legal colophon page-footer", "aside": "sidebar side aside widget related related-posts recommended trending popular tags share social author-bio",
    "notice": "notice cookie cookie-consent alert consent gdpr popup modal banner-notice subscribe paywall message warning-box", "ad": "ad ads advert advertisement sponsored promo adsense ad-slot banner-ad promoted commercial",
    "form": "form newsletter search search-form login signup subscribe-form contact comment-form", "comments": "comments comment comment-list responses discussion replies user-comments disqus comment-body reply reader-comments",
}
_MAIN = "content article article-body post post-content entry entry-content story story-body main main-content text body-text page-content".split()


def training_page(lines: list[str], rng: random.Random) -> str:
    """A made-up page; blocks of main text begin with ``MARK``."""
    def say(short: float = 0.3) -> str:
        words = rng.choice(lines).split() or ["x"]
        if rng.random() < short:
            words = words[:rng.randint(1, 6)]
        else:
            words = (words + (rng.choice(lines).split() if rng.random() < 0.5 else []))[:rng.randint(3, 80)]
        return html.escape(" ".join(words), quote=False)

    mark = lambda s: MARK + s

    def attrs(kind):
        r = rng.random()
        name = rng.choice(_NAMES[kind].split())
        if r < 0.75:
            extra = rng.choice(["", " box", " clearfix", " wrap", " col-3"])
            return f' class="{name}{extra}"'
        return f' id="{name}"' if r < 0.9 else f' class="{name}" id="{rng.choice("abcxyz")}{rng.randint(0, 9)}"'

    def boiler(kind):
        tag = {"header": "header", "nav": "nav", "footer": "footer", "aside": "aside", "form": "form"}.get(kind)
        named = rng.random() < 0.5 or tag is None
        tag = tag if tag and (not named or rng.random() < 0.5) else rng.choice(["div", "section", "div", "ul"]) if kind != "form" else "form"
        a = attrs(kind) if named or tag in ("div", "section", "ul") else ""
        if kind == "nav" or (kind in ("aside", "footer", "header") and rng.random() < 0.4):
            items = "".join(f'<li><a href="/x">{say(0.9)}</a></li>' for _ in range(rng.randint(2, 9)))
            inner = items if tag == "ul" else f"<ul>{items}</ul>"
        elif kind == "comments":
            person = rng.choice(["div", "li", "article"])
            inner = (f"<h3>{say(0.9)}</h3>" if rng.random() < 0.6 else "") + "".join(
                f"<{person}{attrs('comments') if rng.random() < 0.7 else ''}>" + (f"<span>{say(0.9)}</span>" if rng.random() < 0.5 else "")
                + "".join(f"<p>{say(0.2)}</p>" for _ in range(rng.randint(1, 3))) + f"</{person}>" for _ in range(rng.randint(1, 7)))
        elif kind == "form":
            inner = f'<label>{say(0.9)}</label><input name="q"><button>{say(0.9)}</button>' + (f"<p>{say(0.4)}</p>" if rng.random() < 0.4 else "")
        else:
            inner = rng.choice([say(0.2), f"<p>{say(0.2)}</p>", f"<h3>{say(0.9)}</h3><p>{say(0.3)}</p>", f"&copy; {say(0.5)} &middot; {say(0.3)}", f'{say(0.4)} <a href="#">{say(0.9)}</a>'])
            if rng.random() < 0.25:
                inner += f"<p>{say(0.2)}</p>"
        return f"<{tag}{a}>{inner}</{tag}>\n"

    def piece():
        r = rng.random()
        t = mark(say(0.25))
        if rng.random() < 0.15:
            t = t + f' <a href="/y">{say(0.9)}</a> ' + say(0.8)
        if r < 0.6:
            return rng.choice([f"<p>{t}</p>", f"<p>{t}\n", f"<p><b>{t}</p>", f"<p><b>{t}<br>", f"<p><em>{t}</em></p>"])
        if r < 0.7:
            return f"<h{rng.randint(2, 4)}>{mark(say(0.8))}</h{2}>"
        if r < 0.8:
            k = rng.choice(["ul", "ol"])
            return f"<{k}>" + "".join(f"<li>{mark(say(0.6))}</li>" for _ in range(rng.randint(1, 5))) + f"</{k}>"
        if r < 0.86:
            return f"<blockquote>{rng.choice([t, f'<p>{t}</p>'])}</blockquote>"
        if r < 0.9:
            return f'<figure><img src="a.png"><figcaption>{t}</figcaption></figure>'
        if r < 0.94:
            return f"<table><tr><td>{t}</td><td>{mark(say(0.9))}</td></tr></table>"
        return rng.choice([f"<pre>{t}</pre>", f"<div>{t}</div>"])

    body = [f"<h1>{mark(say(0.5))}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 2, 4, 6, 8, 12, 20])):
        body.append(piece())
        if rng.random() < 0.1:
            body.append(boiler(rng.choice(["ad", "notice", "aside", "form", "nav"])))
    if rng.random() < 0.15:
        body.append(boiler("comments"))
    cls = f' class="{rng.choice(_MAIN)}"'
    r = rng.random()
    inner = "\n".join(body) if rng.random() < 0.5 else "".join(body)
    if r < 0.45:
        art = f"<article{cls if rng.random() < 0.4 else ''}>{inner}</article>"
    elif r < 0.6:
        art = f"<main{cls if rng.random() < 0.4 else ''}>{inner}</main>"
    elif r < 0.7:
        art = f"<main><article>{inner}</article></main>"
    else:
        art = f"<{rng.choice(['div', 'section'])}{cls}>{inner}</div>"
    kinds = ["header", "nav", "nav", "ad", "notice", "aside", "form"]
    before = [boiler(k) for k in kinds if rng.random() < 0.45]
    after = [boiler(k) for k in ("comments", "aside", "ad", "form", "notice", "nav", "footer", "footer") if rng.random() < 0.45]
    rng.shuffle(before)
    middle = "".join(before) + art + "".join(after)
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["wrapper", "container", "page", "site", "row"])}">{middle}</div>'
    return f"<!DOCTYPE html><html><head><title>{say(0.5)}</title><style>p{{}}</style></head><body>{middle}</body></html>"


def train(lines: list[str], pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = 7) -> BlockLabeller:
    """A labeller trained on made-up pages; the same lines always give the same one."""
    rng, data = random.Random(seed), []
    lines = sorted(set(lines)) or ["a few words."]
    for _ in range(pages):
        found = blocks(training_page(lines, rng))
        if found:
            y = np.array([MARK in t for t, _, _ in found], np.float32)
            data.append((vectors([(t.replace(MARK, ""), p, n) for t, p, n in found]), y))
    model = BlockLabeller()
    model.fit(data, epochs)
    return model


def sample_lines(pages: DataFrame, count: int = SAMPLE_PAGES) -> list[str]:
    """Up to ten lines each of about ``count`` pages, drawn by a hash of the page id; words for the training pages only."""
    share = min(1.0, count / max(1, pages.count()))

    @F.pandas_udf("array<string>")
    def some(col: pd.Series) -> pd.Series:
        return col.map(lambda h: [t[:400] for t, _, _ in blocks(h)[:40:4]])

    drawn = pages.where(F.pmod(F.xxhash64("page_id"), F.lit(1_000_003)) < share * 1_000_003)
    return [x for r in drawn.select(some("html").alias("x")).collect() for x in r["x"]]


def main_text(page_html: Column, model: BlockLabeller) -> Column:
    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = []
            for k in range(0, len(part), 256):
                found = [blocks(h) for h in part.iloc[k:k + 256]]
                marks = model.label([vectors(f) for f in found])
                out += ["\n".join(t for (t, _, _), m in zip(f, ms) if m) for f, ms in zip(found, marks)]
            yield pd.Series(out, dtype=object)

    return extract(page_html)


def extract_pages(pages: DataFrame, model: BlockLabeller | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of ``pages``.

    Null and empty pages, and pages without main text, give an empty string.
    Repeated rows are extracted one by one; other columns are not read.
    """
    model = model or train(sample_lines(pages))
    return pages.select("page_id", "url", main_text(F.col("html"), model).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
