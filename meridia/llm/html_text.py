"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks (runs of text between block-level tags). Each
block has a tag-path vector (hashed tags, classes, ids and roles of the open elements), a
hashed bag of all its words and a few numbers (length, share of link text, place). A
bidirectional LSTM in numpy reads the whole sequence, so that every block is labelled in
the context of the document, and the blocks labelled content make the text.

There are no labelled pages, so the network is trained on a bounded sample of
``TRAIN_PAGES`` pages (by a hash of page_id, none longer than ``TRAIN_CHARS``) with labels
from markup conventions: what stands in navigation, header, footer, aside and form
elements, or in elements whose class, id or role says so, is not content; the rest of an
article, main or content element is. Each sampled page is also used with disguises: the
article as a plain ``div`` with a telling class, and with notices, sidebars, forms, adverts
and reader comments put in from other pages' text. Training is seeded and repeats exactly.

All pages are labelled whole; long pages are read as one sequence. Edge cases: null and
empty html give the empty text; html without tags is one block; malformed markup (open
comments, stray or missing end tags, unquoted attributes) is read as browsers would, as
far as blocks go; repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.llm.common import table

TRAIN_PAGES = 120
TRAIN_CHARS = 40_000
STEPS = 140
HIDDEN = 16
PATH_DIMS, WORD_DIMS, PLAIN_DIMS = 64, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + PLAIN_DIMS
SEED = 11

# Elements by their part in a page.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = BLOCK_TAGS - frozenset(["body", "html", "head", "title", "button", "label", "option", "caption", "td", "th", "tr", "li", "dd", "dt"])
SIBLINGS = {"li": "li", "dd": "dd dt", "dt": "dd dt", "option": "option", "tr": "tr td th", "td": "td th", "th": "td th"}
RAW_TAGS = "script style textarea title"  # end with their end tag only
EMBEDDED_TAGS = "noscript template svg iframe object canvas audio video"
OFF_TAGS = frozenset("nav header footer aside form menu button select label dialog option legend".split())
OFF_WORDS = frozenset("ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright dialog disclaimer footer form header login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related reply replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split())
ON_WORDS = frozenset("article articlebody body content entry main post story text".split())

RAW, EMBEDDED = "|".join(RAW_TAGS.split()), "|".join(EMBEDDED_TAGS.split())
# An embedded element without an end tag, or closed in its own tag, hides nothing but the tag.
PART = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z)|<({EMBEDDED})\b(?:[^>]*/>|[^>]*>.*?</\2\s*>|[^>]*>)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[^\W_]+")
SPACE = re.compile(r"\s+")


def blocks_of(html: str) -> list[tuple[str, tuple[str, ...], int]]:
    """(text, path, characters of link text) of each leaf block in page order; the path names open elements."""
    out: list[tuple[str, tuple[str, ...], int]] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # (tag, its path entries)
    parts: list[str] = []
    state = [0, 0]  # open links, characters of link text

    def flush():
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text:
                out.append((text, tuple(e for _, entries in stack for e in entries), state[1]))
            parts.clear()
            state[1] = 0

    def put(text: str):
        if text:
            parts.append(text)
            if state[0]:
                state[1] += len(text)

    def pop_to(names: tuple[str, ...], within: tuple[str, ...] = ()):
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                flush()
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    at = 0
    for m in PART.finditer(html):
        put(html[at : m.start()])
        at = m.end()
        tag = m.group(4)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br" or tag in ("hr", "img") and not m.group(3):
            if tag == "hr":
                flush()
            else:
                put(" ")
        elif tag == "a":
            state[0] = 0 if m.group(3) else 1
        elif tag in BLOCK_TAGS:
            if m.group(3):
                if any(t == tag for t, _ in stack):
                    pop_to((tag,))
                else:
                    flush()
                continue
            flush()
            state[0] = 0
            if tag in CLOSES_P:
                pop_to(("p",), ("div", "td", "li", "article", "section", "main", "blockquote", "form"))
            elif tag in SIBLINGS:
                pop_to(tuple(SIBLINGS[tag].split()), ("ul", "ol", "dl", "table", "select"))
            entries = [tag]
            for a in ATTRIBUTE.finditer(m.group(5) or ""):
                entries += [f".{w}" for w in WORDS.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())]
            stack.append((tag, tuple(entries)))
    put(html[at:])
    flush()
    return [b for b in out if "head" not in b[1]]


def _place(word: str, dims: int, cache: dict[str, int]) -> int:
    got = cache.get(word)
    if got is None:
        if len(cache) > 200_000:
            cache.clear()
        got = cache[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % dims
    return got


def vectors(blocks, caches: tuple[dict, dict]) -> np.ndarray:
    x = np.zeros((len(blocks), DIMS), np.float32)
    n = len(blocks)
    for i, (text, path, linked) in enumerate(blocks):
        for e in path:
            x[i, _place(e, PATH_DIMS, caches[0])] += 1.0
        places = [_place(w, WORD_DIMS, caches[1]) for w in text.split()]
        x[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = np.bincount(places, minlength=WORD_DIMS) / len(places)
        x[i, -8:] = (np.log1p(len(text)) / 5, linked / (len(text) + 1), i / n, (n - i) / n, len(path) / 8, text[-1] in ".!?…", text.count(" ") / (len(text) + 1) * 4, 1.0)
    return x


def convention(path: tuple[str, ...], text: str, linked: int) -> int:
    """Content (1) or not, from markup conventions; the training labels."""
    tags = [e for e in path if e[0] != "."]
    named = {e[1:] for e in path if e[0] == "."}
    inside = "article" in tags or "main" in tags or named & ON_WORDS
    if "article" in tags:  # a header or footer within an article is judged by its class
        tags = [t for i, t in enumerate(tags) if t != "header" or "article" not in tags[:i]]
    if OFF_TAGS & set(tags) or named & OFF_WORDS:
        return 0
    return int(bool(inside) or (linked < 0.5 * len(text) and (len(text) > 60 or text[-1] in ".!?")))


class Labeller:
    """A bidirectional LSTM with a logistic output at each block; parameters in one dictionary."""

    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p = parameters

    @classmethod
    def new(cls, dims: int = DIMS, hidden: int = HIDDEN, seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        p = {"out": rng.normal(0, 0.3, 2 * hidden).astype(np.float32), "bias": np.zeros(1, np.float32)}
        for d in "fb":
            p[f"{d}w"] = (rng.normal(0, 1, (dims, 4 * hidden)) / np.sqrt(dims)).astype(np.float32)
            p[f"{d}u"] = (rng.normal(0, 1, (hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            p[f"{d}b"] = np.repeat(np.array([0, 1, 0, 0], np.float32), hidden)  # forget gates open
        return cls(p)

    def _run(self, x, mask, d):
        """x: (pages, steps, dims); gates and states of each step."""
        p, (n, steps, _) = self.p, x.shape
        h = np.zeros((n, self.p["fu"].shape[0]), np.float32)
        c, saved = h, []
        xs = x @ p[f"{d}w"] + p[f"{d}b"]
        size, out = h.shape[1], np.zeros((n, steps, h.shape[1]), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            g = xs[:, t] + h @ p[f"{d}u"]
            s = 1 / (1 + np.exp(-np.clip(g[:, : 3 * size], -30, 30)))
            i, f, o, z = s[:, :size], s[:, size : 2 * size], s[:, 2 * size :], np.tanh(g[:, 3 * size :])
            m = mask[:, t, None]
            before = c
            c = m * (f * c + i * z)
            y = np.tanh(c)
            previous, h = h, m * (o * y)
            saved.append((t, i, f, o, z, y, before, previous, m))
            out[:, t] = h
        return out, saved

    def probabilities(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        hf, hb = self._run(x, mask, "f")[0], self._run(x, mask, "b")[0]
        return 1 / (1 + np.exp(-(np.concatenate([hf, hb], 2) @ self.p["out"] + self.p["bias"])))

    def gradients(self, x, y, mask) -> tuple[float, dict[str, np.ndarray]]:
        p, size = self.p, self.p["fu"].shape[0]
        (hf, sf), (hb, sb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate([hf, hb], 2)
        prob = 1 / (1 + np.exp(-(both @ p["out"] + p["bias"])))
        total = mask.sum()
        loss = -(mask * np.log(np.where(y > 0, prob, 1 - prob) + 1e-7)).sum() / total
        e = mask * (prob - y) / total
        g = {"out": (both * e[:, :, None]).sum((0, 1)), "bias": np.array([e.sum()], np.float32)}
        for d, saved, part in (("f", sf, p["out"][:size]), ("b", sb, p["out"][size:])):
            dx = np.zeros((*x.shape[:2], 4 * size), np.float32)
            gu = np.zeros_like(p[f"{d}u"])
            dh = dc = np.zeros((len(x), size), np.float32)
            for t, i, f, o, z, tc, before, previous, m in reversed(saved):
                dh = (dh + e[:, t, None] * part) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                a = np.concatenate([dc * z * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - z * z)], 1)
                dx[:, t] = a
                gu += previous.T @ a
                dh, dc = a @ p[f"{d}u"].T, dc * f
            flat = dx.reshape(-1, 4 * size)
            g |= {f"{d}w": x.reshape(-1, x.shape[2]).T @ flat, f"{d}u": gu, f"{d}b": flat.sum(0)}
        return float(loss), g


def padded(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(map(len, items))
    x, mask = np.zeros((len(items), steps, DIMS), np.float32), np.zeros((len(items), steps), np.float32)
    for k, v in enumerate(items):
        x[k, : len(v)], mask[k, : len(v)] = v, 1
    return x, mask


def disguised(html: str, rng: np.random.Generator, texts: list[str]) -> str:
    """A page with other markup for its article and with foreign blocks put in."""
    say = lambda: texts[rng.integers(len(texts))] if texts else "text"
    off = lambda ws: ws[rng.integers(len(ws))]
    extra = [
        f'<div class="{off(["cookie-notice", "notice", "banner", "consent popup"])}"><p>{say()}</p></div>',
        f'<aside class="{off(["sidebar", "related", "widget"])}"><h3>{say()[:30]}</h3><p>{say()}</p></aside>',
        f"<form><label>{say()[:20]}</label><button>{say()[:12]}</button><p>{say()[:80]}</p></form>",
        f'<section id="{off(["comments", "respond"])}" class="comments"><div class="comment"><p>{say()}</p></div><div class="comment"><p>{say()}</p></div></section>',
        f'<div class="{off(["ad", "advert", "promo", "sponsored"])}">{say()}</div>',
        f'<header class="site-header"><p>{say()[:60]}</p></header>',
    ]
    kept = [e for e in extra if rng.random() < 0.5]
    way = rng.integers(4)
    if way == 1:
        html = re.sub(r"<article\b", "<main", html).replace("</article>", "</main>")
    elif way == 2:
        html = re.sub(r"<article\b", '<div class="content"', html).replace("</article>", "</div>")
    for e in kept:
        if rng.random() < 0.4 and "<p>" in html:
            cut = html.rfind("<p>")
            html = html[:cut] + e + html[cut:]
        else:
            cut = html.find("<footer") if rng.random() < 0.5 else html.find("<article")
            html = html[:cut] + e + html[cut:] if cut > 0 else html + e
    return html


def train(pages: list[str], steps: int = STEPS, seed: int = SEED) -> Labeller:
    rng = np.random.default_rng(seed)
    net = Labeller.new(seed=seed)
    texts = [b[0] for h in pages[:50] for b in blocks_of(h)][:400]
    caches: tuple[dict, dict] = ({}, {})
    items = []
    for html in pages + [disguised(h, rng, texts) for h in pages]:
        if blocks := blocks_of(html):
            items.append((vectors(blocks, caches), np.array([convention(path, text, linked) for text, path, linked in blocks], np.float32)))
    if not items:
        return net
    mean = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    for step in range(1, steps + 1):
        picked = [items[i] for i in rng.integers(0, len(items), 32)]
        x, mask = padded([v for v, _ in picked])
        y = np.zeros(mask.shape, np.float32)
        for k, (_, labels) in enumerate(picked):
            y[k, : len(labels)] = labels
        _, g = net.gradients(x, y, mask)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in g.items():
            v = v * min(1.0, 5.0 / (norm + 1e-9))
            mean[k] = 0.9 * mean[k] + 0.1 * v
            square[k] = 0.99 * square[k] + 0.01 * v * v
            net.p[k] = (net.p[k] - rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def fit(pages: DataFrame, bound: int = TRAIN_PAGES, seed: int = SEED) -> Labeller:
    """Train on a bounded sample: the ``bound`` pages of moderate length with the least hashes of page_id."""
    part = min(1.0, 8 * bound / max(1, pages.count()))  # few candidates a task, so that little is sent
    mark = F.xxhash64("page_id", F.lit(seed))
    rows = pages.where(F.pmod(mark, F.lit(1_000_000)) < int(1_000_000 * part) + 1).where(F.length("html").between(1, TRAIN_CHARS)).select("html", mark.alias("h")).orderBy("h", "html").limit(bound).collect()
    return train([r["html"] for r in rows], seed=seed)


def extract(pages: DataFrame, net: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars) of each row."""
    parameters = net.p

    def run(batches):
        own, caches = Labeller(parameters), ({}, {})
        for batch in batches:
            htmls = batch.column(2).to_pylist()
            texts = [""] * len(htmls)
            size, at, found = 0, [], []

            def label():
                order = sorted(range(len(at)), key=lambda k: len(found[k]))
                start = 0
                while start < len(order):  # pages of like length together
                    longest = len(found[order[min(start + 255, len(order) - 1)]])
                    end = start + max(1, min(256, 60_000 // max(longest, 1)))
                    group = order[start:end]
                    x, mask = padded([vectors(found[k], caches) for k in group])
                    good = own.probabilities(x, mask) >= 0.5
                    for row, k in zip(good, group):
                        texts[at[k]] = "\n".join(b[0] for b, g in zip(found[k], row) if g)
                    start = end

            for i, html in enumerate(htmls):
                if html and (blocks := blocks_of(html)):
                    at.append(i), found.append(blocks)
                    size += len(html)
                if size > 2_000_000:
                    label()
                    size, at, found = 0, [], []
            if at:
                label()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return extract(pages, fit(pages))
