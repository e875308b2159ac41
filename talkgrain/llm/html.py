"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: the text between block-level tags, with the path of open
tags (names, classes, ids, roles), the share of it inside links, and its words. Path and words have
hashed embeddings; a bidirectional LSTM in numpy reads the sequence, so each block is judged with the
whole page around it, and labels it main text or not. Characters references are decoded, white space
inside a block becomes one space, and the main blocks are joined by line feeds.

There are no labelled pages, so the labeller learns from pages that say themselves what is what: a
bounded sample of the table whose blocks stand inside or outside ``article`` or ``main``, and drawn pages
whose parts (menus, notices, comments, forms, adverts, sidebars) are named in many ways.

Pages stay where they are: one pass, no shuffle. Cases: a null or empty page, or one without main text,
gives an empty text; broken markup is read as far as it goes; a script, style, title or textarea without
end tag takes the rest of the page, as in a browser, any other element that is never closed or closes
itself takes nothing; repeated rows are read each; an empty table gives an empty table; only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.text import in_small_batches, mix, word_hashes, word_spans

SAMPLE = 400
DRAWN = 500
#: A longer page is labelled like any other but not learned from.
LEARN_CHARS = 100_000
BUCKETS = 1 << 12
PATH_SIZE, WORD_SIZE, HIDDEN = 16, 8, 16
ROUNDS = 260
BATCH = 24
#: Blocks, with padding, that run through the network together.
CELLS = 1 << 14

# Elements of HTML.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is characters up to their end tag, to the end of the page where there is none.
_RAW = "script|style|textarea|title"
#: Not shown, and elements like others: what follows one that is never closed is not inside it.
_HIDDEN = set("iframe noscript object select svg template".split())
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q"
              " s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S | re.I)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_PARTS = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


@dataclass
class Block:
    path: tuple[str, ...]
    text: str
    linked: int


def _element(tag: str, attributes: str) -> str:
    """The tag with the words of its class, id and role: ``div class:side``."""
    words = [tag]
    for name, *values in _NAMED.findall(attributes):
        words += [f"{name.lower()}:{w}" for w in _PARTS.findall("".join(values).lower())]
    return " ".join(words)


def _hidden(tokens: list[re.Match]) -> dict[int, int]:
    """The start of each hidden element that is closed -> the end of its end tag. An end tag closes the
    last open element of its name, so one that is never closed stays open beside later ones."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {}
    for token in tokens:
        tag = (token[3] or "").lower()
        if tag not in _HIDDEN:
            continue
        if not token[2]:
            if not _SELF_CLOSED.search(token[4]):
                opened.setdefault(tag, []).append(token.start())
        elif opened.get(tag):
            ends[opened[tag].pop()] = token.end()
    return ends


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order."""
    out: list[Block] = []
    names: list[str] = []
    path: list[str] = []
    depth: Counter[str] = Counter()
    held: list[str] = []
    state = {"at": (), "linked": 0}

    def flush() -> None:
        if held:
            text = _WHITE.sub(" ", entities.unescape("".join(held))).strip()
            if text:
                out.append(Block(state["at"], text, state["linked"]))
            held.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if not held:
            if not text.strip():
                return
            state["at"] = tuple(path)
        held.append(text)
        if depth["a"]:
            state["linked"] += len(text)

    def leave(k: int) -> None:
        depth.subtract(names[k:])
        del names[k:], path[k:]

    at = 0
    tokens = list(_TOKEN.finditer(page))
    hidden = _hidden(tokens)
    for token in tokens:
        if token.start() < at:  # inside a hidden element
            continue
        if token.start() > at:
            add(page[at:token.start()])
        at = token.end()
        if token[3] is None:
            continue
        tag = token[3].lower()
        if tag in _HIDDEN:
            at = hidden.get(token.start(), at)
            continue
        if tag not in _INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if token[2]:
            if depth[tag]:
                leave(next(k for k in range(len(names) - 1, -1, -1) if names[k] == tag))
            continue
        if tag not in _INLINE:
            closes = _CLOSES.get(tag)
            if depth["p"] or closes:
                for k in range(len(names) - 1, -1, -1):
                    if names[k] == "p" or closes and names[k] in closes:
                        leave(k)
                        break
                    if names[k] in ("div", "ul", "ol", "table", "article", "section", "main", "body"):
                        break
        if tag not in _VOID:
            names.append(tag)
            depth[tag] += 1
            path.append(_element(tag, token[4] or ""))
    if at < len(page):
        add(page[at:])
    flush()
    return out


def _bucket(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(data, np.array([0]), np.array([len(data)]))[0] % (BUCKETS - 1)) + 1


@dataclass
class Page:
    """What the network reads of some pages: path rows, word rows and numbers of every block."""

    size: np.ndarray
    path: np.ndarray
    path_first: np.ndarray
    word: np.ndarray
    word_first: np.ndarray
    number: np.ndarray


_paths: dict[tuple[str, ...], list[int]] = {}


def _path_rows(path: tuple[str, ...]) -> list[int]:
    got = _paths.get(path)
    if got is None:
        if len(_paths) > 50_000:
            _paths.clear()
        words = [w for element in path for w in element.split()]
        tags = [element.split()[0] for element in path]
        words += [f"last:{tags[-1]}"] if tags else ["last:"]
        got = _paths[path] = [_bucket(w) for w in dict.fromkeys(words)]
    return got


def read(pages: list[list[Block]]) -> Page:
    flat = [b for page in pages for b in page]
    rows = [_path_rows(b.path) for b in flat]
    encoded = [b.text.encode() for b in flat]
    size = np.fromiter(map(len, encoded), np.int64, len(encoded))
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = np.frombuffer(b"".join(encoded), np.uint8)
    start, end, first = word_spans(data, offsets)
    word = (mix(word_hashes(data, start, end)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    n = np.diff(first)
    linked = np.array([b.linked for b in flat], float)
    number = np.column_stack([np.log1p(n) / 4, np.minimum(linked / np.maximum(size, 1), 1), n == 1])
    return Page(np.array([len(p) for p in pages]), np.array([r for x in rows for r in x], np.int64),
                np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64), word, first,
                number.astype(np.float32))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, values.shape[1]))
    np.cumsum(values, axis=0, out=total[1:])
    return (total[first[1:]] - total[first[:-1]]).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Labeller:
    """Embeddings, two LSTM directions (input, recurrent, bias) and the output layer, which also sees
    the block itself."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def new(rng: np.random.Generator) -> Labeller:
        width = PATH_SIZE + WORD_SIZE + 3
        p = {"path": rng.normal(0, 0.3, (BUCKETS, PATH_SIZE)), "word": rng.normal(0, 0.3, (BUCKETS, WORD_SIZE)),
             "out": rng.normal(0, 0.2, 2 * HIDDEN + width), "level": np.zeros(1)}
        for way in "fb":
            p[f"in_{way}"] = rng.normal(0, 0.2, (width, 4 * HIDDEN))
            p[f"re_{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            p[f"bias_{way}"] = np.zeros(4 * HIDDEN)
        return Labeller({k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, page: Page) -> np.ndarray:
        words = np.maximum(np.diff(page.word_first), 1)[:, None]
        return np.concatenate([_sums(self.p["path"][page.path], page.path_first),
                               _sums(self.p["word"][page.word], page.word_first) / words, page.number], 1)

    def direction(self, x: np.ndarray, live: np.ndarray, way: str, keep: bool):
        """Hidden states (page, time, hidden) of padded inputs; a page's state stands still past its
        end. ``keep``: also what the gradient needs."""
        pages, length, _ = x.shape
        given = x @ self.p[f"in_{way}"] + self.p[f"bias_{way}"]
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        out, tape = np.zeros((pages, length, HIDDEN), np.float32), []
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = given[:, t] + h @ self.p[f"re_{way}"]
            i, f, o = (_sigmoid(z[:, k * HIDDEN:(k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            g = np.tanh(z[:, 3 * HIDDEN:])
            on = live[:, t, None]
            now = f * c + i * g
            bent = np.tanh(now)
            if keep:
                tape.append((t, h, c, i, f, o, g, bent, on))
            c = np.where(on, now, c)
            h = np.where(on, o * bent, h)
            out[:, t] = h
        return out, tape

    def logits(self, page: Page) -> np.ndarray:
        """One per block, pages of like length together."""
        x = self.inputs(page)
        first = np.cumsum(page.size) - page.size
        out = np.zeros(len(x), np.float32)
        order = np.argsort(page.size, kind="stable")
        order = order[page.size[order] > 0]
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and page.size[order[b]] * (b + 1 - a) <= CELLS:
                b += 1
            rows = order[a:b]
            at, live = _padded(first[rows], page.size[rows])
            states = [self.direction(x[at], live, way, False)[0] for way in "fb"]
            z = np.concatenate([*states, x[at]], 2) @ self.p["out"] + self.p["level"][0]
            out[at[live]] = z[live]
            a = b
        return out


def _padded(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(size.max())
    live = step < size[:, None]
    return first[:, None] + np.where(live, step, 0), live


def train(pages: list[list[Block]], labels: list[np.ndarray], seed: int = 3) -> Labeller:
    """Adam on the log loss over blocks, by back-propagation through time."""
    rng = np.random.default_rng(seed)
    model = Labeller.new(rng)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.p.items()}
    some = [k for k in range(len(pages)) if pages[k]]
    for step in range(1, ROUNDS + 1):
        picked = rng.choice(some, min(BATCH, len(some)), replace=False)
        page = read([pages[k] for k in picked])
        y = np.concatenate([labels[k] for k in picked]).astype(np.float32)
        x = model.inputs(page)
        at, live = _padded(np.cumsum(page.size) - page.size, page.size)
        xs = x[at] * live[:, :, None]
        runs = {way: model.direction(xs, live, way, True) for way in "fb"}
        seen = np.concatenate([runs["f"][0], runs["b"][0], xs], 2)
        z = seen @ model.p["out"] + model.p["level"][0]
        error = np.where(live, _sigmoid(z) - y[at], 0) / live.sum()
        grad = {"out": np.einsum("pt,pth->h", error, seen) + 1e-5 * model.p["out"],
                "level": np.array([error.sum()])}
        d_seen = error[:, :, None] * model.p["out"]
        d_x = d_seen[:, :, 2 * HIDDEN:].copy()
        for k, way in enumerate("fb"):
            d_out = d_seen[:, :, k * HIDDEN:(k + 1) * HIDDEN]
            d_h = np.zeros((len(picked), HIDDEN), np.float32)
            d_c = np.zeros_like(d_h)
            d_in = np.zeros_like(model.p[f"in_{way}"])
            d_re = np.zeros_like(model.p[f"re_{way}"])
            d_bias = np.zeros_like(model.p[f"bias_{way}"])
            for t, h, c, i, f, o, g, bent, on in reversed(runs[way][1]):
                d_h = d_h + d_out[:, t]
                dh, dc = np.where(on, d_h, 0), np.where(on, d_c, 0)
                dc = dc + dh * o * (1 - bent * bent)
                dz = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f),
                                     dh * bent * o * (1 - o), dc * i * (1 - g * g)], 1)
                d_in += xs[:, t].T @ dz
                d_re += h.T @ dz
                d_bias += dz.sum(0)
                d_x[:, t] += dz @ model.p[f"in_{way}"].T
                d_h = np.where(on, dz @ model.p[f"re_{way}"].T, d_h)
                d_c = np.where(on, dc * f, d_c)
            grad |= {f"in_{way}": d_in, f"re_{way}": d_re, f"bias_{way}": d_bias}
        d_block = d_x[live]
        for name, rows, first, a, b in (("path", page.path, page.path_first, 0, PATH_SIZE),
                                        ("word", page.word, page.word_first, PATH_SIZE, PATH_SIZE + WORD_SIZE)):
            n = np.diff(first)
            share = d_block[:, a:b] / (np.maximum(n, 1)[:, None] if name == "word" else 1)
            grad[name] = np.zeros_like(model.p[name])
            np.add.at(grad[name], rows, np.repeat(share, n, axis=0))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        rate = 0.02 * (1 - (step - 1) / ROUNDS) + 0.001
        for name, g in grad.items():
            g = g * min(1.0, 1.0 / (norm + 1e-9))
            m, v = moments[name]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            model.p[name] -= (rate * (m / (1 - 0.9 ** step)) / (
                np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return model


# Names by which pages call their parts.
_MAIN = ("article", "main", 'div class="content"', 'div class="post-body"', 'div id="main-content"',
         'section class="article-body"', 'div class="entry text"', 'div role="main"')
_OTHER = {
    "nav": ("nav", 'div class="menu"', 'ul class="nav-links"', 'div id="navigation"', 'div class="breadcrumb"'),
    "head": ("header", 'div class="page-header"', 'div id="header"', 'div class="masthead banner"'),
    "foot": ("footer", 'div class="footer"', 'div id="footer"', 'div class="copyright"'),
    "side": ("aside", 'div class="sidebar"', 'div class="related"', 'div class="widget"', 'div class="share social"'),
    "ad": ('div class="ad"', 'div class="ads banner"', 'div class="sponsored promo"', 'div id="advert"'),
    "note": ('div class="cookie-notice"', 'div id="consent"', 'div class="popup modal"', 'div class="notice"'),
    "form": ("form", 'form class="newsletter subscribe"', 'div class="login"'),
    "said": ('div class="comments"', 'section id="comments"', 'ol class="comment-list"', 'div class="replies"'),
}


def _prose(rng: np.random.Generator, low: int, high: int) -> str:
    parts = "ba ce di fo gu la me ni ro su ta ve wi xo yu an er il on us".split()
    words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(low, high))]
    return " ".join(words).capitalize() + rng.choice([".", "!", "", "?"])


def drawn_page(rng: np.random.Generator) -> tuple[str, str]:
    """A page with named parts, and its main text."""
    def part(kind: str) -> str:
        name = str(rng.choice(_OTHER[kind]))
        texts = [_prose(rng, 1, 30 if kind in ("said", "side", "note", "ad") else 6) for _ in range(rng.integers(1, 7))]
        if kind == "nav" or kind == "foot" and rng.random() < 0.5:
            inner = "<ul>" + "".join(f'<li><a href="/{k}">{t}</a></li>' for k, t in enumerate(texts)) + "</ul>"
        elif rng.random() < 0.4:
            inner = texts[0]
        else:
            inner = "".join(f"<p>{t}</p>" if rng.random() < 0.7 else f"<div>{t}</div>" for t in texts)
        return f"<{name}>{inner}</{name.split()[0]}>"

    texts = [_prose(rng, 1, 60) for _ in range(rng.integers(1, 14))]
    body = [f"<h1>{texts[0]}</h1>"]
    for t in texts[1:]:
        kind = rng.random()
        body.append(f"<h2>{t}</h2>" if kind < 0.12 else f"<p><b>{t}<br>" if kind < 0.2 else
                    f"<ul><li>{t}</li></ul>" if kind < 0.28 else f"<blockquote>{t}</blockquote>" if kind < 0.34
                    else f"<p>{t}</p>")
    inside = [part(str(rng.choice(["ad", "side", "form"])))] if rng.random() < 0.25 else []
    for extra in inside:
        body.insert(int(rng.integers(1, len(body) + 1)), extra)
    name = str(rng.choice(_MAIN))
    before = [part(k) for k in ("head", "nav", "note", "ad", "side") if rng.random() < 0.55]
    after = [part(k) for k in ("said", "side", "ad", "form", "foot", "note") if rng.random() < 0.5]
    rng.shuffle(before)
    page = "".join(["<html><body>", *before, f"<{name}>", *body, f"</{name.split()[0]}>", *after, "</body></html>"])
    return page, "\n".join(texts)


_OUTSIDE = {"nav", "header", "footer", "aside", "form"}


def own_labels(page: list[Block]) -> np.ndarray | None:
    """Labels of a page that marks its main text by ``article`` or ``main``; None if it does not."""
    tags = [[e.split()[0] for e in b.path] for b in page]
    if not any("article" in t or "main" in t for t in tags):
        return None
    return np.array([("article" in t or "main" in t) and not _OUTSIDE & set(t)
                     and not any(" " in e and e.split()[0] == "div" and _named_other(e) for e in b.path)
                     for t, b in zip(tags, page, strict=True)])


def _named_other(element: str) -> bool:
    return any(element == _element(o.split()[0], o) for group in _OTHER.values() for o in group)


def fit(pages: DataFrame, sample: int = SAMPLE, drawn: int = DRAWN) -> Labeller:
    """Learn from at most ``sample`` pages of the table, first by a hash of the id, and drawn ones."""
    rows = pages.where(F.length("html") <= LEARN_CHARS).orderBy(F.xxhash64("page_id")).select("html").limit(sample)
    read_pages, labels = [], []
    for row in rows.toArrow().column(0).to_pylist():
        page = blocks(row or "")
        own = own_labels(page)
        if own is not None:
            read_pages.append(page)
            labels.append(own)
    rng = np.random.default_rng(11)
    for _ in range(drawn):
        source, text = drawn_page(rng)
        page, main = blocks(source), text.split("\n")
        own, at = [], 0
        for b in page:
            # Main blocks come in the order of the text; parts in between have other words.
            hit = at < len(main) and b.text == _WHITE.sub(" ", main[at]).strip() and any(
                e == _element(m.split()[0], m) for e in b.path for m in _MAIN)
            at += hit
            own.append(hit)
        read_pages.append(page)
        labels.append(np.array(own, bool))
    return train(read_pages, labels)


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    rows = in_small_batches(pages).select("page_id", "url", F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [blocks(h or "") for h in part.column(2).to_pylist()]
                page = read(found)
                main = shared.value.logits(page) > 0
                first = np.cumsum(page.size) - page.size
                texts = ["\n".join(b.text for b, keep in zip(p, main[f:f + len(p)], strict=True) if keep)
                         for p, f in zip(found, first, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = rows.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars bigint")
