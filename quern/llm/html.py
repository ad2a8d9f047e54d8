"""Main text of web pages by a recurrent block labeller.

A page is cut into blocks: runs of text between block-level tags. Each block has a vector of its tag path
(learned vectors of the tags, classes and ids above it, summed), of its words (learned vectors by hash,
averaged) and of its length, links and punctuation. A bidirectional LSTM in numpy reads a page's blocks
in order in both directions, so that each is judged by the context of the whole page, and labels it as
article text or not. It is trained on the driver from `TRAIN_PAGES` generated pages, once in a session;
its weights are of a fixed size and go to the tasks as a broadcast.

Defined results: null and empty html and a page without article text give an empty text; white space
alone is no block; `<br>` is white space; unclosed and wrongly nested tags close as their parents do; an
unended comment, script or tag reaches to the end; repeated rows and null ids each give a row; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import itertools
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.llm.common import map_batches

TRAIN_PAGES, EPOCHS, GROUP, SPEED, SEED = 1200, 6, 32, 0.008, 11
PATH_SIZE, WORD_SIZE, WIDTH, HIDDEN, PLAIN = 1 << 11, 1 << 12, 16, 20, 5
#: Elements whose text never shows or is a control's.
SKIPPED = {"script", "style", "noscript", "template", "title", "textarea", "select", "button", "iframe", "svg", "object", "head"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
EMPTY = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What a start tag closes first, up to the nearest of its containers.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "body", "article", "section", "div", "main", "aside", "nav"}
#: The attributes of a tag, and its end: `>`, or the page's end, before which a quoted value may be cut off.
REST = r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+"
STOP = r"\Z|[\"'][^>]*+\Z"
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|title|textarea|select|button|iframe|svg|object)\b{REST}(?:>.*?(?:</(?P=raw)\s*>|\Z)|{STOP})"
    rf"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*+)(?P<rest>{REST})(?:>|{STOP})|<[!?/][^>]*+(?:>|\Z)",
    re.I | re.S,
)
NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[A-Za-z]+")
CACHE = 100_000
#: Pages labelled together: at most so many, and so many places of the grid that pads them to the longest (or one page).
TOGETHER, PLACES = 64, 1 << 15


def number(key: str, size: int) -> int:
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) % size


class WordNumbers(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = number(word, WORD_SIZE)
        return value


WORDS = WordNumbers()
OPENED: dict[tuple[str, str], list[int]] = {}


def opened_as(name: str, rest: str) -> list[int]:
    """Path numbers of a start tag: its name and the words of its class, id and role."""
    key = (name, rest)
    if key not in OPENED:
        if len(OPENED) >= CACHE:
            OPENED.clear()
        words = {w.lower() for m in NAMED.finditer(rest) for w in PART.findall(m[2] or m[3] or m[4] or "")}
        OPENED[key] = [number("<" + name, PATH_SIZE), *(number("." + w, PATH_SIZE) for w in sorted(words))]
    return OPENED[key]


def blocks(page: str) -> Iterator[tuple[str, list[int], int]]:
    """(text, path numbers, characters inside links) of each block in page order."""
    stack: list[tuple[str, list[int]]] = []
    parts: list[str] = []
    links = link_depth = at = 0
    head = False

    def flush() -> tuple[str, list[int], int] | None:
        nonlocal links
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        found, links = (text, [n for _, numbers in stack for n in numbers], links) if text else None, 0
        return found

    def text(piece: str) -> None:
        nonlocal links
        if piece and not head:
            parts.append(piece)
            if link_depth:
                links += len(piece.strip())

    for m in TAG.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                link_depth = 0 if m["end"] else 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if found := flush():
            yield found
        link_depth = 0
        if name == "head":
            head = not m["end"]
        elif name == "body":
            head = False
        if m["end"]:
            if any(tag == name for tag, _ in stack):
                while stack.pop()[0] != name:
                    pass
        elif name not in EMPTY:
            if name in CLOSES:
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] in CLOSES[name] or stack[k][0] in BOUNDS), -1)
                if depth >= 0 and stack[depth][0] in CLOSES[name]:
                    del stack[depth:]
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == "p" or stack[k][0] in BOUNDS or stack[k][0] in ("li", "td")), -1)
            if depth >= 0 and stack[depth][0] == "p":
                del stack[depth:]
            stack.append((name, opened_as(name, m["rest"] or "")))
    text(page[at:])
    if found := flush():
        yield found


def inputs(found: list[tuple[str, list[int], int]]) -> tuple[Lists, Lists, np.ndarray]:
    """Path numbers, word numbers and plain features of a page's blocks."""
    plain = np.zeros((len(found), PLAIN))
    words = []
    for k, (text, _, links) in enumerate(found):
        w = text.lower().split()
        words.append(list(map(WORDS.__getitem__, w)))
        plain[k] = np.log1p(len(w)) / 5, min(links / len(text), 1.0), text[-1] in ".!?…", k / len(found), "©" in text
    return flat([path or [0] for _, path, _ in found]), flat(words), plain


Lists = tuple[np.ndarray, np.ndarray]


def flat(lists: list[list[int]]) -> Lists:
    """Lists of numbers as all of them one after another and the size of each list."""
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64)


def joined(parts: list[Lists]) -> Lists:
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def summed(table: np.ndarray, lists: Lists, mean: bool) -> np.ndarray:
    numbers, sizes = lists
    out = np.add.reduceat(table[numbers], np.r_[0, np.cumsum(sizes)[:-1]], axis=0)
    return out / sizes[:, None] if mean else out


def spread(size: int, lists: Lists, part: np.ndarray, mean: bool) -> np.ndarray:
    """The gradient of a table of `size` rows from that of its sums or means."""
    numbers, sizes = lists
    rows = np.repeat(part / sizes[:, None] if mean else part, sizes, axis=0)
    return np.stack([np.bincount(numbers, rows[:, k], size) for k in range(rows.shape[1])], axis=1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def lstm(x: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool = True) -> tuple[np.ndarray, list]:
    """Hidden states (steps, rows, HIDDEN) over x (steps, rows, inputs), and what the backward pass needs if keep."""
    h = c = np.zeros((x.shape[1], HIDDEN))
    out, kept = np.empty((*x.shape[:2], HIDDEN)), []
    drive = x @ w + b
    for t in range(len(x)):
        z = drive[t] + h @ u
        gates, new = sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, c_before = h, c
        c = f * c + i * new
        shown = np.tanh(c)
        out[t] = h = o * shown
        if keep:
            kept.append((before, c_before, i, f, o, new, shown))
    return out, kept


def lstm_back(x: np.ndarray, d_out: np.ndarray, kept: list, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of x, w, u and b."""
    dx, dw, du, db = np.empty_like(x), np.zeros_like(w), np.zeros_like(u), np.zeros(4 * HIDDEN)
    dh = dc = np.zeros((x.shape[1], HIDDEN))
    for t in range(len(x) - 1, -1, -1):
        before, c_before, i, f, o, new, shown = kept[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - shown**2)
        dz = np.concatenate([dc * new * i * (1 - i), dc * c_before * f * (1 - f), dh * shown * o * (1 - o), dc * i * (1 - new**2)], axis=1)
        dx[t], dh, dc = dz @ w.T, dz @ u.T, dc * f
        dw += x[t].T @ dz
        du += before.T @ dz
        db += dz.sum(axis=0)
    return dx, dw, du, db


Model = dict[str, np.ndarray]


def fresh(rng: np.random.Generator) -> Model:
    size = 2 * WIDTH + PLAIN
    model = {"path": rng.normal(0, 0.1, (PATH_SIZE, WIDTH)), "word": rng.normal(0, 0.1, (WORD_SIZE, WIDTH)), "out": rng.normal(0, 0.2, 2 * HIDDEN + size), "bias": np.zeros(1)}
    for k in ("f", "b"):
        model |= {"w" + k: rng.normal(0, 0.2, (size, 4 * HIDDEN)), "u" + k: rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), "b" + k: np.r_[np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]}
    return model


def padded(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of pages of these sizes in a (steps, pages) grid, and of the same reversed."""
    step = np.concatenate([np.arange(n) for n in sizes])
    page = np.repeat(np.arange(len(sizes)), sizes)
    return step * len(sizes) + page, (np.repeat(sizes, sizes) - 1 - step) * len(sizes) + page


def forward(model: Model, x: np.ndarray, sizes: np.ndarray, keep: bool = True) -> tuple[np.ndarray, tuple]:
    """The logit of every block, and what training needs if keep; x has the rows of the pages one after another."""
    grid = (int(sizes.max()), len(sizes))
    states, kept, places = [], [], padded(sizes)
    for k, place in zip("fb", places, strict=True):
        flat = np.zeros((grid[0] * grid[1], x.shape[1]))
        flat[place] = x
        run = flat.reshape(*grid, -1)
        h, cache = lstm(run, model["w" + k], model["u" + k], model["b" + k], keep)
        states.append(h.reshape(-1, HIDDEN)[place])
        if keep:
            kept.append((run, cache))
    top = np.concatenate([*states, x], axis=1)
    return top @ model["out"] + model["bias"], (places, kept, top, grid)


def train(pages: list[tuple[str, list[bool]]] | None = None) -> Model:
    """Fit the labeller with Adam on pages and the labels of their blocks; generated ones by default."""
    rng = np.random.default_rng(SEED)
    data = []
    for page, marks in pages or [generated(rng) for _ in range(TRAIN_PAGES)]:
        found = list(blocks(page))
        data.append((*inputs(found), np.array(marks, float)))
    model, lengths = fresh(rng), np.array([len(d[3]) for d in data])
    first, second, step = {k: np.zeros_like(v) for k, v in model.items()}, {k: np.zeros_like(v) for k, v in model.items()}, 0
    for epoch in range(EPOCHS):
        # Pages of like length share a group, so that few steps are empty.
        order = np.argsort(lengths + rng.uniform(0, 4, len(data)))
        for at in GROUP * rng.permutation(-(-len(order) // GROUP)):
            group = [data[k] for k in order[at : at + GROUP]]
            paths, words = joined([d[0] for d in group]), joined([d[1] for d in group])
            plain, y = np.concatenate([d[2] for d in group]), np.concatenate([d[3] for d in group])
            # Half of the blocks are shown without their words and marks, so that the path has to tell.
            shown = rng.random(len(y)) < 0.5
            x = np.concatenate([summed(model["path"], paths, False), summed(model["word"], words, True) * shown[:, None], plain * shown[:, None]], axis=1)
            sizes = np.array([len(d[3]) for d in group])
            logits, (places, kept, top, grid) = forward(model, x, sizes)
            d_logit = (sigmoid(logits) - y) / len(y)
            grads = {"out": top.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
            d_top = d_logit[:, None] * model["out"]
            dx = d_top[:, 2 * HIDDEN :].copy()
            for n, (k, place) in enumerate(zip("fb", places, strict=True)):
                flat = np.zeros((grid[0] * grid[1], HIDDEN))
                flat[place] = d_top[:, n * HIDDEN : (n + 1) * HIDDEN]
                run, cache = kept[n]
                back, grads["w" + k], grads["u" + k], grads["b" + k] = lstm_back(run, flat.reshape(*grid, -1), cache, model["w" + k], model["u" + k])
                dx += back.reshape(-1, x.shape[1])[place]
            grads["path"] = spread(PATH_SIZE, paths, dx[:, :WIDTH], False)
            grads["word"] = spread(WORD_SIZE, words, dx[:, WIDTH : 2 * WIDTH] * shown[:, None], True)
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model[k] = model[k] - SPEED * (0.5 ** (epoch / 3)) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def together(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """First and end of each group of pages that run together, of rising sizes."""
    first = 0
    for k in range(1, len(sizes) + 1):
        if k == len(sizes) or k - first == TOGETHER or (k - first + 1) * sizes[k] > PLACES:
            yield first, k
            first = k


def labelled(model: Model, pages: list[list[tuple[str, list[int], int]]]) -> list[np.ndarray]:
    """Whether each block of each page is article text; pages of like size run together."""
    out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
    order = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
    for first, end in together([len(pages[k]) for k in order]):
        some = order[first:end]
        parts = [inputs(pages[k]) for k in some]
        x = np.concatenate([summed(model["path"], joined([a[0] for a in parts]), False), summed(model["word"], joined([a[1] for a in parts]), True), np.concatenate([a[2] for a in parts])], axis=1)
        sizes = np.array([len(pages[k]) for k in some])
        marks = forward(model, x, sizes, keep=False)[0] > 0
        for k, mark in zip(some, np.split(marks, np.cumsum(sizes)[:-1]), strict=True):
            out[k] = mark
    return out


@cache
def own_model() -> Model:
    """The labeller of the generated pages; it is the same whenever it is fitted, so a session fits it once."""
    return train()


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    shared = pages.sparkSession.sparkContext.broadcast({k: v.astype(np.float32) for k, v in (model or own_model()).items()})

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        pages = batch.column("html").to_pylist()
        for at in range(0, len(pages), 256):
            found = [list(blocks(p or "")) for p in pages[at : at + 256]]
            marks = labelled(shared.value, found)
            texts += ["\n".join(b[0] for b, keep in zip(page, mark, strict=True) if keep) for page, mark in zip(found, marks, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


# Generated pages for training: (element, classes or ids) of each kind of part, and words that it holds.
MAIN = ["article", "main", "article.post", "div.content", "div#content", "div.article-body", "div.entry-content", "section.story", "div.post-text", "main#main", "div.main", "section.article", "div#article"]
OTHER = {
    "nav": ["nav", "nav.menu", "div.nav", "div#menu", "ul.navbar", "div.navigation", "div.breadcrumbs", "nav.pagination", "div.topbar", "ul.tabs"],
    "header": ["header", "div.header", "div#header", "div.masthead", "header.site-header", "div.banner", "div.logo"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "div.bottom"],
    "side": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "section.recommended", "div.widget", "div.trending", "div.tags", "div.author-box", "div.share", "div.social"],
    "notice": ["div.notice", "div.cookie-banner", "div#cookie", "div.consent", "section.alert", "div.popup", "div.modal", "div.gdpr", "div.warning", "div.newsletter", "div.subscribe", "div.paywall"],
    "ad": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "aside.ad", "div.adsbygoogle", "div.banner-ad", "section.promotion", "div#ad"],
    "form": ["form", "form.search", "form#login", "form.newsletter", "div.form", "fieldset", "div.search"],
    "comment": ["section.comments", "div.comments", "div#comments", "ul.comment-list", "div.comment", "ol.commentlist", "div.discussion", "div.replies", "section#comments", "div.disqus"],
}
SAID = {
    "nav": "home about news contact menu topics archive next previous top page login sign in",
    "header": "welcome site daily the official home of magazine search subscribe",
    "footer": "© copyright all rights reserved privacy policy terms of use contact imprint",
    "side": "related posts read more popular share follow us tags latest recommended about the author",
    "notice": "we use cookies accept decline settings this site notice please subscribe to continue",
    "ad": "advertisement sponsored buy now offer sale click here free shipping limited",
    "form": "email name password search submit send login register your message required",
    "comment": "comment reply says posted likes report thanks for sharing i agree great post",
}
SYLLABLES = "an ar be ble da de ea ed en er es eur fa ge ha in ing ion is ka la le li ment mi na nd ne nt on or ou pa ra re ro sch se sh st ta te th ti tion tre un ve wa wh ya zu".split()


POOL = ["".join(p) for n in (1, 2, 3) for p in itertools.product(SYLLABLES[::n], repeat=n)]


def words(rng: np.random.Generator, low: int, high: int) -> list[str]:
    return [POOL[k] for k in rng.integers(0, len(POOL), rng.integers(low, high))]


def title(rng: np.random.Generator) -> str:
    """A heading, with or without the marks of a sentence."""
    said = " ".join(words(rng, 1, 12))
    return said.capitalize() + str(rng.choice([".", "", "?", ". " + " ".join(words(rng, 1, 4)), ","])) if rng.random() < 0.7 else said


def prose(rng: np.random.Generator) -> str:
    """A run of sentences, now and then only one of a word or two."""
    mark = str(rng.choice(["", "", "", "", "", "", " |", "***", "%%%", " -"]))
    said = [(mark + " ").join(words(rng, 1, 22)).capitalize() + "." for _ in range(rng.choice([1, 1, 2, 4, 7]))]
    return " ".join(said)


def tag(kind: str) -> tuple[str, str]:
    name, mark, value = re.fullmatch(r"(\w+)([.#]?)(.*)", kind).groups()
    return name, f"<{name}{' class=' if mark == '.' else ' id='}\"{value}\">" if mark else f"<{name}>"


def other(rng: np.random.Generator, kind: str) -> tuple[str, int]:
    """A part that is no article text, and its number of blocks."""
    name, start = tag(str(rng.choice(OTHER[kind])))
    own = SAID[kind].split()

    def line(low: int, high: int) -> str:
        made = list(rng.choice(own, rng.integers(1, 4))) if rng.random() < 0.6 else []
        return " ".join(made + words(rng, low, high)) + str(rng.choice(["", "", ".", ","]))

    inner = []
    style = rng.random()
    if name in ("ul", "ol"):
        inner = [f"<li><a href=\"/x\">{line(1, 3)}</a></li>" if style < 0.7 else f"<li>{prose(rng)}</li>" for _ in range(rng.integers(1, 8))]
    elif kind in ("nav", "side", "header", "footer") and style < 0.5:
        count = int(rng.integers(1, 8))
        return f"{start}<ul>" + "".join(f"<li><a href=\"/{k}\">{line(1, 3)}</a></li>" for k in range(count)) + f"</ul></{name}>", count
    elif kind == "form" and style < 0.7:
        inner = [f"<p><label>{line(1, 3)}</label><input name=\"x\"></p>" for _ in range(rng.integers(1, 4))]
    elif kind in ("ad", "notice", "footer", "header") and style < 0.8:
        return f"{start}{prose(rng) if rng.random() < 0.6 else line(1, 12)}</{name}>", 1
    else:
        inner = [f"<p>{prose(rng) if rng.random() < 0.6 else line(1, 9)}</p>" for _ in range(rng.integers(1, 7))]
        if rng.random() < 0.4:
            inner.insert(0, f"<h3>{line(1, 3)}</h3>")
    return f"{start}{''.join(inner)}</{name}>", len(inner)


def generated(rng: np.random.Generator) -> tuple[str, list[bool]]:
    """A page and whether each of its blocks is article text."""
    out, marks = ["<!DOCTYPE html><html><head><title>x</title></head><body>"], []
    wrap = [tag(str(k)) for k in rng.choice(["div.container", "div.wrapper", "div#page", "div.row"], rng.integers(0, 3))]
    out += [start for _, start in wrap]

    def add(*kinds: str) -> None:
        for kind in kinds:
            part, count = other(rng, kind)
            out.append(part)
            marks.extend([False] * count)

    def text(part: str) -> None:
        out.append(part)
        marks.append(True)

    before = [k for k, p in (("notice", 0.2), ("header", 0.4), ("nav", 0.8), ("form", 0.2), ("ad", 0.5), ("side", 0.15)) if rng.random() < p]
    rng.shuffle(before)
    add(*before)
    main = [] if rng.random() < 0.04 else [tag(str(rng.choice(MAIN)))]
    if main and rng.random() < 0.15:
        main.append(tag("article"))
    out += [start for _, start in main]
    if rng.random() < 0.85:
        top = f"<h1>{title(rng)}</h1>"
        text(f"<header>{top}</header>" if rng.random() < 0.1 else top)
    for _ in range(rng.integers(1, 14)):
        kind = rng.random()
        if kind < 0.06 and main:
            add(str(rng.choice(["ad", "ad", "side", "notice", "form", "nav"])))
        elif kind < 0.13:
            text(f"<h2>{title(rng)}</h2>")
        elif kind < 0.18:
            name = str(rng.choice(["ul", "ol"]))
            out.append(f"<{name}>")
            for _ in range(rng.integers(1, 5)):
                text(f"<li>{prose(rng)}</li>")
            out.append(f"</{name}>")
        elif kind < 0.24:
            name = str(rng.choice(["blockquote", "pre", "figcaption", "div"]))
            text(f"<{name}>{prose(rng)}</{name}>")
        elif kind < 0.27:
            out.append("<table><tr>")
            for _ in range(rng.integers(1, 4)):
                text(f"<td>{title(rng)}</td>")
            out.append("</tr></table>")
        else:
            link = f" <a href=\"/y\">{' '.join(words(rng, 1, 3))}</a> " if rng.random() < 0.15 else ""
            text(f"<p>{'<b>' * (rng.random() < 0.1)}{prose(rng)}{link}{prose(rng)}{'</p>' if rng.random() < 0.8 else '<br>'}")
    if main and rng.random() < 0.12:
        add("comment")
    out += [f"</{name}>" for name, _ in reversed(main)]
    after = [k for k, p in (("comment", 0.35), ("side", 0.35), ("ad", 0.25), ("form", 0.2), ("nav", 0.15)) if rng.random() < p]
    rng.shuffle(after)
    add(*after)
    if rng.random() < 0.8:
        add("footer")
    if rng.random() < 0.1:
        add("notice")
    out += [f"</{name}>" for name, _ in reversed(wrap)]
    return "".join(out) + "</body></html>", marks
