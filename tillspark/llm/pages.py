"""Main text of web pages by a recurrent block labeller.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block is a
vector: its tag path with class and id words, hashed; its own words, hashed; and a few measures
such as the share of linked text. A bidirectional LSTM in numpy reads the whole sequence both
ways, so that each block is judged with the document around it, and blocks it takes for the
article are joined in page order.

The model is trained here, on pages that ``layouts`` composes from a seed (documented parameters
``PAGES`` and ``SEED``): articles inside menus, headers, adverts, notices, forms, side columns,
comments and footers, under many tag and class names. It is trained once for each driver process
and is the same every time.

Edge cases: null and empty pages give an empty text, as do pages without any article block.
Broken markup (open tags, stray ends, unclosed comments) is read as far as it goes: a quote inside
an unquoted value is a sign like any other, and a quoted value without a proper end stops at the
first blank or ``>``. A page is read once from front to back, whatever stands in it. Repeated
rows give repeated results. Only ``html`` is read, all columns pass through.
"""

from __future__ import annotations

import functools
import html
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.llm.common import annotate, table, texts_of

PATH_SLOTS, WORD_SLOTS, MEASURES = 256, 32, 10
WIDTH = PATH_SLOTS + WORD_SLOTS + MEASURES
HIDDEN = 20
PAGES, SEED = 1_600, 5
_TOGETHER = 64

# Names of HTML elements.
_SKIPPED = frozenset(
    "script style title noscript template textarea svg math iframe object canvas select".split())
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label "
    "legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th "
    "thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"},
           "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = _BLOCKS - {"button", "label", "option", "optgroup"}

_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_SPACE = re.compile(r"[\s/]*")
_ATTRIBUTE = re.compile(r"[^\s/>=][^\s/>=]*|=")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_LETTERS = re.compile(r"[a-z]+")
_HIDES = re.compile(r"display\s*:\s*none", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _SKIPPED}


class Path:
    """The open elements at a place. Grows by one element from its parent in constant time."""

    __slots__ = ("tag", "depth", "slots", "leaf", "key", "linked")

    def __init__(self, parent: Path | None, tag: str, names: tuple[str, ...]):
        own, depth, key, linked = 0, 0, 0, False
        if parent is not None:
            own, depth, key, linked = parent.slots, parent.depth, parent.key, parent.linked
        for token in (tag, *names):
            own |= 1 << _slot(token, PATH_SLOTS)
        self.tag, self.slots, self.depth = tag, own, depth + 1 + len(names)
        self.leaf = names[-1] if names else tag
        self.key, self.linked = hash((key, tag, names)), linked or tag == "a"


class Block:
    __slots__ = ("path", "text", "linked")

    def __init__(self, path: Path | None, text: str, linked: float):
        self.path, self.text, self.linked = path, text, linked


class _Tags:
    """Reads the tags of a page, each sign a bounded number of times."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        """Like ``str.find``; looks only once for what is not to come any more."""
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def value(self, at: int) -> tuple[str, int]:
        """(value, end) of an attribute whose value begins at ``at``."""
        page = self.page
        sign = page[at:at + 1]
        if sign in ("'", '"'):
            end = self.find(sign, at + 1)
            if end >= 0 and (page[end + 1:end + 2] in (" ", "\n", "\t", "\r", "\f", "/", ">", "")
                             or page.find(">", at, end) < 0):
                return page[at + 1:end], end + 1
            at += 1
        end = _BARE.match(page, at).end()
        return page[at:end], end

    def names(self, at: int) -> tuple[tuple[str, ...], int, bool]:
        """(words of the telling attributes, place after ``>``, whether it closes itself)."""
        page, found, size = self.page, [], len(self.page)
        while True:
            space = _SPACE.match(page, at)
            at = space.end()
            if at >= size:
                return tuple(found), size, False
            if page[at] == ">":
                return tuple(found), at + 1, page[at - 1] == "/"
            at = _ATTRIBUTE.match(page, at).end()
            name = page[space.end():at].lower()
            value, equals = "", _EQUALS.match(page, at)
            if equals:
                value, at = self.value(equals.end())
            if name in ("hidden", "aria-hidden") or name == "style" and _HIDES.search(value):
                found.append(".hidden")
            elif name in ("class", "id", "role", "type"):
                found += ["." + w for w in _LETTERS.findall(value.lower()) if len(w) > 1]

    def __iter__(self):
        """(start, end, name or None, whether it ends an element, attribute words)."""
        page, at = self.page, 0
        while (start := self.find("<", at)) >= 0 and self.find(">", start) >= 0:
            if page.startswith("<!--", start):
                end = self.find("-->", start + 4)
                at = end + 3 if end >= 0 else len(page)
                yield start, at, None, False, ()
            elif page[start + 1:start + 2] in ("!", "?"):
                at = self.find(">", start) + 1
                yield start, at, None, False, ()
            elif name := _TAG_NAME.match(page, start + 1):
                tag = name[0].lower()
                words, at, itself = self.names(name.end())
                if tag[0] == "/":
                    yield start, at, tag[1:], True, ()
                elif tag in _SKIPPED:
                    if not itself:
                        end = _ENDS[tag].search(page, at) if tag not in self.missing else None
                        if not end:
                            self.missing.add(tag)
                        end = self.find(">", end.end()) if end else -1
                        at = end + 1 if end >= 0 else len(page)
                    yield start, at, None, False, ()
                else:
                    yield start, at, tag, False, words
                    if itself and tag not in _VOID:
                        yield at, at, tag, True, ()
            else:
                at = start + 1


def leaf_blocks(page: str) -> list[Block]:
    """All blocks with text, in page order."""
    stack: list[Path] = []
    opened: Counter = Counter()
    blocks, parts, linked, at, path, some = [], [], 0, 0, None, False

    def add(raw):
        nonlocal linked, path, some
        if not raw:
            return
        if not some and not raw.isspace():
            path, some = stack[-1] if stack else None, True
        parts.append(raw)
        if stack and stack[-1].linked:
            linked += len(raw)

    def close():
        nonlocal parts, linked, path, some
        if some:
            raw = "".join(parts)
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                blocks.append(Block(path, text, min(1.0, linked / max(len(raw.strip()), 1))))
        parts, linked, path, some = [], 0, None, False

    def cut(size):
        for gone in stack[size:]:
            opened[gone.tag] -= 1
        del stack[size:]

    def pop(tag):
        """Closes an open ``tag`` unless a list, table or section was opened in it."""
        if not opened[tag]:
            return
        for i in range(len(stack) - 1, -1, -1):
            own = stack[i].tag
            if own == tag:
                return cut(i)
            if tag != "p" and own in ("ul", "ol", "dl", "table", "menu") or own in (
                    "td", "body", "article"):
                return

    for start, end, tag, ends, names in _Tags(page):
        add(page[at:start])
        at = end
        if tag is None:
            continue
        if tag in _BLOCKS:
            close()
        elif tag == "br":
            parts.append(" ")
        if ends:
            if opened[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i].tag == tag:
                        cut(i)
                        break
        elif tag not in _VOID:
            for closed in _CLOSES.get(tag, ()) if tag != "p" else ():
                pop(closed)
            if tag in _ENDS_P:
                pop("p")
            stack.append(Path(stack[-1] if stack else None, tag, names))
            opened[tag] += 1
    add(page[at:])
    close()
    return blocks


@functools.lru_cache(maxsize=100_000)
def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode("utf-8", "surrogatepass")) % slots


@functools.lru_cache(maxsize=20_000)
def _places(slots: int) -> list[int]:
    return [i for i in range(PATH_SLOTS) if slots >> i & 1]


def _path_slots(path: Path | None) -> list[int]:
    if path is None:
        return []
    return _places(path.slots | 1 << _slot("leaf " + path.leaf, PATH_SLOTS))


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row for each block; words count by their share in blocks of more than 30."""
    count = len(blocks)
    rows, slots, word_rows, word_slots, measures, sizes = [], [], [], [], [], []
    keys = [None, *(b.path.key if b.path else 0 for b in blocks), None]
    for i, b in enumerate(blocks):
        own = _path_slots(b.path)
        rows += [i] * len(own)
        slots += own
        words = [_slot(w, WORD_SLOTS) for w in b.text.lower().split()]
        word_rows += [i * WORD_SLOTS] * len(words)
        word_slots += words
        sizes.append(len(words))
        measures.append((
            len(b.text), b.linked, len(words), b.text[-1] in ".!?", b.text.count(",") > 2,
            i == 0, i / count, (b.path.depth if b.path else 0) / 12, keys[i] == keys[i + 1],
            keys[i + 2] == keys[i + 1]))
    out = np.zeros((count, WIDTH), np.float32)
    out[rows, slots] = 1
    counts = np.bincount(np.array(word_rows, np.int64) + np.array(word_slots, np.int64),
                         minlength=count * WORD_SLOTS).reshape(count, WORD_SLOTS)
    out[:, PATH_SLOTS:-MEASURES] = counts * (6 / np.maximum(np.array(sizes), 30))[:, None]
    out[:, -MEASURES:] = measures
    out[:, -MEASURES] = np.log1p(out[:, -MEASURES]) / 6
    out[:, 2 - MEASURES] = np.minimum(out[:, 2 - MEASURES] / 30, 1.2)
    return out


class Labeller:
    """Bidirectional LSTM with one logistic output for each block."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)

        def init(*shape):
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.hidden = hidden
        self.p = {}
        for way in "fb":
            self.p[way + "x"], self.p[way + "h"] = init(WIDTH, 4 * hidden), init(hidden, 4 * hidden)
            bias = np.zeros(4 * hidden, np.float32)
            bias[hidden:2 * hidden] = 1  # keep at first
            self.p[way + "b"] = bias
        self.p["o"], self.p["c"] = init(2 * hidden), np.zeros(1, np.float32)

    def _pass(self, way: str, x: np.ndarray, mask: np.ndarray):
        """x (time, page, WIDTH), already in reading order; returns states and what they need."""
        n, pages, _ = x.shape
        h = c = np.zeros((pages, self.hidden), np.float32)
        drive = x @ self.p[way + "x"] + self.p[way + "b"]
        states, trace = np.zeros((n, pages, self.hidden), np.float32), []
        for t in range(n):
            z = drive[t] + h @ self.p[way + "h"]
            i, f, o, g = np.split(z, 4, axis=1)
            i, f, o = (1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (i, f, o))
            g = np.tanh(g)
            m = mask[t][:, None]
            c_new = np.where(m, f * c + i * g, c)
            h_new = np.where(m, o * np.tanh(c_new), h)
            trace.append((h, c, i, f, o, g, c_new))
            h, c = h_new, c_new
            states[t] = h
        return states, trace

    def forward(self, x: np.ndarray, mask: np.ndarray):
        ahead, one = self._pass("f", x, mask)
        back, two = self._pass("b", x[::-1], mask[::-1])
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.p["o"] + self.p["c"], (both, one, two)

    def gradients(self, x, mask, labels):
        z, (both, one, two) = self.forward(x, mask)
        prob = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        error = ((prob - labels) * mask / mask.sum()).astype(np.float32)
        grad = {"o": np.einsum("tp,tpk->k", error, both), "c": error.sum(keepdims=True)[0]}
        into = error[:, :, None] * self.p["o"]
        for way, trace, xs, ms, d in (
                ("f", one, x, mask, into[:, :, :self.hidden]),
                ("b", two, x[::-1], mask[::-1], into[::-1, :, self.hidden:])):
            dz = np.zeros((*xs.shape[:2], 4 * self.hidden), np.float32)
            dh = dc = np.zeros((xs.shape[1], self.hidden), np.float32)
            gh = np.zeros_like(self.p[way + "h"])
            for t in range(len(xs) - 1, -1, -1):
                h, c, i, f, o, g, c_new = trace[t]
                m = ms[t][:, None]
                total = dh + d[t]
                own, tc = total * m, np.tanh(c_new)
                dcell = dc * m + own * o * (1 - tc * tc)
                dz[t] = np.concatenate([dcell * g * i * (1 - i), dcell * c * f * (1 - f),
                                        own * tc * o * (1 - o), dcell * i * (1 - g * g)], axis=1)
                gh += h.T @ dz[t]
                dh = dz[t] @ self.p[way + "h"].T + total * ~m
                dc = dcell * f + dc * ~m
            grad[way + "h"] = gh
            grad[way + "x"] = np.einsum("tpw,tpk->wk", xs, dz, optimize=True)
            grad[way + "b"] = dz.sum(axis=(0, 1))
        return grad

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], rounds: int = 10, rate: float = 0.02,
            seed: int = SEED) -> Labeller:
        rng = np.random.default_rng(seed)
        mean = {k: np.zeros_like(v) for k, v in self.p.items()}
        square = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, last = 0, rounds * -(-len(pages) // 32)
        for _ in range(rounds):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), 32):
                some = [pages[k] for k in order[a:a + 32]]
                x, mask = padded([v for v, _ in some])
                labels = np.zeros(mask.shape, np.float32)
                for k, (_, y) in enumerate(some):
                    labels[:len(y), k] = y
                step += 1
                for k, g in self.gradients(x, mask, labels).items():
                    g = np.clip(g, -1, 1)
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.99 * square[k] + 0.01 * g * g
                    self.p[k] -= (rate * (1.02 - step / last) * mean[k] / (1 - 0.9 ** step) / (
                        np.sqrt(square[k] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks belong to the article."""
        out = [np.zeros(len(p), bool) for p in pages]
        filled = sorted((k for k, p in enumerate(pages) if p), key=lambda k: len(pages[k]))
        at = 0
        while at < len(filled):
            # Pages of like length together, and few of them when they are very long.
            size = max(1, min(_TOGETHER, 200_000 // (len(pages[filled[at]]) * 16)))
            some = filled[at:at + size]
            at += size
            x, mask = padded([vectors(pages[k]) for k in some])
            z, _ = self.forward(x, mask)
            for column, k in enumerate(some):
                out[k] = z[:len(pages[k]), column] > 0
        return out


def padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, rows)), len(rows), WIDTH), np.float32)
    mask = np.zeros(x.shape[:2], bool)
    for k, v in enumerate(rows):
        x[:len(v), k], mask[:len(v), k] = v, True
    return x, mask


# Names that page authors give to parts of a page.
_AROUND = {
    "menu": "nav navbar menu navigation topnav breadcrumb breadcrumbs toc links main-menu",
    "header": "header masthead site-header topbar branding banner logo",
    "footer": "footer site-footer copyright legal colophon bottom credits",
    "side": "sidebar widget related recommended trending popular more-stories read-next aside rail",
    "notice": "cookie cookies consent notice gdpr alert popup modal overlay message privacy",
    "advert": "ad ads advert advertisement sponsor sponsored promo promotion adslot ad-box banner-ad",
    "form": "newsletter subscribe signup search login form contact register subscription",
    "comments": "comments comment comment-list responses replies discussion disqus reply thread",
    "share": "share social sharing buttons tags pagination pager tools toolbar author-box",
}
_INSIDE = ("content article post entry story body text main article-body post-content "
           "entry-content story-body page-content maincontent prose").split()
_SAID = {
    "menu": "home about contact news sport products services login sitemap",
    "header": "welcome the official site of magazine daily",
    "footer": "© copyright all rights reserved terms privacy imprint contact",
    "side": "related most read popular stories more from you may also like",
    "notice": "we use cookies accept privacy policy settings please note important",
    "advert": "advertisement sponsored buy now free offer sale discount click here",
    "form": "subscribe email your name search submit send newsletter password sign up",
    "comments": "comments reply says posted ago like report great post thanks agree",
    "share": "share tweet print email facebook next previous page tags",
}


def layouts(count: int = PAGES, seed: int = SEED) -> list[tuple[list[Block], np.ndarray]]:
    """Composed pages: their blocks, and which are the article's.

    Every text of an article begins with a mark that is taken off again after parsing, so labels
    are what the parser makes of the page.
    """
    rng = np.random.default_rng(seed)
    syllables = [a + b for a in "b d f g k l m n p r s t v w th sh ch".split()
                 for b in "a e i o u an en er on ing".split()]

    def pick(options):
        return options[int(rng.integers(len(options)))]

    def words(n):
        return " ".join("".join(pick(syllables) for _ in range(int(rng.integers(1, 4))))
                        for _ in range(n))

    def sentence(low, high):
        text = words(int(rng.integers(low, high)))
        return (text[0].upper() + text[1:] + pick([".", ".", ".", "!", "?", "", ","]))

    def prose(low=1, high=6):
        return " ".join(sentence(3, 18) for _ in range(int(rng.integers(low, high))))

    def attributes(kind):
        names = _AROUND.get(kind, "").split() or list(_INSIDE)
        r = rng.random()
        chosen = pick(names) + (f" {pick(['wide', 'box', 'col', 'css', 'x'])}" if r < 0.3 else "")
        return f' {pick(["class", "class", "id"])}="{chosen}"'

    def around(kind):
        """One part that is not the article."""
        said = _SAID[kind].split()
        def phrase():
            own = " ".join(pick(said) for _ in range(int(rng.integers(1, 5))))
            return pick([own, words(int(rng.integers(1, 6))), prose(1, 3), f"{own} {words(3)}"])
        tag = {"menu": pick(["nav", "div", "ul"]), "header": pick(["header", "div"]),
               "footer": pick(["footer", "div"]), "side": pick(["aside", "div", "section"]),
               "form": pick(["form", "form", "div"]), "comments": pick(["section", "div"]),
               }.get(kind, pick(["div", "div", "section", "p"]))
        native = tag in ("nav", "header", "footer", "aside", "form")
        attrs = "" if native and rng.random() < 0.6 else attributes(kind)
        if kind == "menu" or kind in ("share", "side") and rng.random() < 0.5:
            items = [f'<a href="/{k}">{words(int(rng.integers(1, 4)))}</a>'
                     for k in range(int(rng.integers(2, 8)))]
            inner = pick(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>",
                          " | ".join(items), "".join(f"<li>{i}</li>" for i in items)])
        elif kind == "form":
            inner = (f"<label>{phrase()}</label><input type=text><button>{phrase()}</button>"
                     + pick(["", f"<p>{prose(1, 3)}</p>", f"<h3>{phrase()}</h3>"]))
        elif kind == "comments":
            inner = pick(["", f"<h3>{phrase()}</h3>"]) + "".join(
                pick([f"<p>{prose()}</p>", f"<div class=comment><b>{words(2)}</b> {prose()}</div>",
                      f"<li><p>{prose()}</p></li>", f"<article class=comment><p>{prose()}</p>"
                      "</article>"]) for _ in range(int(rng.integers(1, 6))))
        else:
            inner = pick([phrase(), f"<p>{phrase()}</p>", f"<h3>{words(2)}</h3><p>{prose()}</p>",
                          prose(1, 4), f"<p>{phrase()} <a href=#>{words(2)}</a></p>"])
        return f"<{tag}{attrs}>{inner}</{tag}>"

    mark = "\x02"

    def odd():
        """Article text that looks like something else: phrases of other parts, signs, one word."""
        said = pick(list(_SAID.values())).split()
        own = words(int(rng.integers(1, 9))).split()
        return pick([" ".join(pick(said) for _ in range(int(rng.integers(2, 7)))),
                     " | ".join(own), " ".join(w + pick(["***", "&&&", "%%%", "!!"]) for w in own),
                     " ".join(own[:1] * 30), own[0], sentence(1, 3)])

    def article():
        parts = [f"<h1>{mark}{sentence(3, 9)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(int(rng.integers(1, 14))):
            r = rng.random()
            text = mark + (odd() if rng.random() < 0.15 else prose(1, 7 if r < 0.5 else 2))
            if r < 0.72:
                parts.append(pick([f"<p>{text}</p>", f"<p>{text}</p>", f"<p><b>{text}<br>",
                                   f"<p>{text[:9]}{text[9:]} <a href=#>{words(2)}</a> {words(3)}</p>",
                                   f"<div>{text}</div>"]))
            elif r < 0.8:
                parts.append(f"<{(t := pick(['h2', 'h3']))}>{mark}{sentence(2, 6)}</{t}>")
            elif r < 0.86:
                parts.append("<ul>" + "".join(f"<li>{mark}{sentence(2, 12)}</li>"
                                              for _ in range(3)) + "</ul>")
            elif r < 0.9:
                parts.append(f"<blockquote>{text}</blockquote>")
            elif r < 0.93:
                parts.append("<table>" + "".join(f"<tr><td>{mark}{words(2)}<td>{mark}{words(1)}"
                                                 for _ in range(3)) + "</table>")
            elif r < 0.95:
                parts.append(f"<figure><figcaption>{mark}{sentence(2, 9)}</figcaption></figure>")
            else:
                parts.append(around(pick(["advert", "share", "form", "side", "notice", "menu"])))
        inner = "".join(parts)
        r = rng.random()
        if r < 0.45:
            return f"<article{pick(['', attributes('inside')])}>{inner}</article>"
        if r < 0.75:
            return f"<div{attributes('inside')}>{inner}</div>"
        if r < 0.9:
            return f"<main>{inner}</main>"
        return f"<main><article>{inner}</article></main>"

    found = []
    for _ in range(count):
        before = [k for k in ("header", "menu", "notice", "advert", "form", "share", "side")
                  if rng.random() < 0.45]
        after = [k for k in ("share", "advert", "side", "comments", "form", "notice", "footer")
                 if rng.random() < 0.45]
        if rng.random() < 0.5:
            after = [k for k in after if k != "footer"] + ["footer"]
        body = "".join(map(around, before)) + article() + "".join(map(around, after))
        if rng.random() < 0.5:
            body = f"<div{pick([' id=wrapper', ' class=container', ' class=page', ''])}>{body}</div>"
        blocks = leaf_blocks(f"<html><body>{body}</body></html>")
        labels = np.array([mark in b.text for b in blocks], np.float32)
        for b in blocks:
            b.text = b.text.replace(mark, "")
        found.append((blocks, labels))
    return found


@functools.lru_cache(maxsize=4)
def trained(count: int = PAGES, seed: int = SEED) -> Labeller:
    return Labeller(seed=seed).fit([(vectors(b), y) for b, y in layouts(count, seed)])


def main_texts(pages: list[str], labeller: Labeller) -> list[str]:
    parsed = [leaf_blocks(p) for p in pages]
    return ["\n".join(b.text for b, keep in zip(blocks, kept) if keep)
            for blocks, kept in zip(parsed, labeller.label(parsed))]


def extract(pages: DataFrame, count: int = PAGES, seed: int = SEED) -> DataFrame:
    """(row, text): every page and its main text."""
    labeller = trained(count, seed)

    def begin():
        return lambda batch: (main_texts(texts_of(batch, "html"), labeller),)

    return annotate(pages, "html", begin, "text string")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("row.page_id", "row.url", "text",
                                 F.length("text").cast("long").alias("n_chars"))
