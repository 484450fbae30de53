"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: runs of text that no block-level tag interrupts. Each block has features of its ancestors
(tags, words in class and id) and of its text (length, share of link text, final punctuation and the like). A chain model
with the labels main text and other, trained on labelled pages (labelled_pages) by gradient ascent on the conditional
likelihood, labels the blocks of a page together by Viterbi decoding. What is main text is written in page order.

A page is scanned once from start to end, in time linear in its length. The pages are read once and never shuffled; the model is trained on the driver from a fixed set of pages and has
fewer than a hundred weights.

Defined results: null or empty html, and html without main text, gives the empty string; unclosed and misnested tags
are closed where the next block needs it; scripts, styles, templates, titles and comments are never text and do not part
a block; what follows a tag, comment or script that is never closed is none of the page; line breaks
inside a block count as white space; elements nested more than DEPTH deep count as parts of the one that holds them; repeated rows and null ids give a row each; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.labelled_pages import labelled_pages
from lodestone.sources.tables import spread

# --- blocks -------------------------------------------------------------------------------------------------

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
#: Elements whose content is no text of the page. The first kind takes all that follows if it is never closed.
_RAW = frozenset("script style textarea title iframe".split())
_HIDDEN = frozenset("template noscript svg object select".split())
DEPTH = 256  # open elements beyond this are not told from their ancestors, as in browsers
_CLOSE = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW | _HIDDEN}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)

_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
_FENCES = frozenset("article aside body div footer form header html main nav ol section table td th ul dl".split())


class Block:
    __slots__ = ("linked", "names", "tags", "text")

    def __init__(self, text: str, linked: int, tags: tuple[str, ...], names: tuple[str, ...]) -> None:
        self.text, self.linked, self.tags, self.names = text, linked, tags, names


def leaf_blocks(html: str) -> list[Block]:
    """The blocks of a page in order, white space collapsed, without those that hold none but white space."""
    found: list[Block] = []
    stack: list[tuple[str, str]] = []  # open block-level tags and their class, id and role
    parts: list[str] = []
    state = {"link": 0, "linked": 0}
    within: list[tuple[tuple[str, ...], tuple[str, ...]]] = []  # tags and names of the stack, while it stays as it is

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                if not within:
                    within.append((tuple(t for t, _ in stack), tuple(n for _, n in stack if n)))
                found.append(Block(text, state["linked"], *within[0]))
            parts.clear()
        state["linked"] = 0

    def close(names, fences) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                del stack[k:]
                within.clear()
                return
            if stack[k][0] in fences:
                return

    def text(piece: str) -> None:
        piece = entities.unescape(piece)
        parts.append(piece)
        if state["link"]:
            state["linked"] += len(piece)

    def element(ends: bool, tag: str, attributes: str) -> None:
        if tag == "a":
            state["link"] = max(0, state["link"] + (-1 if ends else 1))
        if tag in _INLINE:
            if tag == "br":
                parts.append(" ")
            return
        flush()
        if ends:
            close({tag}, () if tag in _FENCES else _FENCES)
            state["link"] = 0 if tag in _FENCES else state["link"]
            return
        if tag in _CLOSES_P:
            close({"p"}, _FENCES)
        if tag in _SIBLINGS and tag != "p":
            close(_SIBLINGS[tag], {"ul", "ol", "dl", "table", "menu", "nav"})
        if tag not in _VOID and not attributes.endswith("/") and len(stack) < DEPTH:
            stack.append((tag, " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)).lower()))
            within.clear()

    # Each part of the page is looked at once: what is searched for in vain to the end is not searched for again.
    at, unclosed = 0, set()
    while at < len(html):
        mark = html.find("<", at)
        if mark < 0:
            text(html[at:])
            break
        if mark > at:
            text(html[at:mark])
        if html.startswith("<!--", mark):
            end = html.find("-->", mark + 4)
            at = end + 3 if end >= 0 else len(html)
            continue
        m = _TAG.match(html, mark)
        if m is None:
            name = html[mark + 1 : mark + 3].lstrip("/")[:1]
            if html[mark + 1 : mark + 2] in ("!", "?", "/") or name.isascii() and name.isalpha():
                end = html.find(">", mark)  # a declaration, or a tag whose quotes do not match
                at = end + 1 if end >= 0 else len(html)
            else:
                text("<")
                at = mark + 1
            continue
        at, tag = m.end(), m.group(2).lower()
        if tag in _CLOSE:
            if not m.group(1) and tag not in unclosed and not (tag in _HIDDEN and m.group(3).endswith("/")):
                end = _CLOSE[tag].search(html, at)
                if end:
                    at = end.end()
                elif tag in _RAW:
                    at = len(html)
                else:
                    unclosed.add(tag)
            continue
        element(bool(m.group(1)), tag, m.group(3))
    flush()
    return found


# --- features -----------------------------------------------------------------------------------------------

_TAGS = "article main section nav header footer aside form ul ol li table td h1 h2 h3 h4 p div pre blockquote figure figcaption button fieldset dialog details address".split()
_NAMES = {
    "menu": r"nav|menu|breadcrumb|pagination|toolbar|tabs",
    "header": r"header|masthead|banner|topbar|logo",
    "footer": r"footer|copyright|legal|colophon",
    "side": r"side|aside|related|widget|recommend|trending|popular|tags",
    "advert": r"\bads?\b|\bads?[-_]|[-_]ads?\b|advert|sponsor|promo|adslot|doubleclick",
    "notice": r"notice|cookie|consent|gdpr|alert|popup|modal|overlay|newsletter|subscri|signup|login",
    "comment": r"comment|repl(?:y|ies)|discussion|disqus|respond",
    "share": r"share|social|follow|byline|author|meta",
    "body": r"content|article|post|entry|story|main|body|prose|text",
}
_NAME_RX = {k: re.compile(v) for k, v in _NAMES.items()}
_TEXT = "one few short medium long linked half_linked stop colon copyright shout bars digits".split()
FEATURES = ["bias", *(f"<{t}>" for t in _TAGS), *(f"leaf <{t}>" for t in _TAGS), *_NAMES, *_TEXT, "first", "last", "in article and plain"]
_AT = {f: k for k, f in enumerate(FEATURES)}


@lru_cache(maxsize=4096)
def _context(tags: tuple[str, ...], names: tuple[str, ...]) -> tuple[int, ...]:
    found = {_AT["bias"]} | {_AT[f"<{t}>"] for t in tags if f"<{t}>" in _AT}
    if tags and f"leaf <{tags[-1]}>" in _AT:
        found.add(_AT[f"leaf <{tags[-1]}>"])
    joined = " ".join(names)
    kinds = {k for k, rx in _NAME_RX.items() if rx.search(joined)}
    found |= {_AT[k] for k in kinds}
    boxed = {"nav", "aside", "form", "footer", "header", "dialog", "button"} & set(tags) or kinds - {"body"}
    if {"article", "main"} & set(tags) and not boxed:
        found.add(_AT["in article and plain"])
    return tuple(sorted(found))


def _features(blocks: list[Block]) -> list[list[int]]:
    rows = []
    for k, b in enumerate(blocks):
        own = list(_context(b.tags, b.names))
        t = b.text
        n = t.count(" ") + 1
        own.append(_AT["one" if n < 2 else "few" if n < 5 else "short" if n < 15 else "medium" if n < 40 else "long"])
        if b.linked > 0.9 * len(t):
            own.append(_AT["linked"])
        elif b.linked > 0.4 * len(t):
            own.append(_AT["half_linked"])
        if t[-1] in ".!?…":
            own.append(_AT["stop"])
        if t[-1] == ":":
            own.append(_AT["colon"])
        if "©" in t[:40]:
            own.append(_AT["copyright"])
        if t.isupper():
            own.append(_AT["shout"])
        if " | " in t:
            own.append(_AT["bars"])
        if t.isdigit():
            own.append(_AT["digits"])
        if k == 0:
            own.append(_AT["first"])
        if k == len(blocks) - 1:
            own.append(_AT["last"])
        rows.append(own)
    return rows


# --- model --------------------------------------------------------------------------------------------------


class Chain:
    """Linear-chain conditional random field with two labels: 0 other, 1 main text."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray) -> None:
        self.weights, self.steps = weights, steps  # of feature and label; of label and next label

    def decode(self, rows: list[list[int]]) -> list[int]:
        """The likeliest labels of a page together (Viterbi)."""
        if not rows:
            return []
        w = self.weights
        (s00, s01), (s10, s11) = self.steps.tolist()
        own = [w[r].sum(axis=0).tolist() for r in rows]
        a, b = own[0]
        back = []
        for x, y in own[1:]:
            from0, from1 = a + s00 >= b + s10, a + s01 >= b + s11
            back.append((0 if from0 else 1, 0 if from1 else 1))
            a, b = max(a + s00, b + s10) + x, max(a + s01, b + s11) + y
        label = 0 if a >= b else 1
        labels = [label]
        for step in reversed(back):
            label = step[label]
            labels.append(label)
        return labels[::-1]


def train(pages: list[tuple[str, list[int]]], rounds: int = 150, l2: float = 0.02, rate: float = 0.15) -> Chain:
    """Gradient ascent (Adam) on the conditional log-likelihood, forward-backward over all pages at once."""
    data = [(_features(b), y) for b, y in ((leaf_blocks(h), y) for h, y in pages) if b]
    if any(len(x) != len(y) for x, y in data):
        raise ValueError("labels do not match blocks")
    n, most = len(data), max(len(y) for _, y in data)
    x = np.zeros((n, most, len(FEATURES)))
    y = np.zeros((n, most), np.int64)
    live = np.zeros((n, most), bool)
    for i, (rows, own) in enumerate(data):
        for t, r in enumerate(rows):
            x[i, t, r] = 1
        y[i, : len(own)], live[i, : len(own)] = own, True
    pairs = live[:, 1:]
    seen_w = np.einsum("ntf,ntl->fl", x, np.eye(2)[y] * live[..., None])
    seen_s = np.zeros((2, 2))
    np.add.at(seen_s, (y[:, :-1][pairs], y[:, 1:][pairs]), 1)
    theta = np.zeros(2 * len(FEATURES) + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda z, axis: np.logaddexp.reduce(z, axis=axis)
    for k in range(1, rounds + 1):
        w, s = theta[:-4].reshape(-1, 2), theta[-4:].reshape(2, 2)
        u = x @ w
        forward, backward = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        forward[0] = u[:, 0]
        for t in range(1, most):
            forward[t] = np.where(live[:, t, None], lse(forward[t - 1][:, :, None] + s, 1) + u[:, t], forward[t - 1])
        for t in range(most - 2, -1, -1):
            backward[t] = np.where(live[:, t + 1, None], lse(s + (u[:, t + 1] + backward[t + 1])[:, None, :], 2), 0)
        z = lse(forward[-1], 1)
        node = np.exp(np.transpose(forward + backward, (1, 0, 2)) - z[:, None, None]) * live[..., None]
        edge = np.zeros((2, 2))
        for t in range(most - 1):
            p = np.exp(forward[t][:, :, None] + s + (u[:, t + 1] + backward[t + 1])[:, None, :] - z[:, None, None])
            edge += (p * pairs[:, t, None, None]).sum(axis=0)
        grad = np.concatenate([(seen_w - np.einsum("ntf,ntl->fl", x, node)).ravel(), (seen_s - edge).ravel()]) / n - l2 / 10 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(theta[:-4].reshape(-1, 2).copy(), theta[-4:].reshape(2, 2).copy())


def main_text(html: str | None, chain: Chain) -> str:
    blocks = leaf_blocks(html or "")
    return "\n".join(b.text for b, label in zip(blocks, chain.decode(_features(blocks)), strict=True) if label)


# --- query --------------------------------------------------------------------------------------------------


def _extractor(chain: Chain):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                own = batch.slice(k, 200)
                texts = [main_text(h.as_py(), chain) for h in own.column(2)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    chain = chain or train(labelled_pages())
    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).transform(spread).mapInArrow(_extractor(chain), "page_id long, url string, text string, n_chars long")


def op9_html(pages: DataFrame) -> DataFrame:
    return extract(pages)
