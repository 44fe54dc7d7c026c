"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text without a block-level tag inside. Scripts, styles, the
head, form controls and comments of the markup are no text. Each block becomes a vector of its hashed
tag path (tags with their class and id words), its hashed words and a few measures (length, share of
linked text, place in the page). Every word of the block and every element of the path counts: sums of
words are scaled to a common length, so that a repeated word does not outgrow the rest; elements weigh
less the more different ones lie below them, and a repeated element (nested lists) weighs a little more.
A bidirectional LSTM in numpy reads the vectors of a whole page and gives every block the probability of
being main text, so a block is judged within its document.

The network is fitted on a bounded sample of about `SAMPLE` pages. Its labels are weak: the innermost
ancestor that names a role (`MAIN` or `BOILER` words, as tag, class or id) decides, blocks without such
an ancestor are not used. Each page also appears `DRESSED` times in other clothes: the same texts under
other tags and classes, some of them deeply nested, with notices, forms, side bars and reader comments
between them, and with part of the paths and measures blanked, so that it also learns from words,
lengths and neighbours.

Pages are parsed and labelled where they are read; whole pages go in, nothing is shuffled.

Defined results: a null page or one without main text gives the empty string and 0 characters; unknown
character references stay as they are; unclosed tags end with their parent or the page; repeated pages
are treated alike; an empty table gives no row; other columns are passed on, those named like a result
are replaced.
"""

from __future__ import annotations

import html as markup
import re
import zlib
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stemma.llm.tables import collected, sampled, small_batches

SAMPLE, DRESSED, EPOCHS = 200, 2, 8
PATH_DIMS, WORD_DIMS, MEASURES = 96, 24, 8
DIMS = PATH_DIMS + WORD_DIMS + MEASURES
HIDDEN = 16
GROUP = 256

# Tags that end a block; tags whose content is no text; tags without content.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_SILENT = frozenset("script style noscript template iframe svg math object canvas audio video select button textarea datalist head title".split())
_RAW = frozenset("script style textarea title noscript iframe template".split())
_VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
# Words that name the role of an element, as tag, class or id.
MAIN = frozenset("article main content post entry story blogpost articlebody articletext maintext bodytext prose hentry".split())
BOILER = frozenset(
    "nav navbar navigation menu menus header masthead topbar footer foot sidebar aside widget ad ads advert adverts advertisement adslot banner sponsor "
    "sponsored promo promotion cookie cookies consent notice notices alert popup modal gdpr form search login signup subscribe newsletter comment comments "
    "commentlist disqus reply replies respond related recommended share sharing social breadcrumb breadcrumbs pagination pager toolbar legal copyright".split()
)
_DRESS_MAIN = ["article", "main", "div.content", "div.post", "div.entry", "section.story", "div.article-body", "div#content", "div.main-content", "div.text", "div"]
_DRESS_BOILER = [
    "nav", "div.menu", "ul.navigation", "div#nav", "footer", "div.footer", "div#footer", "header", "div.header", "aside", "div.sidebar", "div#sidebar", "div.widget",
    "div.ad", "div.advert", "div.banner", "section.sponsored", "div.cookie-notice", "div.notice", "div.consent", "div.popup", "form", "div.form", "div.newsletter",
    "section.comments", "div#comments", "div.comment", "ol.commentlist", "div.related", "div.share", "div.social", "div.breadcrumbs", "div.pagination", "div.legal",
]

_DRESS_WRAPS = ["div", "div", "div.row", "div.col", "div.inner", "div.box", "div.block", "div.wrap", "section", "div.grid", "div.container", "div.layer", "div.cell", "div.panel"]

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"<]*\"|'[^'<]*'|[^>])*?)(?:>|\Z)|[^<]+|<", re.S)
_ROLE = re.compile(r"(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPLIT = re.compile(r"[^a-z]+")


class Block(NamedTuple):
    path: tuple[str, ...]  # elements as tag.word.word, outermost first
    text: str
    linked: float


@lru_cache(maxsize=20_000)
def _element(tag: str, attributes: str) -> str:
    names = [w for m in _ROLE.finditer(attributes) for w in _SPLIT.split((m[1] or m[2] or m[3] or "").lower()) if w]
    return ".".join([tag, *names])


@lru_cache(maxsize=100)
def _closing(tag: str):
    return re.compile(rf"</{tag}\b", re.I)


def parse(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    text: list[str] = []
    linked, in_link, silent = 0, False, 0

    def flush():
        nonlocal linked, in_link
        whole = " ".join("".join(text).split())
        if whole:
            out.append(Block(tuple(e for _, e in stack), whole, min(1.0, linked / len(whole))))
        text.clear()
        linked, in_link = 0, False

    def pop(n: int):
        nonlocal silent
        silent -= sum(t in _SILENT for t, _ in stack[n:])
        del stack[n:]

    page, at = page or "", 0
    while at < len(page):
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[0] == "<" and piece != "<" or silent:
                continue
            piece = markup.unescape(piece) if "&" in piece else piece
            text.append(piece)
            if in_link:
                linked += len(piece)
            continue
        tag = tag.lower()
        if tag == "br":
            text.append(" ")
        elif m[1]:
            if tag == "a":
                in_link = False
            elif tag in _BLOCK or tag in _SILENT:
                open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
                if tag in _BLOCK:
                    flush()
                if open_at is not None:
                    pop(open_at)
        elif tag == "a":
            in_link = True
        elif tag in _VOID or m[3].endswith("/"):
            if tag in _BLOCK:
                flush()
        elif tag in _RAW:
            end = _closing(tag).search(page, at)
            at = end.start() if end else len(page)
            if tag in _BLOCK:
                flush()
        elif tag in _BLOCK or tag in _SILENT:
            if tag in _BLOCK:
                flush()
                while stack and (stack[-1][0] == "p" or (tag in ("li", "dt", "dd", "tr", "td", "th") and stack[-1][0] == tag)):
                    pop(len(stack) - 1)
            stack.append((tag, _element(tag, m[3])))
            silent += tag in _SILENT
    flush()
    return out


def weak_label(path: tuple[str, ...]) -> int:
    """1 main, 0 not, -1 unknown, by the innermost element that names a role."""
    for element in reversed(path):
        words = element.split(".")
        if any(w in BOILER for w in words) and not (words[0] == "header" and len(words) == 1 and any(e.split(".")[0] == "article" for e in path)):
            return 0
        if any(w in MAIN for w in words):
            return 1
    return -1


def _hashed(word: str, dims: int) -> tuple[tuple[int, float], ...]:
    h = zlib.crc32(word.encode("utf-8", "replace"))
    return ((h % dims, 1.0 if h & 0x10000 else -1.0), ((h >> 18) % dims, 1.0 if h & 0x20000 else -1.0))


@lru_cache(maxsize=50_000)
def _coded(word: str) -> int:
    """Both places of a word and their signs as one number, each place as one of 2 * WORD_DIMS."""
    a, b = (i + WORD_DIMS * (sign < 0) for i, sign in _hashed(word, WORD_DIMS))
    return a * 2 * WORD_DIMS + b


@lru_cache(maxsize=20_000)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    """All words of all elements; the innermost place of a word decides its weight, repeats add to it."""
    rank: dict[str, int] = {}
    times: dict[str, int] = {}
    for depth, element in enumerate(dict.fromkeys(reversed(path))):
        for word in set(element.split(".")):
            rank.setdefault(word, depth)
    for element in path:
        for word in set(element.split(".")):
            times[word] = times.get(word, 0) + 1
    v = np.zeros(PATH_DIMS, np.float32)
    for word, depth in rank.items():
        for i, sign in _hashed(word, PATH_DIMS):
            v[i] += sign * (1 + 0.25 * np.log(times[word])) / np.sqrt(1 + 0.3 * depth)
    return v


def vectors(blocks: list[Block]) -> np.ndarray:
    """One row per block."""
    out = np.zeros((len(blocks), DIMS), np.float32)
    for i, b in enumerate(blocks):
        out[i, :PATH_DIMS] = _path_vector(b.path)
        words = b.text.split()
        codes = np.fromiter(map(_coded, b.text.lower().split()), np.int64)
        n = np.bincount(codes // (2 * WORD_DIMS), minlength=2 * WORD_DIMS) + np.bincount(codes % (2 * WORD_DIMS), minlength=2 * WORD_DIMS)
        v = n[:WORD_DIMS] - n[WORD_DIMS:]
        out[i, PATH_DIMS : PATH_DIMS + WORD_DIMS] = v / max(4.0, np.sqrt(v @ v))
        last = b.path[-1].split(".")[0] if b.path else ""
        out[i, -MEASURES:] = (
            np.log1p(len(words)) / 3, b.linked, b.text[-1] in ".!?…", sum(map(b.text.count, ".,;")) / (1 + len(words)),
            i / len(blocks), 1 - i / len(blocks), last[:1] == "h" and last[1:].isdigit(), last == "li",
        )
    return out


class Labeller:
    """Bidirectional LSTM with a logistic output per block."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        w = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p |= {f"x{d}": w(DIMS, 4 * HIDDEN), f"h{d}": w(HIDDEN, 4 * HIDDEN), f"b{d}": np.zeros(4 * HIDDEN, np.float32)}
            self.p[f"b{d}"][HIDDEN : 2 * HIDDEN] = 1
        self.p |= {"o": w(2 * HIDDEN, 1)[:, 0], "c": np.zeros(1, np.float32)}

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str):
        """Hidden states over (page, block) and what the way back needs."""
        n, t, _ = x.shape
        z = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((n, HIDDEN), np.float32)
        states, saved = np.zeros((n, t, HIDDEN), np.float32), []
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[:, k] + h @ self.p[f"h{d}"]
            i, f, o = (1 / (1 + np.exp(-np.clip(g[:, j * HIDDEN : (j + 1) * HIDDEN], -30, 30))) for j in range(3))
            u = np.tanh(g[:, 3 * HIDDEN :])
            m = mask[:, k : k + 1]
            c_new = f * c + i * u
            tc = np.tanh(c_new)
            saved.append((k, h, c, i, f, o, u, tc, m))
            c = m * c_new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            states[:, k] = h
        return states, saved

    def forward(self, x: np.ndarray, mask: np.ndarray):
        (hf, sf), (hb, sb) = self._run(x, mask, "f"), self._run(x, mask, "b")
        both = np.concatenate([hf, hb], 2)
        return 1 / (1 + np.exp(-np.clip(both @ self.p["o"] + self.p["c"], -30, 30))), both, sf, sb

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, used: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean logistic loss over the used blocks."""
        p, both, sf, sb = self.forward(x, mask)
        dz = (p - y) * used / max(1.0, used.sum())
        grad = {"o": np.einsum("ntk,nt->k", both, dz), "c": np.array([dz.sum()], np.float32)}
        dh_all = dz[:, :, None] * self.p["o"]
        for d, saved, part in (("f", sf, dh_all[:, :, :HIDDEN]), ("b", sb, dh_all[:, :, HIDDEN:])):
            dg_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), np.float32)
            gh = np.zeros_like(self.p[f"h{d}"])
            for k, h, c, i, f, o, u, tc, m in reversed(saved):
                dh = dh + part[:, k]
                inner = m * dh
                dcn = m * dc + inner * o * (1 - tc * tc)
                dg = np.concatenate([dcn * u * i * (1 - i), dcn * c * f * (1 - f), inner * tc * o * (1 - o), dcn * i * (1 - u * u)], 1)
                dg_all[:, k] = dg
                gh += h.T @ dg
                dh = (1 - m) * dh + dg @ self.p[f"h{d}"].T
                dc = (1 - m) * dc + dcn * f
            grad |= {f"h{d}": gh, f"x{d}": np.einsum("ntd,ntg->dg", x, dg_all, optimize=True), f"b{d}": dg_all.sum((0, 1))}
        return grad

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability of main text for each block of each page."""
        out: list[np.ndarray] = [np.empty(0)] * len(pages)
        order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
        at = 0
        while at < len(order):
            group = [order[at]]
            while len(group) < GROUP and at + len(group) < len(order) and len(pages[order[at + len(group)]]) * (len(group) + 1) <= 8192:
                group.append(order[at + len(group)])
            at += len(group)
            x, mask = _padded([vectors(pages[i]) for i in group])
            p = self.forward(x, mask)[0]
            for row, i in enumerate(group):
                out[i] = p[row, : len(pages[i])]
        return out


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    t = max(map(len, rows))
    x, mask = np.zeros((len(rows), t, DIMS), np.float32), np.zeros((len(rows), t), np.float32)
    for i, r in enumerate(rows):
        x[i, : len(r)], mask[i, : len(r)] = r, 1
    return x, mask


def _dress(blocks: list[Block], labels: list[int], pool: list[str], rng) -> tuple[list[Block], list[int]]:
    """The same texts under other tags, with boilerplate of other pages put around and between them."""
    pick = lambda options: options[int(rng.integers(len(options)))]
    outer = ("html", "body") + (("div",) if rng.random() < 0.5 else ()) + (("div.wrap",) if rng.random() < 0.3 else ())
    wraps = lambda: tuple(pick(_DRESS_WRAPS) for _ in range(int(rng.integers(4, 16)))) if rng.random() < 0.15 else ()
    inside = outer + (pick(_DRESS_MAIN),) + (("section",) if rng.random() < 0.2 else ()) + wraps()
    out: list[tuple[Block, int]] = []

    def boiler(texts: list[str], nested: bool):
        role = pick(_DRESS_BOILER)
        leaf = pick([(), ("p",), ("p",), ("ul", "li"), ("div",), ("div", "p"), ("h3",)])
        if rng.random() < 0.15:
            leaf = ("ol", "li") * int(rng.integers(2, 10)) + leaf if rng.random() < 0.5 else wraps() + leaf
        linked = float(rng.random() < (0.8 if "li" in leaf else 0.15))
        out.extend((Block((inside if nested else outer) + (role,) + leaf, t, linked), 0) for t in texts)

    run: list[str] = []
    for b, y in zip(blocks, labels):
        if y == 1:
            if run:
                boiler(run, False)
                run = []
            leaf = "h1" if b.path and b.path[-1][:1] == "h" else pick(["p"] * 8 + ["blockquote", "li", "h2", "div"])
            out.append((Block(inside + (leaf,), b.text, 0.0), 1))
            if rng.random() < 0.08:
                boiler([pick(pool) for _ in range(1 + int(rng.integers(3)))], True)
        elif y == 0:
            run.append(b.text)
    if rng.random() < 0.5:
        boiler([pick(pool) for _ in range(1 + int(rng.integers(6)))], rng.random() < 0.3)
    if run:
        boiler(run, False)
    if rng.random() < 0.3:
        boiler([pick(pool) for _ in range(1 + int(rng.integers(4)))], False)
    return [b for b, _ in out], [y for _, y in out]


def fit_labeller(pages: list[str], seed: int = 0) -> Labeller:
    """Learns from pages with weak labels and from the same pages dressed anew."""
    rng = np.random.default_rng(seed)
    known = [(b, y) for b in map(parse, pages) if b and 1 in (y := [weak_label(x.path) for x in b])]
    if not known:  # without any sample: plain paragraphs and short links
        words = "the of and to in a is that for it was on are as with his they at be this".split()
        say = lambda n: " ".join(words[int(i)] for i in rng.integers(len(words), size=n))
        known = [
            ([Block(("html", "body", "nav", "ul", "li"), say(2), 1.0)] * 4 + [Block(("html", "body", "article", "p"), say(40) + ".", 0.0)] * 5 + [Block(("html", "body", "footer"), say(6), 0.0)], [0] * 4 + [1] * 5 + [0])
            for _ in range(50)
        ]
    pool = [x.text for b, _ in known for x in b]
    examples = list(known)
    for _ in range(DRESSED):
        examples += [_dress(b, y, pool, rng) for b, y in known]
    data = []
    for k, (b, y) in enumerate(examples):
        x, y = vectors(b), np.array(y)
        if k >= len(known):  # blank parts of what it could lean on
            x[rng.random(len(x)) < 0.15, :PATH_DIMS] = 0
            x[:, -MEASURES:][rng.random((len(x), MEASURES)) < 0.2] = 0
        data.append((x, y))
    model = Labeller(seed)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(len(data)), key=lambda i: len(data[i][0]) // 8)
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        for g in rng.permutation(len(groups)):
            rows = [data[i] for i in groups[g]]
            x, mask = _padded([r[0] for r in rows])
            y = np.zeros(mask.shape, np.float32)
            used = np.zeros(mask.shape, np.float32)
            for i, (_, label) in enumerate(rows):
                y[i, : len(label)], used[i, : len(label)] = label == 1, label >= 0
            grad, step = model.step(x, mask, y, used), step + 1
            for k, v in model.p.items():
                d = np.clip(grad[k], -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                v -= (0.01 if epoch < EPOCHS - 2 else 0.003) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return model


def fit(pages: DataFrame, *, key: str = "page_id", html: str = "html", seed: int = 0) -> Labeller:
    """Fits the labeller on a sample of about `SAMPLE` pages."""
    have = pages.where(F.col(html).isNotNull()).count()
    rows = collected(pages.where(F.col(html).isNotNull()).where(sampled(F.col(key), have, SAMPLE, seed)).select(F.col(html).alias("h")).limit(2 * SAMPLE))
    return fit_labeller(sorted(rows["h"]), seed)


def extract(pages: DataFrame, model: Labeller, *, html: str = "html", main_from: float = 0.5) -> DataFrame:
    """Adds text, the main text, and n_chars, its length in code points; drops the html."""
    small_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("text string, n_chars long")
    def main_text(col: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(col), GROUP):
            parsed = [parse(h) for h in col.iloc[at : at + GROUP]]
            for blocks, p in zip(parsed, sent.value.label(parsed)):
                text = "\n".join(b.text for b, q in zip(blocks, p) if q >= main_from)
                out.append((text, len(text)))
        return pd.DataFrame(out, columns=["text", "n_chars"])

    keep = [c for c in pages.columns if c not in ("text", "n_chars", "_m", html)]
    return pages.select(*keep, main_text(F.col(html)).alias("_m")).select(*keep, "_m.text", "_m.n_chars")
